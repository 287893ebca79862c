"""A small map server over a folder of web tiles and one GeoJSON document."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from terrapane.sources import files

TILE = re.compile(r"/tiles/([0-9]{1,2})/([0-9]{1,9})/([0-9]{1,9})\.(png|jpe?g)")
KINDS = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
MAX_ZOOM = 15

PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Embedding tiles</title>
<link rel="stylesheet" href="https://unpkg.com/leaflet@1.9.4/dist/leaflet.css">
<script src="https://unpkg.com/leaflet@1.9.4/dist/leaflet.js"></script>
<style>html, body, #map {{ height: 100%; margin: 0 }} #bar {{ position: fixed; bottom: 1em; left: 1em; z-index: 1000; background: white; padding: 0.5em }}</style></head>
<body><div id="map"></div><label id="bar">Opacity <input id="opacity" type="range" min="0" max="100" value="70"></label><script>
const map = L.map("map").fitBounds({bounds});
const ground = L.tileLayer("https://tile.openstreetmap.org/{{z}}/{{x}}/{{y}}.png", {{attribution: "OpenStreetMap"}}).addTo(map);
const image = L.tileLayer("/tiles/{{z}}/{{x}}/{{y}}.png", {{opacity: 0.7, maxNativeZoom: {zoom}}}).addTo(map);
const shapes = L.layerGroup().addTo(map);
L.control.layers({{"Map": ground}}, {{"Embeddings": image, "Regions": shapes}}).addTo(map);
document.getElementById("opacity").addEventListener("input", e => image.setOpacity(e.target.value / 100));
const rows = p => Object.entries(p || {{}}).map(([k, v]) => {{ const d = document.createElement("div"); d.textContent = k + ": " + v; return d.outerHTML; }}).join("");
fetch("/geojson").then(r => r.json()).then(g => L.geoJSON(g, {{onEachFeature: (f, l) => l.bindPopup(rows(f.properties))}}).addTo(shapes));
</script></body></html>"""


def bounds_of(geojson: dict) -> list[list[float]]:
    """[[south, west], [north, east]] of all coordinates; the world if there are none."""
    xs, ys = [], []

    def walk(v) -> None:
        if isinstance(v, list):
            if len(v) >= 2 and all(isinstance(x, (int, float)) for x in v[:2]):
                xs.append(v[0])
                ys.append(v[1])
            else:
                for x in v:
                    walk(x)
        elif isinstance(v, dict):
            for k in ("features", "geometry", "geometries", "coordinates"):
                walk(v.get(k))

    walk(geojson)
    return [[min(ys), min(xs)], [max(ys), max(xs)]] if xs else [[-90, -180], [90, 180]]


def handler(geojson: dict, tiles: str) -> type[BaseHTTPRequestHandler]:
    """A request handler over shared, read-only state."""
    page = PAGE.format(bounds=json.dumps(bounds_of(geojson)), zoom=MAX_ZOOM).encode()
    document = json.dumps(geojson).encode()

    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, kind: str, body: bytes, **headers: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            path = self.path.split("?", 1)[0]
            if path == "/":
                self.answer(200, "text/html; charset=utf-8", page)
            elif path == "/geojson":
                self.answer(200, "application/json", document, Access_Control_Allow_Origin="*")
            elif m := TILE.fullmatch(path):
                # numbers alone reach the file system
                try:
                    with files.opened(f"{tiles}/{m[1]}/{m[2]}/{m[3]}.{m[4]}") as f:
                        self.answer(200, KINDS[m[4]], f.read(), Cache_Control="max-age=86400")
                except FileNotFoundError:
                    self.answer(404, "text/plain", b"no such tile")
                except OSError:
                    self.answer(500, "text/plain", b"the tile can't be read")
            else:
                self.answer(404, "text/plain", b"not found")

        def log_message(self, *_) -> None:
            pass

    return Handler


def server(geojson: dict, tiles: str, port: int = 8000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    return ThreadingHTTPServer((host, port), handler(geojson, tiles))
