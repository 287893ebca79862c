"""Commands over an engine: ``python -m terrapane.cli --help``."""

from __future__ import annotations

import argparse
import tempfile
import webbrowser

from terrapane import __version__
from terrapane.engine import Engine
from terrapane.operators import catalog, registry
from terrapane.serve import server
from terrapane.session import session
from terrapane.sources import files, vector


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="terrapane", description="Embedding tiles on Spark")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--root", default=".", help="folder or URI with the registry, arrays and land masks")
    p.add_argument("--master", help="Spark master")
    sub = p.add_subparsers(dest="command", required=True)

    def picture(c: argparse.ArgumentParser) -> None:
        c.add_argument("--bands", type=int, nargs=3, default=[0, 1, 2])
        c.add_argument("--year", type=int, default=2024)

    c = sub.add_parser("list-embeddings", help="tiles in order of year, latitude, longitude")
    c.add_argument("--limit", type=int, default=None, help="0 or none for all")
    sub.add_parser("info", help="numbers of tiles, years and places")
    c = sub.add_parser("map", help="a world map of coverage")
    c.add_argument("--output", default="coverage.png")
    c = sub.add_parser("visualize", help="a mosaic over a vector file's bounds")
    c.add_argument("--topojson", required=True)
    c.add_argument("--output", required=True)
    c.add_argument("--target-crs", default="EPSG:4326")
    c.add_argument("--no-normalize", action="store_true")
    c.add_argument("--clip-to-geometry", action="store_true", help="tiles that meet the polygons instead of their bounds")
    picture(c)
    c = sub.add_parser("serve", help="a web map of a vector file's region")
    c.add_argument("--geojson", required=True)
    c.add_argument("--port", type=int, default=8000)
    c.add_argument("--open", action="store_true")
    c.add_argument("--tiles-output")
    picture(c)
    for name, what in (("update", "both kinds of registry and the master"), ("update-representations", "the arrays' registries"), ("update-tiles", "the land masks' registries")):
        c = sub.add_parser(name, help=what)
        c.add_argument("--registry-dir")
        c.add_argument("--workers", type=int, help="tasks to hash files in")
        c.add_argument("--force", action="store_true")
        c.add_argument("--skip-checksum", action="store_true")
        c.add_argument("--prune", action="store_true")
        c.add_argument("--entries", help="also write all entries into this one file")
    c = sub.add_parser("list", help="registry files and their entries")
    c.add_argument("--registry-dir")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if getattr(a, "limit", None) is not None and a.limit < 0:
        p.error("--limit is negative")
    if (getattr(a, "workers", None) or 1) < 1:
        p.error("--workers is not positive")
    spark = session(master=a.master)
    engine = Engine(spark, a.root)
    if a.command == "list-embeddings":
        left = 0
        for r in engine.list_embeddings(a.limit).toLocalIterator():
            print(f"{r['year']}: {r['lat_c'] / 100:.2f}, {r['lon_c'] / 100:.2f}")
            left = r["remaining"]
        if left:
            print(f"... and {left:,} more")
    elif a.command == "info":
        tiles = engine.catalog().cache()
        print(f"tiles {tiles.count():,}, places {catalog.coverage(tiles).count():,}, land masks {engine.landmasks().count():,}, years {', '.join(map(str, engine.years()))}")
    elif a.command == "map":
        engine.coverage_map(a.output)
    elif a.command == "visualize":
        if a.clip_to_geometry:
            engine.region_image(a.topojson, a.output, a.bands, not a.no_normalize, a.year)
        else:
            engine.region_mosaic(tuple(vector.total_bounds(vector.read(spark, a.topojson)).first()), a.output, a.target_crs, a.bands, not a.no_normalize, a.year)
    elif a.command == "serve":
        if not (a.tiles_output or spark.sparkContext.master.startswith("local")):
            p.error("--tiles-output is needed off a local master: a folder that all executors and this machine see")
        with tempfile.TemporaryDirectory() as temp:
            tiles = files.qualified(spark, a.tiles_output or f"file://{temp}/tiles")
            image = f"{tiles}/mosaic.tiff"
            if not engine.has_tiles(tiles):
                engine.region_mosaic(tuple(vector.total_bounds(vector.read(spark, a.geojson)).first()), image, "EPSG:4326", a.bands, True, a.year)
                engine.web_tiles(image, tiles)
            with server(vector.read_raw(spark, a.geojson), tiles, a.port) as http:
                if a.open:
                    webbrowser.open(f"http://127.0.0.1:{a.port}/")
                http.serve_forever()
    elif a.command == "list":
        for r in registry.listing(spark, a.registry_dir or engine.registry).collect():
            print(f"{r['name']}: {r['n']:,}")
    else:
        options = {"registry": a.registry_dir, "force": a.force, "checksum": not a.skip_checksum, "prune": a.prune, "workers": a.workers}
        go = {"update": registry.update, "update-representations": registry.update_embeddings, "update-tiles": registry.update_masks}[a.command]
        print(f"{go(spark, a.root, **options).count():,} entries")
        if a.entries:
            registry.write_entries(spark, a.registry_dir or engine.registry, a.entries)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
