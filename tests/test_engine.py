"""Whole pipelines over a small root folder, against numpy."""

import hashlib
import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest

from terrapane import cli
from terrapane.engine import Engine
from terrapane.operators import catalog, registry
from terrapane.serve import server
from terrapane.sources import geotiff, npy, png
from terrapane.streaming import ingest

H = W = 10
TILES = [(5.05, 50.05), (5.15, 50.05), (5.05, 50.15)]  # lon, lat


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("root")
    rng = np.random.default_rng(7)
    for year in (2023, 2024):
        for lon, lat in TILES:
            name = f"grid_{lon:.2f}_{lat:.2f}"
            d = base / registry.EMBEDDINGS / str(year) / name
            d.mkdir(parents=True)
            (d / f"{name}.npy").write_bytes(npy.encode(rng.integers(-100, 100, (H, W, 6)).astype(np.int8)))
            (d / f"{name}_scales.npy").write_bytes(npy.encode((rng.integers(1, 5, (H, W)) / 4).astype(np.float32)))
    masks = base / registry.MASKS
    masks.mkdir()
    for lon, lat in TILES:
        t = geotiff.from_bounds(lon, lat, lon + 0.1, lat + 0.1, W, H)
        (masks / f"grid_{lon:.2f}_{lat:.2f}.tiff").write_bytes(geotiff.encode((np.add.outer(range(H), range(W)) % 2).astype(np.uint8), t, "EPSG:4326"))
    (base / "registry").mkdir()
    registry.update(spark, str(base))
    return base


def raw(root, lon, lat, year=2024):
    name = f"grid_{lon:.2f}_{lat:.2f}"
    d = root / registry.EMBEDDINGS / str(year) / name
    return npy.decode((d / f"{name}.npy").read_bytes()).astype(np.float32) * npy.decode((d / f"{name}_scales.npy").read_bytes())[:, :, None]


def test_registry_files(root):
    names = sorted(p.name for p in (root / "registry").iterdir() if not p.name.startswith("."))
    assert names == ["registry.txt", "registry_2023_lon5_lat50.txt", "registry_2024_lon5_lat50.txt", "registry_index.txt", "registry_tiles_lon5_lat50.txt", "tiles_registry_index.txt"]
    lines = (root / "registry" / "registry_2024_lon5_lat50.txt").read_text().splitlines()
    assert lines == sorted(lines) and len(lines) == 6
    for x in lines:
        path, h = x.split(" ")
        assert h == hashlib.sha256((root / registry.EMBEDDINGS / path).read_bytes()).hexdigest()
    master = dict(x.split(" ") for x in (root / "registry" / "registry.txt").read_text().splitlines())
    assert set(master) == {n for n in names if "lon" in n}
    assert all(h == hashlib.sha256((root / "registry" / n).read_bytes()).hexdigest() for n, h in master.items())


def test_catalogue(spark, root, capsys):
    e = Engine(spark, str(root))
    assert e.count_embeddings() == 6 and e.years() == [2023, 2024] and e.landmasks().count() == 3
    rows = [tuple(r) for r in e.list_embeddings(4).collect()]
    assert [r[:3] for r in rows] == sorted((y, round(b * 100), round(a * 100)) for y in (2023, 2024) for a, b in TILES)[:4] and rows[0][3] == 2
    assert len(e.list_embeddings(0).collect()) == 6 and e.needs_fetch(str(root / registry.EMBEDDINGS)).isEmpty()
    with pytest.raises(ValueError):
        e.list_embeddings(-1)
    assert cli.main(["--root", str(root), "list-embeddings", "--limit", "1"]) == 0
    assert "... and 5 more" in capsys.readouterr().out
    assert cli.main(["--root", str(root), "info"]) == 0 and cli.main(["--root", str(root), "list"]) == 0
    assert "tiles 6, places 3, land masks 3, years 2023, 2024" in capsys.readouterr().out


def test_update_reads_new_files_only(spark, root, tmp_path):
    import shutil

    shutil.copytree(root, tmp_path / "r")
    base = tmp_path / "r"
    file = base / registry.EMBEDDINGS / "2024/grid_5.05_50.05/grid_5.05_50.05.npy"
    file.write_bytes(npy.encode(np.zeros((2, 2, 6), np.int8)))
    assert {r["status"] for r in registry.update_embeddings(spark, str(base)).collect()} <= {"same", "kept"}
    changed = [r["path"] for r in registry.update_embeddings(spark, str(base), force=True).collect() if r["status"] == "changed"]
    assert changed == ["2024/grid_5.05_50.05/grid_5.05_50.05.npy"]
    file.unlink()
    assert "2024/grid_5.05_50.05/grid_5.05_50.05.npy" not in {r["path"] for r in registry.update_embeddings(spark, str(base), prune=True).collect()}


def test_update_opens_new_files_only(spark, root, tmp_path):
    """A known file that can't be opened doesn't matter; a new one is hashed in as many tasks as asked for."""
    import shutil

    shutil.copytree(root, tmp_path / "r")
    base = tmp_path / "r"
    folder = base / registry.EMBEDDINGS / "2024/grid_5.05_50.05"
    (folder / "grid_5.05_50.05.npy").write_bytes(b"changed")
    (folder / "other.npy").write_bytes(b"new")
    got = {r["path"]: (r["status"], r["hash"]) for r in registry.update_embeddings(spark, str(base), prune=True, workers=2).collect()}
    assert got["2024/grid_5.05_50.05/other.npy"] == ("new", hashlib.sha256(b"new").hexdigest())
    assert {s for s, _ in got.values()} == {"same", "new"} and hashlib.sha256(b"changed").hexdigest() not in {h for _, h in got.values()}
    found = registry.files(spark, str(base / registry.EMBEDDINGS), "*.npy", content=True, workers=3)
    assert found.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="not what the registry says"):
        Engine(spark, str(base)).embedding(50.05, 5.05).collect()


def test_repeated_lines(spark, tmp_path):
    (tmp_path / "registry_2024_lon5_lat50.txt").write_text("a.npy ffff\n# a.npy 0\n\na.npy 1111\nb.npy 2 2\nc.npy\n")
    (tmp_path / "registry.txt").write_text("m ffff\nm 1111\n")
    got = registry.known(spark, str(tmp_path), "registry_[0-9]*_lon*_lat*.txt").collect()
    assert sorted(map(tuple, got)) == [("a.npy", "1111"), ("b.npy", "2 2")]
    assert [tuple(r) for r in catalog.read_master(spark, str(tmp_path)).collect()] == [("m", "ffff")]


def test_entries_in_one_file(spark, root, tmp_path):
    assert cli.main(["--root", str(root), "update", "--workers", "2", "--entries", f"{tmp_path}/all.txt"]) == 0
    names = sorted(p for p in (root / "registry").iterdir() if "_lon" in p.name and not p.name.startswith("."))
    assert (tmp_path / "all.txt").read_text().splitlines() == [x for p in names for x in p.read_text().splitlines()]


def test_point_fetch(spark, root):
    e = Engine(spark, str(root))
    got = e.embedding(50.05, 5.15)
    a = np.zeros((H, W, 6), np.float32)
    for r in got.collect():
        a[r["py"], r["px"]] = r["embedding"]
    assert np.array_equal(a, raw(root, 5.15, 50.05))
    assert e.embedding(50.09, 5.18, bands=[3], snap=True).count() == H * W
    with pytest.raises(LookupError):
        e.embedding(10.0, 10.0)


def norm(a):
    lo, hi = a.min((0, 1)), a.max((0, 1))
    return (a.astype(np.float64) - lo) / (hi.astype(np.float64) - lo)


def test_tile_export(spark, root, tmp_path):
    Engine(spark, str(root)).export_tile(50.05, 5.05, f"{tmp_path}/t.tiff", bands=[4, 0, 2])
    a, m = geotiff.decode((tmp_path / "t.tiff").read_bytes())
    want = (norm(raw(root, 5.05, 50.05)[:, :, [4, 0, 2]]) * 255).astype(int)
    assert np.array_equal(a, want) and m.crs == "EPSG:4326" and np.allclose(m.bounds, (5.05, 50.05, 5.15, 50.15))
    with pytest.raises(ValueError):
        Engine(spark, str(root)).export_tile(50.05, 5.05, f"{tmp_path}/t.tiff", bands=[1, 2])


@pytest.fixture
def region(tmp_path):
    path = tmp_path / "region.geojson"
    path.write_text(json.dumps({"type": "Feature", "properties": {"name": "<b>x</b>"}, "geometry": {"type": "Polygon", "coordinates": [[[5.06, 50.06], [5.24, 50.06], [5.06, 50.24], [5.06, 50.06]]]}}))
    return path


def test_polygon_image(spark, root, region, tmp_path):
    e = Engine(spark, str(root))
    e.region_image(str(region), f"{tmp_path}/r.tiff", bands=[1, 2, 3])
    a, m = geotiff.decode((tmp_path / "r.tiff").read_bytes())
    want = np.zeros_like(a, dtype=int)
    for lon, lat in sorted(TILES, key=lambda t: t[::-1]):
        y, x = int((50.25 - lat - 0.1) * 100), int((lon - 5.05) * 100)
        part = (norm(raw(root, lon, lat)[:, :, [1, 2, 3]]) * 255).astype(int)
        y = min(y, a.shape[0])
        want[y : y + H, x : x + W] = part[: a.shape[0] - y, : a.shape[1] - x]
    assert np.array_equal(a, want) and a.shape[0] in (19, 20) and a.shape[1] in (19, 20)


def test_region_mosaic(spark, root, tmp_path):
    e = Engine(spark, str(root))
    e.region_mosaic((5.06, 50.06, 5.24, 50.24), f"{tmp_path}/m.tiff", bands=[0, 1, 2])
    a, m = geotiff.decode((tmp_path / "m.tiff").read_bytes())
    assert a.shape == (20, 20, 3) and np.allclose(m.bounds, (5.05, 50.05, 5.25, 50.25))
    whole = np.zeros((20, 20, 3))
    for lon, lat in TILES:
        y, x = round((50.15 - lat) * 100), round((lon - 5.05) * 100)
        whole[y : y + H, x : x + W] = raw(root, lon, lat)[:, :, :3]
    for k in range(3):
        b = whole[:, :, k]
        lo, hi = b[b != 0].min(), b[b != 0].max()
        want = np.where(b != 0, (b - lo) / (hi - lo), 0) * 255
        assert np.abs(a[:, :, k] - want).max() <= 1.01
    e.region_mosaic((5.06, 50.06, 5.24, 50.24), f"{tmp_path}/u.tiff", target_crs="EPSG:32631", bands=[0, 1, 2])
    a, m = geotiff.decode((tmp_path / "u.tiff").read_bytes())
    assert m.crs == "EPSG:32631" and a.any() and abs(m.transform[0] - 900) < 250
    with pytest.raises(ValueError):
        e.region_mosaic((5, 50, 6, 51), "x.tiff", bands=[1])
    with pytest.raises(LookupError):
        e.region_mosaic((80, 10, 81, 11), "x.tiff")


def test_masks(spark, root, tmp_path):
    Engine(spark, str(root)).landmask_mosaic((5.06, 50.06, 5.24, 50.24), f"{tmp_path}/l.tiff")
    a, _ = geotiff.decode((tmp_path / "l.tiff").read_bytes())
    assert a.shape == (20, 20, 1) and set(np.unique(a)) == {0, 255} and np.array_equal(a[:10, :10, 0], np.add.outer(range(H), range(W)) % 2 * 255)


def test_web_tiles_and_server(spark, root, region, tmp_path):
    e = Engine(spark, str(root))
    e.region_mosaic((5.06, 50.06, 5.24, 50.24), f"{tmp_path}/m.tiff", bands=[0, 1, 2])
    n = e.web_tiles(f"{tmp_path}/m.tiff", f"{tmp_path}/tiles", [1, 7, 8])
    assert n >= 3 and e.web_tiles(f"{tmp_path}/m.tiff", f"{tmp_path}/tiles", [1], overwrite=False) == 0
    made = sorted(p.relative_to(tmp_path / "tiles") for p in (tmp_path / "tiles").rglob("*.png"))
    assert png.decode((tmp_path / "tiles" / made[0]).read_bytes()).shape == (256, 256, 4)
    e.coverage_map(f"{tmp_path}/map.png")
    assert (png.decode((tmp_path / "map.png").read_bytes())[:, :, [0, 2]] == (200, 40)).all(2).any()
    data = (tmp_path / "map.png").read_bytes()
    assert b"Title\0Coverage: 3 places" in data and b" UTC" in data
    doc = json.loads(region.read_text())
    with server(doc, f"{tmp_path}/tiles", 0) as http:
        threading.Thread(target=http.serve_forever, daemon=True).start()
        get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{http.server_address[1]}{p}")
        r = get("/geojson")
        assert json.load(r) == doc and r.headers["Access-Control-Allow-Origin"] == "*"
        assert b"leaflet" in get("/").read() and b"[[50.06, 5.06], [50.24, 5.24]]" in get("/").read()
        r = get(f"/tiles/{made[0]}")
        assert r.headers["Content-Type"] == "image/png" and r.headers["Cache-Control"] == "max-age=86400"
        for bad in ("/tiles/1/99/99.png", "/tiles/../m.tiff", "/other"):
            with pytest.raises(urllib.error.HTTPError):
                get(bad)
        http.shutdown()


def test_streamed_registry(spark, root, tmp_path):
    import shutil

    inbox = tmp_path / "in"
    shutil.copytree(root / registry.EMBEDDINGS / "2023", inbox / "2023")
    go = lambda: ingest.keep_registry(spark, str(inbox), f"{tmp_path}/table", f"{tmp_path}/cp").awaitTermination()
    go()
    assert ingest.current(spark, f"{tmp_path}/table").count() == 6
    shutil.copytree(root / registry.EMBEDDINGS / "2024", inbox / "2024")
    go()
    got = {r["path"]: r["hash"] for r in ingest.current(spark, f"{tmp_path}/table").collect()}
    assert len(got) == 12 and all(h == hashlib.sha256((inbox / p).read_bytes()).hexdigest() for p, h in got.items())


def test_streamed_registry_compacts(spark, tmp_path, monkeypatch):
    """Later contents win over earlier ones, across versions; merged folders go."""
    monkeypatch.setattr(ingest, "COMPACT", 2)
    inbox, table = tmp_path / "in", f"{tmp_path}/table"
    inbox.mkdir()
    for n in range(6):
        (inbox / f"f{n}.npy").write_bytes(bytes([n]))
        ingest.keep_registry(spark, str(inbox), table, f"{tmp_path}/cp").awaitTermination()
    got = {r["path"]: r["hash"] for r in ingest.current(spark, table).collect()}
    assert got == {f"f{n}.npy": hashlib.sha256(bytes([n])).hexdigest() for n in range(6)}
    assert sorted(p.name for p in (tmp_path / "table").iterdir()) == ["c4", "c5", "v3", "v5"]
    assert ingest.current(spark, table, 5).count() == 5
    (tmp_path / "table/v5/_SUCCESS").unlink()  # an unfinished version counts for nothing
    assert ingest.current(spark, table).count() == 6
    spark.createDataFrame([("f0.npy", "x")], "path string, hash string").write.parquet(f"{table}/c6")
    assert ingest.current(spark, table).where("path = 'f0.npy'").first()["hash"] == "x"
