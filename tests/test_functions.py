import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrapane.functions import crs, geometry, grid, pixel
from terrapane.operators import mosaic, registry, reproject, spatial


def column(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_names(spark):
    rows = [(2024, -5055, -2065), (2024, 0, 5), (2017, -5, -18000), (2020, 18000, 9000), (2020, 12, -10)]
    got = column(spark, rows, "y int, x int, z int", grid.tile_name(F.col("x"), F.col("z")), grid.embedding_path(F.col("y"), F.col("x"), F.col("z")), grid.block_of(F.col("x")), grid.block_of(F.col("z")))
    for (y, x, z), (name, path, bx, bz) in zip(rows, got):
        assert name == f"grid_{x / 100:.2f}_{z / 100:.2f}" and path == f"{y}/{name}/{name}.npy"
        assert (bx, bz) == (math.floor(x / 500) * 5, math.floor(z / 500) * 5)


def test_parsing(spark):
    names = [("grid_-50.55_-20.65",), ("grid_1_2",), ("grid_1.5_2.5_tail",), ("grid_nan_1.0",), ("grid_1.0",), ("tile_1.0_2.0",), ("grid_abc_1.05",), ("",), (None,)]
    got = column(spark, names, "n string", grid.parsed_grid_name(F.col("n")), grid.split_grid_name(F.col("n")))
    prefix = [(-50.55, -20.65), None, (1.5, 2.5), None, None, None, None, None, None]
    assert [None if a is None else tuple(a) for a, _ in got] == prefix
    assert [None if b is None else tuple(b) for _, b in got[:3]] == [(-50.55, -20.65), (1.0, 2.0), None]
    assert math.isnan(got[3][1][0]) and all(b is None for _, b in got[4:])
    files = [("registry_2024_lon-55_lat0.txt",), ("registry_tiles_lon0_lat5.txt",), ("registry_index.txt",), ("registry_2024_lon1_lat2.txt.bak",)]
    assert [None if r[0] is None else tuple(r[0]) for r in column(spark, files, "n string", grid.parsed_block_file(F.col("n")))] == [(2024, -55, 0), None, None, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(-18000, 18000), st.integers(-9000, 9000)), min_size=1, max_size=50))
def test_parse_undoes_format(spark, points):
    got = column(spark, points, "x int, y int", grid.parsed_grid_name(grid.tile_name(F.col("x"), F.col("y"))))
    assert [(round(r[0][0] * 100), round(r[0][1] * 100)) for r in got] == points


def test_overlap_is_strict_and_symmetric(spark):
    boxes = [(0, 0, 10, 10), (10, 0, 20, 10), (5, 5, 8, 8), (-5, -5, 0, 0), (9, 9, 30, 30)]
    rows = [(*a, *b) for a in boxes for b in boxes]
    names = list("abcdefgh")
    got = column(spark, rows, ", ".join(f"{n} int" for n in names), grid.overlaps(*map(F.col, names)), grid.overlaps(*map(F.col, names[4:] + names[:4])))
    for r, (x, y) in zip(rows, got):
        assert x == y == (r[0] < r[6] and r[2] > r[4] and r[1] < r[7] and r[3] > r[5])


def test_pixel_values_as_numpy(spark):
    v = [0.0, 1.0, 0.5, -3.0, 7.0, 254.999 / 255, 0.1, float("nan")]
    got = [r[0] for r in column(spark, [(x,) for x in v], "v double", pixel.to_u8(F.col("v")))]
    assert got == [int(np.clip(x, 0, 1) * 255) if x == x else 0 for x in v]
    q, s = np.random.default_rng(1).integers(-128, 128, (40, 8)), np.random.default_rng(2).random(40, np.float32)
    df = spark.createDataFrame([(i, [int(x) for x in r], float(k)) for i, (r, k) in enumerate(zip(q, s))], "i int, q array<tinyint>, scale float")
    want = q.astype(np.float32) * s[:, None]
    out = np.array([r[0] for r in df.orderBy("i").select(pixel.dequantized(F.col("q"), F.col("scale"))).collect()], np.float32)
    assert np.array_equal(out, want)
    for bands in ([2], [7, 0, 7]):
        rows = df.orderBy("i").select(F.transform(pixel.band_values(F.col("q"), F.col("scale"), bands), lambda x: x["value"])).collect()
        assert np.allclose([r[0] for r in rows], want[:, bands])
    for bad in ([1, 2], [-1, 2, 3]):
        with pytest.raises(ValueError):
            pixel.checked_bands(bad, exactly=3)


def test_normalizing(spark):
    rows = [(t, b, v) for t in (0, 1) for b, vs in enumerate(([0.0, 1.0, 3.0], [2.0, 2.0, 2.0], [0.0, 0.0, 0.0], [-1.0, float("nan"), 1.0])) for v in vs]
    df = spark.createDataFrame(rows, "tile int, band int, value double")
    by = lambda d: sorted((r["tile"], r["band"], repr(r["value"])) for r in d.collect())
    want = [(t, b, repr((v - 0) / 3 if b == 0 else v)) for t, b, v in rows]
    assert by(pixel.normalized_by_tile(df)) == sorted(want)
    clean = df.where("band < 3")
    assert by(pixel.normalized_by_window(clean)) == by(pixel.normalized_by_tile(clean))
    glob = by(pixel.normalized_globally(clean))
    assert glob == sorted((t, b, repr((v - 1) / 2 if b == 0 and v else v)) for t, b, v in rows if b < 3)


def test_winners_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(0, int(c) // 5, int(c) % 5, int(t), float(v)) for t in range(6) for c, v in zip(rng.permutation(25)[:15], rng.integers(0, 3, 15))]
    want_first, want_last = {}, {}
    for _, r, c, t, v in rows:
        want_last[r, c] = v
        want_first[r, c] = want_first.get((r, c)) or v
    for n in (1, 7):
        df = spark.createDataFrame(rows, "band int, row int, col int, tile int, value double").repartition(n)
        assert {(r["row"], r["col"]): r["value"] for r in mosaic.last_wins(df, "tile").collect()} == want_last
        assert {(r["row"], r["col"]): r["value"] for r in mosaic.first_wins(df, "tile").collect()} == want_first


def test_reference_systems(spark):
    # Published coordinates, to the accuracy that they are given in.
    known = [("EPSG:32631", 3.0, 0.0, 500000.0, 0.0, 1e-6), ("EPSG:32630", -0.1275, 51.5072, 699319.0, 5710158.0, 60.0), ("EPSG:3857", 180.0, 0.0, 20037508.342789, 0.0, 1e-5), ("EPSG:32733", 15.0, 0.0, 500000.0, 10000000.0, 1e-6), ("EPSG:3031", 0.0, -71.0, 0.0, 2082760.0, 2000.0)]
    for system, lon, lat, x, y, near in known:
        px, py = crs.forward(system, math)(lon, lat)
        assert abs(px - x) < near and abs(py - y) < near
    for system, lons, lats in (("EPSG:32631", (-1, 7), (-5, 84)), ("EPSG:32719", (-73, -65), (-80, -1)), ("EPSG:3857", (-179, 179), (-85, 85)), ("EPSG:3995", (-179, 179), (55, 89.9)), ("EPSG:3031", (-179, 179), (-89.9, -55)), ("EPSG:4326", (-180, 180), (-90, 90))):
        rng = np.random.default_rng(4)
        pts = [(float(rng.uniform(*lons)), float(rng.uniform(*lats))) for _ in range(50)]
        there, back = crs.forward(system, math), crs.inverse(system, math)
        for p in pts:
            assert np.allclose(back(*there(*p)), p, atol=1e-8)
        cols = crs.forward(system)(F.col("x"), F.col("y"))
        got = column(spark, pts, "x double, y double", *cols)
        assert np.allclose(got, [there(*p) for p in pts], atol=1e-5)
    assert crs.same("epsg:4326", "4326") and not crs.same("EPSG:4326", "EPSG:3857")
    with pytest.raises(ValueError):
        crs.code("EPSG:27700")


def test_suggested_grid():
    t, w, h = crs.suggested_grid("EPSG:4326", "EPSG:4326", 100, 50, (0.0, 0.0, 1.0, 0.5))
    assert (w, h) == (100, 50) and np.allclose(t, (0.01, 0, 0, 0, -0.01, 0.5))
    t, w, h = crs.suggested_grid("EPSG:32631", "EPSG:4326", 1000, 1000, (400000.0, 5500000.0, 410000.0, 5510000.0))
    assert 700 < h < 900 and 1100 < w < 1300 and 0 < t[0] < 2e-4


def test_polygons(spark):
    square = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]]
    two = [[(20, 20), (22, 20), (22, 22)], [(30, 30), (31, 30), (31, 31), (30, 31), (30, 30)]]
    boxes = [((-1, -1, 1, 1), 1, 0), ((4, 4, 6, 6), 0, 0), ((3, 3, 4, 4), 1, 0), ((1, 1, 2, 2), 1, 0), ((10, 10, 11, 11), 1, 0), ((-5, -5, 50, 50), 1, 1), ((20, 21, 20.5, 21.8), 0, 0), ((30.2, 30.2, 30.4, 30.4), 0, 1), ((11, 0, 12, 1), 0, 0)]
    struct = lambda rings: [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    rows = [(struct(g), *map(float, b)) for b, _, _ in boxes for g in (square, two)]
    got = column(spark, rows, f"g {geometry.RINGS}, w double, s double, e double, n double", geometry.meets_box(*(F.col(c) for c in "gwsen")))
    assert [int(r[0]) for r in got] == [v for _, a, b in boxes for v in (a, b)]


def test_binned_join_is_the_theta_join(spark):
    rng = np.random.default_rng(5)
    regions = [(i, int(a), int(b), int(a + rng.integers(0, 80)), int(b + rng.integers(0, 80))) for i, (a, b) in enumerate(rng.integers(-200, 200, (30, 2)))]
    tiles = [(int(10 * x + 5), int(10 * y + 5)) for x, y in {tuple(p) for p in rng.integers(-30, 30, (400, 2))}]
    r = spark.createDataFrame(regions, "id int, min_lon_c int, min_lat_c int, max_lon_c int, max_lat_c int")
    t = spark.createDataFrame(tiles, "lon_c int, lat_c int")
    want = {(i, x, y) for i, w, s, e, n in regions for x, y in tiles if x < e and x + 10 > w and y < n and y + 10 > s}
    got = spatial.overlapping(r, t).select("id", "lon_c", "lat_c").collect()
    assert {tuple(g) for g in got} == want and len(got) == len(want)


def test_resampling(spark):
    a = np.random.default_rng(6).random((6, 5))
    px = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(6) for x in range(5)], "py int, px int, value double")
    t = (1.0, 0.0, 0.0, 0.0, -1.0, 6.0)
    row, col = reproject.source_position(t, t)
    for how in (reproject.nearest, reproject.bilinear):
        got = {(r["row"], r["col"]): r["value"] for r in how(px, reproject.target_cells(spark, 6, 5), row, col).collect()}
        assert len(got) == 30 and all(abs(got[y, x] - a[y, x]) < 1e-9 for y in range(6) for x in range(5))
    half = (0.5, 0.0, 0.0, 0.0, -0.5, 6.0)
    row, col = reproject.source_position(half, t)
    got = {(r["row"], r["col"]): r["value"] for r in reproject.bilinear(px, reproject.target_cells(spark, 12, 10), row, col).collect()}
    assert len(got) == 120 and abs(got[1, 1] - (a[0, 0] * 0.5625 + a[0, 1] * 0.1875 + a[1, 0] * 0.1875 + a[1, 1] * 0.0625)) < 1e-9 and abs(got[0, 0] - a[0, 0]) < 1e-9


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, hash string")
    once = registry.merged(old, new)
    assert {tuple(r) for r in once.collect()} == {("a", "1", "kept"), ("b", "2", "same"), ("c", "9", "changed"), ("d", "4", "new")}
    assert {r["status"] for r in registry.merged(once, new).collect()} == {"kept", "same"}
    assert {r["path"] for r in registry.merged(old, new, prune=True).collect()} == {"b", "c", "d"}


def test_tile_routes(spark):
    long = "x" * 5000
    rows = [("/tiles/3/1/2.png", "3/1/2.png"), (f"/tiles/{long}", long), ("/tiles/", ""), ("/tiles", None), ("/a/tiles/1", None), ("", None), (None, None)]
    got = spark.createDataFrame(rows, "p string, want string").select("want", grid.tile_route(F.col("p")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


@pytest.mark.parametrize("target_crs", ["EPSG:4326", "EPSG:3857", "EPSG:32631"])
def test_tiles_resample_as_rows_do(spark, target_crs):
    """``onto`` in one task against the join of pixels, in both ways and over a target that the tile only partly meets."""
    rng = np.random.default_rng(3)
    image = rng.normal(size=(9, 7, 2))
    source = (0.01, 0.0, 5.0, 0.0, -0.012, 50.1)
    grid, w, h = crs.suggested_grid("EPSG:4326", target_crs, 7, 9, (5.0, 50.1 - 9 * 0.012, 5.07, 50.1))
    target = (grid[0] * 0.7, 0.0, grid[2] + 2.3 * grid[0], 0.0, grid[4] * 0.7, grid[5] + 1.7 * grid[0])
    height, width = 2 * h, w
    pixels = spark.createDataFrame([(k, y, x, float(image[y, x, k])) for k in range(2) for y in range(9) for x in range(7)], "band int, py int, px int, value double")
    cells = reproject.target_cells(spark, height, width)
    row, col = reproject.source_position(target, source, target_crs, "EPSG:4326")
    for smooth, how in ((True, reproject.bilinear), (False, reproject.nearest)):
        want = {(r["band"], r["row"], r["col"]): r["value"] for r in how(pixels, cells, row, col, ("band",)).collect()}
        got = {}
        for j, i, v in reproject.onto(image, source, target, height, width, "EPSG:4326", target_crs, smooth):
            got |= {(k, int(a), int(b)): v[n, k] for n, (a, b) in enumerate(zip(j, i)) for k in range(2)}
        assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tiles_beyond_the_target(monkeypatch):
    image, source = np.ones((4, 4, 1)), (0.1, 0.0, 5.0, 0.0, -0.1, 50.0)
    assert list(reproject.onto(image, source, (0.1, 0.0, 60.0, 0.0, -0.1, 50.0), 10, 10, "EPSG:4326", "EPSG:4326")) == []
    monkeypatch.setattr(reproject, "BLOCK", 3)
    parts = list(reproject.onto(image, source, source, 4, 4, "EPSG:4326", "EPSG:4326"))
    assert len(parts) == 4 and sum(len(v) for _, _, v in parts) == 16


@pytest.mark.parametrize("system,transform,height,width", [("EPSG:4326", (0.01, 0.0, 5.0, 0.0, -0.01, 50.0), 12, 17), ("EPSG:32631", (700.0, 0.0, 500000.0, 0.0, -700.0, 5.5e6), 9, 8), ("EPSG:3995", (40000.0, 0.0, -160000.0, 0.0, -40000.0, -2000000.0), 6, 7)])
def test_pyramid_has_no_gaps(spark, system, transform, height, width):
    """Every web pixel whose centre lies in the raster, at zooms around its own resolution, against a walk over all of them."""
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (height, width))
    cells = spark.createDataFrame([(0, y, x, float(image[y, x])) for y in range(height) for x in range(width)], "band int, py int, px int, u8 double")
    edge = mosaic.averaging_zoom(transform, height, width, system, 16)
    zooms = [0, edge - 2, edge - 1, edge, edge + 1, edge + 2]
    a, _, c, _, e, f = transform
    sums, seen = {}, set()
    to, back = crs.between(system, "EPSG:3857", math), crs.between("EPSG:3857", system, math)
    world = 2 * math.pi * 6378137.0
    for z in zooms:
        n = 16 * 2**z
        spots = []
        for y in range(height):
            for x in range(width):
                p, q = to((x + 0.5) * a + c, (y + 0.5) * e + f)
                at = (z, math.floor((p / world + 0.5) * n), math.floor((0.5 - q / world) * n))
                spots.append(at)
                if z <= edge:
                    sums.setdefault(at, []).append(image[y, x])
        for i in range(max(0, min(s[1] for s in spots) - 3), min(n, max(s[1] for s in spots) + 4)):
            for j in range(max(0, min(s[2] for s in spots) - 3), min(n, max(s[2] for s in spots) + 4)):
                p, q = back(((i + 0.5) / n - 0.5) * world, (0.5 - (j + 0.5) / n) * world)
                x, y = math.floor((p - c) / a), math.floor((q - f) / e)
                if 0 <= x < width and 0 <= y < height:
                    seen.add((z, i, j))
                    if z > edge:
                        sums.setdefault((z, i, j), []).append(image[y, x])
    rows = mosaic.pyramid(cells, transform, height, width, system, zooms, 16).collect()
    got = {(r["z"], r["x"] * 16 + r["px"], r["y"] * 16 + r["py"]): r["value"] for r in rows}
    assert len(got) == len(rows) and got.keys() == sums.keys()
    assert all(abs(got[k] - sum(v) / len(v)) < 1e-9 for k, v in sums.items())
    # a centre near the edge may lie in a pixel that no source centre falls in; inside there is none
    inner = {k for k in seen if k[0] > edge} | {k for k in seen if all((k[0], k[1] + i, k[2] + j) in seen for i in (-1, 0, 1) for j in (-1, 0, 1))}
    assert inner and inner <= got.keys()
