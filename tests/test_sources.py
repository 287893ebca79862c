import json

import numpy as np
import pytest

from terrapane.sources import geotiff, npy, png, vector


def test_lzw():
    rng = np.random.default_rng(1)
    for data in (b"", b"a", b"aaaaaaa", bytes(range(256)) * 40, rng.integers(0, 256, 60_000).astype(np.uint8).tobytes(), rng.integers(0, 3, 200_000).astype(np.uint8).tobytes()):
        assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data


@pytest.mark.parametrize("dtype", ["u1", "i2", "u2", "f4", "f8"])
@pytest.mark.parametrize("compression", [geotiff.LZW, geotiff.NONE])
def test_geotiff(dtype, compression):
    a = (np.random.default_rng(2).random((130, 37, 3)) * 200).astype(dtype)
    t = geotiff.from_bounds(1.5, 50.0, 1.6, 50.1, 37, 130)
    back, m = geotiff.decode(geotiff.encode(a, t, "EPSG:32631", compression))
    assert np.array_equal(back, a) and m.crs == "EPSG:32631" and np.allclose(m.transform, t) and m.dtype == a.dtype
    assert np.allclose(m.bounds, (1.5, 50.0, 1.6, 50.1))
    one, m = geotiff.decode(geotiff.encode(a[:, :, 0], t, "EPSG:4326", compression))
    assert np.array_equal(one[:, :, 0], a[:, :, 0]) and m.crs == "EPSG:4326"


def test_png():
    rng = np.random.default_rng(3)
    for shape in ((5, 7), (5, 7, 3), (5, 7, 4)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(png.decode(png.encode(a)).reshape(shape), a)


def test_npy():
    for a in (np.arange(24, dtype="i1").reshape(2, 3, 4), np.asfortranarray(np.random.default_rng(4).random((4, 5)).astype(">f4"))):
        assert np.array_equal(npy.decode(npy.encode(a)), a)
    with pytest.raises(ValueError):
        npy.decode(b"something else")


def test_vectors(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "s", "properties": {"name": "one", "n": 3}, "geometry": {"type": "Polygon", "coordinates": [square]}},
        {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [[[5, 5], [6, 5], [6, 7], [5, 5]]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [9, 9]}},
    ]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc, indent=1))
    got = {r["feature_id"]: r for r in vector.read(spark, f"{tmp_path}/a.geojson").collect()}
    assert set(got) == {"s", "1"} and got["s"]["properties"] == {"name": "one", "n": "3"} and len(got["1"]["rings"]) == 2
    assert tuple(vector.total_bounds(vector.read(spark, f"{tmp_path}/a.geojson")).first()) == (0, 0, 6, 7)
    assert vector.read_raw(spark, f"{tmp_path}/a.geojson") == doc
    # two triangles that share an edge, quantized
    topo = {"type": "Topology", "transform": {"scale": [0.5, 0.5], "translate": [10, 20]}, "objects": {"o": {"type": "GeometryCollection", "geometries": [{"type": "Polygon", "id": "l", "arcs": [[0, 1]], "properties": {"k": "v"}}, {"type": "Polygon", "id": "r", "arcs": [[2, -1]]}]}}, "arcs": [[[0, 0], [4, 4]], [[4, 4], [-4, 0], [0, -4]], [[0, 0], [4, 0], [0, 4]]]}
    (tmp_path / "b.json").write_text(json.dumps(topo))
    got = {r["feature_id"]: [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]] for r in vector.read(spark, f"{tmp_path}/b.json").collect()}
    assert got == {"l": [[(10, 20), (12, 22), (10, 22), (10, 20)]], "r": [[(10, 20), (12, 20), (12, 22), (10, 20)]]}


def test_xml(spark):
    rows = [(1, '<TileMap><BoundingBox minx="-1.5" miny="2" maxx="3" maxy="4.25"/></TileMap>'), (2, "<TileMap/>")]
    got = {r["i"]: tuple(r)[1:] for r in vector.xml_bounds(spark.createDataFrame(rows, "i int, value string")).collect()}
    assert got == {1: (2.0, -1.5, 4.25, 3.0), 2: (None,) * 4}
