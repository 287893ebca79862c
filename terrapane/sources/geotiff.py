"""GeoTIFF without GDAL: classic TIFF in strips or tiles, LZW or none, and the tags for place.

The codec works on arrays and bytes.  ``write_mosaic`` builds strips on
executors and sends only compressed strips to the driver, which puts them into
one file through the Hadoop file system.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import crs as systems
from terrapane.operators import reproject
from terrapane.sources import files

# Tags, field types and GeoTIFF keys.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, PREDICTOR = 322, 323, 324, 325, 339, 317
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS = 33550, 33922, 34264, 34735
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
MODEL_TYPE, RASTER_TYPE, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
LZW, NONE = 5, 1
STRIP = 64


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: codes from 9 bits, high bit first, one earlier than GIF's."""
    out, acc, held = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    bits, code = 9, 258

    def put(v: int) -> None:
        nonlocal acc, held
        acc, held = acc << bits | v, held + bits
        while held >= 8:
            held -= 8
            out.append(acc >> held & 255)
        acc &= (1 << held) - 1

    put(256)
    table = {bytes([i]): i for i in range(256)}
    w = b""
    for k in range(len(data)):
        c = data[k : k + 1]
        if w + c in table:
            w += c
            continue
        put(table[w])
        table[w + c] = code
        code += 1
        if code == 4094:
            put(256)
            table = {bytes([i]): i for i in range(256)}
            bits, code = 9, 258
        elif code >= 1 << bits:
            bits += 1
        w = c
    if w:
        put(table[w])
        code += 1
        if code >= 1 << bits and bits < 12:
            bits += 1
    put(257)
    if held:
        out.append(acc << 8 - held & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    out, table = bytearray(), []
    acc = held = 0
    bits, last = 9, None
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < bits:
            continue
        held -= bits
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, bits, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) + 1 >= 1 << bits and bits < 12:
            bits += 1
    return bytes(out)


@dataclass
class Meta:
    """What a reader needs of a file before its pixels."""

    width: int
    height: int
    bands: int
    dtype: np.dtype
    transform: tuple[float, float, float, float, float, float]
    crs: str | None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, _, c, _, e, f = self.transform
        x, y = c + a * self.width, f + e * self.height
        return min(c, x), min(f, y), max(c, x), max(f, y)


def from_bounds(west: float, south: float, east: float, north: float, width: int, height: int) -> tuple[float, ...]:
    """The transform of a north-up raster that fills its bounds."""
    return (east - west) / width, 0.0, west, 0.0, -(north - south) / height, north


def _geo_keys(crs: str) -> list[int]:
    n = systems.code(crs)
    geographic = n == 4326
    keys = [(MODEL_TYPE, 0, 1, 2 if geographic else 1), (RASTER_TYPE, 0, 1, 1), (GEOGRAPHIC if geographic else PROJECTED, 0, 1, n)]
    return [v for row in [(1, 1, 0, len(keys)), *keys] for v in row]


def assembled(width: int, height: int, bands: int, dtype: np.dtype, strips: list[bytes], rows: int, transform: tuple, crs: str, compression: int = LZW) -> bytes:
    """A file from its compressed strips (pixel-interleaved)."""
    dtype = np.dtype(dtype)
    a, b, c, d, e, f = transform
    if b or d:
        raise ValueError("only north-up rasters are written")
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    entries = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * dtype.itemsize] * bands), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if bands == 3 else 1]),
        (STRIP_OFFSETS, 4, [0] * len(strips)), (SAMPLES, 3, [bands]), (ROWS_PER_STRIP, 4, [rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (PLANAR, 3, [1]),
        (SAMPLE_FORMAT, 3, [kind] * bands), (PIXEL_SCALE, 12, [a, -e, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, c, f, 0.0]), (GEO_KEYS, 3, _geo_keys(crs)),
    ]
    head = 8 + 2 + 12 * len(entries) + 4
    extra, at = bytearray(), head
    sizes = {t: SIZES[k] * len(v) for t, k, v in entries}
    data_at = head + sum(s + s % 2 for s in sizes.values() if s > 4)
    offsets, p = [], data_at
    for s in strips:
        offsets.append(p)
        p += len(s)
    out = bytearray(b"II*\0" + struct.pack("<IH", 8, len(entries)))
    for tag, k, v in entries:
        v = offsets if tag == STRIP_OFFSETS else v
        raw = struct.pack(f"<{len(v)}{CODES[k]}", *v)
        if len(raw) <= 4:
            out += struct.pack("<HHI", tag, k, len(v)) + raw.ljust(4, b"\0")
        else:
            out += struct.pack("<HHII", tag, k, len(v), at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return bytes(out + struct.pack("<I", 0) + extra + b"".join(strips))


def encode(array: np.ndarray, transform: tuple, crs: str, compression: int = LZW) -> bytes:
    """A file from an array of shape (height, width) or (height, width, bands)."""
    a = array if array.ndim == 3 else array[:, :, None]
    press = lzw_encode if compression == LZW else bytes
    raw = a.astype(a.dtype.newbyteorder("<"))
    strips = [press(raw[t : t + STRIP].tobytes()) for t in range(0, a.shape[0], STRIP)]
    return assembled(a.shape[1], a.shape[0], a.shape[2], a.dtype, strips, STRIP, transform, crs, compression)


def _tags(data: bytes | _Slices) -> tuple[dict[int, tuple], str]:
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a classic TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
        size = SIZES[kind] * n
        start = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        out[tag] = (data[start : start + size],) if kind in (2, 7) or kind not in CODES else struct.unpack(f"{order}{n}{CODES[kind]}", data[start : start + size])
    return out, order


def meta(data: bytes | _Slices) -> Meta:
    """Size, type, transform and system from the header alone."""
    t, _ = _tags(data)
    if TRANSFORMATION in t:
        m = t[TRANSFORMATION]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    else:
        sx, sy = t.get(PIXEL_SCALE, (1.0, 1.0))[:2]
        i, j, _, x, y, _ = t.get(TIEPOINT, (0.0,) * 6)
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = t.get(GEO_KEYS, ())
    system = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    n = system.get(PROJECTED) or system.get(GEOGRAPHIC)
    kind = {1: "u", 2: "i", 3: "f"}[t.get(SAMPLE_FORMAT, (1,))[0]]
    return Meta(t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0], np.dtype(f"{kind}{t[BITS][0] // 8}"), transform, f"EPSG:{n}" if n else None)


def decode(data: bytes) -> tuple[np.ndarray, Meta]:
    """Pixels (height, width, bands) and header of a file in strips or tiles."""
    t, order = _tags(data)
    m = meta(data)
    if t.get(PLANAR, (1,))[0] != 1 or t.get(PREDICTOR, (1,))[0] != 1:
        raise ValueError("planes and predictors aren't read")
    unpress = {LZW: lzw_decode, NONE: bytes}.get(t.get(COMPRESSION, (NONE,))[0])
    if unpress is None:
        raise ValueError(f"compression {t[COMPRESSION][0]} isn't read")
    tiled = TILE_OFFSETS in t
    h, w = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]) if tiled else (t.get(ROWS_PER_STRIP, (m.height,))[0], m.width)
    out = np.zeros((m.height, m.width, m.bands), m.dtype)
    across = -(-m.width // w)
    for k, (at, n) in enumerate(zip(t[TILE_OFFSETS if tiled else STRIP_OFFSETS], t[TILE_BYTES if tiled else STRIP_BYTES])):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, m.height - y)
        part = np.frombuffer(unpress(data[at : at + n]), m.dtype.newbyteorder(order), count=rows * w * m.bands).reshape(rows, w, m.bands)
        out[y : y + h, x : x + w] = part[: m.height - y, : m.width - x]
    return out, m


META = "path string, width int, height int, bands int, dtype string, transform array<double>, crs string, bounds array<double>"


class _Slices:
    """Parts of an open file by position, read when asked for."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f = f

    def __getitem__(self, part: slice) -> bytes:
        self.f.seek(part.start or 0)
        return self.f.read(part.stop - (part.start or 0))


def _listed(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """path of the files below ``root``, dealt over the shuffle partitions."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif*").load(root)
    return found.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def read_meta(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """A row for each file's header; no more of a file is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in b.column("path").to_pylist():
                with files.opened(p) as f:
                    m = meta(_Slices(f))
                rows.append({"path": p, "width": m.width, "height": m.height, "bands": m.bands, "dtype": m.dtype.name, "transform": list(m.transform), "crs": m.crs, "bounds": list(m.bounds)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bands", pa.int32()), ("dtype", pa.string()), ("transform", pa.list_(pa.float64())), ("crs", pa.string()), ("bounds", pa.list_(pa.float64()))]))

    return _listed(spark, root).mapInArrow(run, META)


def _whole(path: str) -> tuple[np.ndarray, Meta]:
    with files.opened(path) as f:
        return decode(f.read())


def read_pixels(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """path, band, py, px and value of every pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():
                a, _ = _whole(p)
                for top in range(0, a.shape[0], STRIP):
                    part = a[top : top + STRIP]
                    y, x, k = np.indices(part.shape).reshape(3, -1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([p] * y.size), pa.array(k), pa.array(y + np.int32(top)), pa.array(x), pa.array(part.reshape(-1).astype(np.float64))], names=["path", "band", "py", "px", "value"])

    return _listed(spark, root).mapInArrow(run, "path string, band int, py int, px int, value double")


def read_onto(refs: DataFrame, target: reproject.Transform, height: int, width: int, target_crs: str) -> DataFrame:
    """lon_c, lat_c, row, col and value of the files ``mask`` resampled to the nearest pixel of their first band.

    The task that opens a file resamples it; only target cells leave it.
    """
    n = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                a, _ = _whole(r["mask"])
                source = (r["a"], 0.0, r["c"], 0.0, r["e"], r["f"])
                for row, col, value in reproject.onto(a[:, :, :1], source, target, height, width, r["crs"], target_crs, smooth=False):
                    key = [np.full(row.size, r[c], np.int32) for c in ("lon_c", "lat_c")]
                    cols = [*key, row.astype(np.int32), col.astype(np.int32), value[:, 0].astype(np.float64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["lon_c", "lat_c", "row", "col", "value"])

    rows = refs.select("lon_c", "lat_c", "mask", "crs", "a", "c", "e", "f").repartition(n, "mask")
    return rows.mapInArrow(run, "lon_c int, lat_c int, row int, col int, value double")


def write_mosaic(cells: DataFrame, path: str, bands: list[int], height: int, width: int, transform: tuple, crs: str, compression: int = LZW) -> None:
    """One RGB (or single-band) u8 file from rows (band, row, col, u8); cells without a row are 0.

    Strips are built and compressed on executors; the driver holds the file's
    compressed bytes, as a single file must pass through one writer.
    """
    spark = cells.sparkSession
    number = F.array_position(F.array(*map(F.lit, bands)), F.col("band")).cast("int") - 1
    rows = cells.where((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width)).select(F.floor(F.col("row") / STRIP).cast("int").alias("strip"), "row", "col", number.alias("k"), F.col("u8").cast("int").alias("u8")).where("k >= 0")
    n = len(bands)

    def strip(t: pa.Table) -> pa.Table:
        s = t.column("strip")[0].as_py()
        a = np.zeros((min(STRIP, height - s * STRIP), width, n), np.uint8)
        a[t.column("row").to_numpy() - s * STRIP, t.column("col").to_numpy(), t.column("k").to_numpy()] = t.column("u8").to_numpy()
        raw = a.tobytes()
        return pa.table({"strip": pa.array([s], pa.int32()), "data": pa.array([lzw_encode(raw) if compression == LZW else raw], pa.binary())})

    made = {r["strip"]: bytes(r["data"]) for r in rows.groupBy("strip").applyInArrow(strip, "strip int, data binary").toLocalIterator()}
    press = lzw_encode if compression == LZW else bytes
    empty = {k: press(bytes(k * width * n)) for k in {STRIP, height % STRIP or STRIP}}
    strips = [made.get(s) or empty[min(STRIP, height - s * STRIP)] for s in range(-(-height // STRIP))]
    put(spark, path, assembled(width, height, n, np.dtype("u1"), strips, STRIP, transform, crs, compression))


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write bytes through the Hadoop file system, in pieces that the gateway takes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()
