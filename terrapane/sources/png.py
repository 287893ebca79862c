"""PNG files, and the z/x/y pyramid of them."""

from __future__ import annotations

import struct
import zlib
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapane.sources import files


def encode(a: np.ndarray, notes: dict[str, str] | None = None) -> bytes:
    """8-bit grey (h, w), RGB (h, w, 3) or RGBA (h, w, 4), with text fields (Latin-1)."""
    a = a if a.ndim == 3 else a[:, :, None]
    h, w, n = a.shape
    raw = np.zeros((h, 1 + w * n), np.uint8)
    raw[:, 1:] = a.reshape(h, w * n)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    texts = b"".join(chunk(b"tEXt", k.encode("latin1") + b"\0" + v.encode("latin1")) for k, v in (notes or {}).items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + texts + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """What ``encode`` writes (filter 0 alone)."""
    at, body, head = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head, body = (part if kind == b"IHDR" else head), body + (part if kind == b"IDAT" else b"")
        at += 12 + n
    w, h, _, colour = struct.unpack(">IIBB", head[:10])
    n = {0: 1, 2: 3, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    if raw[:, 0].any():
        raise ValueError("filtered rows aren't read")
    return raw[:, 1:].reshape(h, w, n)


def tiles(pyramid: DataFrame, bands: list[int], size: int = 256) -> DataFrame:
    """z, x, y and png of a pyramid's pixels; pixels without data are transparent.

    A group is one tile, ``size`` squared pixels at most.
    """
    number = F.array_position(F.array(*map(F.lit, bands)), F.col("band")).cast("int") - 1
    rows = pyramid.select("z", "x", "y", "py", "px", number.alias("k"), F.col("value").cast("int").alias("v")).where("k >= 0")
    n = len(bands)

    def one(t: pa.Table) -> pa.Table:
        a = np.zeros((size, size, n), np.uint8)
        full = np.zeros((size, size), np.uint8)
        y, x = t.column("py").to_numpy(), t.column("px").to_numpy()
        a[y, x, t.column("k").to_numpy()] = t.column("v").to_numpy()
        full[y, x] = 255
        rgb = a if n == 3 else np.repeat(a[:, :, :1], 3, 2)
        key = {c: pa.array([t.column(c)[0].as_py()], pa.int32()) for c in ("z", "x", "y")}
        return pa.table({**key, "png": pa.array([encode(np.dstack([rgb, full]))], pa.binary())})

    return rows.groupBy("z", "x", "y").applyInArrow(one, "z int, x int, y int, png binary")


def write_tiles(made: DataFrame, out: str, overwrite: bool = True) -> int:
    """``{out}/{z}/{x}/{y}.png``, written by the tasks that draw them.  Returns how many."""
    spark = made.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not overwrite and fs.exists(p) and fs.listStatus(p):
        return 0
    name = F.concat(F.concat_ws("/", *(F.col(c).cast("string") for c in ("z", "x", "y"))), F.lit(".png"))
    return files.written(made.select(name.alias("name"), F.col("png").alias("data")), out).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def coverage_map(points: DataFrame, width: int = 1440, height: int = 720) -> bytes:
    """A world map of tile counts: binned and summed by Spark, at most a row for each map pixel.

    The places' number and the time in UTC are the file's title and creation time.
    """
    x = F.least(F.lit(width - 1), F.floor((F.col("lon_c") + 18000) * width / 36000)).cast("int")
    y = F.least(F.lit(height - 1), F.floor((9000 - F.col("lat_c")) * height / 18000)).cast("int")
    bins = points.groupBy(x.alias("x"), y.alias("y")).agg(F.count(F.lit(1)).alias("n")).where((F.col("x") >= 0) & (F.col("y") >= 0))
    a = np.full((height, width, 3), 245, np.uint8)
    a[height // 2, :] = a[:, width // 2] = 215
    places = 0
    for r in bins.toLocalIterator():
        a[r["y"], r["x"]] = (200, max(0, 120 - 20 * r["n"]), 40)
        places += r["n"]
    return encode(a, {"Title": f"Coverage: {places:,} places", "Creation Time": f"{datetime.now(UTC):%Y-%m-%d %H:%M:%S} UTC"})
