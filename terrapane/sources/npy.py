"""Quantized arrays and their scales as pixel rows, or as cells of another grid.

Spark lists and pairs paths; an Arrow function opens a tile's two files and
decodes them in row strips of the bands asked for.  So no contents are shuffled,
and neither a whole tile nor all its channels are expanded at once.  Paths are
dealt over all shuffle partitions, whose number isn't lowered at run time: by the
bytes of two paths a tile all would end in one task.
"""

from __future__ import annotations

import ast
import io
import math
import struct
from collections.abc import Iterator, Sequence
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import grid, pixel
from terrapane.operators import reproject
from terrapane.sources import files

STRIP = 64  # rows of a tile that are turned into Arrow at once


def head(f: BinaryIO) -> tuple[np.dtype, tuple[int, ...], str, int]:
    """Type, shape, order and start of the values of an NPY file of format 1 to 3, without pickles."""
    lead = f.read(12)
    if lead[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    size, start = (struct.unpack("<H", lead[8:10])[0], 10) if lead[6] == 1 else (struct.unpack("<I", lead[8:12])[0], 12)
    f.seek(start)
    fields = ast.literal_eval(f.read(size).decode("latin1"))
    kind = np.dtype(fields["descr"])
    if kind.hasobject:
        raise ValueError("object arrays aren't read")
    return kind, fields["shape"], "F" if fields["fortran_order"] else "C", start + size


def rows(f: BinaryIO, about: tuple[np.dtype, tuple[int, ...], str, int], top: int, bottom: int) -> np.ndarray:
    """Rows ``top`` to ``bottom`` of an array; column-major ones are read whole."""
    kind, shape, order, start = about
    if order == "F":
        f.seek(start)
        return np.frombuffer(f.read(kind.itemsize * math.prod(shape)), kind).reshape(shape, order="F")[top:bottom]
    step, bottom = kind.itemsize * math.prod(shape[1:]), min(bottom, shape[0])
    f.seek(start + top * step)
    return np.frombuffer(f.read((bottom - top) * step), kind).reshape(bottom - top, *shape[1:])


def decode(data: bytes) -> np.ndarray:
    f = io.BytesIO(data)
    about = head(f)
    return rows(f, about, 0, about[1][0]) if about[1] else np.frombuffer(data, about[0], offset=about[3]).reshape(())


def encode(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


KEY = ("year", "lon_c", "lat_c")


def _pairs(spark: SparkSession, root: str | list[str], tiles: DataFrame | None, entries: DataFrame | None) -> DataFrame:
    """KEY, and path and registered hash of a tile's array (e) and scales (c)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(root)
    parts = F.split("path", "/")
    at = grid.parsed_grid_name(F.element_at(parts, -2))
    listed = found.select(F.get(parts, F.size(parts) - 3).cast("int").alias("year"), grid.hundredths(at["lon"]).alias("lon_c"), grid.hundredths(at["lat"]).alias("lat_c"), F.endswith("path", F.lit("_scales.npy")).alias("s"), "path")
    if tiles is not None:
        listed = listed.join(tiles.select(*KEY).distinct(), list(KEY), "left_semi")
    if entries is None:
        listed = listed.withColumn("hash", F.lit(None).cast("string"))
    else:
        known = entries.select(F.col("path").alias("__name"), "hash")
        listed = listed.withColumn("__name", F.concat_ws("/", F.slice(F.split("path", "/"), -3, 3))).join(known, "__name", "left")
    one = lambda s, name: F.min(F.when(F.col("s") == F.lit(s), F.struct("path", "hash"))).alias(name)
    dealt = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY)
    pairs = dealt.groupBy(*KEY).agg(one(False, "e"), one(True, "c")).where("e is not null and c is not null")
    return pairs.select(*KEY, *(F.col(f"{k}.{v}").alias(f"{k}_{v}") for k in "ec" for v in ("path", "hash")))


def _strips(tile: dict, bands: Sequence[int] | None) -> Iterator[tuple[int, tuple[int, int], np.ndarray, np.ndarray]]:
    """First row, the tile's shape, values and scales of a tile's strips, after a check of its hashes."""
    for k in "ec":
        if tile[f"{k}_hash"] and files.sha256(tile[f"{k}_path"]) != tile[f"{k}_hash"]:
            raise ValueError(f"{tile[f'{k}_path']} is not what the registry says")
    with files.opened(tile["e_path"]) as e, files.opened(tile["c_path"]) as c:
        of_e, of_c = head(e), head(c)
        if of_e[1][:2] != of_c[1][:2]:
            raise ValueError(f"array and scales of {[tile[k] for k in KEY]} differ in shape")
        h, w = of_e[1][:2]
        for top in range(0, h, STRIP):
            part = rows(e, of_e, top, top + STRIP)
            yield top, (h, w), part if bands is None else part[:, :, bands], np.ascontiguousarray(rows(c, of_c, top, top + STRIP), np.float32)


def read_pixels(spark: SparkSession, root: str | list[str], tiles: DataFrame | None = None, bands: Sequence[int] | None = None, dequantize: bool = False, entries: DataFrame | None = None) -> DataFrame:
    """year, lon_c, lat_c, py, px and the chosen bands of all tiles below ``root``, or of ``tiles`` alone.

    Without ``dequantize``: q array<int> and scale; with it: embedding
    array<float>.  A tile's two files meet by their common folder, as paths; their
    contents are read by the task that decodes them.  With ``entries`` (path and
    hash of the registry) a file whose SHA-256 differs from its entry is an error.
    """
    bands = None if bands is None else pixel.checked_bands(bands)

    def strips(tile: dict) -> Iterator[pa.RecordBatch]:
        key = [tile[c] for c in KEY]
        for top, (_, w), part, scales in _strips(tile, bands):
            scale = scales.reshape(-1)
            flat = part.reshape(-1, part.shape[2])
            n, k = flat.shape
            values = flat.astype(np.float32) * scale[:, None] if dequantize else flat.astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, n * k + 1, k, dtype=np.int32), pa.array(values.reshape(-1)))
            place = np.arange(n)
            cols = [*(pa.array(np.full(n, v, np.int32)) for v in key), pa.array((top + place // w).astype(np.int32)), pa.array((place % w).astype(np.int32)), lists]
            names = [*KEY, "py", "px", "embedding" if dequantize else "q"]
            yield pa.RecordBatch.from_arrays(cols if dequantize else [*cols, pa.array(scale)], names=names if dequantize else [*names, "scale"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile in b.to_pylist():
                yield from strips(tile)

    tail = "embedding array<float>" if dequantize else "q array<int>, scale float"
    return _pairs(spark, root, tiles, entries).mapInArrow(run, f"year int, lon_c int, lat_c int, py int, px int, {tail}")


def read_onto(spark: SparkSession, root: str | list[str], refs: DataFrame, bands: Sequence[int], target: reproject.Transform, height: int, width: int, target_crs: str, entries: DataFrame | None = None) -> DataFrame:
    """KEY, band (number in ``bands``), row, col and value of tiles resampled onto one grid, bilinearly.

    ``refs`` has a tile's place, crs and transform (a, c, e, f of a north-up
    raster).  A task holds one tile's chosen bands and a block of target cells;
    pixels don't leave it.
    """
    bands = pixel.checked_bands(bands)
    place = refs.select("lon_c", "lat_c", "crs", "a", "c", "e", "f")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cells(tile: dict) -> Iterator[pa.RecordBatch]:
        image = None
        for top, shape, part, scales in _strips(tile, bands):
            image = np.empty((*shape, len(bands)), np.float64) if image is None else image
            image[top : top + STRIP] = part.astype(np.float64) * scales[:, :, None]
        if image is None:
            return
        source = (tile["a"], 0.0, tile["c"], 0.0, tile["e"], tile["f"])
        for row, col, value in reproject.onto(image, source, target, height, width, tile["crs"], target_crs):
            for k in range(len(bands)):
                cols = [*(np.full(row.size, tile[c], np.int32) for c in KEY), np.full(row.size, k, np.int32), row.astype(np.int32), col.astype(np.int32), np.ascontiguousarray(value[:, k])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*KEY, "band", "row", "col", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tile in b.to_pylist():
                yield from cells(tile)

    placed = _pairs(spark, root, None, entries).join(place, ["lon_c", "lat_c"]).repartition(n, *KEY)
    return placed.mapInArrow(run, "year int, lon_c int, lat_c int, band int, row int, col int, value double")
