"""Hilbert-curve sharding (operator 2), all DataFrame expressions.

Metadata dimensions (source, language, size) are quantised to a few bits each;
the cell's index on the Hilbert curve orders the documents, and the order is cut
into runs with counts at most one apart (law ``rows``).  A run then spans few
values of every dimension, so a shard's least and greatest values prune it for
filters on any of them.

The global rank needs no single sorted stream.  Cells are at most
2^(dimensions * bits); their counts go to the driver, which is bounded by the
grid and not by the documents.  A cell's rows are dealt over about the square
root of its count groups by a hash, so that neither the groups of a hot cell
nor the rows of a group are many; rank = rows in cells before + rows in the
cell's groups before + row number in the group.

Defined results: a null text counts 0 bytes (size 1, checksum of nothing); null
metadata quantise to 0; repeated rows are placed each; ties within a group are
ordered by doc_id, checksum and size; an empty table gives an empty result;
extra columns are ignored by ``placed`` and kept by ``write_sharded``.  There the
folders' column is ``shard``, or ``shard_`` and so on where the input has that name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrapane.llm.common import let, literal_array, scratch, staged, table

BITS = 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Index of a point on the Hilbert curve over a grid of 2^bits a side.

    Walks from the highest bit down. The curve in each sub-cube is the whole
    curve under a rotation of the axes and a reflection, both of which follow
    from the sub-cube's Gray-code rank.
    """
    n = len(point)
    entry, turn, index = 0, 0, 0
    full = (1 << n) - 1

    def rotated(x: int, by: int) -> int:
        by %= n
        return ((x >> by) | (x << (n - by))) & full

    for level in reversed(range(bits)):
        corner = sum(((p >> level) & 1) << k for k, p in enumerate(point))
        gray = rotated(corner ^ entry, turn + 1)
        rank, shift = gray, 1
        while shift < n:
            rank ^= rank >> shift
            shift <<= 1
        index = index << n | rank
        # the entry corner and the direction of sub-cube ``rank``
        low = 0 if rank == 0 else (2 * ((rank - 1) // 2)) ^ (2 * ((rank - 1) // 2) >> 1)
        trailing = 0 if rank == 0 else _trailing_ones(rank if rank % 2 else rank - 1) % n
        by = (turn + 1) % n
        entry ^= ((low << by) | (low >> (n - by))) & full
        turn = (turn + trailing + 1) % n
    return index


def _trailing_ones(x: int) -> int:
    return ((x + 1) & -(x + 1)).bit_length() - 1


def hilbert_table(dims: int, bits: int) -> list[int]:
    """Curve index of every cell, cells in row-major order."""
    if dims * bits > 14:
        raise ValueError("at most 14 bits over all dimensions")
    mask = (1 << bits) - 1
    return [hilbert_index(tuple(cell >> bits * (dims - 1 - k) & mask for k in range(dims)), bits) for cell in range(1 << dims * bits)]


def quantised(docs: DataFrame) -> list[Column]:
    """source, lang and size, each as an integer under 2^BITS."""
    hashed = [F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << BITS))).cast("int") for c in ("source", "lang")]
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    return [*hashed, F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(size))).cast("int")]


DIMENSIONS = ("source", "lang", "size")


def digests(docs: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, checksum and curve index of every row, and columns of ``more``; no text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dims = quantised(docs)
    cell = dims[0]
    for d in dims[1:]:
        cell = cell * (1 << BITS) + d
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell.alias("cell"), *more).withColumn("hilbert", F.get(literal_array(hilbert_table(len(dims), BITS), "int"), F.col("cell"))).drop("cell")


def placed(docs: DataFrame, shards: int = 16, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, rank, shard and slot of every row, and columns of ``more``."""
    rows = staged(digests(docs, more))
    cells = {r["hilbert"]: r["count"] for r in rows.groupBy("hilbert").count().collect()}  # bounded by the grid
    total, before, starts, groups = sum(cells.values()), 0, [], []
    for h in range(max(cells, default=0) + 1):
        starts.append(before)
        groups.append(max(1, math.isqrt(cells.get(h, 0))))
        before += cells.get(h, 0)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.get(literal_array(groups, "bigint"), F.col("hilbert"))).cast("int"))
    sums = rows.groupBy("hilbert", "part").count()
    ahead = Window.partitionBy("hilbert").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("hilbert", "part", (F.get(literal_array(starts, "bigint"), F.col("hilbert")) + F.coalesce(F.sum("count").over(ahead), F.lit(0))).alias("ahead"))
    inner = Window.partitionBy("hilbert", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("n", F.row_number().over(inner)).join(sums, ["hilbert", "part"]).withColumn("rank", F.col("ahead") + F.col("n") - 1)
    shard = F.floor(F.col("rank") * shards / F.lit(max(1, total))) if total == 0 else F.expr(f"rank * {shards} div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long")).select("doc_id", "size", "text_crc32", "hilbert", "rank", "shard", "slot", *more)


def _free(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def write_sharded(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write ``docs`` as Parquet, a folder a shard, along the curve within it, and the shards' ranges.

    Every row, repeated ones too, gets a number of its own, which is written with
    it once and so stays when an executor is lost.  Rows are dealt by range over
    (shard, slot): a shard takes as many files as its size asks for, and every
    file covers one run of the curve.  ``{path}/_ranges`` holds ``shard_ranges``.
    """
    row, shard, slot = (_free(c, docs.columns) for c in ("__row", "shard", "__slot"))
    with scratch():
        numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
        q = dict(zip((_free(f"__{d}", docs.columns) for d in DIMENSIONS), quantised(docs)))
        keys = staged(placed(numbered.withColumns(q), shards, (row, *q)))
        ranges = shard_ranges(keys.withColumnsRenamed(dict(zip(q, (f"d_{d}" for d in DIMENSIONS)))), tuple(f"d_{d}" for d in DIMENSIONS))
        at = keys.select(row, F.col("shard").alias(shard), F.col("slot").alias(slot))
        dealt = numbered.join(at, row).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
        dealt.drop(row, slot).write.partitionBy(shard).parquet(path)
        ranges.withColumnRenamed("shard", shard).coalesce(1).write.parquet(f"{path}/_ranges")


def shard_ranges(placed_rows: DataFrame, dimensions: tuple[str, ...] = ()) -> DataFrame:
    """Rows, bytes, range of the curve and of each quantised dimension of every shard, for pruning."""
    ends = [f(d).alias(f"{name}_{d}") for d in ("hilbert", *dimensions) for name, f in (("min", F.min), ("max", F.max))]
    return placed_rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), *ends)


def read_sharded(spark: SparkSession, path: str, source: str | None = None, lang: str | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rows of a written table with a source, a language and a size (bytes plus 1, both ends included).

    Folders of shards whose ranges exclude the filter aren't read: the shards'
    numbers, as many as there are shards, become a partition filter.
    """
    ranges = spark.read.parquet(f"{path}/_ranges")
    shard = ranges.columns[0]
    docs = spark.read.parquet(path)
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1
    bucket = lambda v: F.pmod(F.xxhash64(F.lit(v)), F.lit(1 << BITS))
    level = lambda v: F.lit(min((1 << BITS) - 1, max(1, v).bit_length() - 1))
    for column, value in (("source", source), ("lang", lang)):
        if value is not None:
            ranges = ranges.where(bucket(value).between(F.col(f"min_d_{column}"), F.col(f"max_d_{column}")))
            docs = docs.where(F.col(column) == value)
    if sizes is not None:
        ranges = ranges.where((F.col("min_d_size") <= level(sizes[1])) & (F.col("max_d_size") >= level(sizes[0])))
        docs = docs.where(size.between(*sizes))
    return docs.where(F.col(shard).isin([r[0] for r in ranges.select(shard).collect()]))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


QUERIES = {"op2_hilbert_shards": op2_hilbert_shards}
