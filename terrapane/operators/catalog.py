"""The catalogue of tiles: registries, paths, selections, listings.

Everything is lazy and JVM-side.  A catalogue carries ``block_lon`` and
``block_lat``, so that one written with ``partitioned`` prunes to the blocks of
a selection from the selection's own bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import grid

YEARS = range(2017, 2025)
SPACE = " \t\n\x0b\x0c\r"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """path and hash of registry lines; blank lines, comments and lines without a hash go.

    Other columns stay.
    """
    line = F.btrim(F.col(column), F.lit(SPACE))
    parts = F.split(line, " ", 2)
    rest = [c for c in lines.columns if c not in (column, "path", "hash")]
    return lines.where((line != "") & ~F.startswith(line, F.lit("#")) & (F.size(parts) == 2)).select(*rest, F.get(parts, 0).alias("path"), F.get(parts, 1).alias("hash"))


def read_registries(spark: SparkSession, root: str) -> DataFrame:
    """file, path and hash of every line of the block registries below ``root``."""
    lines = spark.read.text(f"{root}/registry_*.txt").select("value", "_metadata.file_name")
    return parse_lines(lines).withColumnRenamed("file_name", "file")


def read_master(spark: SparkSession, root: str) -> DataFrame:
    """Name and hash of every registry file; the first line of a repeated name counts."""
    return first_wins(numbered_lines(spark, f"{root}/registry.txt"), "at")


def numbered_lines(spark: SparkSession, files: str, raw: bool = False) -> DataFrame:
    """path, hash and ``at`` (file name, line number) of registry files' entries; ``raw``: value and ``at``.

    A file is read whole, as a block holds a few thousand lines, so a line's
    number is its place and not a matter of scheduling.
    """
    whole = spark.read.text(files, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    lines = lines.select(F.struct("file", "line").alias("at"), F.btrim("value", F.lit(SPACE)).alias("value")).where((F.col("value") != "") & ~F.startswith("value", F.lit("#")))
    return lines if raw else parse_lines(lines)


def last_wins(entries: DataFrame, order: str = "line_no") -> DataFrame:
    """One hash a path: the last of its lines."""
    return entries.groupBy("path").agg(F.max_by("hash", order).alias("hash"))


def first_wins(entries: DataFrame, order: str = "line_no") -> DataFrame:
    """One hash a path: the first of its lines."""
    return entries.groupBy("path").agg(F.min_by("hash", order).alias("hash"))


def with_hash(names: DataFrame, master: DataFrame, name: str = "name") -> DataFrame:
    """names with ``hash``, null where the master has none.

    A plain left join: Spark broadcasts the master if it is small enough.  The
    master's names differ, as ``read_master`` gives them.
    """
    return names.join(master.select(F.col("path").alias(name), "hash"), name, "left")


def block_names(files: DataFrame, name: str = "name") -> DataFrame:
    """year, block_lon and block_lat of the embedding registries among file names."""
    return files.withColumn("__b", grid.parsed_block_file(F.col(name))).where(F.col("__b").isNotNull()).select("*", "__b.year", "__b.block_lon", "__b.block_lat").drop("__b")


def with_blocks(tiles: DataFrame) -> DataFrame:
    return tiles.withColumns({"block_lon": grid.block_of(F.col("lon_c")), "block_lat": grid.block_of(F.col("lat_c"))})


def partitioned(tiles: DataFrame, path: str) -> None:
    """Write a catalogue by year and block."""
    with_blocks(tiles).repartition("year", "block_lon", "block_lat").write.mode("overwrite").partitionBy("year", "block_lon", "block_lat").parquet(path)


def in_block(tiles: DataFrame, year: int, lon_c: int, lat_c: int) -> DataFrame:
    """Tiles of the block that holds a point: a scan of one partition."""
    at = lambda c: c // (100 * grid.BLOCK) * grid.BLOCK
    return tiles.where((F.col("year") == year) & (F.col("block_lon") == at(lon_c)) & (F.col("block_lat") == at(lat_c)))


def within(tiles: DataFrame, bounds_c: tuple[int, int, int, int], year: int | None = None) -> DataFrame:
    """Tiles that overlap bounds (hundredths) with an area, after the blocks that can hold them."""
    w, s, e, n = bounds_c
    step = 100 * grid.BLOCK
    block = lambda c: c // step * grid.BLOCK
    if {"block_lon", "block_lat"} <= set(tiles.columns):
        tiles = tiles.where(F.col("block_lon").between(block(w - grid.CELL_C), block(e)) & F.col("block_lat").between(block(s - grid.CELL_C), block(n)))
    if year is not None:
        tiles = tiles.where(F.col("year") == year)
    lon, lat = F.col("lon_c"), F.col("lat_c")
    return tiles.where(grid.overlaps(lon, lat, lon + grid.CELL_C, lat + grid.CELL_C, *map(F.lit, (w, s, e, n))))


def scanned_arrays(paths: DataFrame, column: str = "path") -> DataFrame:
    """year, lon, lat and block of array files, scales among them, by their folders' names."""
    parts = F.split(column, "/")
    at = grid.parsed_grid_name(F.get(parts, F.size(parts) - 2))
    found = paths.where(F.endswith(column, F.lit(".npy")) & (F.size(parts) >= 2) & grid.is_year(F.get(parts, 0))).withColumn("__g", at).where(F.col("__g").isNotNull())
    return _blocks(found.withColumn("year", F.get(parts, 0).cast("int")))


def scanned_masks(paths: DataFrame, column: str = "path") -> DataFrame:
    """lon, lat and block of land masks, by their own names."""
    at = grid.parsed_grid_name(F.element_at(F.split(column, "/"), -1))
    return _blocks(paths.where(F.endswith(column, F.lit(".tiff"))).withColumn("__g", at).where(F.col("__g").isNotNull()))


def _blocks(found: DataFrame) -> DataFrame:
    block = lambda c: (F.floor(F.col(f"__g.{c}") / grid.BLOCK) * grid.BLOCK).cast("int")
    return found.select("*", "__g.lon", "__g.lat", block("lon").alias("block_lon"), block("lat").alias("block_lat")).drop("__g")


def parsed_embeddings(paths: DataFrame, column: str = "path") -> DataFrame:
    """year, lat and lon of the embedding arrays among registry paths; what doesn't parse goes."""
    parts = F.split(column, "/")
    year, at = F.get(parts, 0).try_cast("int"), grid.split_grid_name(F.get(parts, 1))
    shaped = F.endswith(column, F.lit(".npy")) & ~F.endswith(column, F.lit("_scales.npy")) & (F.size(parts) >= 3)
    return paths.where(shaped).select("*", year.alias("year"), at.alias("__g")).where(F.col("year").isNotNull() & F.col("__g").isNotNull()).select("*", "__g.lat", "__g.lon").drop("__g")


def parsed_masks(paths: DataFrame, column: str = "path") -> DataFrame:
    name = F.regexp_replace(column, r"\.tiff$", "")
    return paths.where(F.endswith(column, F.lit(".tiff"))).withColumn("__g", grid.split_grid_name(name)).where(F.col("__g").isNotNull()).select("*", "__g.lat", "__g.lon").drop("__g")


def years(tiles: DataFrame) -> DataFrame:
    """Years at hand in order; the usual ones for an empty catalogue."""
    found = tiles.select("year").distinct()
    usual = tiles.sparkSession.range(YEARS.start, YEARS.stop).select(F.col("id").cast("int").alias("year"))
    return found.union(usual.where(found.agg(F.count(F.lit(1))).scalar() == 0)).orderBy("year")


def coverage(tiles: DataFrame) -> DataFrame:
    return tiles.select("lat_c", "lon_c").distinct()


def counts(tiles: DataFrame, masks: DataFrame) -> DataFrame:
    """n_embeddings and n_masks in one row."""
    return tiles.agg(F.count(F.lit(1)).alias("n_embeddings")).withColumn("n_masks", masks.agg(F.count(F.lit(1))).scalar())


def listed(tiles: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("year", "lat_c", "lon_c")) -> DataFrame:
    """The first tiles in order (all for None or 0), and how many more there are.

    ``limit`` on an order is a top-k: each task keeps that many rows.
    """
    if limit is not None and limit < 0:
        raise ValueError("the limit is negative")
    first = tiles.orderBy(*order)
    if not limit:
        return first.withColumn("remaining", F.lit(0).cast("long"))
    total = tiles.agg(F.count(F.lit(1))).scalar()
    return first.limit(limit).withColumn("remaining", F.greatest(total - F.lit(limit), F.lit(0)).cast("long"))


def grouped_by_block(tiles: DataFrame, *keys: str) -> DataFrame:
    """Tiles of each block."""
    return tiles.groupBy(*keys, "block_lon", "block_lat").agg(F.count(F.lit(1)).alias("n"))


def block_range(w: Column, s: Column, e: Column, n: Column) -> Column:
    """array<struct(block_lon, block_lat)> of all blocks from one corner to another, longitude first."""
    return F.flatten(F.transform(grid.blocks_between(w, e), lambda x: F.transform(grid.blocks_between(s, n), lambda y: F.struct(x.alias("block_lon"), y.alias("block_lat")))))
