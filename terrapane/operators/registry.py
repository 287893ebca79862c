"""Registry maintenance: scan files, hash what is new, merge, write.

A scan lists paths alone.  The old registry joins it before any file is opened, so
an update reads new files only; ``force`` hashes all and keeps what changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.functions import grid
from terrapane.operators import catalog
from terrapane.sources.files import with_sha256

EMBEDDINGS, MASKS = "global_0.1_degree_representation", "global_0.1_degree_tiff_all"


def files(spark: SparkSession, root: str, pattern: str, content: bool = False, known: DataFrame | None = None, workers: int | None = None) -> DataFrame:
    """path (relative to ``root``) and, if asked for, sha256 of files in all folders below.

    Paths of ``known`` are left out before any file is read.  A listing takes no
    contents: ``binaryFile`` reads none where the column isn't used.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    # paths come back with a scheme; what follows the root's own name and a slash is relative
    base = root.split("://", 1)[-1].rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(base) + "/", "")
    rows = found.select(relative.alias("path"), F.col("path").alias("file"))
    rows = rows if known is None else new_paths(rows, known)
    return with_sha256(rows, "file", workers) if content else rows.select("path")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def hashed(rows: DataFrame, column: str, name: str = "hash") -> DataFrame:
    """SHA-256 of a string or binary column, in hex."""
    return rows.withColumn(name, F.sha2(F.col(column).cast("binary"), 256))


def new_paths(found: DataFrame, old: DataFrame) -> DataFrame:
    """Found files that the registry doesn't have."""
    return found.join(old, "path", "left_anti")


def stale_paths(found: DataFrame, old: DataFrame) -> DataFrame:
    """Found files that the registry doesn't have or has with another hash."""
    was = old.select("path", F.col("hash").alias("__old"))
    return found.join(was, "path", "left").where(~F.col("hash").eqNullSafe(F.col("__old"))).drop("__old")


def merged(old: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """path, hash and status of the registry after an update: new, changed, same or kept.

    Entries whose files are gone stay (``kept``) unless ``prune``.
    """
    a, b = old.select("path", F.col("hash").alias("__old")), new.select("path", F.col("hash").alias("__new"))
    both = a.join(b, "path", "full_outer")
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "kept").when(F.col("__old") != F.col("__new"), "changed").otherwise("same")
    out = both.select("path", F.coalesce("__new", "__old").alias("hash"), status.alias("status"))
    return out.where("status != 'kept'") if prune else out


def entries_by_file(entries: DataFrame, name: Column) -> DataFrame:
    """Registry files and their number of entries, for files of that form only."""
    return entries.withColumn("name", name).where(grid.is_registry_file(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def write_lines(entries: DataFrame, out: str, file: Column) -> list[str]:
    """Write sorted ``path hash`` lines, a file for each name; returns the names.

    Blocks are a few thousand lines each.  Spark writes one part for each name
    in a folder of its own; the parts are then moved to flat names by the Hadoop
    file system, so any store will do.
    """
    spark = entries.sparkSession
    line = F.concat_ws(" ", "path", "hash")
    staging = f"{out.rstrip('/')}/_staging"
    rows = entries.select(file.alias("__file"), line.alias("value"), "path").repartition("__file").sortWithinPartitions("__file", "path").drop("path")
    rows.write.mode("overwrite").partitionBy("__file").text(staging)
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for d in fs.listStatus(path(staging)):
        if d.isDirectory() and d.getPath().getName().startswith("__file="):
            name = jvm.java.net.URLDecoder.decode(d.getPath().getName()[len("__file=") :], "UTF-8")
            part = next(p.getPath() for p in fs.listStatus(d.getPath()) if p.getPath().getName().startswith("part-"))
            fs.delete(path(f"{out}/{name}"), False)
            fs.rename(part, path(f"{out}/{name}"))
            names.append(name)
    fs.delete(path(staging), True)
    return sorted(names)


def known(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path and hash of a registry's entries; of a repeated path the last line's."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        return spark.createDataFrame([], "path string, hash string")
    return catalog.last_wins(catalog.numbered_lines(spark, f"{folder}/{pattern}"), "at")


def _updated(spark: SparkSession, root: str, pattern: str, old: DataFrame, force: bool, checksum: bool, prune: bool, workers: int | None) -> DataFrame:
    """path, hash and status after a scan of ``root``."""
    if not checksum:
        names = files(spark, root, pattern).withColumn("hash", F.lit(None).cast("string"))
        return merged(old, names.join(old.select("path", F.col("hash").alias("__h")), "path", "left").select("path", F.coalesce("hash", "__h").alias("hash")), prune)
    if force:
        return merged(old, files(spark, root, pattern, content=True, workers=workers), prune)
    new = files(spark, root, pattern, content=True, known=old, workers=workers)
    if prune:  # known files that are still there keep their hash unread
        new = new.unionByName(old.join(files(spark, root, pattern), "path", "left_semi").select("path", "hash"))
    return merged(old, new, prune)


def update_embeddings(spark: SparkSession, base: str, registry: str | None = None, force: bool = False, checksum: bool = True, prune: bool = False, workers: int | None = None) -> DataFrame:
    """Bring the block registries of the embeddings up to date; returns what they hold."""
    registry = registry or f"{base}/{grid.REGISTRY_FOLDER}"
    now = _updated(spark, f"{base}/{EMBEDDINGS}", "*.npy", known(spark, registry, "registry_[0-9]*_lon*_lat*.txt"), force, checksum, prune, workers)
    at = catalog.scanned_arrays(now).cache()
    names = write_lines(at, registry, grid.block_file(F.col("year"), F.col("block_lon"), F.col("block_lat")))
    _write_names(spark, f"{registry}/registry_index.txt", names)
    return at


def update_masks(spark: SparkSession, base: str, registry: str | None = None, force: bool = False, checksum: bool = True, prune: bool = False, workers: int | None = None) -> DataFrame:
    """The same for land masks, which have no year."""
    registry = registry or f"{base}/{grid.REGISTRY_FOLDER}"
    now = _updated(spark, f"{base}/{MASKS}", "*.tiff", known(spark, registry, "registry_tiles_lon*_lat*.txt"), force, checksum, prune, workers)
    at = catalog.scanned_masks(now).cache()
    names = write_lines(at, registry, grid.tiles_block_file(F.col("block_lon"), F.col("block_lat")))
    _write_names(spark, f"{registry}/tiles_registry_index.txt", names)
    return at


def _write_names(spark: SparkSession, path: str, lines: list[str]) -> None:
    """One small file of a line for each registry file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
    out.close()


def write_master(spark: SparkSession, registry: str) -> DataFrame:
    """``registry.txt``: name and SHA-256 of every block registry; indexes are no entries."""
    found = files(spark, registry, "registry_*.txt", content=True).where(F.col("path").rlike(grid.BLOCK_FILE) | F.col("path").rlike(grid.TILES_BLOCK_FILE))
    rows = found.orderBy("path").collect()  # one row for each block file
    _write_names(spark, f"{registry}/registry.txt", [f"{r['path']} {r['hash']}" for r in rows])
    return found


def write_entries(spark: SparkSession, registry: str, out: str) -> None:
    """All block registries' entries in one file, in order of file and line.

    Blank lines and comments go.  One task merges the sorted lines: a line is some
    hundred bytes, and the file is one by definition.
    """
    lines = catalog.numbered_lines(spark, f"{registry}/registry_*_lon*_lat*.txt", raw=True)
    staging = f"{out.rstrip('/')}_staging"
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").coalesce(1).write.mode("overwrite").text(staging)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(p.getPath() for p in fs.listStatus(path(staging)) if p.getPath().getName().startswith("part-"))
    fs.delete(path(out), False)
    fs.rename(part, path(out))
    fs.delete(path(staging), True)


def update(spark: SparkSession, base: str, **options) -> DataFrame:
    """Both kinds where their folders exist, then the master."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for folder, go in ((EMBEDDINGS, update_embeddings), (MASKS, update_masks)):
        p = fs_path(f"{base}/{folder}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            go(spark, base, **options)
    return write_master(spark, options.get("registry") or f"{base}/{grid.REGISTRY_FOLDER}")


def listing(spark: SparkSession, registry: str) -> DataFrame:
    """Registry files and their entries; comments and blank lines don't count."""
    lines = spark.read.text(f"{registry}/registry_*.txt").select(F.btrim("value").alias("v"), F.col("_metadata.file_name").alias("name"))
    return lines.groupBy("name").agg(F.count_if((F.col("v") != "") & ~F.startswith("v", F.lit("#"))).alias("n")).orderBy("name")
