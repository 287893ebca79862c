"""New tiles as a stream: files are hashed as they arrive and added to a registry table.

The table is Parquet in folders.  A batch writes its own entries alone (``c`` and
its number); every ``COMPACT`` batches all entries are merged into a version
(``v`` and the number), and folders that the version before it had already
merged are removed.  A batch that is run again after a failure writes the same
folders again, and folders without their marker count for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrapane.operators import registry
from terrapane.sources import files

COMPACT = 50  # batches between versions, so that a reader opens that many folders at most


def arrivals(spark: SparkSession, root: str, pattern: str = "*.npy") -> DataFrame:
    """path below ``root`` and file of files as they come; contents aren't read."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split("://", 1)[-1].rstrip("/")
    return found.select(F.regexp_replace(F.col("path"), "^.*?" + registry._quoted(base) + "/", "").alias("path"), F.col("path").alias("file"))


def _folders(spark: SparkSession, table: str, kind: str) -> list[int]:
    """Numbers of the finished folders of a kind."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(table).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(new(table))] if fs.exists(new(table)) else []
    return sorted(int(n[1:]) for n in names if n[:1] == kind and n[1:].isdigit() and fs.exists(new(f"{table}/{n}/_SUCCESS")))


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """path and hash after all batches, or after those before a number; of a path the last batch counts."""
    within = lambda n: before is None or n < before
    base = max(filter(within, _folders(spark, table, "v")), default=-1)
    parts = [(f"{table}/v{base}", base)] if base >= 0 else []
    parts += [(f"{table}/c{n}", n) for n in _folders(spark, table, "c") if n > base and within(n)]
    out = spark.createDataFrame([], "path string, hash string, batch long")
    for path, n in parts:
        out = out.unionByName(spark.read.schema("path string, hash string").parquet(path).withColumn("batch", F.lit(n).cast("long")))
    return out.groupBy("path").agg(F.max_by("hash", "batch").alias("hash"))


def _dropped(spark: SparkSession, table: str, merged: int) -> None:
    """Remove what the version ``merged`` holds, but for itself."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    fs = new(table).getFileSystem(spark._jsc.hadoopConfiguration())
    for kind, last in (("v", merged - 1), ("c", merged)):
        for n in _folders(spark, table, kind):
            if n <= last:
                fs.delete(new(f"{table}/{kind}{n}"), True)


def keep_registry(spark: SparkSession, root: str, table: str, checkpoint: str, pattern: str = "*.npy", once: bool = True) -> StreamingQuery:
    """Start the stream; with ``once`` it ends when all files at hand are in."""

    def batch(df: DataFrame, number: int) -> None:
        here = df.sparkSession
        files.with_sha256(df.dropDuplicates(["path"])).write.mode("overwrite").parquet(f"{table}/c{number}")
        if (number + 1) % COMPACT == 0:
            # the version before stays until this one is whole; a reader of it may still be at work
            older = [n for n in _folders(here, table, "v") if n < number]
            current(here, table, number + 1).write.mode("overwrite").parquet(f"{table}/v{number}")
            if older:
                _dropped(here, table, older[-1])

    writer = arrivals(spark, root, pattern).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
