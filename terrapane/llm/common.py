"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one in ``spark.checkpoint.dir``.

    Where that setting is absent, a temporary folder of this machine is taken,
    which only a local master can share with its executors; others are refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terrapane-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/terrapane-{uuid.uuid4().hex}"


#: For the writing of intermediate tables: shuffle files go when the write is done, and an
#: Arrow batch stays small whatever its rows hold.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

_held: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("held", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``staged`` writes within go at the end, but for ``lasting`` ones, which an outer ``scratch`` may end."""
    own: list[tuple[SparkSession, str]] = []
    token = _held.set((*_held.get(), own))
    try:
        yield
    finally:
        _held.reset(token)
        for spark, path in own:
            dropped(spark, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``staged`` wrote."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def forgotten(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df`` before its ``scratch`` ends."""
    dropped(df.sparkSession, df.inputFiles()[0].rsplit("/", 1)[0])


def staged(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage, and what was written outlives lost executors.  Within
    ``scratch`` it goes when that ends, unless it is ``lasting``; else it stays, as
    the DataFrame that is returned reads it.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    if holders := _held.get()[: -1 if lasting else None]:
        holders[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    An expression that a lambda takes from outside is evaluated again for each
    element; bound as a lambda's own argument it is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_array(values: list, kind: str) -> Column:
    """A constant array, without one expression per entry."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Running sums of an array of integers, exclusive; as long as the array.

    Appending to an array copies it, so sums are taken within blocks and then
    over the blocks' totals: n * block / 2 + (n / block)^2 / 2 steps.
    """

    def running(start: Column, part: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), F.lit(1), F.size(part))

    def blocks(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / F.lit(block)).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.slice(all_, k * block + 1, F.lit(block)))

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x))
        return let(running(F.lit(0).cast("long"), totals), lambda offs: F.flatten(F.zip_with(parts, offs, lambda p, o: running(o, p))))

    return let(lengths.cast("array<bigint>"), lambda a: let(blocks(a), whole))
