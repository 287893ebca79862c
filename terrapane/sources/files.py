"""Files by the paths that Spark lists, opened within tasks.

``binaryFile`` holds a whole file in one row.  Here a task opens the file itself
and reads it in pieces, so only the files asked for are read, none passes through
a shuffle, and memory doesn't follow a file's size.  Local, HDFS, S3 and Google
storage paths are known (``pyarrow.fs``).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

PIECE = 4 << 20  # bytes read at once


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, with or without a scheme, and the file's name in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, name = rest.removeprefix("//").partition("/")
    system, top = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{host}/")
    return system, f"{top.rstrip('/')}/{name}"


def opened(path: str) -> pa.NativeFile:
    """A file to read."""
    system, name = store(path)
    return system.open_input_file(name)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and host that Spark takes it to have, so that tasks and the driver mean the same file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def written(rows: DataFrame, out: str, name: str = "name", data: str = "data") -> DataFrame:
    """Write each row's bytes to ``{out}/{name}`` within tasks; one row, ``n``, for each batch.

    A file is written beside its place and moved there, so a task that is run
    again, or twice at once, leaves whole files alone.
    """
    base = qualified(rows.sparkSession, out).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = store(base)
        folders = set()
        for b in batches:
            for n, content in zip(b.column(name), b.column(data)):
                path = f"{top}/{n.as_py()}"
                folder = path.rsplit("/", 1)[0]
                if folder not in folders:
                    system.create_dir(folder, recursive=True)
                    folders.add(folder)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as f:
                    f.write(content.as_buffer())
                system.move(part, path)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select(name, data).mapInArrow(run, "n long")


def sha256(path: str) -> str:
    digest = hashlib.sha256()
    with opened(path) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def with_sha256(rows: DataFrame, file: str = "file", workers: int | None = None) -> DataFrame:
    """``rows`` (path, ``file``) as path and hash; ``file`` is where the file lies.

    ``workers`` is the number of tasks to read in; without it the rows are dealt
    evenly over the shuffle partitions.  A row is two short strings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = [sha256(p.as_py()) for p in b.column(file)]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(hashes, pa.string())], names=["path", "hash"])

    n = workers or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("path", file).repartition(n).mapInArrow(run, "path string, hash string")
