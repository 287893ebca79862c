"""Token-id files with a shared zstandard dictionary (operator 8).

Format.  A store is a folder with two Parquet tables, so that Spark's committer
makes each write whole or absent and any file system that Spark reads will do:

* ``dictionary``: one row of dictionary bytes, their SHA-256, the id's width in
  bytes and the compression level;
* ``segments``: rows of about a megabyte.  A segment has the number of its part
  and its place there, the ids of its documents, for each the number of tokens
  and the offset of its frame in ``blob``, the tokens of the part before it, and
  the dictionary's hash.

Every document is a zstandard frame of its own, compressed with the shared
dictionary, so one document is read by taking one segment (``first_id`` and
``last_id`` prune files, row groups and segments) and one slice of its blob.

Steps: a bounded sample of rows, picked by a hash, gives the dictionary; all
texts are encoded and compressed in one pass; frames, about a third of the
text's size, are range-partitioned by doc_id and, where one id has very many
rows, by their places in that pass's output; parts are sorted and written as
segments.  A document's start is the tokens before it in its part and the
parts before; the driver sums one number for each part.

Encoding: pre-tokens are encoded on their own, so each worker remembers the ids of
a bounded number of pieces.  Texts of ASCII and Latin letters are cut into
pre-tokens; in others a space before a character that is surely no white space
always starts one, and what lies between two such places is a piece.

Defined results: a null text is empty and holds just the end id; equal ids stand
in any order; a null doc_id comes first; an empty table makes an empty store;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from terrapane.llm.common import literal_array, shared_folder, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
LEVEL = 3
SEGMENT_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
#: Pieces whose ids a worker remembers at least.
REMEMBERED = 400_000

#: In texts of these characters alone, the tokenizer's pre-tokens are those of
#: ``_ATOMS``, its own pattern with the classes written out.
_UNSURE = re.compile("[^\n -~À-ÖØ-öø-ÿ]")
_ATOMS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-/:-@\\[-`{-~]+|[ \n]+(?![!-~À-ÿ])|[ \n]+")
#: Elsewhere, a space before a letter or sign of the common blocks starts a pre-token.
_SURE = re.compile("(?= [!-~¡-ᙿ])")


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in byte-level BPE: itself if it prints, else the next one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: b if b in shown else next(rest) for b in range(256)}


class Memory:
    """Ids of pieces, of which the last used ``most`` at least and twice as many at most are kept."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> tuple[list[bytes | None], list[int]]:
        """Ids of each piece, and the places of those that aren't known."""
        out, gaps, k = list(map(self.new.get, keys)), [], -1
        for _ in range(out.count(None)):
            k = out.index(None, k + 1)
            if (v := self.old.get(keys[k])) is None:
                gaps.append(k)
            else:
                out[k] = self.new[keys[k]] = v
        return out, gaps

    def put(self, made: dict[str, bytes]) -> None:
        self.new.update(made)
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


class Encoder:
    """Ids of texts as bytes of fixed width."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16 or sys.byteorder == "big"
        self.dtype = np.dtype("<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2")
        self.model, self.signs = self.tokenizer.model, _byte_signs()
        self.known = Memory(REMEMBERED)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _stored(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes() if self.wide else array("H", ids).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids by the whole tokenizer."""
        out: list[bytes] = []
        for at in range(0, len(texts), 4096):  # encodings take far more memory than ids
            out += [self._stored(e.ids) for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def _merged(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are one pre-token each, by its model alone."""
        tokenize = self.model.tokenize
        return [self._stored([t.id for t in tokenize(p.encode().decode("latin1").translate(self.signs))]) for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        odd = ["|>" in t or _UNSURE.search(t) is not None for t in texts]
        cut = [_SURE.split(t) if o else _ATOMS.findall(t) for t, o in zip(texts, odd)]
        found = list(map(self.known.find, cut))
        made: dict[str, bytes] = {}
        for kind, learn in ((False, self._merged), (True, self._whole)):
            new = list({pieces[k] for pieces, (_, gaps), o in zip(cut, found, odd) if o is kind for k in gaps if pieces[k] not in made})
            made.update(zip(new, learn(new)))
        for pieces, (ids, gaps) in zip(cut, found):
            for k in gaps:
                ids[k] = made[pieces[k]]
        self.known.put(made)
        return [b"".join(ids) for ids, _ in found]


def _vocabulary(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def _groups(texts: list, most: int = 1 << 18) -> Iterator[slice]:
    """Slices of about ``most`` characters."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def train_dictionary(docs: DataFrame, path: str, sample_rows: int = 1000, sample_bytes: int = 8 << 20) -> bytes:
    """A dictionary from the ids of about ``sample_rows`` rows; empty if they are too few to train on."""
    total = docs.count()
    share = min(1_000_000, math.ceil(sample_rows * 1e6 / max(1, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(encoder.encode([t or "" for t in b.column("text").to_pylist()]), pa.binary())], names=["ids"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).orderBy(F.xxhash64("doc_id")).limit(2 * sample_rows)
    samples, size = [], 0
    for r in picked.select("text").mapInArrow(run, "ids binary").toLocalIterator():
        if r["ids"] and size < sample_bytes:
            samples.append(bytes(r["ids"]))
            size += len(samples[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}


def write_store(docs: DataFrame, out: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id, text) into a store at ``out``, in ascending order of doc_id."""
    spark, path = docs.sparkSession, _vocabulary(vocabulary)
    docs = docs.select("doc_id", "text")
    data = train_dictionary(docs, path)
    digest = hashlib.sha256(data).hexdigest()
    width = Encoder(path).dtype
    spark.createDataFrame([(digest, bytearray(data), width.itemsize, LEVEL)], "dict_sha256 string, dictionary binary, id_bytes int, level int").coalesce(1).write.parquet(f"{out}/dictionary")
    shared = spark.sparkContext.broadcast(data)
    kind = docs.schema["doc_id"].dataType

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = Encoder.of(path), zstandard.ZstdCompressor(level=LEVEL, **_dictionary(shared.value))
        end = np.array([end_id], width).tobytes()
        for whole in batches:
            texts = [t or "" for t in whole.column("text").to_pylist()]
            for part in _groups(texts):
                ids = [x + end for x in encoder.encode(texts[part])]
                yield pa.RecordBatch.from_arrays([whole.column("doc_id")[part], pa.array([len(x) // width.itemsize for x in ids], pa.int32()), pa.array([press.compress(x) for x in ids], pa.binary())], names=["doc_id", "n", "frame"])

    staging = shared_folder(spark)
    docs.mapInArrow(frames, T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.IntegerType()), T.StructField("frame", T.BinaryType())])).write.option("compression", "none").parquet(staging)
    staged = spark.read.parquet(staging)
    segment = T.StructType.fromDDL("part int, place int, ahead long, n_docs int, n_ids long, dict_sha256 string, counts array<int>, offsets array<int>, blob binary")
    for name in ("first_id", "last_id"):
        segment.add(name, kind)
    segment.add("ids", T.ArrayType(kind))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, ahead = TaskContext.get().partitionId(), 0, 0
        ids, counts, frames_, size = [], [], [], 0

        def made() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames_]))).tolist()
            row = {"part": part, "place": place, "ahead": ahead, "n_docs": len(ids), "n_ids": sum(counts), "dict_sha256": digest, "counts": list(counts), "offsets": offsets, "blob": b"".join(frames_), "first_id": ids[0], "last_id": ids[-1], "ids": list(ids)}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for b in batches:
            if arrow is None:
                k = b.schema.field("doc_id").type
                arrow = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("ahead", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("dict_sha256", pa.string()), ("counts", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("blob", pa.binary()), ("first_id", k), ("last_id", k), ("ids", pa.list_(k))])
            for i, n, f in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "frame"))):
                ids.append(i)
                counts.append(n)
                frames_.append(f)
                size += len(f)
                if size >= SEGMENT_BYTES:
                    yield made()
                    place, ahead = place + 1, ahead + sum(counts)
                    ids, counts, frames_, size = [], [], [], 0
        if ids:
            yield made()

    # rows of one id, or without any, may fill several parts: a row's place in the written table deals them
    dealt = staged.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange("doc_id", "deal").sortWithinPartitions("doc_id", "deal")
    dealt.drop("deal").mapInArrow(segments, segment).write.option("compression", "none").parquet(f"{out}/segments")


def opened(spark: SparkSession, store: str) -> tuple[DataFrame, bytes, np.dtype, str]:
    """Segments, dictionary bytes, id type and dictionary hash of a store."""
    row = spark.read.parquet(f"{store}/dictionary").first()
    data = bytes(row["dictionary"])
    if hashlib.sha256(data).hexdigest() != row["dict_sha256"]:
        raise ValueError("the dictionary doesn't have its hash")
    return spark.read.parquet(f"{store}/segments"), data, np.dtype(f"<u{row['id_bytes']}"), row["dict_sha256"]


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    segments, data, dtype, digest = opened(spark, store)
    sizes = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.max(F.col("ahead") + F.col("n_ids")).alias("n")).collect()}  # one row for each part
    bases, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        bases.append(total)
        total += sizes.get(part, 0)
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(**_dictionary(shared.value))
        for b in batches:
            for row in b.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("a segment was made with another dictionary")
                starts, crcs, at = [], [], row["first"]
                for n, s, e in zip(row["counts"], row["offsets"], row["offsets"][1:]):
                    ids = np.frombuffer(unpress.decompress(row["blob"][s:e]), dtype)
                    if len(ids) != n:
                        raise ValueError("a frame doesn't have its number of ids")
                    starts.append(at)
                    at += n
                    crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], b.schema.field("ids").type.value_type), pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = segments.schema["first_id"].dataType.simpleString()
    first = F.get(literal_array(bases or [0], "bigint"), F.col("part")) + F.col("ahead")
    return segments.select(first.alias("first"), "ids", "counts", "offsets", "blob", "dict_sha256").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def fetched(spark: SparkSession, store: str, doc_id) -> list[list[int]]:
    """Ids of the documents with this id: the segments that can hold it, and their frames alone."""
    segments, data, dtype, _ = opened(spark, store)
    unpress = zstandard.ZstdDecompressor(**_dictionary(data))
    place = F.array_position("ids", F.lit(doc_id).cast(segments.schema["first_id"].dataType)) - 1
    # a segment that starts with rows without an id may hold others behind them
    near = segments.where((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)).withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.col("n_docs") - 1), lambda i: F.get("ids", i) == doc_id))).where(place >= 0)
    frame = F.substring("blob", F.get("offsets", F.col("k")) + 1, F.get("offsets", F.col("k") + 1) - F.get("offsets", F.col("k")))
    return [np.frombuffer(unpress.decompress(bytes(r["f"])), dtype).tolist() for r in near.select(frame.alias("f")).collect()]


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shared_folder(spark)
    write_store(table(spark, sf_dir, "documents"), store)
    return read_store(spark, store)


QUERIES = {"op8_token_store": op8_token_store}
