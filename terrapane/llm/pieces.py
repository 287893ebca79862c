"""Sampled SentencePiece segmentations (operator 7).

The lattice of a text has an arc for each piece of the vocabulary that occurs in
it, and for a character that is no piece an arc of its UTF-8 bytes' pieces.
Forward filtering sums the weights of all paths to each place; backward sampling
then walks from the end and draws each arc by its share, so a segmentation comes
up with exactly its share of all paths' weight.  The draws are seeded by the
row's key and the place: the same key and text give the same segmentation
anywhere.

A piece's weight is p^(1 / temperature) with p by rank, 1 / (rank + 10): the
vocabulary orders its pieces by frequency but stores no probabilities.  At a low
temperature few long pieces win; at a high one all paths come up.

No piece spans certain pairs of neighbouring characters, so the lattice falls
apart there into stretches.  All stretches of a batch are filtered and sampled
together as arrays, place by place; a long text is taken in parts that end
between stretches, so memory doesn't follow its length.  Spaces are written as
U+2581 and back; a U+2581 of the text itself goes through its bytes, so decoding
gives back every text whole.

Defined results: a null text stays null on both ways (no ids); an empty one has
no ids; equal keys and texts give equal ids, a null key counts as an empty one;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import table

VOCABULARY = "piece_bpe_32k.model"
TEMPERATURE = 1.0
SPACE = "▁"
#: Characters that are filtered together.
PART = 1 << 17
#: Weights are scaled by this for each character; it changes no share and keeps sums near 1.
SCALE = 16.0

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniforms(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each row's seed and place in it (SplitMix64)."""
    z = seed + (place.astype(np.uint64) + np.uint64(1)) * _GOLDEN
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(40)).astype(np.float64) / float(1 << 24)


class Table:
    """From 64-bit keys to small numbers, looked up for whole arrays; 0 where absent."""

    BITS = 20

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.key = [np.zeros(1 << self.BITS, np.uint64) for _ in range(2)]
        self.value = np.zeros((2, 1 << self.BITS), np.int32)
        self.turn = [_GOLDEN, np.uint64(0xC2B2AE3D27D4EB4F)]
        for level in range(2):
            while True:
                slot = self._slot(keys, level)
                _, first = np.unique(slot, return_index=True)
                if level == 0 or len(first) == len(keys):
                    break
                self.turn[1] = np.uint64((int(self.turn[1]) * 6364136223846793005 + 2) % (1 << 64))
            self.key[level][slot[first]] = keys[first]
            self.value[level][slot[first]] = values[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]

    def _slot(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys * self.turn[level]) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys, 0)
        out = self.value[0][slot]
        off = np.nonzero(self.key[0][slot] != keys)[0]
        if len(off):
            slot = self._slot(keys[off], 1)
            out[off] = np.where(self.key[1][slot] == keys[off], self.value[1][slot], 0)
        return out


class Codec:
    """Sampling encoder and decoder over one vocabulary."""

    _made: dict[tuple[str, float], "Codec"] = {}

    def __init__(self, path: str, temperature: float = TEMPERATURE) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.zeros(256, np.int32)
        self.raw: list[bytes] = []
        pieces, ids = [], []
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            self.raw.append(b"")
            if model.is_byte(i):
                self.bytes[int(p[1:-1], 16)] = i
                self.raw[i] = bytes([int(p[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append(p)
                ids.append(i)
                self.raw[i] = p.replace(SPACE, " ").encode()
        weight = (np.arange(len(pieces) + 1) + 10.0) ** (-1 / temperature)
        size = np.array([len(p) for p in pieces])
        self.longest = int(size.max())
        # entry k of pieces is value k + 1; 0 is no arc, the last one a character by its bytes
        self.weight = np.concatenate(([0.0], weight[:-1] * SCALE**size, [weight[-1] * SCALE]))
        self.id = np.array([0, *ids, 0], np.int32)
        self.by_bytes = len(pieces) + 1
        chars = sorted({c for p in pieces for c in p})
        self.index = np.zeros(0x110000, np.uint16)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.meet = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in pieces:
            for a, b in zip(p, p[1:]):
                self.meet[number[a], number[b]] = True
        self.index[ord(" ")] = self.index[ord(SPACE)]
        self.index[ord(SPACE)] = 0
        # a head's value: twice that of the piece it is, if any, and 1 if a longer piece starts with it
        heads: dict[str, int] = {}
        for k, p in enumerate(pieces):
            heads[p] = heads.get(p, 0) | (k + 1) << 1
            for e in range(1, len(p)):
                heads[p[:e]] = heads.get(p[:e], 0) | 1
        keys = np.array([self._key([number[c] for c in h]) for h in heads], np.uint64)
        assert len(np.unique(keys)) == len(keys)
        self.heads = Table(keys, np.array(list(heads.values()), np.int32))

    @staticmethod
    def _key(numbers: list[int]) -> int:
        h = 0
        for n in numbers:
            h = (h * 0x100000001B3 + n) & 0xFFFFFFFFFFFFFFFF
        return h

    @classmethod
    def of(cls, path: str, temperature: float) -> "Codec":
        """One for each worker process."""
        if (path, temperature) not in cls._made:
            cls._made[path, temperature] = cls(path, temperature)
        return cls._made[path, temperature]

    def _arcs(self, c: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each last character and length (less 1), the value of the piece there; ``left``: characters to the stretch's end."""
        arcs = np.zeros((len(c), self.longest), np.int32)
        at, h = np.arange(len(c)), c.astype(np.uint64)
        for size in range(1, self.longest + 1):
            v = self.heads.find(h)
            hit = np.nonzero(v > 1)[0]
            arcs[at[hit] + size - 1, size - 1] = v[hit] >> 1
            go = np.nonzero((v & 1).astype(bool) & (left[at] > size))[0]
            at = at[go]
            if not len(at):
                break
            h = h[go] * np.uint64(0x100000001B3) + c[at + size]
        arcs[arcs[:, 0] == 0, 0] = self.by_bytes
        return arcs

    def _filtered(self, arcs: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Cumulative shares of the arcs to each place; ``place``: characters before it in its stretch."""
        share = np.ones(arcs.shape, np.float32)
        total = np.ones(len(arcs))
        order = np.argsort(place.astype(np.uint16) if place.max(initial=0) < 1 << 16 else place, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(place))))
        for j in range(1, len(bounds)):
            p = order[bounds[j - 1] : bounds[j]]
            m = min(j, self.longest)
            before = total[p[:, None] - np.arange(1, m + 1)]
            if m == j:
                before[:, -1] = 1.0
            sums = np.cumsum(self.weight[arcs[p, :m]] * before, axis=1)
            total[p] = sums[:, -1]
            share[p, :m] = sums / sums[:, -1:]
            if j % 32 == 0:  # only shares count: keep the sums of a long stretch in range
                for k in range(self.longest - 1, -1, -1):
                    total[p - k] /= total[p]
        return share

    def _drawn(self, c: np.ndarray, new: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last characters and values of the arcs drawn; ``new``: where a stretch starts."""
        starts = np.nonzero(new)[0]
        ends = np.append(starts[1:], len(c))
        number = np.cumsum(new) - 1
        at = np.arange(len(c))
        place, left = at - starts[number], ends[number] - at
        arcs = self._arcs(c, left)
        share = self._filtered(arcs, place)
        value = np.zeros(len(c), np.int32)
        now = ends - 1
        while len(now):
            k = (share[now] <= u[now, None]).sum(1)
            value[now] = arcs[now, k]
            now = (now - k - 1)[place[now] > k]
        last = np.nonzero(value)[0]
        return last, value[last]

    def _cuts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters' numbers, and where a stretch starts."""
        c = self.index[codes]
        new = np.ones(len(c), bool)
        new[1:] = ~self.meet[c[:-1], c[1:]]
        return c, new

    def encode(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """Ids of a segmentation of each text, drawn from all of its."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        batch: list[tuple[int, np.ndarray, int]] = []
        size = 0
        for k, t in enumerate(texts):
            codes, at = np.frombuffer(t.encode("utf-32-le"), np.uint32), 0
            while at < len(codes):
                end = len(codes)
                room = PART
                while end - at > room:  # up to the last cut within reach, further if there is none
                    _, new = self._cuts(codes[at : at + room])
                    if (last := int(np.nonzero(new)[0][-1])) > 0:
                        end = at + last
                        break
                    room *= 2
                batch.append((k, codes[at:end], at))
                size += end - at
                at = end
                if size >= PART:
                    self._encode(batch, keys, out)
                    batch, size = [], 0
        if batch:
            self._encode(batch, keys, out)
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def _encode(self, batch: list[tuple[int, np.ndarray, int]], keys: list[str], out: list[list[np.ndarray]]) -> None:
        codes = np.concatenate([x for _, x, _ in batch])
        sizes = np.array([len(x) for _, x, _ in batch])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        c, new = self._cuts(codes)
        new[bounds[:-1]] = True
        seeds = np.repeat(np.array([xxhash.xxh64_intdigest(keys[k].encode()) for k, _, _ in batch], np.uint64), sizes)
        place = np.arange(len(codes)) - np.repeat(bounds[:-1] - np.array([at for _, _, at in batch]), sizes)
        last, value = self._drawn(c, new, uniforms(seeds, place))
        ids = self.id[value]
        raw = np.nonzero(value == self.by_bytes)[0]
        ids[raw] = self.bytes[np.minimum(codes[last[raw]], 127)]
        wide = raw[codes[last[raw]] > 127]
        if len(wide):  # a character beyond ASCII takes a piece for each of its bytes
            parts = [self.bytes[list(chr(x).encode())] for x in codes[last[wide]]]
            more = np.ones(len(ids), np.int64)
            more[wide] = [len(x) for x in parts]
            ends = np.cumsum(more)
            ids = np.repeat(ids, more)
            for w, x in zip(wide, parts):
                ids[ends[w] - len(x) : ends[w]] = x
            last = np.repeat(last, more)
        cuts = np.searchsorted(last, bounds)
        for (k, _, _), a, b in zip(batch, cuts, cuts[1:]):
            out[k].append(ids[a:b])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()


def _vocabulary(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def encoded(docs: DataFrame, vocabulary: str | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id and ids of every row."""
    path = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, temperature)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column("text").to_pylist()
                ids = codec.encode([t or "" for t in texts], [k or "" for k in b.column("k").to_pylist()])
                ids = [None if t is None else i for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("k")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids."""
    path = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, TEMPERATURE)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if i is None else codec.decode(i) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def sampled(docs: DataFrame, vocabulary: str | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 and lossless of every row: encoded and decoded again in one pass."""
    path = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, temperature)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column("text").to_pylist()
                ids = codec.encode([t or "" for t in texts], [k or "" for k in b.column("k").to_pylist()])
                n, crc = [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                ids = [None if t is None else i for t, i in zip(texts, ids)]
                same = [(None if x is None else codec.decode(x.tolist())) == t for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_pieces", "ids_crc32", "lossless"])

    return docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("k")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_pieces long, ids_crc32 long, lossless boolean")


def with_pieces(docs: DataFrame, vocabulary: str | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """doc_id, lang, source, ids and n_pieces of every row, and ``text`` decoded from the ids."""
    path = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, temperature)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = b.column("text").to_pylist()
                ids = codec.encode([t or "" for t in texts], [k or "" for k in b.column("k").to_pylist()])
                back = [None if t is None else codec.decode(i.tolist()) for t, i in zip(texts, ids)]
                cols = [pa.array([None if t is None else i for t, i in zip(texts, ids)], pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "source")), *cols], names=["doc_id", "lang", "source", "ids", "n_pieces", "text"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source"))
    return docs.select("doc_id", "lang", "source", "text", F.col("doc_id").cast("string").alias("k")).mapInArrow(run, f"{kinds}, ids array<int>, n_pieces long, text string")


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled(table(spark, sf_dir, "documents"))


QUERIES = {"op7_piece_sampling": op7_piece_sampling}
