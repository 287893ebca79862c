"""Edit-aware token counts (operator 1).

Each document keeps a segment tree over its pre-tokens: leaves hold a pre-token's
characters and tokens, inner nodes their sums.  An edit finds its place by going
down the tree, re-splits the text from the last pre-token that the edit cannot
have reached until the new bounds meet the old ones again, re-encodes only what
lies between, and updates the sums above.  Pre-tokens are encoded on their own
by byte-level BPE, so the total is that of encoding the edited text anew.

Trees are built and edited in Arrow batches, one document at a time, without a
shuffle; a tree travels as a binary column, so later edits need no full count.

Defined results: a null text counts as empty and has an empty tree; edits are
applied in order, each in the coordinates of the text as it then is, with
offsets cut to its length; a null edit list is an empty one; equal rows give
equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"
EDITS = "array<struct<start:int,end:int,text:string>>"
#: Pre-tokens in a leaf block; a block over twice that is split.
LEAF = 64
#: A pre-token's end depends on at most so many characters behind it.
CONTEXT = 2
#: Pre-tokens whose counts a worker remembers.
REMEMBERED = 500_000


class Counter:
    """Tokens of pre-tokens under one vocabulary."""

    _made: dict[str, "Counter"] = {}

    def __init__(self, path: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> "Counter":
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        out = list(map(known.get, pieces))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
            for p in {p for p, n in zip(pieces, out) if n is None}:
                known[p] = len(self.encoding.encode_ordinary(p))
            out = [known[p] if n is None else n for p, n in zip(pieces, out)]
        return out


class Tree:
    """Segment tree over blocks of pre-tokens."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars = [chars[i : i + LEAF] for i in range(0, len(chars), LEAF)] or [[]]
        self.tokens = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]]
        self._sums()

    def _sums(self) -> None:
        """All inner sums from the blocks."""
        n = 1
        while n < len(self.chars):
            n *= 2
        self.n = n
        self.csum = [0] * n + [sum(b) for b in self.chars] + [0] * (n - len(self.chars))
        self.tsum = [0] * n + [sum(b) for b in self.tokens] + [0] * (n - len(self.tokens))
        for i in range(n - 1, 0, -1):
            self.csum[i] = self.csum[2 * i] + self.csum[2 * i + 1]
            self.tsum[i] = self.tsum[2 * i] + self.tsum[2 * i + 1]

    @classmethod
    def build(cls, text: str, counter: Counter) -> "Tree":
        pieces = counter.pattern.findall(text)
        return cls(list(map(len, pieces)), counter.counts(pieces))

    @property
    def total(self) -> int:
        return self.tsum[1]

    @property
    def leaves(self) -> int:
        return sum(map(len, self.chars))

    def locate(self, at: int) -> tuple[int, int, int]:
        """Block, leaf within it and first character of the leaf that holds character ``at``."""
        if at >= self.csum[1]:
            b = len(self.chars) - 1
            return b, len(self.chars[b]), self.csum[1]
        i, start = 1, 0
        while i < self.n:
            i *= 2
            if at >= start + self.csum[i]:
                start += self.csum[i]
                i += 1
        b = i - self.n
        for k, c in enumerate(self.chars[b]):
            if at < start + c:
                return b, k, start
            start += c
        raise AssertionError

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """The edited text, and the number of pre-tokens that were encoded."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        out = text[:start] + new + text[end:]
        grown = len(new) - (end - start)
        b0, k0, first = self.locate(max(0, start - CONTEXT - 1))
        b, k, old = b0, k0, first  # the old bound that is looked at, before leaf k of block b
        pieces: list[str] = []
        at = first
        for m in counter.pattern.finditer(out, first):
            if at >= start + len(new):
                while old < at - grown or old < end:
                    if b == len(self.chars) or old >= len(text):
                        break
                    if k >= len(self.chars[b]):
                        b, k = b + 1, 0
                        continue
                    old += self.chars[b][k]
                    k += 1
                if old == at - grown and old >= end:
                    break
            pieces.append(m[0])
            at = m.end()
        else:
            b, k = len(self.chars) - 1, len(self.chars[-1])
        self._replace(b0, k0, b, k, list(map(len, pieces)), counter.counts(pieces))
        return out, len(pieces)

    def _replace(self, b0: int, k0: int, b1: int, k1: int, chars: list[int], tokens: list[int]) -> None:
        """Leaves from (b0, k0) to (b1, k1) give way to new ones; sums above are updated."""
        for blocks, new in ((self.chars, chars), (self.tokens, tokens)):
            whole = blocks[b0][:k0] + new + (blocks[b1][k1:] if b1 < len(blocks) else [])
            blocks[b0] = whole
            for b in range(b0 + 1, min(b1 + 1, len(blocks))):
                blocks[b] = []
        if len(self.chars[b0]) > 2 * LEAF:
            for blocks in (self.chars, self.tokens):
                w = blocks[b0]
                blocks[b0 : b0 + 1] = [w[i : i + LEAF] for i in range(0, len(w), LEAF)]
            self._sums()
            return
        for b in range(b0, min(b1 + 1, len(self.chars))):
            i = self.n + b
            self.csum[i], self.tsum[i] = sum(self.chars[b]), sum(self.tokens[b])
            while i > 1:
                i //= 2
                self.csum[i] = self.csum[2 * i] + self.csum[2 * i + 1]
                self.tsum[i] = self.tsum[2 * i] + self.tsum[2 * i + 1]

    def dump(self) -> bytes:
        """Characters and tokens of all leaves, in the least width that holds them."""
        flat = np.array([[c for b in self.chars for c in b], [t for b in self.tokens for t in b]], np.uint32)
        wide = flat.size and int(flat.max()) > 255
        return bytes([bool(wide)]) + flat.astype("<u4" if wide else "u1").tobytes()

    @classmethod
    def load(cls, data: bytes) -> "Tree":
        flat = np.frombuffer(data, "<u4" if data[0] else "u1", offset=1).reshape(2, -1).tolist()
        return cls(*flat)


def _vocabulary(path: str | None) -> str:
    return path or public_tokenizers.path(VOCABULARY)


def trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, tree and n_tokens of every row."""
    path = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for b in batches:
            made = [Tree.build(t or "", counter) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array([t.dump() for t in made], pa.binary()), pa.array([t.total for t in made], pa.int64())], names=["doc_id", "text", "tree", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, tree binary, n_tokens long")


def _applied(text: str | None, tree: Tree, edits: list[dict] | None, counter: Counter) -> tuple[str, int]:
    text, encoded = text or "", 0
    for e in edits or []:
        text, n = tree.edit(text, e["start"] or 0, e["end"] or 0, e["text"] or "", counter)
        encoded += n
    return text, encoded


def edited(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows of ``trees`` with a column ``edits``: text, tree and count after them."""
    path = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for b in batches:
            texts, dumps, totals, encoded = [], [], [], []
            for t, d, e in zip(*(b.column(c).to_pylist() for c in ("text", "tree", "edits"))):
                tree = Tree.load(d)
                t, n = _applied(t, tree, e, counter)
                texts.append(t)
                dumps.append(tree.dump())
                totals.append(tree.total)
                encoded.append(n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), pa.array(dumps, pa.binary()), pa.array(totals, pa.int64()), pa.array(encoded, pa.int64())], names=["doc_id", "text", "tree", "n_tokens", "n_encoded"])

    return rows.select("doc_id", "text", "tree", F.col("edits").cast(EDITS)).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, tree binary, n_tokens long, n_encoded long")


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Build and edit in one pass, for rows with ``edits``: counts before and after."""
    path = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for b in batches:
            out = []
            for t, e in zip(b.column("text").to_pylist(), b.column("edits").to_pylist()):
                tree = Tree.build(t or "", counter)
                before, leaves = tree.total, tree.leaves
                t, n = _applied(t, tree, e, counter)
                out.append((leaves, before, len(e or []), tree.leaves, tree.total, n, len(t)))
            cols = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text", F.col("edits").cast(EDITS)).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("n_pretokens", "n_tokens", "n_edits", "n_pretokens_after", "n_tokens_after", "n_encoded", "n_chars_after")


def stated_edits() -> Column:
    """Three edits that follow from a row's id and length: a replacement, an insertion and a removal."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n.cast("long") + 1).cast("int")
    one = lambda k, size, text: F.struct(at(k).alias("start"), (at(k) + size).alias("end"), F.lit(text).alias("text"))
    return F.array(one(1, 12, "revised wording"), one(2, 0, " (see note 7)\n"), one(3, 40, ""))


def op1_token_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents").withColumn("edits", stated_edits()))


QUERIES = {"op1_token_tree": op1_token_tree}
