"""Benchmark decontamination by a generalised suffix automaton (operator 5).

The test items' words go into one suffix automaton; a document's words are
streamed through it, and the length of the longest match that ends at each word
is tracked.  Where the length reaches the window (10), the words of the match
are hit; an item shorter than the window counts where it occurs whole.

The automaton is built on the driver from blocks of items whose words stay under
``block_words``, so its size is bounded whatever the benchmark's size: each
block is one broadcast and one pass over the documents, and the passes' spans
are merged by document.  A benchmark under the bound takes one pass and no
shuffle at all.

Defined results: null and empty texts have no words and no hits; a null or empty
item has no window; items with equal texts or ids count each id once; repeated
documents are answered each; an empty table on either side gives no hits; extra
columns are ignored by the query and kept by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapane.llm.common import staged, table

WINDOW = 10
BLOCK_WORDS = 2_000_000

#: A-Z to a-z; every other ASCII character but digits and a-z to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` as UTF-8."""
    return text.encode().translate(_NORMAL).split() if text else []


class Automaton:
    """Suffix automaton over the word sequences of several items.

    State 0 is the root.  ``length`` and ``link`` are as usual; ``items`` has
    the items whose text holds the state's strings; ``ends`` the whole items of
    fewer words than the window among a state's strings, with their lengths; and
    ``short`` the nearest state with such items on the way of links, itself
    included.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.words: set[bytes] = set()
        items = [(i, w) for i, w in items if w]
        for _, w in items:
            last = 0
            for x in w:
                last = self._extend(last, x)
            self.words.update(w)
        self._label(items)

    def _state(self, length: int, next_: dict[bytes, int], link: int) -> int:
        self.length.append(length)
        self.next.append(next_)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, x: bytes) -> int:
        """The state of the string of ``p`` and ``x`` as its own longest one."""
        q = self.next[p][x]
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, x: bytes) -> int:
        if x in self.next[last]:
            return self._split(last, x)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p != -1 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p != -1:
            self.link[new] = self._split(p, x)
        return new

    def _label(self, items: list[tuple[str, list[bytes]]]) -> None:
        """Items of each state that stands for a whole window, and the short items."""
        n = len(self.length)
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        of: list[set[int]] = [set() for _ in range(n)]
        self.ends: dict[int, set[tuple[int, int]]] = {}
        for i, w in items:
            k, s = number[i], 0
            for x in w:
                v = s = self.next[s][x]
                while v > 0 and self.length[v] >= self.window and k not in of[v]:
                    of[v].add(k)
                    v = self.link[v]
            if len(w) < self.window:
                self.ends.setdefault(s, set()).add((len(w), k))
        self.items = [tuple(sorted(x)) for x in of]
        self.short = [0] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.short[s] = s if s in self.ends else self.short[self.link[s]]
        self.least = min([self.window, *(len(w) for _, w in items)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (merged, end exclusive) and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        known = self.words
        i, n = 0, len(words)
        marks = [w in known for w in words]
        while i < n:
            # windows lie within runs of words that some item has
            try:
                i = marks.index(True, i)
            except ValueError:
                break
            try:
                end = marks.index(False, i)
            except ValueError:
                end = n
            if end - i >= self.least:
                self._run(words, i, end, spans, found)
            i = end
        return spans, found

    def _run(self, words: list[bytes], start: int, end: int, spans: list, found: set[int]) -> None:
        step, link, length, window = self.next, self.link, self.length, self.window
        state, size = 0, 0
        for i in range(start, end):
            x = words[i]
            while state and x not in step[state]:
                state = link[state]
                size = length[state]
            if x in step[state]:
                state = step[state][x]
                size += 1
            hit = 0
            if size >= window:
                hit = size
                v = state
                while length[link[v]] >= window:
                    v = link[v]
                found.update(self.items[v])
            v = self.short[state]
            while v:
                for m, k in self.ends[v]:
                    if m <= size:
                        hit = max(hit, m)
                        found.add(k)
                v = self.short[link[v]]
            if hit:
                s = i + 1 - hit
                while spans and spans[-1][1] >= s:
                    s = min(s, spans.pop()[0])
                spans.append((s, i + 1))


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of at most ``block_words`` words (one item may exceed it)."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        w = words_of(r["text"])
        if not w:
            continue
        if block and size + len(w) > block_words:
            yield block
            block, size = [], 0
        block.append(("" if r["i"] is None else r["i"], w))
        size += len(w)
    yield block


FOUND = "n_words long, spans array<struct<s:int,e:int>>, items array<string>"
_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def _pass(docs: DataFrame, automaton) -> DataFrame:
    """One block's spans and items beside the columns of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for b in batches:
            n, spans, items = [], [], []
            for t in b.column("__text"):
                w = words_of(t.as_py())
                s, f = a.scan(w)
                n.append(len(w))
                spans.append([{"s": x, "e": y} for x, y in s])
                items.append([a.ids[k] for k in sorted(f)])
            keep = [c for c in b.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))], names=[*keep, "n_words", "spans", "items"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__text")
    return docs.mapInArrow(scan, f"{kept}, {FOUND}")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans and items of every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    built = [sc.broadcast(Automaton(b, window)) for b in blocks(benchmark, block_words)]
    if len(built) == 1:
        return _pass(docs.select("doc_id", F.col("text").alias("__text")), built[0])
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.col("text").alias("__text"))
    parts = [_pass(rows, a) for a in built]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # repeated rows come once from each pass: their number is the passes' share
    merged = union.groupBy("doc_id", "h", "n_words").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count(F.lit(1)).alias("c"))
    each = merged.withColumn("c", F.explode(F.sequence(F.lit(1), (F.col("c") / len(built)).cast("int"))))
    return each.select("doc_id", "n_words", _merged("spans").alias("spans"), "items")


def _merged(name: str):
    """Spans sorted, and joined where they touch."""
    empty = F.array().cast("array<struct<s:int,e:int>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e"))))
    return F.aggregate(F.array_sort(F.col(name)), empty, lambda acc, x: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] >= x["s"]), joined(acc, x)).otherwise(F.concat(acc, F.array(x))))


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["e"] - s["s"]))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the hit spans, and without rows hit on over ``max_coverage`` of their words.

    A span is cut from its first word's first character to its last word's last;
    the rest of the text stays as it was.  ``n_chars``, where present, follows.
    Spans of all blocks are found on the text as it came; it is judged and cut once.
    """
    sc = docs.sparkSession.sparkContext
    schema, automaton = docs.schema, None
    for b in blocks(benchmark, block_words):
        if automaton is not None:  # written, so that a task holds one automaton at a time
            docs = staged(_noted(docs, automaton))
        automaton = sc.broadcast(Automaton(b, window))
    return _cut(docs, automaton, max_coverage, schema)


def _found(a: Automaton, words: list[bytes], before: list[dict] | None) -> list[tuple[int, int]]:
    """The automaton's spans of hit words, merged with those of the blocks before."""
    spans, _ = a.scan(words)
    if not before:
        return spans
    out: list[tuple[int, int]] = []
    for s, e in sorted([*spans, *((x["s"], x["e"]) for x in before)]):
        if out and out[-1][1] >= s:
            s, e = out[-1][0], max(out.pop()[1], e)
        out.append((s, e))
    return out


def _noted(docs: DataFrame, automaton) -> DataFrame:
    """``docs`` with the spans of hit words so far in ``__spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for b in batches:
            before = b.column("__spans").to_pylist() if "__spans" in b.schema.names else [None] * b.num_rows
            spans = [[{"s": s, "e": e} for s, e in _found(a, words_of(t), x)] for t, x in zip(b.column("text").to_pylist(), before)]
            keep = [c for c in b.schema.names if c != "__spans"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(spans, _SPAN)], names=[*keep, "__spans"])

    return docs.mapInArrow(run, T.StructType([*docs.drop("__spans").schema, T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))]))


def _cut(docs: DataFrame, automaton, max_coverage: float, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton.value
        for b in batches:
            before = [None] * b.num_rows
            if "__spans" in b.schema.names:
                before = b.column("__spans").to_pylist()
                b = b.drop_columns(["__spans"])
            keep, texts, cut = [], [], []
            for t, x in zip(b.column("text").to_pylist(), before):
                w = words_of(t)
                spans = _found(a, w, x)
                keep.append(not spans or sum(e - s for s, e in spans) <= max_coverage * len(w))
                cut.append(bool(spans and keep[-1]))
                texts.append(without(t, spans) if cut[-1] else t)
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in b.schema.names:
                i = b.schema.get_field_index("n_chars")
                n = pa.array([len(t) if new else c for t, new, c in zip(texts, cut, b.column("n_chars").to_pylist())], b.schema.field(i).type)
                b = b.set_column(i, "n_chars", n)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters of the words in ``spans``."""
    raw = text.encode()
    flat = raw.translate(_NORMAL)
    bounds, at = [], 0
    for w in flat.split():
        at = flat.index(w, at)
        bounds.append((at, at + len(w)))
        at += len(w)
    out, done = [], 0
    for s, e in spans:
        out.append(raw[done : bounds[s][0]])
        done = bounds[e - 1][1]
    out.append(raw[done:])
    return b"".join(out).decode()


QUERIES = {"op5_decontaminate": op5_decontaminate}

_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = {
    "op5_decontaminate": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_W}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_W}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM g),
x AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
      FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
m AS (SELECT rid, x.k, i, item_id FROM x JOIN g ON x.k = g.k AND x.g = g.g),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, k, i FROM m)) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id::varchar, ',' ORDER BY item_id::varchar)) AS sha
      FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""
}
