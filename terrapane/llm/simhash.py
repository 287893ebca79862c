"""SimHash near-duplicates by pigeonhole blocks (operator 9).

Fingerprints are made in one pass in Arrow batches.  Equal fingerprints are
merged first, so copies cost one row however many they are.  The remaining ones
are split into blocks: fingerprints that differ in at most k bits of b blocks
agree on at least b - k whole blocks, so each choice of b - k blocks is a table,
and a close pair shares a bucket of some table.  b is 5 for up to a million
fingerprints and grows with their number so that a bucket's expected size stays
under 256; the links found are the same for any b.

A bucket's rows meet in one task, sorted, and its pairs are compared as arrays;
what leaves is a spanning forest of the bucket's links, never all pairs.  A
bucket of over ``SPLIT`` rows is dealt into chunks, and each pair of chunks is
a group of its own.  Components then come from the links alone.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; fewer words than a shingle make one shingle; equal rows share a
component; a null doc_id counts as least; an empty table gives an empty result; extra columns are ignored by
the query and kept by ``deduplicated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import forgotten, scratch, staged, table
from terrapane.llm.components import components

SEED = 42
SPLIT = 2048
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Bits in which linked fingerprints may differ.
DISTANCE = 4

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another hash of 64 bits from each of ``h`` (SplitMix64's step)."""
    h = h + _GOLDEN
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, shingle: int, words: int = 1) -> bytes:
    """64 * ``words`` bits, big-endian; the first 64 from XXH64, the others mixed from it."""
    parts = text.encode().translate(_LOWER).split() if text else []
    if not parts:
        return bytes(8 * words)
    n = max(1, len(parts) - shingle + 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(parts)) - 1 :].tolist()
    ones = np.zeros((words, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], np.uint64)
        for k in range(words):
            if k:
                h = _mixed(h)
            ones[k] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > n, axis=1).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1) -> DataFrame:
    """doc_id, h (hash of the text) and f (fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = pa.array([fingerprint(t, shingle, words) for t in b.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), f], names=["doc_id", "h", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, f binary")


def exact_tables(fingerprints_: int, distance: int, bits: int = 64) -> list[tuple[tuple[int, int], ...]]:
    """Choices of blocks (start, end) such that pairs within ``distance`` share one's bits."""
    for b in range(distance + 1, 2 * distance + 4):
        cuts = [round(i * bits / b) for i in range(b + 1)]
        spans = list(zip(cuts, cuts[1:]))
        least = sum(sorted(e - s for s, e in spans)[: b - distance])
        if fingerprints_ <= 256 << least or b == 2 * distance + 3:
            return list(combinations(spans, b - distance))
    raise AssertionError


def _keyed(tables: list[tuple[tuple[int, int], ...]]):
    def keys(f: np.ndarray) -> Iterator[np.ndarray]:
        bits = np.unpackbits(f, axis=1)
        for t, spans in enumerate(tables):
            v = np.zeros(len(f), np.uint64)
            for s, e in spans:
                for k in range(s, e):
                    v = v << np.uint64(1) | bits[:, k]
            yield (v | np.uint64(t) << np.uint64(48)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("f")
            if len(col) == 0:
                continue
            f = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
            for k in keys(f):
                yield pa.RecordBatch.from_arrays([pa.array(k), b.column("node"), col], names=["key", "node", "f"])

    return run


def _forest(group: np.ndarray, f: np.ndarray, distances: tuple[int, ...]) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows of equal groups; rows are sorted by group.

    Distances are taken one after another, so closer pairs are linked first.
    Pairs are compared by their offset: all rows with the next, the one after
    that, and so on while groups are that large.
    """
    n = len(group)
    root = np.arange(n)
    out: list[tuple[int, int]] = []
    for distance in distances:
        at, step = np.arange(n), 1
        while True:
            at = at[at + step < n]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            far = np.zeros(len(at), np.uint16)
            for k in range(f.shape[1]):
                far += np.bitwise_count(f[at, k] ^ f[at + step, k])
            a = at[far <= distance]
            a = a[root[a] != root[a + step]]
            if len(a):
                root = _joined(root, a, step, out)
            step += 1
    return out


def _joined(root: np.ndarray, a: np.ndarray, step: int, out: list[tuple[int, int]]) -> np.ndarray:
    """Roots after linking each of ``a`` with the row ``step`` behind; links that join are kept in ``out``."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x in a.tolist():
        p, q = find(int(root[x])), find(int(root[x + step]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, x + step))
    renamed = np.arange(len(root))
    for x in list(parent):
        renamed[x] = find(x)
    return renamed[root]


def _groups(rows: pa.Table) -> np.ndarray:
    """One number for each group: rows are sorted by key, i, j."""
    k = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
    return np.concatenate(([0], np.cumsum((k[:, 1:] != k[:, :-1]).any(0))))


def _maps(rows: pa.Table) -> np.ndarray:
    raw = rows.column("f").to_pylist()
    return np.frombuffer(b"".join(raw), ">u8").reshape(len(raw), -1).astype(np.uint64)


def _ends(rows: pa.Table, pairs: list[tuple[int, int]]) -> pa.RecordBatch | None:
    if not pairs:
        return None
    node = rows.column("node").combine_chunks()
    return pa.RecordBatch.from_arrays([node.take(pa.array([p[side] for p in pairs])) for side in (0, 1)], names=["u", "v"])


def _linked(distances: tuple[int, ...]):
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if (found := _ends(rows, _forest(_groups(rows), _maps(rows), distances))) is not None:
            yield found

    return _by_group(work)


def _by_group(work):
    """What ``work`` yields of whole groups of rows, a batch's groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            held = rows if held is None else pa.concat_tables([held, rows])
            new = np.nonzero(np.diff(_groups(held)))[0] if held.num_rows else []
            if len(new):  # the last group may go on in the next batch
                cut = int(new[-1]) + 1
                yield from work(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held)

    return run


def dealt(keyed: DataFrame) -> DataFrame:
    """``keyed`` by key, in sorted groups (key, i, j): pairs of chunks where a key has over ``SPLIT`` rows."""
    columns = [c for c in keyed.columns if c != "key"]
    # written, so that its size is known and the keyed rows are dealt out once
    hot = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > SPLIT).select("key", F.ceil(F.col("c") / SPLIT).cast("int").alias("chunks")))
    if hot.isEmpty():
        rows = keyed.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), *columns)
    else:
        rows = keyed.join(hot, "key", "left").withColumn("c", F.coalesce(F.pmod(F.xxhash64("node"), "chunks"), F.lit(0)).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        rows = rows.select("key", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), *columns)
    # nodes in one order everywhere, so that the buckets of a group of copies give much the same forest
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def links(nodes: DataFrame, tables: list[tuple[tuple[int, int], ...]], *distances: int) -> DataFrame:
    """Links (u, v) that join what is within the last distance among ``nodes`` (node, f), closer ones first."""
    kind = nodes.schema["node"].dataType.simpleString()
    keyed = nodes.select("node", "f").mapInArrow(_keyed(tables), f"key long, node {kind}, f binary")
    return dealt(keyed).mapInArrow(_linked(distances), f"u {kind}, v {kind}")


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; fewer words make one."""
    parts = text.encode().translate(_LOWER).split() if text else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(parts[i : i + shingle]), SEED) for i in range(max(1, len(parts) - shingle + 1))], np.uint64))


def classes_of(rows: DataFrame) -> DataFrame:
    """f and its least struct (doc_id, h) of every different fingerprint."""
    return staged(rows.groupBy("f").agg(F.min(F.struct("doc_id", "h")).alias("first")))


def named(classes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``node`` and component (least struct (doc_id, h) of its root's classes) of every class."""
    rooted = staged(classes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)))
    # written, so that a large component is summed map-side first and isn't dealt out by its root
    firsts = staged(rooted.groupBy("root").agg(F.min("first").alias("component")))
    return rooted.join(firsts, "root").select(node, "component")


def grouped(rows: DataFrame, distance: int) -> DataFrame:
    """Components of ``rows`` under all links within ``distance`` of the whole fingerprint."""
    classes = classes_of(rows)
    found = links(classes.select(F.col("f").alias("node"), "f"), exact_tables(classes.count(), distance), distance)
    return named(classes, components(found), "f")


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 4 or fewer differing bits of 64, 4-word shingles."""
    rows = staged(fingerprints(table(spark, sf_dir, "documents"), shingle=4))
    with scratch():
        groups = staged(grouped(rows, distance=DISTANCE), lasting=True)
    return rows.join(groups, "f").select("doc_id", F.lower(F.hex("f")).alias("fingerprint"), F.col("component.doc_id").alias("component_id"))


#: Bits of the parity maps that travel with postings, by the set's size; documents looked at for common shingles, and in how many of them one is common.
LEVELS, LOOKED_AT, COMMON = (512, 1024, 2048), 10_000, 4
#: Shares of the greatest distance at which links are tried, closest first.
STEPS = (0.4, 0.7, 1.0)
#: Pairs that leave a task at once.
PAIRS = 1 << 16


def parity(s: np.ndarray, bits: int = LEVELS[0]) -> bytes:
    """Whether an odd number of the set's hashes falls on each bit.

    Two maps differ in at most as many bits as the sets have shingles that only
    one of them holds, so what they rule out is ruled out for sure.
    """
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide(n: int) -> int:
    """Bits of the parity map that tells sets of ``n`` shingles well apart."""
    return 1 << min(20, max(LEVELS[0].bit_length() - 1, (2 * n - 1).bit_length()))


def folded(raw: pa.Buffer, size: int) -> np.ndarray:
    """A parity map of so many bytes from one as long or longer (lengths are powers of two)."""
    m = np.frombuffer(raw, np.uint64)
    while m.nbytes > size:
        m = m[: len(m) // 2] ^ m[len(m) // 2 :]
    return m


def set_fingerprint(s: np.ndarray) -> bytes:
    """The 64 bits of ``fingerprint`` over a set of shingles, each counted once."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), CHUNK):
        ones += np.unpackbits(s[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(s)).tobytes()


def prefix(s: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, so many that each set at ``similarity`` has one of its own first ones among them.

    A partner shares at least similarity * n of n shingles.  The order is the
    same for all sets: by hash, and ``common`` ones (sorted, with ranks) last.
    """
    k = len(s) - math.ceil(similarity * len(s) - 1e-9) + 1
    if not len(common):
        return s[:k]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    last = common[at] == s
    rare = s[~last][:k]
    return rare if len(rare) == k else np.concatenate((rare, s[last][np.argsort(rank[at[last]])][: k - len(rare)]))


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts share, and their ranks, rarer ones first.

    They come from a bounded sample of different texts.  What it misses costs
    time and no link: any order of the shingles finds the same pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s, c = np.unique(np.concatenate([shingles(t.as_py(), shingle) for t in b.column("text")]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(c)], names=["s", "c"])

    share = min(1_000_000, math.ceil(LOOKED_AT * 1e6 / max(1, docs.count())))
    picked = docs.select("text", F.xxhash64("text").alias("h")).where(F.pmod("h", F.lit(1_000_000)) < share).dropDuplicates(["h"]).select("text")
    counted = picked.mapInArrow(run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON)
    with scratch():
        found = staged(counted).toArrow()
    s, c = found.column("s").to_numpy().view(np.uint64), found.column("c").to_numpy()
    by_count = np.lexsort((s, c))
    rank = np.empty(len(s), np.int64)
    rank[by_count] = np.arange(len(s))
    order = np.argsort(s)
    return s[order], rank[order]


def shingled(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, h (hash of the text), node (hash of its shingle set), n (its size), p (fingerprint), f (parity map), g (wide map) and keys (prefix) of every row."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, shingle))
    names = ["node", "n", "p", "f", "g", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, n, p, f, g, keys = [], [], [], [], [], []
            for t in b.column("text"):
                s = shingles(t.as_py(), shingle)
                node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                n.append(len(s))
                p.append(set_fingerprint(s))
                f.append(parity(s, next((b for b in LEVELS if 5 * b >= 3 * len(s)), LEVELS[-1])))
                g.append(parity(s, wide(len(s))))
                keys.append(prefix(s, similarity, *common.value).tobytes())
            made = [pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *(pa.array(x, pa.binary()) for x in (p, f, g, keys))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), *made], names=["doc_id", "h", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, node long, n int, p binary, f binary, g binary, keys binary")


def postings(classes: DataFrame) -> DataFrame:
    """(key, node, label, pos) for each shingle of a prefix, pos its place there, that classes (node, label, keys) of more than one label have in their own.

    A key with over ``SPLIT`` rows stays in any case, so that a task holds few.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("keys").to_pylist()
            times = [len(x) // 8 for x in raw]
            place = np.concatenate([np.arange(n, dtype=np.int64) for n in times] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(raw), np.int64)), *(pa.array(np.repeat(b.column(c).to_numpy(), times)) for c in ("node", "label")), pa.array(place)], names=POSTED)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((4, 0), np.int64)  # the rows of the last key, as the next batch may go on with it
        many = False  # whether those that went before them with this key had several labels
        for b in batches:
            if not b.num_rows:
                continue
            held = np.concatenate((held, np.stack([b.column(c).to_numpy() for c in POSTED])), axis=1)
            key, label = held[0], held[2]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.cumsum(first) - 1
            # rows are sorted by key and label
            several = np.zeros(group[-1] + 1, bool)
            several[0] = many
            several[group[1:][~first[1:] & (label[1:] != label[:-1])]] = True
            last = group == group[-1]
            keep = several[group] & ~last
            if several[-1] or last.sum() > SPLIT:  # its rows can go; one stays for its label
                many, keep[:-1] = True, keep[:-1] | last[:-1]
                rest = np.zeros(len(key), bool)
                rest[-1] = True
            else:
                many, rest = False, last
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in held], names=POSTED)
            held = held[:, rest]
        if many:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=POSTED)

    keyed = classes.select("node", "label", "keys").mapInArrow(each, POSTING).repartition("key").sortWithinPartitions("key", "label")
    return staged(keyed.mapInArrow(shared, POSTING))


POSTED = ["key", "node", "label", "pos"]
POSTING = ", ".join(f"{c} long" for c in POSTED)


def _candidates(group: np.ndarray, f: list[np.ndarray], size: np.ndarray, n: np.ndarray, pos: np.ndarray, label: np.ndarray, similarity: float, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal groups that sizes, places and parity maps let be similar, as index arrays.

    A spanning forest of them over the labels, closest first, or ``every`` pair of
    different labels.  In the bucket of the first shingle that two sets share, all
    they share lies from its place on, so as many shingles must be left in both.
    """
    _, root = np.unique(label, return_inverse=True)
    # a label's rows in different groups are apart
    _, root = np.unique(group * (root.max() + 1) + root, return_inverse=True)
    left = n - pos
    for share in (1.0,) if every else STEPS:
        at, step = np.arange(len(group)), 1
        while True:
            at = at[at + step < len(group)]
            at = at[group[at] == group[at + step]]
            if not len(at):
                break
            a = at[root[at] != root[at + step]]
            x, y = n[a], n[a + step]
            fits = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-9
            fits &= np.minimum(left[a], left[a + step]) >= similarity / (1 + similarity) * (x + y) - 1e-6
            a, most = a[fits], (share * (1 - similarity) / (1 + similarity) * (x + y) + 1e-6)[fits]
            for level, maps in zip(LEVELS, f):
                far = np.zeros(len(a), np.uint16)
                for k in range(maps.shape[1]):
                    far += np.bitwise_count(maps[a, k] ^ maps[a + step, k])
                near = (far <= most) | (np.minimum(size[a], size[a + step]) < level)
                a, most = a[near], most[near]
            if every:
                yield a, a + step
            elif len(a):
                found: list[tuple[int, int]] = []
                root = _joined(root, a, step, found)
                yield tuple(np.array(found, np.int64).reshape(-1, 2).T)
            step += 1


def _levels(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Parity maps at each of ``LEVELS``, zero where a row's own is shorter; and the rows' bits."""
    raw = [x.as_buffer() for x in rows.column("f")]
    size = np.fromiter((8 * len(x) for x in raw), np.int64, len(raw))
    out = [np.zeros((len(raw), bits // 64), np.uint64) for bits in LEVELS]
    for k, x in enumerate(raw):
        for maps in out:
            if len(x) >= maps.shape[1] * 8:
                maps[k] = folded(x, maps.shape[1] * 8)
    return out, size


def candidates(met: DataFrame, similarity: float, every: bool) -> DataFrame:
    """Different pairs (u, v), u < v, of ``met`` (key, node, pos, label, n, f); see ``_candidates``."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n, pos, label, node = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "label", "node"))
        held, size = [], 0
        for pair in _candidates(_groups(rows), *_levels(rows), n, pos, label, similarity, every):
            held.append(node[np.stack(pair)])
            size += held[-1].shape[1]
            if size >= PAIRS:
                yield ends(held)
                held, size = [], 0
        if size:
            yield ends(held)

    def ends(held: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.sort(np.concatenate(held, axis=1), axis=0), axis=1)  # u < v; each once
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])

    return dealt(met).mapInArrow(_by_group(work), "u long, v long").distinct()


def narrowed(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (u, v) without those that wide parity maps rule out.

    A map is a twelfth of its set's size or less, so nearly all false pairs go before a
    set is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("nu").to_numpy().astype(np.int64) + b.column("nv").to_numpy()
            far = np.zeros(len(n), np.int64)
            for k, (x, y) in enumerate(zip(b.column("gu"), b.column("gv"))):
                x, y = x.as_buffer(), y.as_buffer()
                size = min(len(x), len(y))
                far[k] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
            yield b.select(["u", "v"]).filter(pa.array(far <= (1 - similarity) / (1 + similarity) * n + 1e-6))

    at = lambda side: classes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("g").alias(f"g{side}"))
    return pairs.join(at("u"), "u").join(at("v"), "v").select("u", "v", "nu", "nv", "gu", "gv").mapInArrow(run, "u long, v long")


def packed_set(s: np.ndarray) -> bytes:
    """48 bits of each hash: two texts of 20,000 words have a shingle too many in common once in a million."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked_set(raw: pa.Buffer) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sets_of(nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """node and s, the shingle set of each of ``nodes`` (node, first: the row (doc_id, h) that stands for it).

    Texts that can't be among them are dropped by a bitmap of their hashes
    before any is dealt out.
    """
    wanted = nodes.select("node", F.col("first.h").alias("h"))
    n_bits = 1 << 25
    bits = np.zeros(n_bits // 8, np.uint8)
    at = wanted.select(F.pmod("h", F.lit(n_bits)).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()
    np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    packed = docs.sparkSession.sparkContext.broadcast(bits)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("h").to_numpy() & np.int64((1 << 25) - 1)
            yield b.filter(pa.array((packed.value[at >> 3] >> (7 - (at & 7))) & 1 == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([packed_set(shingles(t.as_py(), shingle)) for t in b.column("text")], pa.binary())], names=["node", "s"])

    # one of repeated texts, combined map-side
    texts = docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(some, "h long, text string").groupBy("h").agg(F.first("text").alias("text"))
    return staged(wanted.join(texts, "h").select("node", "text").mapInArrow(run, "node long, s binary"))


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (u, v) and ok: whether their sets are at least so similar (Jaccard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("su"), b.column("sv")):
                x, y = unpacked_set(x.as_buffer()), unpacked_set(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])

    at = lambda side: sets.select(F.col("node").alias(side), F.col("s").alias(f"s{side}"))
    return staged(pairs.join(at("u"), "u").join(at("v"), "v").select("u", "v", "su", "sv").mapInArrow(run, "u long, v long, ok boolean"), lasting=True)


def still_apart(slim: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``slim`` (key, node, pos) with their labels, where a key has several."""
    met = staged(slim.select("key", "node", "pos").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"))
    several = met.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    out = staged(met.join(several, "key"))
    forgotten(met)
    return out


def _relabelled(roots: DataFrame, more: DataFrame) -> DataFrame:
    """(node, root) of ``roots`` where each root has gone over to its own in ``more`` (node, root)."""
    by = more.select(F.col("node").alias("root"), F.col("root").alias("__to"))
    gone = roots.join(by, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
    return staged(gone.union(more.join(roots, "node", "left_anti").select("node", "root")))


def near_groups(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, h and component (least struct (doc_id, h)) of every row of ``docs`` under all links at ``similarity`` or more.

    Three searches, each confirmed on the shingle sets, so that no link is false:
    fingerprints that share a block and are within ``DISTANCE`` bits; a forest of
    the pairs that share a prefix's shingle and are still apart; and then every
    such pair that is still apart and wasn't tested, so that a false link hides
    no true one.
    """
    rows = staged(shingled(docs, shingle, similarity))
    members = staged(rows.select("doc_id", "h", "node"))
    whole = staged(rows.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("first"), *(F.min(c).alias(c) for c in ("n", "p", "f", "g", "keys"))))
    forgotten(rows)
    classes = staged(whole.select("node", "first", "n", "f", "g"))

    def checked(found: DataFrame) -> DataFrame | None:
        """The pairs (u, v) of ``found``, with ok."""
        with scratch():
            pairs = staged(narrowed(found, classes, similarity))
            if pairs.isEmpty():
                return None
            ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
            return compared(pairs, sets_of(classes.select("node", "first").join(ends, "node"), docs, shingle), similarity)

    def merged(roots: DataFrame, tested: DataFrame | None) -> DataFrame:
        """Roots after the confirmed links: components of the labels, which are far fewer than the nodes."""
        if tested is None:
            return roots
        label = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        sure = tested.where("ok").join(label("u"), "u", "left").join(label("v"), "v", "left")
        return _relabelled(roots, components(sure.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))))

    by_blocks = links(whole.select("node", F.col("p").alias("f")), exact_tables(whole.count(), DISTANCE), DISTANCE)
    tests = [checked(by_blocks.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())]
    none = docs.sparkSession.createDataFrame([], "node long, root long")
    roots = none if tests[0] is None else components(tests[0].where("ok").select("u", "v"))
    slim = postings(whole.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")))
    forgotten(whole)
    for every in (False, True):
        met = still_apart(slim, roots)
        if met.isEmpty():
            break
        found = candidates(met.join(classes.select("node", "n", "f"), "node"), similarity, every)
        for t in tests if every else ():
            found = found if t is None else found.join(t, ["u", "v"], "left_anti")
        tests.append(checked(found))
        roots = merged(roots, tests[-1])
    return members.join(named(classes.select("node", "first"), roots, "node"), "node")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one of least doc_id.

    Near copies are texts whose sets of shingles have this similarity (Jaccard)
    or more, and what they reach.  Texts of equal sets are one class.  The blocks
    of SimHash fingerprints find most links; as 64 bits can't tell 0.8 from less,
    what they leave apart is searched exactly by prefixes; the sets decide always.
    """
    with scratch():
        marked = near_groups(docs, shingle, similarity).select("doc_id", "h", F.struct("doc_id", "h").eqNullSafe(F.col("component")).alias("first"))
        keys = staged(marked.groupBy("doc_id", "h").agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("c")), lasting=True)
    gone = keys.where(~F.col("first")).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__h"))
    kept = docs.join(gone, same, "left_anti")
    if keys.where("first and c > 1").isEmpty():
        return kept
    # repeated rows: one of each stays
    return kept.withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")


QUERIES = {"op9_simhash_groups": op9_simhash_groups}
