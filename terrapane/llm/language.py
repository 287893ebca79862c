"""Language identification by nearest centroids (operator 3).

A text is a vector of hashed character 1-, 2- and 3-grams (lower case; what is
no letter is a space), weighted by TF-IDF and normalised.  Each language has
several centroids, found by spherical k-means on its labelled texts; a text gets
the language of the centroid with the greatest cosine.  A text is rejected when
it is farther from its centroid than nearly all training texts of the language
and of its length are from theirs: under the ``reject_quantile`` of their cosines,
less ``slack``, and under ``ceiling`` in any case, so that texts of a very even
training set don't make a rule of its evenness.  Short texts have low cosines
whatever their language, so thresholds are learned by the number of different
grams, from the training texts and from excerpts of them; a length of which
there are under ``LEAST`` examples takes the threshold of the next shorter one.

The fit takes at most ``train_rows`` labelled rows (one a language if there are
more languages), picked by a hash over all of them and evenly over the languages,
repeated rows once; their vectors (not texts) come to the driver, 6 bytes for each
different gram, and are spread out (DIMS x 4 bytes) for one language at a time.
The model, a few hundred kB, is broadcast.  Prediction is one pass in Arrow batches with no shuffle; a text is
counted in pieces, so memory doesn't follow the longest one.

Defined results: ``und`` with score 0 for null, empty and letterless texts,
which are rejected too, and for every text if there is nothing to learn from;
rows with null labels are not learned from; equal texts get equal answers; ties
between centroids go to the language first by name; extra columns are ignored by
the query and kept by ``filtered``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import table

DIMS = 4096
#: Characters that are counted at once.
PIECE = 1 << 20
#: Lengths of excerpts that thresholds are learned from, and the least number of examples of a length.
EXCERPTS, LEAST = tuple(1 << k for k in range(2, 12)), 30

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER


def counts(text: str) -> np.ndarray | None:
    """Hashed 1- to 3-gram counts of a text; None without a letter."""
    out, any_ = np.zeros(DIMS, np.float64), False
    for at in range(0, len(text), PIECE):
        # two characters more on the right, so that no gram is lost at a cut
        c = np.frombuffer(text[at : at + PIECE + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        any_ = any_ or bool(letter.any())
        c = np.where(letter, c, np.uint32(32))
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for g in (one, two, three):
            out += np.bincount(g[: PIECE] >> np.uint32(20), minlength=DIMS)
    return out if any_ else None


def log_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 1 + log(count), zero where none; and which texts have a letter."""
    x, has = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), bool)
    for k, t in enumerate(texts):
        c = counts(t) if t else None
        if c is not None:
            has[k] = True
            x[k] = np.log1p(c)
    return x, has


def lengths(grams: np.ndarray | int) -> np.ndarray | int:
    """Class of a number of different grams: its binary order."""
    return np.floor(np.log2(np.maximum(grams, 1))).astype(int)


def normalised(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMS), np.float32))
    owner: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Least cosine by language and length
    least: np.ndarray = field(default_factory=lambda: np.zeros((0, lengths(DIMS) + 1), np.float32))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and cosine of the nearest centroid of each row of log counts."""
        near = normalised(x * self.idf) @ self.centroids.T
        best = near.argmax(1)
        return self.owner[best], near[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines and whether each text is rejected."""
        x, has = log_counts(texts)
        if not self.languages or not len(texts):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        lang, near = self.nearest(x)
        score = np.where(has, np.clip(near, 0, 1), 0).astype(np.float64)
        return [self.languages[k] if ok else "und" for k, ok in zip(lang, has)], score, ~has | (score < self.least[lang, lengths((x > 0).sum(1))])


def _spread(places: list[np.ndarray], values: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors from the places and log counts of each text, with no second array of that size."""
    x = np.zeros((len(places), DIMS), np.float32)
    for row, place, value in zip(x, places, values):
        row[place] = value
    for at in range(0, len(x), 256):
        x[at : at + 256] = normalised(x[at : at + 256] * idf)
    return x


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; seeds are the texts farthest from those before, so no chance is involved."""
    k = min(k, len(x))
    seeds = [int((x @ normalised(x.mean(0, keepdims=True))[0]).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < k:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        mine = (x @ c.T).argmax(1)
        c = np.stack([x[mine == j].sum(0) if (mine == j).any() else c[j] for j in range(k)])
        c = normalised(c)
    return c


def fit(docs: DataFrame, train_rows: int = 4000, centroids: int = 4, reject_quantile: float = 0.001, slack: float = 0.1, ceiling: float = 0.5) -> Model:
    """Learn from ``text`` and non-null ``lang`` of at most ``train_rows`` rows of ``docs``."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000))
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(hashed).alias("low")).collect()  # one row for each language
    if not sizes:
        return Model()
    share = max(1, train_rows // len(sizes))
    # every language gives a row at least; a constant map, so that no text is dealt out for it
    cuts = json.dumps({r["lang"]: float(max(1e9 * share / r["n"], r["low"] + 1)) for r in sizes})
    cut = F.from_json(F.lit(cuts), "map<string,double>")[F.col("lang")]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, has = log_counts(b.column("text").to_pylist())
            rows = np.nonzero(has)[0]
            places = [np.nonzero(x[r])[0].astype("<u2") for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("lang").take(pa.array(rows)), pa.array([p.tobytes() for p in places], pa.binary()), pa.array([x[r, p].tobytes() for r, p in zip(rows, places)], pa.binary()), b.column("h").take(pa.array(rows))], names=["lang", "places", "values", "h"])

    picked = labelled.select("lang", "text", hashed.alias("h")).where(F.col("h") < cut).dropDuplicates(["lang", "h"])
    # Arrow batches, as rows would be unpacked in the JVM and pickled on their way
    found = picked.mapInArrow(vectors, "lang string, places binary, values binary, h long").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    lang = np.array(found.column("lang").to_pylist(), object)
    model = Model(sorted(set(lang)))
    if not len(lang):
        return model
    places, values = ([np.frombuffer(v, kind) for v in found.column(c).to_pylist()] for c, kind in (("places", "<u2"), ("values", "<f4")))
    del found
    model.idf = (np.log((1 + len(lang)) / (1 + np.bincount(np.concatenate(places), minlength=DIMS))) + 1).astype(np.float32)
    parts, owner = [], []
    for k, name in enumerate(model.languages):
        mine = np.nonzero(lang == name)[0]
        c = _clusters(_spread([places[r] for r in mine], [values[r] for r in mine], model.idf), centroids)
        parts.append(c)
        owner += [k] * len(c)
    model.centroids, model.owner = np.concatenate(parts).astype(np.float32), np.array(owner)
    model.least = thresholds(picked, model, reject_quantile, slack, ceiling)
    return model


def thresholds(picked: DataFrame, model: Model, reject_quantile: float, slack: float, ceiling: float) -> np.ndarray:
    """Least cosine with a language's own centroids, by language and length, from texts and excerpts of ``picked`` (lang, text)."""
    shared = picked.sparkSession.sparkContext.broadcast(model)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {v: k for k, v in enumerate(m.languages)}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                # excerpts from one place each, the later ones further on in the text
                cut = [text[at : at + n] for k, n in enumerate(EXCERPTS) if n < len(text) for at in [k * (len(text) - n) // len(EXCERPTS)]]
                x, has = log_counts([*cut, text])
                x = x[has]
                if lang in number and len(x):
                    mine = (normalised(x * m.idf) @ m.centroids[m.owner == number[lang]].T).max(1)
                    yield pa.RecordBatch.from_arrays([pa.array([number[lang]] * len(x), pa.int32()), pa.array(lengths((x > 0).sum(1)), pa.int32()), pa.array(mine, pa.float32())], names=["lang", "length", "cosine"])

    found = picked.select("lang", "text").mapInArrow(examples, "lang int, length int, cosine float").toArrow()
    lang, length, cosine = (found.column(c).to_numpy() for c in ("lang", "length", "cosine"))
    least = np.full((len(model.languages), lengths(DIMS) + 1), -1.0, np.float32)
    for k in range(len(model.languages)):
        for n in range(least.shape[1]):
            those = cosine[(lang == k) & (length == n)]
            least[k, n] = min(ceiling, float(np.quantile(those, reject_quantile)) - slack) if len(those) >= LEAST else least[k, max(n - 1, 0)]
    return least


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                lang, score, out = shared.value.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predicted(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def filtered(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    model = fit(docs.where(~held_out())) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield b.filter(pa.array(~shared.value.predict(b.column("text").to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op3_language_centroids": op3_language_centroids}
