"""Secret scans (operator 6), all DataFrame expressions.

Fixed patterns find the known kinds.  What they miss is found by two character
Markov models, one of random strings and one of ordinary identifiers: a long
token whose log-likelihood ratio per transition is over a threshold is a secret
too.  Both are fitted to labelled samples: random strings in the usual
alphabets together with the values that the patterns find, against identifiers
and paths made of usual words together with the ordinary tokens of the same documents.  The documents that give samples are bounded by
``sample_rows``; they are picked by a hash over the whole table.

Positions come from a text's gaps (``split``) and matches, whose lengths
alternate, so that a text is read a few times however many spans it holds, and
only where a kind occurs at all.

Defined results: a null text is empty and has no spans; spans are whole matches
in code points; a Markov span within a base span is dropped, one that reaches
beyond it stays beside it; equal rows give equal spans; an empty table gives an empty result (the models then rest on
the made strings alone); extra columns are ignored by the query and kept by
``redact``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import let, literal_array, prefix_sums, table

# The patterns and the least lengths of their kinds.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
#: A rejected assignment still takes its place, so that what follows is found as after it.
ASSIGN_VALUE = 12


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, kind, end) of the pattern's matches that ``keep`` lets stand."""

    def build(gaps: Column, found: Column) -> Column:
        parts = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m"), m.alias("t")))

        def placed(p: Column) -> Column:
            starts = prefix_sums(F.transform(p, lambda x: x["g"] + x["m"]))
            all_ = F.zip_with(p, starts, lambda x, s: F.struct((s + x["g"]).alias("start"), F.lit(kind).alias("kind"), (s + x["g"] + x["m"]).alias("end"), x["t"].alias("t")))
            kept = F.filter(all_, lambda x: keep(x["t"])) if keep else all_
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))

        return let(parts, placed)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.struct(F.split(text, pattern, -1).alias("g"), found.alias("m")), lambda x: build(x["g"], x["m"]))


def none() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds, by start and then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_VALUE
    kinds = [
        F.when(text.rlike(ASSIGN), spans_of(text, ASSIGN, 0, value)).otherwise(none()),
        F.when(F.contains(text, F.lit("AKIA")), spans_of(text, ACCESS, 1)).otherwise(none()),
        F.when(text.rlike(HEX), spans_of(text, HEX, 2)).otherwise(none()),
    ]
    return F.array_sort(reduce(F.concat, kinds))


def transitions(token: Column) -> Column:
    """Row of the table for each pair of neighbouring characters."""
    n = len(ALPHABET) + 1
    code = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(code, lambda a: F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: x * n + y))


def made_strings(spark: SparkSession, rows: int) -> DataFrame:
    """Random strings, the same on every call, in hex, base 32, base 36, base 62 and base 64."""
    digest = lambda k: F.sha2(F.concat(F.lit(f"{k}:"), F.col("id").cast("string")), 512)
    base64 = F.base64(F.unhex(digest(1)))
    kinds = [F.substring(digest(0), 1, 40), F.substring(base64, 1, 40), F.upper(F.regexp_replace(base64, "[+/=]", "")), F.regexp_replace(F.base64(F.unhex(digest(2))), "[+/=]", ""), F.lower(F.regexp_replace(F.base64(F.unhex(digest(3))), "[+/=]", ""))]
    return spark.range(rows).select(F.explode(F.array(*kinds)).alias("token"))


# Words of which ordinary identifiers and paths are made.
WORDS = """access account action active address administration allow annotation application archive argument array assets
attribute average backup balance before binary body boundary branch browser buffer build button cache calculate category
channel character check client cluster code collection column command common compare component config connection constant
container content context control convert count create current customer data database date default delete description device
dictionary directory display document domain download dynamic element email enable encoding engine entity environment error
event example execute export expression extension factory feature field file filter first folder format forward frame function
general generate global graph group handler header height history host identifier image import index information initialize
input instance integer interface internal international invoice item journal javascript kernel keyboard language last layer
layout length level library license limit line link list listener loader local location lookup manager mapping message method
model module monitor name network node notification number object offset operation option order output overview package page
parameter parent parse partition path pattern performance period permission picture platform policy position predicate prefix
price process product profile project property protocol provider public query queue quick range reader receive record reference
region register release remote render report repository request require resource response result return review role route
sample schedule schema score screen search section select sequence server service session setting shape share signature size
source space standard start state static statistics status step storage stream string structure style subject summary support
switch symbol system table target task template temporary test text theme thread threshold time timeout title total trace
transaction transform tree trigger type unit update upload user utility validate value variable vector version view visible
volume warning wave web weight width window worker workflow write year zone""".split()


def made_ordinary(spark: SparkSession, rows: int) -> DataFrame:
    """Identifiers and paths, the same on every call, in snake, kebab, camel and Pascal case, capitals, as paths and with numbers; and rules of one character."""
    words = literal_array(WORDS, "string")
    word = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    a, b, c, d = (F.col(x) for x in "abcd")
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3000)).cast("string")
    kinds = [
        F.concat_ws("_", a, b, c),
        F.concat_ws("-", a, b, c, d),
        F.concat(a, F.initcap(b), F.initcap(c)),
        F.concat(F.initcap(a), F.initcap(b), F.initcap(c), F.initcap(d)),
        F.upper(F.concat_ws("_", a, b, c)),
        F.concat(a, F.lit("/"), b, F.lit("/"), c, F.lit("/"), F.initcap(d), F.initcap(a)),
        F.concat(F.lit("/"), a, F.lit("/"), b, F.lit("_"), c, F.lit("/"), d, number),
        F.concat(a, F.lit("_"), b, F.lit("_"), number),
        F.concat(b, F.lit("-"), number, F.lit("-"), c),
        F.repeat(F.substr(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), 24),
    ]
    return spark.range(rows).select("id", *(word(k).alias(x) for k, x in enumerate("abcd"))).select(F.explode(F.array(*kinds)).alias("token"))


def fit(docs: DataFrame, sample_rows: int = 2000, made_rows: int = 2000) -> list[float]:
    """The table of log-likelihood ratios, a row for each pair of characters.

    Add-one smoothing over the alphabet; the counts that reach the driver are
    at most two for each pair.  The made samples of either label keep the model
    usable for tables that have few tokens.
    """
    spark = docs.sparkSession
    total = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(min(1_000_000, math.ceil(sample_rows * 1e6 / max(1, total))))).select("text")
    values = picked.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(ASSIGN), F.lit(2))).alias("token")).where(F.length("token") >= ASSIGN_VALUE)
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), ASSIGN, " "), f"{ACCESS}|{HEX}", " ")
    ordinary = picked.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[A-Za-z][A-Za-z_-]{5,}"), F.lit(0))).alias("token"))
    labelled = values.union(made_strings(spark, made_rows)).withColumn("random", F.lit(True)).union(ordinary.union(made_ordinary(spark, made_rows)).withColumn("random", F.lit(False)))
    counts = labelled.select("random", F.explode(transitions(F.col("token"))).alias("pair")).groupBy("random", "pair").count().collect()
    n = len(ALPHABET) + 1
    seen = {True: [1.0] * (n * n), False: [1.0] * (n * n)}
    for r in counts:
        seen[r["random"]][r["pair"]] += r["count"]
    out = [0.0] * (n * n)
    for a in range(n):
        sums = {k: sum(v[a * n : a * n + n]) for k, v in seen.items()}
        for b in range(n):
            i = a * n + b
            out[i] = round(math.log(seen[True][i] / sums[True]) - math.log(seen[False][i] / sums[False]), 5)
    return out


def ratio(token: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    return let(transitions(token), lambda t: F.aggregate(t, F.lit(0.0), lambda a, x: a + F.get(model, x)) / F.greatest(F.lit(1), F.size(t)))


def all_spans(text: Column, model: list[float], threshold: float = 1.0) -> Column:
    """struct(base, all): spans by the patterns, and those with the model's added."""
    weights = literal_array(model, "double")
    secret = lambda m: ratio(m, weights) > threshold
    hit = F.exists(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), secret)

    def merged(base: Column) -> Column:
        clear = lambda m: ~F.exists(base, lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"]))
        more = F.when(hit, F.filter(spans_of(text, CANDIDATE, 3, secret), clear)).otherwise(none())
        return F.struct(base.alias("base"), F.array_sort(F.concat(base, more)).alias("all"))

    return let(base_spans(text), merged)


def joined(spans: Column) -> Column:
    names = literal_array(list(KINDS), "string")
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = 1.0) -> DataFrame:
    """doc_id, base and all: the spans of every row's whole text."""
    model = fit(docs) if model is None else model
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t")).select("doc_id", all_spans(F.col("t"), model, threshold).alias("s")).select("doc_id", "s.base", "s.all")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span's characters replaced; overlapping spans count as one."""

    def cut(s: Column) -> Column:
        # where the text goes on after each span: the greatest end so far
        ends = F.aggregate(s, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x["end"]))))
        return let(ends, lambda e: F.concat(F.array_join(F.transform(s, lambda x, i: F.when(x["start"] >= F.get(e, i), F.concat(F.substr(text, (F.get(e, i) + 1).cast("int"), (x["start"] - F.get(e, i)).cast("int")), F.lit(mask))).otherwise(F.lit(""))), ""), F.substr(text, (F.element_at(e, -1) + 1).cast("int"))))

    return F.when(F.size(spans) > 0, let(spans, cut)).otherwise(text)


def closed(text: Column, spans: Column) -> Column:
    """``spans`` with the closing quote of an assigned value whose opening quote is in its span."""

    def end(s: Column) -> Column:
        part = lambda at, n: F.substr(text, (at + 1).cast("int"), n.cast("int"))
        quote = F.regexp_extract(part(s["start"], s["end"] - s["start"]), r"""[:=]\x20*(["'])""", 1)
        return F.when((s["kind"] == 0) & (quote != "") & (quote == part(s["end"], F.lit(1))), s["end"] + 1).otherwise(s["end"])

    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), end(s).alias("end")))


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``docs`` with secrets masked in ``text``, quotes around an assigned value too; ``n_chars``, where present, follows."""
    model = fit(docs) if model is None else model
    text = F.col("text")
    new = F.when(text.isNull(), F.lit(None).cast("string")).otherwise(let(all_spans(text, model)["all"], lambda s: redacted(text, closed(text, s))))
    out = docs.withColumn("text", new)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_markov"))


QUERIES = {"op6_secret_spans": op6_secret_spans}
