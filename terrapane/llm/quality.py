"""Quality rules with host verdicts (operator 10), all DataFrame expressions.

Every document is measured in one pass over its own text, without exploding
words into rows.  The measures (no text) are written to the shared folder once;
failures are then summed by host with map-side combine, the hosts' rates are
shrunk by a beta prior that is fitted to all hosts by moments, and the verdicts
are joined back to the documents.  The join's small side is broadcast only if
Spark finds it under its own size threshold; past it, adaptive execution splits
a host that holds many rows.

Defined results: a null text has no words and fails; a null host is a host of
its own; repeated rows are measured and counted each; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import SPACES, let, staged, table

SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def repeated_words(words: Column) -> Column:
    """Words covered by a 3-word window that the text holds twice or more.

    Equal windows have equal hashes, so a text whose window hashes all differ
    has none; the others are settled on the windows' strings: sort, compare
    neighbours, mark three positions for each window that has an equal one.
    """

    def settle(w: Column) -> Column:
        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("p"))))

        def marks(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))))

        return let(windows, marks)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).when(let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(settle(w))

    return of(words)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the measures of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return docs.select(
        "doc_id",
        "source",
        let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    ).select("doc_id", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), F.col("l.n").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_failed(max_symbols_pct: int = 10, max_dup_lines_pct: int = 30, max_word_chars: int = 14) -> Column:
    """Failure of any rule: the base rules, symbols per word, repeated lines, long words."""
    return base_failed() | (100 * F.col("n_symbols") > max_symbols_pct * F.col("n_words")) | (100 * F.col("n_dup_lines") > max_dup_lines_pct * F.col("n_lines")) | (F.col("word_chars") > max_word_chars * F.col("n_words"))


def host_key() -> Column:
    """Keeps a null host apart from an empty name."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), F.col("source")))


def host_verdicts(measured: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, its failures, its shrunk failure rate and whether that is over ``max_rate``.

    Moments of the hosts' rates p give the prior: with mean m and variance v
    beyond what binomial sampling alone causes, alpha + beta = m (1 - m) / v - 1,
    kept within 1 and 1000.
    """
    hosts = staged(measured.groupBy(host_key().alias("host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(rule_failed().cast("long")).alias("host_failed")))
    rate = F.col("host_failed") / F.col("host_docs")
    row = hosts.agg(F.sum("host_failed").alias("k"), F.sum("host_docs").alias("n"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_docs")).alias("i")).first()
    mean = (row["k"] or 0) / max(1, row["n"] or 0)
    spread = max(1e-9, (row["v"] or 0.0) - mean * (1 - mean) * (row["i"] or 0.0))
    strength = min(1000.0, max(1.0, mean * (1 - mean) / spread - 1))
    shrunk = (F.col("host_failed") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk > max_rate).alias("host_bad"))


def judge(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """Measures and verdict of every row of ``docs`` (doc_id, text, source)."""
    measured = staged(measures(docs))
    verdicts = host_verdicts(measured, max_rate).select("host", "host_rate", "host_bad")
    joined = measured.withColumn("host", host_key()).join(verdicts, "host", "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(F.col("host_bad"), F.lit(False))).alias("kept"), F.round("host_rate", 6).alias("host_rate"))


def op10_quality_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


QUERIES = {"op10_quality_hosts": op10_quality_hosts}

_WS = "[\\x20\\x09-\\x0D]"
ORACLE = {
    "op10_quality_hosts": rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
p AS (SELECT rid, list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) > 2)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
r AS (SELECT rid, count(DISTINCT q) AS rep FROM (SELECT rid, unnest([i, i+1, i+2]) AS q FROM c WHERE n > 1) GROUP BY rid),
m AS (SELECT t.rid, t.doc_id, t.source, len(w) AS n_words, length(regexp_replace(text, '{_WS}', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, len(l) AS n_lines
      FROM t JOIN p USING (rid) LEFT JOIN r USING (rid)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
a AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR 100 * n_symbols > 10 * n_words
             OR 100 * n_dup_lines > 30 * n_lines OR word_chars > 14 * n_words) AS k FROM f GROUP BY source),
s AS (SELECT sum(k)::double / greatest(1, sum(n)) AS mean, coalesce(var_samp(k::double / n), 0) AS v, avg(1.0::double / n) AS i FROM a),
z AS (SELECT mean, least(1000, greatest(1, mean * (1 - mean) / greatest(1e-9, v - mean * (1 - mean) * i) - 1)) AS st FROM s),
h AS (SELECT source, (k + mean * st) / (n + st) AS rate FROM a, z)
SELECT f.doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols,
       n_dup_lines::bigint AS n_dup_lines, n_repeat_words::bigint AS n_repeat_words, base_failed,
       (NOT base_failed AND NOT rate > 0.5) AS kept, round(rate, 6) AS host_rate
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source
"""
}
