"""A corpus from raw documents: five stages, each an operator of ``terrapane.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before
kept and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``:

1. ``language``: rows that language ID rejects go; the model learns from the
   input's own labels, without the held-out third.
2. ``near_dedup``: one row of each group of near copies stays (5-word shingles,
   a similarity of 0.8 or more).
3. ``decontaminate``: benchmark passages (10 words or more) are cut out; rows
   that are mostly such passages go.
4. ``secrets``: secrets are masked.
5. ``pieces``: texts become sampled pieces, from which ``text`` is decoded again.

Rows with null texts go in stage 1.  Stages 1 to 4 return the columns of their
input; stage 5 returns doc_id, lang, source, ids, n_pieces and the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm import decontam, language, pieces, secrets, simhash
from terrapane.llm.common import forgotten, scratch, staged, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_pieces(docs)


STAGES = [
    ("language", identify),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("pieces", encode_pieces),
]

#: Centroids, XXH64 and sampling have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before = docs
        with scratch():
            docs = staged(stage(spark, before, sf_dir), lasting=True)
        if k:
            forgotten(before)
    return docs
