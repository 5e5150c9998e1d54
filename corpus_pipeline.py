"""A training-data pipeline over the documents table.

Quality rules, site-relative line removal, near-duplicates, personal data and
packing follow each other. Every stage reads what its predecessor has written,
works on all of it, and all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import linededup, neardup, packing, pii, quality
from textmill.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.select("doc_id", "text", "lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


#: Rejected ids up to which they are sent to every task instead of shuffling the texts.
BROADCAST_IDS = 1 << 20


def _without(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among the rejected ones (doc_id, kept). The
    ids are written and counted; beyond ``BROADCAST_IDS`` both sides are
    shuffled by doc_id."""
    rejected = materialize(judged.filter(~F.col("kept")).select("doc_id").distinct(), "rejected")
    if rejected.count() <= BROADCAST_IDS:
        rejected = F.broadcast(rejected)
    return _documents(docs.join(rejected, "doc_id", "left_anti"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, quality.judge(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(linededup.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of five words, similarity 0.8; the smallest doc_id of a group stays."""
    return _without(docs, neardup.classify(docs, width=5, percent=80))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    return _documents(pii.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Tokens and min-hash signatures have no SQL; tests/llm holds the rows against a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep, as ``packing.pack`` gives
    them. A null or empty text fails the quality rules; repeated rows stay
    together through every stage but the near-duplicates', which keeps or drops
    all rows of a doc_id; columns that documents does not have are left out; an
    empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
