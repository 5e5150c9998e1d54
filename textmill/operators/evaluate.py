"""Retrieval and answer metrics over labelled queries, and their gate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embed import Embedder
from . import answer, search
from .index import Index

KEYS = ("recall_at_k", "precision_at_k", "mrr")
TOLERANCE = 1e-9


def relevant_ranks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, query, rel_doc and the rank of the first hit in the labelled
    document, 0 without one."""
    first = hits.join(queries.select("query_id", "rel_doc"), "query_id").filter(F.col("rel_path") == F.col("rel_doc")).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return queries.join(first, "query_id", "left").select("query_id", "query", "rel_doc", F.coalesce("rank", F.lit(0)).alias("rank"))


def retrieval_metrics(ranks: DataFrame, k: int) -> DataFrame:
    """n_queries, recall_at_k, precision_at_k and mrr; all 0 without queries.
    One document is relevant to a query, so precision is at most 1 / k."""
    if k <= 0:
        raise ValueError("k has to be positive")
    hit = (F.col("rank") > 0).cast("double")
    inverse = F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)
    found = ranks.agg(F.count(F.lit(1)).alias("n_queries"), F.avg(hit).alias("r"), F.avg(inverse).alias("m"))
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return found.select("n_queries", value(F.col("r")).alias("recall_at_k"), value(F.col("r") / k).alias("precision_at_k"), value(F.col("m")).alias("mrr"))


#: Passages up to which they are held by the driver and sent to every task.
BROADCAST_PASSAGES = 10_000


def holding(docs: DataFrame, passages: DataFrame, window: int = 4) -> DataFrame:
    """query_id and rel_path of each text (rel_path, text) that contains a
    passage (query_id, passage) of ``window`` + 2 tokens or more. A passage is
    looked for by the tokens after its first, which stand whole in any text that
    holds it, and then in full; by one Arrow pass, as hashing the windows in SQL
    takes some forty times as long. More passages are joined by these hashes."""
    sent = search.few(passages.select("query_id", "passage"), BROADCAST_PASSAGES)
    if sent is None:
        cut = lambda at: F.xxhash64(F.slice("ts", at, window))
        keyed = passages.select("query_id", "passage", T.tokens(F.col("passage")).alias("ts")).select("query_id", "passage", cut(2).alias("key"))
        tokens = docs.select("rel_path", "text", T.tokens(F.col("text")).alias("ts")).filter(F.size("ts") >= window)
        keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ts") - window + 1), cut))
        found = tokens.select("rel_path", "text", F.explode(keys).alias("key")).join(keyed, "key").filter(F.contains(F.col("text"), F.col("passage")))
        return found.select("query_id", "rel_path")
    known: dict[tuple[str, ...], list[tuple[int, str]]] = {}
    for query_id, passage in zip(*(sent.column(c).to_pylist() for c in ("query_id", "passage")), strict=True):
        known.setdefault(tuple(re.findall("[a-z0-9]+", passage.lower())[1 : window + 1]), []).append((query_id, passage))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                tokens = re.findall("[a-z0-9]+", (text or "").lower())
                for key in known.keys() & set(zip(*(tokens[k:] for k in range(window)), strict=False)):
                    inside = [query_id for query_id, passage in known[key] if passage in text]
                    ids += inside
                    rows += [row] * len(inside)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column("rel_path").take(pa.array(rows, pa.int64()))], names=["query_id", "rel_path"])

    return docs.select("rel_path", "text").mapInArrow(run, "query_id long, rel_path string")


def evaluate(index: Index, queries: DataFrame, embedder: Embedder | None = None, k: int = 5, mode: str = "hybrid") -> tuple[DataFrame, DataFrame]:
    """Metrics (one row) and the rank of each labelled query."""
    if k <= 0:
        raise ValueError("k has to be positive")
    ranks = relevant_ranks(queries, search.run(index, queries.select("query_id", "query"), mode, embedder, k))
    return retrieval_metrics(ranks, k), ranks


def answer_metrics(queries: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metrics (one row) and the figures of each query: precision is the share
    of citations that come from the labelled document, recall the share of
    queries with such a citation; a query without claims is a refusal."""
    joined = queries.join(claims.select("query_id", "rel_path"), "query_id", "left")
    per = joined.groupBy("query_id", "query", "rel_doc").agg(F.count("rel_path").alias("claims"), F.coalesce(F.sum((F.col("rel_path") == F.col("rel_doc")).cast("long")), F.lit(0)).alias("relevant"))
    per = per.withColumns({"refused": F.col("claims") == 0, "supported": F.col("relevant") > 0})
    total = per.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum(F.col("refused").cast("long")), F.lit(0)).alias("refusals"), F.sum("relevant").alias("r"), F.sum("claims").alias("c"), F.avg(F.col("supported").cast("double")).alias("s"))
    precision = F.when(F.col("c") > 0, F.col("r") / F.col("c")).otherwise(0.0)
    return total.select("n_queries", "refusals", F.round(precision, 6).alias("citation_precision"), F.round(F.coalesce("s", F.lit(0.0)), 6).alias("citation_recall")), per


def evaluate_answers(index: Index, queries: DataFrame, embedder: Embedder | None = None, mode: str = "term", k: int = 5) -> tuple[DataFrame, DataFrame]:
    plain = queries.select("query_id", "query")
    hits = answer.hits_with_text(index, search.run(index, plain, mode, embedder, k))
    return answer_metrics(queries, answer.claims(plain, hits))


def against_baseline(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, current, baseline, passed for each key of two one-row tables: a
    value below its baseline by more than ``TOLERANCE`` fails."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias(name)) for k in KEYS])).alias("m")).select("m.*")
    both = long(metrics, "current").join(long(baseline, "baseline"), "metric")
    return both.withColumn("passed", F.col("current") >= F.col("baseline") - TOLERANCE)


def report(metrics: dict, per_query: list[dict], mode: str, k: int) -> str:
    lines = [f"{metrics['n_queries']} queries, mode {mode}, k {k}"]
    lines += [f"{key:<20}{metrics[key]}" for key in metrics if key != "n_queries"]
    for q in per_query:
        if "rank" in q:
            lines.append(f"  {'hit' if q['rank'] else 'miss'}, rank {q['rank'] or '-'}: {q['query']} -> {q['rel_doc']}")
        else:
            lines.append(f"  {'refusal' if q['refused'] else 'hit' if q['supported'] else 'miss'}, {q['relevant']} of {q['claims']} claims: {q['query']} -> {q['rel_doc']}")
    return "\n".join(lines)
