"""Extractive answers: sentences of retrieved chunks, each with its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.embed import Embedder
from . import search
from .index import Index

#: Hits up to which their texts are held by the driver, for what reads them twice.
HELD_TEXTS = 10_000
REFUSAL = "no retrieved passage supports an answer to this question."


def supported(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id and supported: whether some hit (query_id, text) holds enough
    of the query's significant tokens. A query without tokens or hits is not."""
    tokens = queries.select("query_id", T.significant_tokens(F.col("query")).alias("tokens"))
    held = hits.join(tokens, "query_id").select("query_id", ((F.size("tokens") > 0) & (T.matches(F.col("text"), F.col("tokens")) >= T.needed_matches(F.col("tokens")))).alias("ok"))
    found = held.groupBy("query_id").agg(F.max("ok").alias("ok"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("ok", F.lit(False)).alias("supported"))


def claims(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Sentences of the hits (query_id, rank, doc_id, rel_path, chunk_index,
    chunk_id, text) that hold a token of a supported query, each sentence once,
    where it comes first; seq counts from 1. A query's hits are a few chunks, so
    its sentences fit one task."""
    gate = supported(queries, hits).filter("supported").select("query_id")
    tokens = queries.join(gate, "query_id").select("query_id", T.significant_tokens(F.col("query")).alias("tokens"))
    cut = hits.join(tokens, "query_id").select("*", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))
    matching = cut.filter(T.matches(F.col("sentence"), F.col("tokens")) > 0)
    first = Window.partitionBy("query_id", "sentence").orderBy("rank", "place")
    once = matching.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
    seq = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "place"))
    return once.select("query_id", seq.alias("seq"), T.marker(F.col("doc_id"), F.col("chunk_index")).alias("marker"), F.col("sentence").alias("text"), "doc_id", "chunk_index", "chunk_id", "rel_path")


def hits_with_text(index: Index, hits: DataFrame) -> DataFrame:
    """Full texts of hits, the snippet where a chunk has gone. Few hits go to the
    chunks and not the chunks to them."""
    hits = search.held(hits, search.BROADCAST_HITS)
    texts = index.chunks.join(hits.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.col("text").alias("full"))
    return hits.join(texts, "chunk_id", "left").withColumn("text", F.coalesce("full", "snippet")).drop("full")


def answers(index: Index, queries: DataFrame, embedder: Embedder | None = None, mode: str = "term", k: int = 5, alpha: float = search.ALPHA) -> DataFrame:
    """query_id, query, refused, answer and citations of each query."""
    hits = search.held(hits_with_text(index, search.run(index, queries, mode, embedder, k, alpha)), HELD_TEXTS)
    made = claims(queries, hits)
    parts = F.array_sort(F.collect_list(F.struct("seq", "marker", "text", "doc_id", "chunk_index", "chunk_id", "rel_path")))
    grouped = made.groupBy("query_id").agg(parts.alias("citations"))
    lines = F.array_join(F.transform("citations", lambda c: F.concat_ws(" ", c["text"], c["marker"])), "\n")
    rows = queries.join(grouped, "query_id", "left")
    refused = F.col("citations").isNull()
    return rows.select("query_id", "query", refused.alias("refused"), F.when(refused, F.lit(f"Refusal: {REFUSAL}")).otherwise(lines).alias("answer"), F.coalesce("citations", F.array().cast("array<struct<seq:int,marker:string,text:string,doc_id:string,chunk_index:bigint,chunk_id:string,rel_path:string>>")).alias("citations"))


def render(answer: dict) -> str:
    return answer["answer"] if answer["refused"] else f"answer to '{answer['query']}':\n{answer['answer']}"
