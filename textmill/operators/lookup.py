"""Documents, chunks and their neighbours by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import Index


def list_documents(index: Index, limit: int = 100) -> DataFrame:
    """Documents by path with their number of chunks, 0 where there are none."""
    counts = index.chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    rows = index.documents.join(counts, "doc_id", "left")
    return rows.select("doc_id", "rel_path", "sha256", "size", "kind", F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("rel_path").limit(limit)


def document_chunks(index: Index, wanted: DataFrame) -> DataFrame:
    """The documents in ``wanted`` (doc_id) with each of their chunks; one row
    without a chunk for a document that has none."""
    found = index.documents.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.join(index.chunks, "doc_id", "left").select("doc_id", "rel_path", "sha256", "size", "kind", "chunk_id", "chunk_index", "text")


def get_document(index: Index, doc_id: str) -> dict | None:
    """A document with its chunks in order, or None. Of one document, so what
    comes to the driver is its text."""
    wanted = index.documents.sparkSession.createDataFrame([(doc_id,)], "doc_id string")
    rows = [r.asDict() for r in document_chunks(index, wanted).orderBy("chunk_index").collect()]
    if not rows:
        return None
    chunks = [{k: r[k] for k in ("chunk_id", "chunk_index", "text")} for r in rows if r["chunk_id"] is not None]
    return {k: rows[0][k] for k in ("doc_id", "rel_path", "sha256", "size", "kind")} | {"chunks": chunks}


def chunk_context(index: Index, wanted: DataFrame, window: int = 1) -> DataFrame:
    """For each wanted (doc_id, chunk_index) the chunks from ``window`` before
    to ``window`` after it; an equality join on the places themselves."""
    places = wanted.select("doc_id", F.col("chunk_index").alias("centre"), F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    return index.chunks.join(places, ["doc_id", "chunk_index"]).select("doc_id", "centre", "chunk_index", "chunk_id", "text")


def stats(index: Index) -> dict:
    """What the build recorded of itself."""
    found = index.runs.first()
    return found.asDict() if found else {}
