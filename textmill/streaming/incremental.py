"""An extension: chunks and terms of documents that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import sha256
from ..operators.index import chunk_table, term_table

ARRIVING = "rel_path string, text string, arrived timestamp"


def read_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(ARRIVING).json(folder)


def fresh_documents(arrivals: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each content once within the watermark; state holds one hash for each
    document that is younger than ``lateness``."""
    known = arrivals.filter(F.col("text").isNotNull()).withColumn("doc_id", sha256(F.col("text")))
    return known.withWatermark("arrived", lateness).dropDuplicatesWithinWatermark(["doc_id"])


def append_index(arrivals: DataFrame, out: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Appends documents, chunks and terms under ``out``. A batch that is run
    again after a failure overwrites its own folder, so nothing is doubled."""

    def put(batch: DataFrame, number: int) -> None:
        documents = batch.select("doc_id", "rel_path", "text")
        documents.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        written = batch.sparkSession.read.parquet(f"{out}/documents/batch={number}")
        chunks = chunk_table(written)
        chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        term_table(batch.sparkSession.read.parquet(f"{out}/chunks/batch={number}")).write.mode("overwrite").parquet(f"{out}/terms/batch={number}")

    return fresh_documents(arrivals, lateness).writeStream.option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
