"""Content-derived identifiers as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(value: Column) -> Column:
    """Of bytes, or of a string's UTF-8 bytes, in lower-case hex."""
    return F.sha2(value, 256)


def chunk_id(doc_id: Column, chunk_index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", doc_id, chunk_index.cast("string"), text), 256)


def run_id(manifest_sha: str | Column, chunks_sha: str | Column) -> Column:
    m, c = (x if isinstance(x, Column) else F.lit(x) for x in (manifest_sha, chunks_sha))
    return F.sha2(F.concat(m, F.lit(":"), c), 256)


def fingerprint(rows: DataFrame) -> str:
    """One hash for a table whatever its order and partitions: the count and
    the sum and exclusive or of the rows' hashes, reduced in the tasks."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x"))
    return found.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.coalesce("s", F.lit(0)).cast("string"), F.coalesce("x", F.lit(0)).cast("string")), 256)).first()[0]
