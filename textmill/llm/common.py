"""What the operators of this subpackage share: tables, shared storage and
Arrow batches."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import delete, shared_dir

#: The words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What ``materialize`` has written and ``discard`` has not deleted.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it again:
    lineage is cut, lost executors cost nothing that was written, and several
    readers share one computation. The files stay until ``discard`` or, for what
    a result still reads, until the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _written[path] = spark
    made = spark.read.schema(df.schema).parquet(path)
    made._textmill_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``materialize`` that nothing reads any more."""
    for table in tables:
        _delete(table._textmill_path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        delete(spark, path)


@atexit.register
def _delete_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            _delete(path)


def collector_off(run: Callable) -> Callable:
    """A worker function that keeps many objects without cycles runs without
    Python's cycle collector, which would walk them again and again. At its end
    the worker, which waits for other tasks, gives back what Arrow has kept."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()

    return wrapped


#: Rows of a small table up to which it is sent to every task.
BROADCAST_ROWS = 10_000
#: Parts that a hot key's rows are dealt to where it is larger.
SALTS = 32


def join_hosts(rows: DataFrame, known: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with what ``known`` (written, one row a key, its key column
    named ``key`` too) has of their key, nulls where it has none. A small table
    is broadcast; a larger one is copied ``SALTS`` times and the rows are dealt
    to the copies by ``spread``, so that a hot key's rows do not meet in one task."""
    if known.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(known), key, "left")
    copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small slices, so that a worker never holds Python
    objects for more than ``rows`` texts at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def words(text: Column) -> Column:
    """Words of a text by the contracts' definition; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
