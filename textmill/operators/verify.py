"""The audit: every row of an index traced to its source and its hash."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import chunk_id
from .index import Index, token_runs
from .search import held

FAILURE = "check_no int, subject string, message string"


def _failures(check: int, rows: DataFrame, subject: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check_no"), subject.cast("string").alias("subject"), message.alias("message"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def orphan_chunks(index: Index) -> DataFrame:
    return index.chunks.join(index.documents, "doc_id", "left_anti")


def orphan_terms(index: Index) -> DataFrame:
    """Runs of the terms table. They are moved to the ids of the chunks as they
    are, a row for each chunk, and nothing is sorted."""
    return index.terms.join(index.chunks.select("chunk_id").hint("shuffle_hash"), "chunk_id", "left_anti")


def repeated_paths(index: Index) -> DataFrame:
    return index.documents.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def phantom_documents(index: Index, files: DataFrame) -> DataFrame:
    return index.documents.join(files.select(F.col("sha256").alias("doc_id")), "doc_id", "left_anti")


def against_disk(index: Index, disk: DataFrame, exempt: DataFrame) -> DataFrame:
    """Documents that are not exempt, with the hash of the file on disk
    (rel_path, actual), null where the file is missing."""
    return index.documents.join(exempt, "rel_path", "left_anti").join(disk.select("rel_path", "actual", F.lit(True).alias("there")), "rel_path", "left")


def hash_rows(index: Index, files: DataFrame) -> DataFrame:
    """For each hash of the manifest: the documents that carry it, their path
    and the canonical path."""
    canonical = files.filter(F.col("status").isin("ok", "duplicate")).groupBy("sha256").agg(F.min(F.when(F.col("status") == "ok", F.col("rel_path"))).alias("canonical"))
    carried = index.documents.groupBy(F.col("doc_id").alias("sha256")).agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("rel_path"))
    return canonical.join(carried, "sha256", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _terms() -> Column:
    return F.coalesce(F.sum(F.size("tokens").cast("long")), F.lit(0)).cast("long")


def live_counts(index: Index) -> DataFrame:
    """name, recorded, live of the three counts of the run; recorded is null
    unless there is exactly one run."""
    runs = index.runs.agg(F.count(F.lit(1)).alias("runs"), *[F.max(c).alias(c) for c in ("doc_count", "chunk_count", "term_count")])
    live = {"doc_count": (index.documents, F.count(F.lit(1))), "chunk_count": (index.chunks, F.count(F.lit(1))), "term_count": (index.terms, _terms())}
    counted = reduce(DataFrame.unionByName, [rows.agg(n.alias("live")).withColumn("name", F.lit(name)) for name, (rows, n) in live.items()])
    recorded = runs.select("runs", F.explode(F.create_map(*[x for c in ("doc_count", "chunk_count", "term_count") for x in (F.lit(c), F.col(c))])).alias("name", "recorded"))
    return counted.join(recorded, "name").select("name", F.when(F.col("runs") == 1, F.col("recorded")).alias("recorded"), "live", "runs")


def failures(index: Index, files: DataFrame, disk: DataFrame, exempt: DataFrame) -> DataFrame:
    """check_no, subject, message of everything that is wrong. ``disk`` has
    rel_path and actual (hash, or null with ``error`` where it cannot be read)."""
    docs, D = index.documents, "document "
    chunks = orphan_chunks(index).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0)
    sizes = replace(index, terms=index.terms.select("chunk_id", F.size("tokens").cast("long").alias("n")))
    terms = orphan_terms(sizes).agg(F.sum("n").alias("n")).filter(F.col("n") > 0)
    disk_rows = against_disk(index, disk, exempt)
    there = disk_rows.filter(F.col("there") & F.col("actual").isNotNull())
    hashes, counts = hash_rows(index, files), live_counts(index)
    path = F.col("rel_path")
    parts = [
        _failures(1, chunks, F.lit(""), _say(F.col("n"), " chunk(s) reference a missing document")),
        _failures(2, terms, F.lit(""), _say(F.col("n"), " term(s) reference a missing chunk")),
        _failures(3, repeated_paths(index), path, _say("duplicate rel_path in documents: ", path)),
        _failures(4, docs.filter(F.col("doc_id") != F.col("sha256")), path, _say(D, path, ": doc_id ", F.col("doc_id"), " != stored sha256 ", F.col("sha256"))),
        _failures(6, disk_rows.filter(F.col("there").isNull()), path, _say(D, path, ": source file missing from disk")),
        _failures(6, disk_rows.filter(F.col("there") & F.col("actual").isNull()), path, _say(D, path, ": unreadable")),
        _failures(7, there.filter(F.col("actual") != F.col("sha256")), path, _say(D, path, ": hash mismatch (stored ", F.col("sha256"), ", disk ", F.col("actual"), ")")),
        _failures(7, there.filter(F.col("actual") != F.col("doc_id")), path, _say(D, path, ": doc_id does not match content hash")),
        _failures(8, hashes.filter(F.col("n") != 1), F.col("sha256"), _say("hash ", F.col("sha256"), ": expected 1 document row, found ", F.col("n"))),
        _failures(8, hashes.filter((F.col("n") == 1) & (F.col("canonical") != path)), F.col("sha256"), _say("hash ", F.col("sha256"), ": index rel_path ", path, " != manifest canonical ", F.col("canonical"))),
        _failures(9, phantom_documents(index, files), path, _say(D, path, ": doc_id ", F.col("doc_id"), " not in manifest")),
        _failures(10, counts.filter((F.col("runs") != 1) & (F.col("name") == "doc_count")), F.lit(""), _say("expected exactly 1 run row, found ", F.col("runs"))),
        _failures(10, counts.filter(F.col("recorded") != F.col("live")), F.col("name"), _say("runs.", F.col("name"), " ", F.col("recorded"), " != live count ", F.col("live"))),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Chunks up to which those with other terms than their text are held by the driver.
BROADCAST_CHUNKS = 100_000


def stray_terms(index: Index) -> DataFrame:
    """chunk_id and n: how many rows of the terms table a chunk's text does not
    give, and how many that it gives are not there. Both sides of a chunk meet
    by a hash first; only those of chunks that differ are compared."""
    both = index.terms.select("chunk_id", F.lit(1).alias("side"), "start", "tokens").unionByName(token_runs(index.chunks).withColumn("side", F.lit(0)))
    hashed = both.select("chunk_id", "side", F.unhex(F.sha2(F.to_json(F.struct("start", "tokens")), 256)).alias("hash"))
    same = (F.count(F.lit(1)) == 2) & (F.sum("side") == 1) & (F.min("hash") == F.max("hash"))
    differing = hashed.groupBy("chunk_id").agg(same.alias("same")).filter("not same").select("chunk_id")
    runs = both.join(held(differing.hint("shuffle_hash"), BROADCAST_CHUNKS), "chunk_id", "left_semi")
    gathered = runs.groupBy("chunk_id").agg(*[F.collect_list(F.when(F.col("side") == k, F.struct("start", "tokens"))).alias(name) for k, name in ((1, "listed"), (0, "given"))])

    def lacking(rows: str, others: str) -> Column:
        def there(term: Column, place: Column) -> Column:
            at = lambda run: place - run["start"]
            return F.exists(others, lambda run: F.when((at(run) >= 0) & (at(run) < F.size(run["tokens"])), F.get(run["tokens"], at(run).cast("int")) == term).otherwise(False))

        return F.aggregate(rows, F.lit(0).cast("long"), lambda n, run: n + F.size(F.filter(run["tokens"], lambda term, i: ~there(term, run["start"] + i))))

    return gathered.select("chunk_id", (lacking("listed", "given") + lacking("given", "listed")).alias("n")).filter("n > 0")


def deep_failures(index: Index) -> DataFrame:
    """What the plain audit does not look at: ids that their chunk's text does
    not give, terms that a chunk does not have or lacks, vectors without a chunk
    and, if there are vectors, chunks without one."""
    wrong = index.chunks.filter(F.col("chunk_id") != chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))
    stray = stray_terms(index)
    parts = [
        _failures(11, wrong, F.col("chunk_id"), _say("chunk ", F.col("chunk_id"), ": id does not match its text")),
        _failures(12, stray, F.col("chunk_id"), _say("chunk ", F.col("chunk_id"), ": ", F.col("n"), " term row(s) differ from its text")),
        _failures(13, index.vectors.join(index.chunks, "chunk_id", "left_anti"), F.col("chunk_id"), _say("vector of a missing chunk ", F.col("chunk_id"))),
    ]
    if index.has_vectors():
        parts.append(_failures(13, index.chunks.join(index.vectors, "chunk_id", "left_anti"), F.col("chunk_id"), _say("chunk ", F.col("chunk_id"), " has no vector")))
    return reduce(DataFrame.unionByName, parts)


def verify(index: Index, files: DataFrame, disk: DataFrame, exempt: DataFrame, deep: bool = False) -> tuple[bool, DataFrame, dict]:
    """Whether all is well, the failures in order, and counts (always filled)."""
    found = failures(index, files, disk, exempt)
    if deep:
        found = found.unionByName(deep_failures(index))
    ordered = found.orderBy("check_no", "subject", "message")
    live = {r["name"]: r["live"] for r in live_counts(index).collect()}
    n = found.count()
    exempted = index.documents.join(exempt, "rel_path", "left_semi").count()
    return n == 0, ordered, {"documents": live["doc_count"], "chunks": live["chunk_count"], "terms": live["term_count"], "exempted": exempted, "failures": n}
