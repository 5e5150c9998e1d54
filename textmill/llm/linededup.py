"""Removing boilerplate lines by their frequency within a site.

For every host the pages that contain a line are divided by the host's pages; a
line on at least ``SHARE`` of them, and on at least ``LEAST`` pages, is dropped
from all of the host's pages. Pages with the same text count once on both sides
of the division, so that copies of a page do not make its lines boilerplate.
Lines are told apart by 64-bit hashes, which are not checked against the lines:
of a million boilerplate lines of a host, one of 10^13 others is dropped by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hosts, materialize

SHARE, LEAST = 0.05, 5


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def frequent_lines(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host and drop, an array of the hashes of its boilerplate lines. Lines
    without a word are never counted. A host has at most its average lines a
    page divided by ``share`` of them, whatever its size. Tasks count their
    lines before these are shuffled, so a frequent line is a row for each task."""
    texts = docs.filter(F.col("text").isNotNull() & F.col("source").isNotNull())
    worded = F.filter(_lines(F.col("text")), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    once = texts.select(F.col("source").alias("host"), F.xxhash64("text", F.length("text")).alias("page"), F.array_distinct(F.transform(worded, _key)).alias("lines"))
    # of equal pages one stays
    pages = materialize(once.groupBy("host", "page").agg(F.first("lines").alias("lines")), "lines")
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return counted.join(totals, "host").filter(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("drop"))


def clean(docs: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The rows with boilerplate lines taken out of ``text`` and two columns
    added, n_lines and n_dropped. All rows and columns stay (a column of these
    names gives way); the other lines stay as they are and in order. Null texts
    stay null, rows without a source are left alone; repeated rows are treated
    alike; an empty table gives an empty result."""
    known = materialize(frequent_lines(docs, share, least), "boilerplate")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("source").alias("host"))  # no column's name can clash
    text = F.col("row")["text"]
    joined = join_hosts(rows, known, "host", F.col("row")["doc_id"] if "doc_id" in columns else text).select("row", _lines(text).alias("lines"), "drop")
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda line: ~F.array_contains(F.col("drop"), _key(line)) | ~line.rlike(r"[^\x20\x09-\x0D]")))
    left = joined.select("row", "lines", kept.alias("kept"))
    count = lambda of: F.when(text.isNull(), 0).otherwise(F.size(of)).cast("long")
    shown = [F.array_join("kept", "\n").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in columns]
    return left.select(*shown, count("lines").alias("n_lines"), (count("lines") - count("kept")).alias("n_dropped"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded, trim(line, ' ') AS bare FROM l),
c AS (SELECT source, bare, count(DISTINCT text) AS n FROM w WHERE worded AND source IS NOT NULL GROUP BY source, bare),
t AS (SELECT source, count(DISTINCT text) AS pages FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source),
f AS (SELECT c.source, bare, TRUE AS bad FROM c JOIN t ON c.source = t.source WHERE n >= 5 AND n >= 0.05::DOUBLE * pages),
j AS (SELECT w.*, coalesce(bad AND worded, FALSE) AS dropped FROM w LEFT JOIN f ON w.source = f.source AND w.bare = f.bare),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '') AS text FROM j GROUP BY doc_id)
SELECT d.doc_id, g.text, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_dropped, 0)::BIGINT AS n_dropped
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
