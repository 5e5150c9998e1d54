"""Quality rules of documents and of the hosts they come from.

Each text is measured by SQL expressions alone. Documents that break a base rule
are rejected. The share of rule-breaking documents of each host is shrunk towards
the corpus by a beta prior that is fitted to the hosts' own counts, so that a
host of three documents is not judged by them alone. In hosts whose shrunk share
is above ``HOST_SHARE`` a document has to pass the strict rules too; elsewhere
the base rules decide.

The prior is fitted by weighted moments of the beta-binomial. A host's share
varies by m (1 - m) (r + (1 - r) / n): r is what hosts differ by, 1 / n what n
draws differ by, and only r makes the prior. With weights w that sum to W, the
squared distances from the weighted mean sum to m (1 - m) (r A + (1 - r) B) on
average, where A sums w (1 - w / W) and B sums the same over n; that gives r. A
first round weighs hosts by n; the second by n / (1 + (n - 1) r), so that a host
with a third of all rows counts as one host and not as a third of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

#: Shrunk share of strict failures above which a host's documents are held to the strict rules.
HOST_SHARE = 0.5
#: Prior weight, in documents, where the hosts do not tell one (one host, or a document each).
PRIOR_WEIGHT = 20.0
#: Share of the variance between hosts, at least: hosts that differ by chance alone get a prior of this inverse weight.
LEAST_BETWEEN = 1e-6
WINDOW = 8

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BLANKS = " \t\n\x0b\f\r"


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the metrics of each row's whole text. Null and
    empty texts measure 0 throughout; repeated rows are measured alike; other
    columns are ignored.

    n_repeat_words counts the words inside windows of eight words that occur
    twice or more: window hashes are compared first, and only texts in which
    two agree are sorted to find the places.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(*keep, words(F.col("text")).alias("_w"), text.alias("_t"), lines.alias("_l"))
    hashed = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", _BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    kept = [*keep, *METRICS[:4]]
    window = F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    windows = hashed.select(*kept, F.when(F.size("_h") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")).alias("_v"))
    paired = windows.select(*kept, F.when(F.size(F.array_distinct("_v")) < F.size("_v"), F.array_sort(F.transform("_v", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_p"))

    def repeated(k: Column) -> Column:
        here = F.get("_p", k)
        return F.when(F.coalesce(F.get("_p", k - 1)["h"] == here["h"], F.lit(False)) | F.coalesce(F.get("_p", k + 1)["h"] == here["h"], F.lit(False)), here["i"])

    starts = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.size("_p") - 1), repeated), lambda i: i.isNotNull()))
    placed = paired.select(*kept, F.when(F.col("_p").isNotNull(), starts).alias("_s"))
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("_s") - 1), F.lit(0), lambda n, k: n + F.least(F.get("_s", k) - F.get("_s", k - 1), F.lit(WINDOW)))
    covered = F.when(F.col("_s").isNotNull(), gaps + WINDOW).otherwise(0)
    return placed.select(*kept, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def strict_failed() -> Column:
    """Rules that a clean text of a suspicious host passes easily."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return base_failed() | (10 * F.col("n_symbols") > chars) | (chars > 15 * n) | (chars < 2 * n) | (10 * F.col("n_repeat_words") > n)


def _between(hosts: DataFrame, r: float) -> tuple[float, float | None]:
    """Weighted mean of the hosts' shares, and the share of the variance that
    lies between hosts, with the weights that ``r`` gives; None where it cannot
    be told."""
    n, p = F.col("n_docs").cast("double"), F.col("n_failed") / F.col("n_docs")
    w = n / (1 + (n - 1) * F.lit(float(r)))
    sums = {"w": w, "w2": w * w, "wp": w * p, "wp2": w * p * p, "b": w / n, "b2": w * w / n}
    found = hosts.agg(*[F.sum(v).alias(k) for k, v in sums.items()]).first()
    if not found["w"]:
        return 0.0, None
    total, m = found["w"], found["wp"] / found["w"]
    over, under = found["w"] - found["w2"] / total, found["b"] - found["b2"] / total
    if not 1e-12 < m < 1 - 1e-12 or over - under < 1e-9 * total:
        return m, None
    return m, min(1.0, max(LEAST_BETWEEN, ((found["wp2"] - m * m * total) / (m * (1 - m)) - under) / (over - under)))


def prior(hosts: DataFrame) -> tuple[float, float]:
    """Mean and weight (in documents) of the beta prior of the hosts' shares
    (n_docs, n_failed)."""
    m, r = _between(hosts, 0.0)
    if r is not None:
        m, again = _between(hosts, r)
        r = r if again is None else again
    return m, PRIOR_WEIGHT if r is None else 1 / r - 1


def host_verdicts(measured: DataFrame) -> DataFrame:
    """One row per host (null is a host of its own): n_docs, n_failed, the
    shrunk share ``failure_rate`` and ``host_rejected``. Tasks count their
    documents before hosts are shuffled."""
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("strict_failed").cast("long")).alias("n_failed"))
    m, w = prior(hosts)
    rate = (F.col("n_failed") + F.lit(m * w)) / (F.col("n_docs") + F.lit(w))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("failure_rate"), (rate > HOST_SHARE).alias("host_rejected"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, source, the metrics, base_failed, host_rejected and kept, for
    every row (repeated ones too). Texts as in ``measures``; an empty table
    gives an empty result; columns other than doc_id, text and source are
    ignored. The numbers are written once and then read for the hosts and for
    the documents, so each text is measured once. Only hosts that are rejected
    are joined back, and rows of a hot host are counted before they are
    shuffled."""
    measured = measures(docs, "doc_id", "source").select("doc_id", F.col("source").alias("host"), *METRICS, base_failed().alias("base_failed"), strict_failed().alias("strict_failed"))
    measured = materialize(measured, "quality")
    rejected = host_verdicts(measured).filter("host_rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("host_rejected"))
    joined = measured.join(rejected, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    bad = F.coalesce("host_rejected", F.lit(False))
    return joined.select("doc_id", F.col("host").alias("source"), *METRICS, "base_failed", bad.alias("host_rejected"), (~F.col("base_failed") & ~(bad & F.col("strict_failed"))).alias("kept"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
wins AS (SELECT doc_id, i, ws[i:i+7] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, host, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m),
s AS (SELECT *, (base_failed OR 10 * n_symbols > word_chars OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_repeat_words > n_words) AS strict_failed FROM f),
h AS (SELECT host, count(*) AS n_docs, count(*) FILTER (WHERE strict_failed) AS n_failed FROM s GROUP BY host),
x AS (SELECT n_docs::DOUBLE AS n, n_failed / n_docs::DOUBLE AS p FROM h),
s1 AS (SELECT sum(w) AS w, sum(w * w) AS w2, sum(w * p) AS wp, sum(w * p * p) AS wp2, sum(w / n) AS b, sum(w * w / n) AS b2 FROM (SELECT n, p, n AS w FROM x)),
m1 AS (SELECT *, wp / w AS m, w - w2 / w AS o, b - b2 / w AS u FROM s1),
r1 AS (SELECT CASE WHEN m > 1e-12 AND m < 1 - 1e-12 AND o - u >= 1e-9 * w THEN least(1, greatest(1e-6, ((wp2 - m * m * w) / (m * (1 - m)) - u) / (o - u))) END AS r, m FROM m1),
s2 AS (SELECT sum(w) AS w, sum(w * w) AS w2, sum(w * p) AS wp, sum(w * p * p) AS wp2, sum(w / n) AS b, sum(w * w / n) AS b2 FROM (SELECT n, p, n / (1 + (n - 1) * coalesce(r, 0)) AS w FROM x, r1)),
m2 AS (SELECT *, wp / w AS m, w - w2 / w AS o, b - b2 / w AS u FROM s2),
r2 AS (SELECT CASE WHEN m > 1e-12 AND m < 1 - 1e-12 AND o - u >= 1e-9 * w THEN least(1, greatest(1e-6, ((wp2 - m * m * w) / (m * (1 - m)) - u) / (o - u))) END AS r, m FROM m2),
p AS (SELECT r2.m AS mean, coalesce(1 / coalesce(r2.r, r1.r) - 1, 20) AS w FROM r1, r2),
r AS (SELECT host, (n_failed + mean * w) / (n_docs + w) > 0.5 AS host_rejected FROM h, p)
SELECT s.doc_id, s.host AS source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       r.host_rejected, (NOT base_failed AND NOT (r.host_rejected AND strict_failed)) AS kept
FROM s JOIN r ON s.host IS NOT DISTINCT FROM r.host
"""
