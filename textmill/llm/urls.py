"""Judging urls by rules and by the link graph of hosts.

Rules of host and path come first; the longest that fits a url decides. Other
urls are judged by their host, by two measures between 0 and 1. Trust is the
share of a host's PageRank that comes from the hosts of allowed urls: their
personalised PageRank over the one that starts everywhere. Distrust flows from
blocked hosts against the links: it is the chance that a walk from the host,
which stops at each step as PageRank's does, meets a blocked one. As each host
divides by its own links, neither measure thins out where a blocked host has
many linkers or a trusted one many links. A host is blocked where its distrust
reaches a threshold and exceeds its trust. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: verdict, host, path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, ROUNDS = 0.85, 12
#: Distrust that blocks a host: about half of its links lead to blocked ones.
DISTRUST = 0.4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end. Both are empty
    for null and where there is no ``://``."""
    whole = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(whole, pattern, 1), _UPPER, _LOWER)
    return host, F.regexp_extract(whole, pattern, 2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, else nulls."""

    def fits(rule: tuple[str, str, str]) -> Column:
        return ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))

    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        name = F.when(fits(rule), F.lit(rule[1] + rule[2])).otherwise(name)
        verdict = F.when(fits(rule), F.lit(rule[0])).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and weight (pages of src that link to dst) between different
    hosts, from the absolute links of ``html``."""
    host, _ = host_and_path(F.col("url"))
    html = F.coalesce(F.col("html"), F.lit(""))
    found = F.when(F.contains(html, F.lit("//")), F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER))))
    linked = pages.select(host.alias("src"), F.explode(found).alias("dst")).filter((F.col("src") != "") & (F.col("dst") != F.col("src")))
    return linked.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def shares(edges: DataFrame) -> DataFrame:
    """src, dst and the share of src's links that go to dst."""
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    return edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share"))


def trust_scores(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trusted, rank and trust (their quotient) of every host of ``links``
    (as ``shares`` gives them): personalised PageRank with the hosts of
    ``seeds`` as restarts beside the one with all hosts, in one pass a round.
    What reaches a host without links leaves the graph. Scores are summed in the
    tasks before they are shuffled; a round is written, so lineage stays short."""
    hosts = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    marked = hosts.join(seeds.select("host", F.lit(1.0).alias("seed")).distinct(), "host", "left")
    restart = materialize(marked.select("host", (F.coalesce("seed", F.lit(0.0)) * (1 - damping)).alias("trusted"), F.lit(1 - damping).alias("rank")), "restart")
    scores = restart
    for _ in range(rounds):
        met = links.join(scores, F.col("src") == F.col("host"))
        moved = met.select(F.col("dst").alias("host"), *[(F.col(c) * F.col("share") * damping).alias(c) for c in ("trusted", "rank")])
        before, scores = scores, materialize(restart.unionByName(moved).groupBy("host").agg(F.sum("trusted").alias("trusted"), F.sum("rank").alias("rank")), "rank")
        if before is not restart:
            discard(before)
    return scores.withColumn("trust", F.col("trusted") / F.col("rank"))


def distrust_scores(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host and distrust of the hosts from which a walk along ``links`` can
    meet one of ``seeds``, which have 1; each step before it counts ``damping``."""
    start = seeds.select("host", F.lit(1.0).alias("distrust"), F.lit(True).alias("seed")).distinct()
    scores = start
    for k in range(rounds):
        met = links.join(scores, F.col("dst") == F.col("host"))
        moved = met.select(F.col("src").alias("host"), (F.col("distrust") * F.col("share") * damping).alias("distrust"), F.lit(False).alias("seed"))
        summed = start.unionByName(moved).groupBy("host").agg(F.when(F.max("seed"), 1.0).otherwise(F.sum("distrust")).alias("distrust"))
        before, scores = scores, materialize(summed, "distrust")
        if k:
            discard(before)
    return scores.select("host", "distrust")


def blocked_hosts(pages: DataFrame, rules: tuple = RULES) -> DataFrame | None:
    """Hosts that their links condemn, or None where no page links to another
    host. Seeds of distrust are hosts that a rule for all paths blocks; seeds of
    trust are hosts with an allowed url that are not among those."""
    edges = materialize(host_edges(pages), "hosts")
    if edges.isEmpty():
        discard(edges)
        return None
    whole = tuple(r for r in rules if r[2] == "/")
    host, path = host_and_path(F.col("url"))
    judged = pages.select(host.alias("host"), rule_of(host, path, rules)[1].alias("verdict")).distinct()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    blocked = materialize(nodes.filter(rule_of(F.col("host"), F.lit("/"), whole)[1] == "block"), "blocked")
    trusted = judged.filter(F.col("verdict") == "allow").select("host").distinct().join(blocked, "host", "left_anti")
    links = materialize(shares(edges), "links")
    distrust = distrust_scores(links, blocked).filter(F.col("distrust") >= DISTRUST)
    both = distrust.join(trust_scores(links, trusted), "host", "left")
    bad = materialize(both.filter(F.col("distrust") > F.coalesce("trust", F.lit(0.0))).select("host"), "bad")
    discard(edges, blocked, links)
    return bad


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row, repeated ones too. A
    null url or one without ``://`` has an empty host and path, no rule, and is
    allowed; null html has no links; other columns are ignored; an empty table
    gives an empty result."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    bad = blocked_hosts(pages, rules)
    if bad is None:
        return named.withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    marked = named.join(bad.withColumn("bad", F.lit(True)), "host", "left")
    return marked.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"))


def _rounds(name: str, start: str, step: str) -> str:
    """The rounds of a propagation, each a query of its own; ``step`` names the scores before it {before}."""
    parts = [f"{name}0 AS ({start})"]
    parts += [f"{name}{k + 1} AS MATERIALIZED ({step.format(before=f'{name}{k}')})" for k in range(ROUNDS)]
    return ",\n".join(parts)


def _fits(rule: tuple[str, str, str]) -> str:
    return f"(host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}')"


def _first(column: int) -> str:
    """CASE over the rules, the longest first: the rule's name (0) or verdict (1)."""
    longest = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    return "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{(r[1] + r[2], r[0])[column]}'" for r in longest) + " END"


_SQL_PARTS = r"""regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)"""
_SQL_LOWER = f"translate({{}}, '{_UPPER}', '{_LOWER}')"

ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, html, {_SQL_LOWER.format(_SQL_PARTS)} AS host, {_SQL_PARTS.replace("1)", "2)")} AS path FROM pages),
named AS (SELECT page_id, host, path, {_first(0)} AS rule, {_first(1)} AS verdict FROM p),
linked AS (SELECT page_id, host AS src, unnest(list_distinct(list_transform(regexp_extract_all(coalesce(html, ''), '{_LINK.replace("'", "''")}', 1), lambda h: {_SQL_LOWER.format("h")}))) AS dst FROM p),
edges AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM linked WHERE src <> '' AND src <> dst GROUP BY src, dst),
hosts AS (SELECT src AS host, '/' AS path FROM edges UNION SELECT dst, '/' FROM edges),
blocked AS (SELECT host FROM hosts WHERE {" OR ".join(f"({_fits(r)})" for r in RULES if r[0] == "block" and r[2] == "/") or "FALSE"}),
trusted AS (SELECT DISTINCT host FROM named WHERE verdict = 'allow' AND host NOT IN (SELECT host FROM blocked)),
shares AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM edges),
{_rounds("trust", f"SELECT host, CASE WHEN host IN (SELECT host FROM trusted) THEN {1 - DAMPING}::DOUBLE ELSE 0 END AS t, {1 - DAMPING}::DOUBLE AS r FROM hosts", f"SELECT host, sum(t) AS t, sum(r) AS r FROM (SELECT * FROM trust0 UNION ALL SELECT dst, t * share * {DAMPING}, r * share * {DAMPING} FROM {{before}} JOIN shares ON src = host) GROUP BY host")},
{_rounds("distrust", "SELECT DISTINCT host, 1::DOUBLE AS d FROM blocked", f"SELECT host, CASE WHEN max(seed) = 1 THEN 1 ELSE sum(d) END AS d FROM (SELECT host, d, 1 AS seed FROM distrust0 UNION ALL SELECT src, d * share * {DAMPING}, 0 FROM {{before}} JOIN shares ON dst = host) GROUP BY host")},
bad AS (SELECT d.host FROM distrust{ROUNDS} d LEFT JOIN trust{ROUNDS} t ON d.host = t.host WHERE d >= {DISTRUST} AND d > coalesce(t / r, 0))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM named
"""
