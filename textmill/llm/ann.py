"""Nearest neighbours by collision-counting hashing.

Vectors are lifted to the unit sphere, so that the largest inner product is the
smallest angle, and projected on single lines; each projection is one sorted
array. A query's windows on all lines begin at its own place and are widened
step by step (virtual rehashing). What enters a window is counted for its
vector, and nothing else is looked at; a vector that lies in the windows of at
least ``THRESHOLD`` of the lines collides often enough. Widening ends when enough
vectors collide, the threshold rises to the highest that still leaves enough,
and those vectors are verified by their exact inner product. The lines come in
orthogonal sets, which tell more of a distance than as many independent ones.

Candidates are dealt to shards of a bounded size, queries to blocks. Every block
meets every shard, finds its nearest there, and the shards' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LINES, THRESHOLD, WIDEN = 96, 0.6, 1.25
#: Verified vectors of a shard, as a multiple of k and at least as a share of the shard.
VERIFY, VERIFY_SHARE = 20, 0.12
SHARD_ROWS, BLOCK_ROWS = 16_384, 4_096


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, dim and vec of the vectors that take part: not null, not empty, no
    null, NaN or infinite component, not all zero; components as doubles."""
    v = F.col(vector_column)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(v.isNotNull() & F.col(id_column).isNotNull()).filter(whole & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_column).cast("long").alias("id"), F.size(v).alias("dim"), v.cast("array<double>").alias("vec"))


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector over the power of two next above its largest component, and
    that power: squares and products of what is left neither over- nor
    underflow, and nothing is rounded."""
    power = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, -power[:, None]), power


def orthogonal_lines(dim: int, lines: int, seed: int) -> np.ndarray:
    """Unit columns, every ``dim`` of them a random rotation."""
    r = np.random.default_rng(seed)
    sets = [np.linalg.qr(r.standard_normal((dim, dim)))[0] for _ in range(-(-lines // dim))]
    return np.concatenate(sets, axis=1)[:, :lines]


class Shard:
    """One shard's vectors, and on every line their places in the order of
    their projections. ``start`` is the window that typical queries need, and
    ``verified`` counts inner products."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, seed: int = 11):
        self.ids = ids
        self.vectors, self.power = _scaled(vectors)
        self.repeated = len(np.unique(ids)) < len(ids)
        shrunk = np.ldexp(self.vectors, (self.power - self.power.max())[:, None])
        norms = np.sqrt((shrunk**2).sum(axis=1))
        top = float(norms.max())
        lifted = np.sqrt(np.maximum(top**2 - norms**2, 0))
        self.lines = orthogonal_lines(vectors.shape[1] + 1, lines, seed)
        projected = ((shrunk @ self.lines[:-1] + lifted[:, None] * self.lines[-1]) / top).T
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)
        self.need = int(np.ceil(THRESHOLD * lines))
        self.start, self.verified = 16, 0

    def places(self, queries: np.ndarray) -> np.ndarray:
        """Where scaled queries fall on each line."""
        projected = (queries / np.sqrt((queries**2).sum(axis=1))[:, None]) @ self.lines[:-1]
        return np.stack([np.searchsorted(line, p) for line, p in zip(self.sorted, projected.T, strict=True)], axis=1)

    def _different(self, rows: np.ndarray, query_id: int) -> int:
        own = self.ids[rows]
        return len(np.unique(own[own != query_id])) if self.repeated else len(rows) - int(query_id in own)

    def candidates(self, centres: np.ndarray, query_id: int, wanted: int) -> np.ndarray:
        """Rows that collide with a query on enough lines: ``wanted`` different
        ids besides the query's own, or all rows where there are fewer."""
        n = len(self.ids)
        if n <= wanted:
            return np.arange(n)
        seen, low, high, width = np.zeros(n, dtype=np.int64), centres, centres, self.start
        while True:
            below, above = np.maximum(centres - width, 0), np.minimum(centres + width, n)
            rings = [line[i:j] for line, i, j in zip(self.order, below, low, strict=True)] + [line[i:j] for line, i, j in zip(self.order, high, above, strict=True)]
            seen += np.bincount(np.concatenate(rings), minlength=n)
            hit = np.flatnonzero(seen >= self.need)
            if width >= n or (len(hit) >= wanted and self._different(hit, query_id) >= wanted):
                break
            low, high, width = below, above, int(width * WIDEN) + 1
        # the next query begins a little below where this one ended
        self.start = max(16, int(0.25 * self.start + 0.75 * width / WIDEN**0.5))
        if not self.repeated and len(hit) > wanted + 1:
            counts = seen[hit]
            hit = hit[counts >= np.partition(counts, -(wanted + 1))[-(wanted + 1)]]
        return hit

    def nearest(self, query_id: int, query: np.ndarray, power: int, centres: np.ndarray, k: int) -> list[tuple[int, float, float]]:
        """id, score and order of the k nearest. Scores are exact products; they
        may be beyond the range of doubles, and then the order, which is 0
        elsewhere, tells which is larger."""
        rows = self.candidates(centres, query_id, max(VERIFY * k, int(VERIFY_SHARE * len(self.ids))))
        self.verified += len(rows)
        rows = rows[self.ids[rows] != query_id]
        products, powers, ids = self.vectors[rows] @ query, self.power[rows] + power, self.ids[rows]
        with np.errstate(over="ignore", under="ignore", divide="ignore"):
            scores = np.ldexp(products, powers)
            beyond = ~np.isfinite(scores) | ((np.abs(scores) < 1e-290) & (products != 0))
            order = np.where(beyond, np.sign(products) * (np.log2(np.abs(products)) + powers + 5000.0), 0.0)
        best = np.lexsort((ids, -order, -scores))
        if self.repeated:
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
        return list(zip(ids[best[:k]].tolist(), scores[best[:k]].tolist(), order[best[:k]].tolist(), strict=True))


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(shard):
            index = Shard(shard["id"].to_numpy(), np.stack(shard["vec"].to_numpy()))
            asked, powers = _scaled(np.stack(queries["vec"].to_numpy()))
            for query_id, query, power, centres in zip(queries["id"].tolist(), asked, powers.tolist(), index.places(asked), strict=True):
                out += [(query_id, *found) for found in index.nearest(query_id, query, power, centres, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "order"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64", "order": "float64"})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` for each of
    ``queries`` (both as ``usable`` gives them), by the largest inner product in
    double precision, ties to the smaller id; never the row with the query's own
    id. Vectors meet queries of the same dimension only. Ids that occur more
    than once are reported once for each query, with their best score, and never
    crowd out others. Products beyond the range of doubles are infinite or zero
    and still in their true order. Fewer than k rows are returned only where
    there are fewer candidates. Empty tables give an empty result. A shard's
    sorted arrays are made once for each block, which takes a fiftieth of a full
    block's time."""
    vectors, queries = materialize(vectors.dropDuplicates(["id", "vec"]), "vectors"), materialize(queries.dropDuplicates(["id", "vec"]), "queries")
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-m // block_rows))
    number = F.monotonically_increasing_id()  # in a select of its own: beside explode it would number that one's rows
    dealt = vectors.select("*", F.pmod(number, F.lit(shards)).cast("int").alias("shard")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = queries.select("*", F.pmod(number, F.lit(blocks)).cast("int").alias("block")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["dim", "shard", "block"]
    found = asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(_search(k), "query_id long, vec_id long, score double, order double")
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "order")).alias("best")).select("query_id", "vec_id", "best.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("order"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
