"""Exact top-k inner-product search with multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the deviation are kept. For two vectors
    q . v  <=  sum over segments of  n * (mean_q * mean_v + dev_q * dev_v),
which in squared distance is the lower bound |q|^2 + |v|^2 - 2 * (that sum). Resolutions go from coarse
segments to fine ones; at each, candidates whose bound stays below a query's k-th best score so far are
dropped, and only a query's survivors of the finest one are scored exactly. Integer arithmetic decides the
result; bounds only ever keep too much (a small margin covers rounding).

Plan: rows are written in shards and stay there. Queries first meet SEEDS rows, the first by hash, which
gives each a lower bound of its k-th best score. Then TILE_BYTES of queries at a time are sent to all tasks,
each of which reads a part of the rows once and keeps a running top k per query; rows are never copied or
shuffled, and are read once per tile. The parts' lists are merged by a ranking window, which drops all
but k rows of a query on the side of the parts before anything moves.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of
different lengths have no inner product, so each length is searched by itself; components beyond LARGEST after
scaling count as that, and scores beyond a long as the largest or smallest long; equal scores go to the smaller id; every row but the query's own is a
candidate, so other rows of the query's id are too; each row with a query's id is a query with k results of
its own, under the same query_id; fewer than k candidates give all; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Segment counts from coarse to fine; the finest is still shorter than the vectors.
RESOLUTIONS = (4, 16, 32, 48)
#: Queries and rows met at once in a task; rows that give a query its first bound; bytes of the queries sent to all tasks at a time.
BLOCK, CHUNK, SEEDS, TILE_BYTES = 512, 4096, 4096, 32 << 20
#: Rows of a written shard, and shards at least (of rows that fill them a little).
SHARD, LEAST_SHARDS, LEAST_ROWS = 65536, 24, 512
#: Components count as this much at most, so that products and their sums fit 128 bits.
LARGEST = 1 << 59


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<bigint>): components as floor(scale * x); rows that take no part are left out."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))
    bounded = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.lit(float(scale)) * x.cast("double")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v).where(good & F.col("vec_id").isNotNull()).select("vec_id", F.transform(vec_col, lambda x: F.floor(bounded(x)).cast("long")).alias("v"))


def segment_statistics(v: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations times the root of the segment's length, side by side: their inner product is the bound."""
    edges = np.linspace(0, v.shape[1], segments + 1).astype(int)
    parts = [v[:, a:b] for a, b in zip(edges, edges[1:])]
    root = [np.sqrt(p.shape[1]) for p in parts]
    means = [p.mean(1) * r for p, r in zip(parts, root)]
    devs = [p.std(1) * r for p, r in zip(parts, root) if p.shape[1] > 1]  # of one number there is none
    return np.stack([*means, *devs], axis=1)


def statistics(v: np.ndarray) -> list[np.ndarray]:
    """Bound vectors at each resolution."""
    return [segment_statistics(v.astype(np.float64), r) for r in RESOLUTIONS if r < v.shape[1]]


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these hold every sum, else in 64-bit integers, else in Python's, cut to a long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[-1]
    if most < 2.0**53:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return v.astype(np.int64) @ q.astype(np.int64)
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in v.astype(object) @ q.astype(object)], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: highest score, then smallest id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Search:
    """The top k so far of some queries; least: scores below are of no use to a query."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, least: np.ndarray, k: int):
        self.rows, self.v, self.k, self.least = rows, v, k, least.astype(np.float64)
        self.bounds, self.sizes = statistics(v), np.linalg.norm(v.astype(np.float64), axis=1)
        self.scores = [np.zeros(0, np.int64)] * len(rows)
        self.ids = [np.zeros(0, np.int64)] * len(rows)
        self.pairs = self.scored = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Take in a chunk of candidates."""
        theirs, largest = statistics(v), float(np.linalg.norm(v.astype(np.float64), axis=1).max(initial=0))
        for lo in range(0, len(self.rows), BLOCK):
            hi = min(lo + BLOCK, len(self.rows))
            columns, alive = np.arange(len(rows)), None
            for own, other in zip(self.bounds, theirs):
                bound = own[lo:hi] @ other[columns].T
                ok = bound >= (self.least[lo:hi] - 1e-3 - 1e-9 * np.abs(self.least[lo:hi]) - 1e-12 * self.sizes[lo:hi] * largest)[:, None]
                alive = ok if alive is None else alive & ok
                some = alive.any(0)
                if not some.all():
                    columns, alive = columns[some], alive[:, some]
            for i in range(lo, hi):
                at = columns if alive is None else columns[alive[i - lo]]
                at = at[rows[at] != self.rows[i]]
                self.scored += len(at)
                if len(at):
                    self.take(i, exact(self.v[i], v[at]), ids[at])
            self.pairs += (hi - lo) * len(rows)

    def take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least[i]
        if not good.any():
            return
        s, d = np.concatenate([self.scores[i], scores[good]]), np.concatenate([self.ids[i], ids[good]])
        top = best(s, d, self.k)
        self.scores[i], self.ids[i] = s[top], d[top]
        if len(top) == self.k:
            self.least[i] = max(self.least[i], self.scores[i][-1])


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().reshape(-1, dim)


def seeded(queries: DataFrame, seeds: tuple[np.ndarray, np.ndarray], dim: int, k: int) -> DataFrame:
    """queries (row, vec_id, v) and least: the k-th best score among the seeds, or the least long."""
    held = queries.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, v = held.value
        for batch in batches:
            own, q = batch.column(0).to_numpy(), matrix(batch.column(2), dim)
            least = np.full(len(own), np.iinfo(np.int64).min)
            for i in range(len(own)):
                scores = exact(q[i], v)[rows != own[i]]
                if len(scores) >= k:
                    least[i] = np.partition(scores, len(scores) - k)[len(scores) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least)], names=["row", "vec_id", "v", "least"])

    return queries.mapInArrow(run, "row bigint, vec_id bigint, v array<bigint>, least bigint")


def search(rows: DataFrame, tile: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dim: int, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): of each part of the rows, the k best for every query of the tile at most."""
    held = rows.sparkSession.sparkContext.broadcast(tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qrow, qid, q, least = held.value
        found = Search(qrow, q, least, k)
        pending: list[pa.RecordBatch] = []
        size = 0

        def flush() -> None:
            t = pa.Table.from_batches(pending)
            found.add(t.column(0).to_numpy(), t.column(1).to_numpy(), matrix(t.column(2), dim))

        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                pending.append(batch.slice(lo, CHUNK))
                size += pending[-1].num_rows
                if size >= CHUNK:
                    flush()
                    pending, size = [], 0
        if size:
            flush()
        for lo in range(0, len(qrow), 4096):
            part = range(lo, min(lo + 4096, len(qrow)))
            n = [len(found.ids[i]) for i in part]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qrow[part.start : part.stop], n)), pa.array(np.repeat(qid[part.start : part.stop], n)), pa.array(np.concatenate([found.ids[i] for i in part])), pa.array(np.concatenate([found.scores[i] for i in part]))], names=["query", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score bigint")


def top_k(queries: Column, rows: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score); rows: (vec_id, v array<bigint>), queries: a condition over vec_id that says which are queries."""
    spark = rows.sparkSession
    n = rows.count()
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not n:
        return out
    shards = max(-(-n // SHARD), min(LEAST_SHARDS, -(-n // LEAST_ROWS)))
    spread = rows.repartition(shards, F.xxhash64("vec_id", "v")).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    rows = common.materialize(spread, "vectors")
    for r in rows.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():
        found = of_length(queries, rows.where(F.size("v") == r.dim), r.dim, k)
        out = out if found is None else out.unionByName(found)
    return out


def of_length(queries: Column, rows: DataFrame, dim: int, k: int) -> DataFrame | None:
    """top_k of (row, vec_id, v) whose vectors have this length; None without queries."""
    first = rows.orderBy(F.xxhash64("row"), "row").limit(SEEDS).collect()
    seeds = np.array([r.row for r in first], np.int64), np.array([r.v for r in first], np.int64)
    tiles = F.pmod(F.xxhash64("row", F.lit("tile")), F.lit(max(1, -(-rows.where(queries).count() * dim * 8 // TILE_BYTES)))).cast("int")
    asked = common.materialize(seeded(rows.where(queries), seeds, dim, k).withColumn("tile", tiles), "queries")
    lists = None
    for r in asked.select("tile").distinct().orderBy("tile").collect():
        t = asked.where(F.col("tile") == r.tile).select("row", "vec_id", "v", "least").toArrow()
        tile = t.column("row").to_numpy(), t.column("vec_id").to_numpy(), matrix(t.column("v"), dim), t.column("least").to_numpy()
        found = common.materialize(search(rows, tile, dim, k), "found")
        lists = found if lists is None else lists.unionByName(found)
    if lists is None:
        return None
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(F.col("vec_id") % 20 == 0, usable(common.table(spark, sf_dir, "embeddings")))


OP1_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(greatest(-576460752303423488.0, least(576460752303423488.0, 64 * CAST(x AS DOUBLE)))) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(least(9223372036854775807, greatest(-9223372036854775808, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])))) AS BIGINT) AS score
      FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
