"""Approximate nearest neighbours by collision counting (query-aware hashing).

Largest inner products become nearest Euclidean neighbours by one more component that lifts all vectors to one norm.
Each block of rows keeps, for each of M random directions, its projections as one sorted array. A query opens a window
around its own projection in every array; virtual rehashing widens all its windows by the same factor from round to round.
Vectors that lie inside at least a share THRESHOLD of the windows are verified by their score. The share is high and windows are
wide, which tells near from far with few directions, and collisions are counted by those that are missing: a query
touches the rows outside its windows, then those that enter as the windows widen. A query ends when a vector as far as its
k-th neighbour known so far would have passed the threshold with the probability RECALL, so nothing is capped: a hard query
opens its windows until they hold all rows.

A task builds the arrays of its block once and streams the queries past them. The first block, a random part of all rows,
is searched before the others: its k-th scores let queries end early in every other block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

DIRECTIONS, THRESHOLD, RECALL = 64, 0.93, 0.97
#: Half width of the first windows (all vectors lie on a sphere of radius one), and the factor from round to round.
FIRST, WIDEN = 1.8, 1.15
#: Rows of a block, as far as BLOCK_BYTES hold them (two copies of their components as doubles, one as floats); queries that a task searches together; queries below which a block isn't shared by several tasks.
BLOCK, BLOCK_BYTES, TOGETHER, SHARED = 131072, 160 << 20, 64, 256
#: Blocks from which on the first one is searched ahead of the others.
AHEAD = 4
_VERIFIED = 255  # marks verified rows; less any number of directions it is still more than a row may miss


def usable(vector: Column) -> Column:
    """No null, nan or infinite component, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pass_probability(half: float, distance: float, m: int, least: int) -> float:
    """Probability that a vector at ``distance`` lies in ``least`` of m windows of half width ``half``."""
    p = math.erf(half / (distance * math.sqrt(2))) if distance > 0 else 1.0
    if p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    logs = [math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(p) + (m - i) * math.log1p(-p) for i in range(least, m + 1)]
    return min(1.0, sum(map(math.exp, logs)))


def half_width_over_distance(m: int, least: int, recall: float) -> float:
    """Least window half width, in units of the distance, at which a vector passes with probability ``recall``."""
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if _pass_probability(mid, 1.0, m, least) >= recall else (mid, high)
    return high


def log2_norms(x: np.ndarray) -> np.ndarray:
    """Logarithm of the norms, also where squares would overflow or vanish."""
    most, exponent = np.frexp(np.abs(x).max(axis=1))
    scaled = np.ldexp(x, -exponent[:, None])
    return np.log2(np.einsum("ij,ij->i", scaled, scaled)) / 2 + exponent


class Block:
    """The sorted projections of one block of rows (ids ascending, vectors as doubles), and the search in them.

    Rows are divided by a power of two so that no norm is above one; queries are brought to one norm, which changes no
    order of their scores. Both are safe for any finite components.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, top_log2: float, k: int, m: int = DIRECTIONS, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 3):
        self.ids, self.x, self.k = ids, x, k
        self.small = np.ldexp(x, -math.ceil(top_log2))
        self.directions = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, m))
        lift = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", self.small, self.small), 0))
        at = self.small @ self.directions[:-1] + lift[:, None] * self.directions[-1]
        self.rough = self.small.astype(np.float32)
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        self.lines = np.take_along_axis(at.T, self.order, axis=1)
        self.least = max(1, math.ceil(threshold * m))
        self.reach = half_width_over_distance(m, self.least, recall)

    def search(self, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, float]]:
        """(query id, vector ids, scores, k-th scaled score) of each query's nearest in the block, nearest first.

        bound: a scaled score that k rows elsewhere reach, -inf if none is known. Scaled scores are cosines times the norms of
        the rows over the power of two.
        """
        n, m = self.order.shape[1], len(self.order)
        unit = np.ldexp(q, -np.frexp(np.abs(q).max(axis=1))[1][:, None])
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        centres = (unit @ self.directions[:-1]).T
        starts = np.array([line.searchsorted(c) for line, c in zip(self.lines, centres, strict=True)])
        own = np.searchsorted(self.ids, query_ids)
        own = np.where((own < n) & (self.ids[np.minimum(own, n - 1)] == query_ids), own, -1)
        rough = unit.astype(np.float32)
        missing = np.zeros((len(q), n), np.uint8)
        half = np.full(len(q), FIRST)
        low, high = starts.copy(), starts.copy()
        opened = np.zeros(len(q), bool)
        found: list[list[np.ndarray]] = [[] for _ in q]
        scaled: list[np.ndarray] = [np.zeros(0) for _ in q]
        active = np.arange(len(q))
        while len(active):
            a = np.array([line.searchsorted(c) for line, c in zip(self.lines, centres[:, active] - half[active], strict=True)])
            b = np.array([line.searchsorted(c, "right") for line, c in zip(self.lines, centres[:, active] + half[active], strict=True)])
            still = []
            for column, i in enumerate(active.tolist()):
                mine = missing[i]
                if not opened[i]:  # what lies outside of windows that hold the most, what lies inside of the others
                    opened[i] = True
                    wide = (2 * (b[:, column] - a[:, column]) > n).tolist()
                    ends = list(zip(self.order, wide, a[:, column].tolist(), b[:, column].tolist(), strict=True))
                    outside = [part for line, is_wide, x, y in ends if is_wide for part in (line[:x], line[y:])]
                    inside = [line[x:y] for line, is_wide, x, y in ends if not is_wide]
                    mine += np.uint8(len(inside))
                    if outside:
                        mine += np.bincount(np.concatenate(outside), minlength=n).astype(np.uint8)
                else:
                    ends = zip(self.order, a[:, column].tolist(), low[:, i].tolist(), high[:, i].tolist(), b[:, column].tolist(), strict=True)
                    inside = [part for line, a0, a1, b0, b1 in ends for part in (line[a0:a1], line[b0:b1])]
                if inside:
                    mine -= np.bincount(np.concatenate(inside), minlength=n).astype(np.uint8)
                low[:, i], high[:, i] = a[:, column], b[:, column]
                new = np.flatnonzero(mine <= m - self.least)
                if len(new):
                    mine[new] = _VERIFIED
                    new = new[new != own[i]]
                    found[i].append(new)
                    scaled[i] = np.concatenate([scaled[i], self.rough.take(new, axis=0) @ rough[i]])
                if not low[:, i].any() and (high[:, i] == n).all():
                    continue
                kth = bound[i]
                if len(scaled[i]) >= self.k:
                    kth = max(kth, np.partition(scaled[i], len(scaled[i]) - self.k)[len(scaled[i]) - self.k])
                wanted = half[i] * WIDEN
                if kth > -math.inf:
                    enough = self.reach * math.sqrt(max(2 - 2 * kth, 0))
                    if half[i] >= enough:
                        continue
                    wanted = min(wanted, enough * (1 + 1e-9))
                half[i] = wanted
                still.append(i)
            active = np.array(still, np.int64)
        for i in range(len(q)):
            rows, s = np.concatenate([np.zeros(0, np.int64), *found[i]]), scaled[i]
            kth = -math.inf
            if len(s) > self.k:
                kth = float(np.partition(s, len(s) - self.k)[len(s) - self.k])
                close = rows[s >= kth - 1e-5]  # of which single precision can't tell the order
            else:
                close = rows
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                score = np.einsum("ij,j->i", self.x[close], q[i])
                if len(close) < len(rows) and not np.isfinite(score).all():  # overflow: all that were found compete
                    close, score = rows, np.einsum("ij,j->i", self.x[rows], q[i])
            score = np.where(np.isnan(score), -np.inf, score)
            best = np.lexsort((self.ids[close], -score))[: self.k]
            yield int(query_ids[i]), self.ids[close[best]], score[best], kth if len(s) > self.k else (float(s.min()) if len(s) == self.k else -math.inf)


def _run(k: int, top_log2: float):
    """Search rows (place, kind, id, v, bound), sorted by place and kind: kind 0 are the block's rows, 1 its queries."""

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, [], None
        for batch in batches:
            places, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = [0, *(np.flatnonzero((places[1:] != places[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), len(places)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if places[x] != place:
                    place, held, block = places[x], [], None
                part = batch.slice(x, y - x)
                ids, v = np.asarray(part.column(2)), matrix(part.column(3))
                if kinds[x] == 0:
                    held.append((ids, v))
                    continue
                if block is None and held:
                    ids0, v0 = (np.concatenate(c) for c in zip(*held, strict=True))
                    order = np.argsort(ids0, kind="stable")
                    block, held = Block(ids0[order], v0[order], top_log2, k), []
                if block is None:
                    continue
                bound = np.asarray(part.column(4).fill_null(-math.inf))
                for at in range(0, len(ids), TOGETHER):
                    s = slice(at, at + TOGETHER)
                    out = list(block.search(ids[s], v[s], bound[s]))
                    n = [len(f) for _, f, _, _ in out]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat([i for i, *_ in out], n), pa.int64()), pa.array(np.concatenate([f for _, f, _, _ in out]), pa.int64()),
                        pa.array(np.concatenate([c for _, _, c, _ in out])), pa.array(np.repeat([b for *_, b in out], n)),
                    ], ["query_id", "vec_id", "score", "bound"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: each query's k nearest rows found, by inner product in double precision.

    Queries are the rows where ``is_query``; candidates are all rows but those with the query's id. Vectors that are null,
    zero, or hold null or non-finite components and rows with a null id take no part. Products exist between vectors of one
    length only: the length that most rows have counts (the larger of two as frequent), rows of other lengths take no part.
    Any magnitude is searched; a product that overflows is infinite, one without a value ranks last. Ties go to smaller ids.
    An id with several vectors has the least of them and is a query if one of its rows is. Other columns aren't read.
    Empty in, empty out.

    Each row goes to one block by a hash of its id, and each query to all blocks; on few blocks, and while the first is searched
    ahead, several tasks share a block.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("query"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.min(F.struct(F.size("v").alias("length"), "v")).alias("s"), F.max(F.coalesce("query", F.lit(False))).alias("query"), F.count("*").alias("copies"))
    most = F.array_max(F.transform("s.v", lambda x: F.abs(x.cast("double"))))
    log2_norm = F.log2(most) + F.log2(F.aggregate(F.transform("s.v", lambda x: x.cast("double") / most), F.lit(0.0), lambda a, x: a + x * x)) / 2
    lengths = rows.groupBy(F.col("s.length").alias("length")).agg(F.count("*").alias("n"), F.count_if("query").alias("queries"), F.max(log2_norm).alias("top"))
    main = lengths.orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not main:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    length, n, n_queries, top_log2 = main[0]
    rows = rows.where(F.col("s.length") == length).select("id", F.col("s.v").alias("v"), "query")
    blocks = -(-n // max(1, min(block, BLOCK_BYTES // (20 * length))))

    def shares(n_blocks: int) -> int:
        """Tasks that share a block, so that all cores have work."""
        return max(1, min(-(-spark.sparkContext.defaultParallelism // n_blocks), n_queries // SHARED))

    rows = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    queries = rows.where("query").select("id", "v")

    def searched(data: DataFrame, asked: DataFrame, first: int, n_blocks: int) -> DataFrame:
        """Blocks ``first`` to first + n_blocks - 1; task (b - first) * shared + g has block b and group g of the queries."""
        shared = shares(n_blocks)
        asked = asked.withColumn("g", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(shared)).cast("int"))
        groups = F.explode(F.sequence(F.lit(0), F.lit(shared - 1)))
        left = data.withColumn("g", groups).select(((F.col("b") - first) * shared + F.col("g")).alias("place"), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("double").alias("bound"))
        right = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select((F.col("b") * shared + F.col("g")).alias("place"), F.lit(1).alias("kind"), "id", "v", "bound")
        dealt = left.union(right).repartitionById(n_blocks * shared, F.col("place")).sortWithinPartitions("place", "kind")
        return dealt.mapInArrow(_run(k, top_log2), "query_id long, vec_id long, score double, bound double")

    unbounded = queries.withColumn("bound", F.lit(None).cast("double"))
    if blocks < AHEAD:
        found = searched(rows, unbounded, 0, blocks)
    else:
        found = written(searched(rows.where("b = 0"), unbounded, 0, 1), "neighbours")
        known = found.groupBy("query_id").agg(F.max("bound").alias("bound"))
        bounded = queries.join(known, F.col("id") == F.col("query_id"), "left").select("id", "v", "bound")
        found = found.union(searched(rows.where("b > 0"), bounded, 1, blocks - 1))
    by_rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
