"""Approximate nearest neighbours by collision counting.

Vectors are projected on m lines (whole sets of orthogonal directions). Every row
lies in one block, which keeps one array per line, sorted by projection. A query
opens a window around its own projection on every line; a vector inside the window
collides with it there. Windows widen by the factor `ratio` (virtual rehashing: no
array is built anew) through a series of radii R: a vector within R falls into a
line's window with probability P, so one that collides on `slack` standard
deviations less than m P lines, or more, is verified by its exact distance. A query
ends in a block once k verified vectors lie within R, or all rows are verified.
Queries are sent to every block and stream past its arrays; each block sends k rows
per query on.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.plans.leaders import tasks
from voxtab.plans.lineage import materialize

#: Rows of a block: at most so many, and not fewer than that for the sake of more tasks.
MOST, LEAST = 65_536, 16_384


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles of the rows that take part: no nulls, only finite components, not all zero."""
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad & F.exists("embedding", lambda x: x != 0))


def directions(dim: int, lines: int, seed: int) -> np.ndarray:
    """Unit columns: orthogonal sets of dim each, as many as `lines` needs."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-lines // dim))], 1)[:, :lines]


class Block:
    """Sorted projections of a block's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: np.ndarray, ratio: float):
        self.ids, self.x, self.lines = ids, x, lines
        p = (x @ lines).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order, 1)
        # Radii from an eighth of the spread of the vectors to twice their greatest distance from the middle.
        far = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
        low, high = max(far.mean() / 8, 1e-300), max(2.1 * far.max(), 1e-299)
        self.radii = low * ratio ** np.arange(2 + int(np.log(high / low) / np.log(ratio)))

    def search(self, qid: int, q: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and distances of the k nearest that were verified, nearest first, ties to the smaller id; and how many were verified."""
        m, n = self.lines.shape[1], len(self.ids)
        share = erf(1 / sqrt(2))  # of a line's window, whose half-width is one standard deviation of R's projections
        threshold = max(1, int(m * share - slack * sqrt(m * share * (1 - share))))
        at, width = q @ self.lines, self.radii / sqrt(len(q))
        lo = np.stack([np.searchsorted(s, a - width) for s, a in zip(self.sorted, at)])
        hi = np.stack([np.searchsorted(s, a + width, "right") for s, a in zip(self.sorted, at)])
        start = np.stack([np.searchsorted(s, a) for s, a in zip(self.sorted, at)])
        hits, open_ = np.zeros(n, np.int64), self.ids != qid
        found, dist = [np.zeros(0, np.int64)], [np.zeros(0)]
        total, left = 0, int(open_.sum())
        before_lo = before_hi = start
        for step in range(len(self.radii)):
            new_lo, new_hi = np.minimum(lo[:, step], start), np.maximum(hi[:, step], start)
            if step == len(self.radii) - 1:
                new_lo, new_hi = np.zeros(m, np.int64), np.full(m, n)
            rings = [o[a:b] for o, a, b in zip(self.order, new_lo, before_lo) if b > a] + [o[a:b] for o, a, b in zip(self.order, before_hi, new_hi) if b > a]
            before_lo, before_hi = new_lo, new_hi
            if not rings:
                continue
            hits += np.bincount(np.concatenate(rings), minlength=n)
            new = np.flatnonzero((hits >= threshold) & open_)
            if len(new):
                open_[new] = False
                found.append(new)
                dist.append(np.sqrt(((self.x[new] - q) ** 2).sum(1)))
                total += len(new)
            if total == left:
                break
            if total >= k and np.partition(np.concatenate(dist), k - 1)[k - 1] <= self.radii[step]:
                break
        f, d = np.concatenate(found), np.concatenate(dist)
        best = np.lexsort((self.ids[f], d))[:k]
        return self.ids[f[best]], d[best], total


def nearest(vectors: DataFrame, is_query, k: int = 10, lines: int = 128, slack: float = 1.0, ratio: float = 1.08, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): the k nearest rows found for each query, by Euclidean distance.

    is_query: a condition on vec_id; verified: the share of the rows of the found
    row's block whose distance from the query was computed. A query is no neighbour of itself (rows of its own
    vec_id are left out); of rows that repeat a query's vec_id the least vector is
    asked, while each row that repeats another vec_id may be found. Rows whose
    vectors are null, zero or hold nulls or non-finite numbers take no part, nor do
    those of another length than most. Fewer than k candidates give as many rows; no
    queries or no vectors give none. Other columns are not read.
    """
    rows = usable(vectors).withColumn("dim", F.size("embedding"))
    rows = materialize(rows)
    most = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, verified double")
    dim, n = most
    rows = rows.where(F.col("dim") == dim).drop("dim")
    blocks = max(-(-n // MOST), min(tasks(rows), n // LEAST), 1)
    a = directions(dim, lines, seed)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    held = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(False))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))

    def run(batches):
        block, number = None, None
        ids, xs = [], []
        for b in batches:
            of, own, x = b.column(2).to_numpy(), b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, dim)
            asks = b.column(3).to_numpy(zero_copy_only=False)
            for part in np.unique(of).tolist():
                if part != number:
                    block, number, ids, xs = None, part, [], []
                rows, queries = np.flatnonzero((of == part) & ~asks), np.flatnonzero((of == part) & asks)
                if len(rows):
                    ids.append(own[rows])
                    xs.append(x[rows])
                if len(queries) and ids:
                    block = block or Block(np.concatenate(ids), np.concatenate(xs), a, ratio)
                    out: list[list] = [[], [], [], []]
                    for qid, v in zip(own[queries].tolist(), x[queries]):
                        near, d, seen = block.search(qid, v, k, slack)
                        for c, values in zip(out, ([qid] * len(near), near.tolist(), d.tolist(), [seen / len(block.ids)] * len(near))):
                            c += values
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["query_id", "vec_id", "score", "verified"])

    dealt = held.select("vec_id", "embedding", "block", "asks").unionByName(asked.select("vec_id", "embedding", "block", "asks"))
    dealt = dealt.repartitionByRange(blocks, "block").sortWithinPartitions("block", "asks")
    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double, verified double")
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")
