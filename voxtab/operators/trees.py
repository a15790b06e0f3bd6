"""Boosted trees and forests on binned rows, out of fold, by histograms that Spark merges.

Rows hold bins instead of values: `bins` has one byte per feature, `fold` the fold a
row belongs to, `train` is false for rows that are only scored. One model is fitted
per fold, on the training rows outside it, and all models grow at once: for every
level of all their trees, each task adds up integer histograms per (model, tree,
node, feature, bin), the groups are merged, and one small row per node comes back
with its best split. So a fit is a few passes over the rows, what reaches the driver
is one row per node of the model, and as sums are of integers, any order of tasks
and any retry give the same trees.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.plans.lineage import materialize

BINS = 16
#: Gradients are summed as integers of this unit.
UNIT = 1 << 20
#: Fixed: the cumulated chances of 0, 1, 2 and 3 copies in a bootstrap sample, in thousandths (Poisson with mean 1).
COPIES = (368, 736, 920, 981)


class Split(NamedTuple):
    """What a node does: rows whose bin of `feature` is at most `cut` go left; a leaf has feature -1 and values."""

    feature: int
    cut: int
    values: tuple[float, ...]


#: Per (model, tree): its nodes by number; the children of node i are 2 i + 1 and 2 i + 2.
Trees = dict[tuple[int, int], dict[int, Split]]


def binned(rows: DataFrame, features: str, dims: int, bins: int = BINS) -> DataFrame:
    """rows with bins instead of the array `features` of at least dims numbers: equal widths between each feature's least and largest value.

    A null or missing value has bin 0, and so has every value of a constant feature.
    """
    x = [F.get(features, F.lit(d)) for d in range(dims)]
    ends = rows.agg(*[F.min(c).alias(f"l{d}") for d, c in enumerate(x)], *[F.max(c).alias(f"h{d}") for d, c in enumerate(x)]).first()
    low, high = ([ends[f"{e}{d}"] or 0.0 for d in range(dims)] for e in "lh")

    def one(d: int):
        width = (high[d] - low[d]) / bins
        at = F.least(F.floor((x[d] - low[d]) / width), F.lit(bins - 1)).cast("int")
        return F.when(x[d].isNotNull(), at).otherwise(0) if width > 0 else F.lit(0)

    return rows.withColumn("bins", F.array(*[one(d) for d in range(dims)])).drop(features)


def mirrored(rows: DataFrame, features: str, label: str, sided: int, key: str) -> DataFrame:
    """rows, as scored ones (train false), and for training each of them and its mirror image, in the same fold.

    A mirror image swaps features 2m and 2m + 1, and a sided label (below `sided`)
    with its partner. `copy` is 0 for a row itself and 1 for its image.
    """
    x = F.col(features)
    swapped = F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, F.when(i % 2 == 1, i - 1).when(i + 1 < F.size(x), i + 1).otherwise(i)))
    other = F.when(F.col(label) < sided, F.col(label).bitwiseXOR(1)).otherwise(F.col(label))
    own = rows.withColumn("copy", F.lit(0))
    image = rows.withColumn(features, F.when(F.size(x) > 0, swapped).otherwise(x)).withColumn(label, other).withColumn("copy", F.lit(1))
    return own.unionByName(image).withColumn("train", F.col(label).isNotNull())


def _route(trees: dict[int, Split], bins: np.ndarray) -> np.ndarray:
    """The node of one tree that each row reaches."""
    at = np.zeros(len(bins), np.int64)
    for node in sorted(trees):
        split = trees[node]
        if split.feature >= 0:
            here = at == node
            at[here] = 2 * node + 1 + (bins[here, split.feature] > split.cut)
    return at


def _values(trees: dict[int, Split], at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(at), width))
    for node, split in trees.items():
        if split.feature < 0:
            out[at == node] = split.values
    return out


def _matrix(column: pa.Array, dims: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)


def _histograms(state: DataFrame, dims: int, groups, width: int) -> DataFrame:
    """(model, tree, node, feature, sums): sums of `width` integers per bin, from what `groups(batch)` yields.

    groups yields (model, tree, node, rows, features, values): the rows of a batch
    that are in the node, the features to try, and width integers for each row.
    """
    schema = "model int, tree int, node int, feature int, sums array<bigint>"
    kinds = pa.schema([("model", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        total: dict[tuple[int, int, int, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            bins = _matrix(b.column("bins"), dims, np.int64)
            for model, tree, node, rows, features, values in groups(b, bins):
                cell = (bins[np.ix_(rows, features)] + np.arange(len(features)) * BINS).ravel()
                each = np.repeat(values, len(features), axis=0)
                tables = np.stack([np.bincount(cell, v, len(features) * BINS) for v in each.T], 1).astype(np.int64).reshape(len(features), -1)
                for f, flat in zip(features, tables):
                    key = (model, tree, node, int(f))
                    total[key] = total[key] + flat if key in total else flat
        if total:
            keys = list(zip(*total))
            yield pa.RecordBatch.from_arrays([*[pa.array(k, pa.int32()) for k in keys], pa.array(list(total.values()), kinds[4].type)], schema=kinds)

    parts = state.mapInArrow(run, schema)
    merged = [F.sum(F.get("sums", F.lit(i))) for i in range(BINS * width)]
    return parts.groupBy("model", "tree", "node", "feature").agg(F.array(*merged).alias("sums"))


def _best(histograms: DataFrame, judge) -> dict[tuple[int, int, int], tuple]:
    """Per (model, tree, node) the best split over features: judge(sums [BINS, width]) gives (gain, cut, ...) of one feature.

    Gains are compared to nine decimals, ties go to the smaller feature and cut.
    """
    schema = "model int, tree int, node int, feature int, gain double, cut int, total array<bigint>"
    kinds = pa.schema([("model", pa.int32()), ("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("cut", pa.int32()), ("total", pa.list_(pa.int64()))])

    def run(batches):
        for b in batches:
            rows = []
            for *key, sums in zip(*[b.column(c).to_pylist() for c in range(5)]):
                table = np.array(sums, np.int64).reshape(BINS, -1)
                gain, cut = judge(table, key[0])
                rows.append((*key, round(float(gain), 9), int(cut), table.sum(0)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), kinds)], schema=kinds)

    scored = histograms.mapInArrow(run, schema)
    pick = F.min_by(F.struct("feature", "cut", "gain", "total"), F.struct(-F.col("gain"), "feature", "cut")).alias("b")
    return {(r["model"], r["tree"], r["node"]): tuple(r["b"]) for r in scored.groupBy("model", "tree", "node").agg(pick).collect()}


def _cuts(left: np.ndarray, count: np.ndarray, least: int) -> np.ndarray:
    """Which of the BINS - 1 cuts leave `least` rows on both sides; count is cumulative."""
    return (count[:-1] >= least) & (count[-1] - count[:-1] >= least)


def class_counts(rows: DataFrame, label: str, models: int, classes: int) -> np.ndarray:
    """Training rows per model and class: those outside the model's fold."""
    n = np.zeros((models, classes), np.int64)
    for r in rows.where("train").groupBy("fold", label).agg(F.count("*").alias("n")).collect():
        n[np.arange(models) != r["fold"], r[label]] += r["n"]
    return n


def boosted(rows: DataFrame, label: str, classes: int, dims: int, folds: int, rounds: int = 5, depth: int = 2, rate: float = 0.3, ridge: float = 1.0, least: int = 3) -> tuple[DataFrame, Trees]:
    """Multi-class Newton boosting: rows with `scores`, the sums of their own fold's model, and the trees.

    Every round gives one tree per class on the gradients of the softmax loss, with
    rows weighted so that classes weigh the same. A split needs `least` rows on
    either side and a gain above 0; leaves are -rate G / (H + ridge). Rows of null
    label are scored only. Round by round the rows are written with the scores of
    all models, so a lost executor costs a part of one pass.
    """
    n = class_counts(rows, label, folds, classes)
    weight = np.divide(1.0, n, out=np.zeros(n.shape), where=n > 0)
    weight *= np.divide(n.sum(1), (weight * n).sum(1), out=np.zeros(folds), where=n.sum(1) > 0)[:, None]
    state = materialize(rows.withColumn("scores", F.array_repeat(F.lit(0.0), folds * classes)))
    trees: Trees = {}
    for r in range(rounds):
        grown: dict[int, dict[int, Split]] = {m * classes + c: {} for m in range(folds) for c in range(classes)}
        for level in range(depth + 1):

            def groups(b: pa.RecordBatch, bins: np.ndarray, grown=grown, level=level):
                fold, y = b.column("fold").to_numpy(), b.column(label).to_numpy(zero_copy_only=False)
                train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
                scores = _matrix(b.column("scores"), folds * classes, float).reshape(-1, folds, classes)
                for m in range(folds):
                    rows = np.flatnonzero(train & (fold != m))
                    if not len(rows):
                        continue
                    e = np.exp(scores[rows, m] - scores[rows, m].max(1, keepdims=True))
                    p, label_of = e / e.sum(1, keepdims=True), y[rows].astype(np.int64)
                    w = weight[m, label_of]
                    for c in range(classes):
                        at = _route(grown[m * classes + c], bins[rows])
                        g = np.floor(w * (p[:, c] - (label_of == c)) * UNIT + 0.5).astype(np.int64)
                        h = np.floor(w * p[:, c] * (1 - p[:, c]) * UNIT + 0.5).astype(np.int64)
                        values = np.stack([g, h, np.ones(len(rows), np.int64)], 1)
                        for node in range(2**level - 1, 2 ** (level + 1) - 1):
                            here = at == node
                            if here.any():
                                yield m, c, node, rows[here], np.arange(dims if level < depth else 1), values[here]

            def judge(table: np.ndarray, _):
                left = table.cumsum(0)
                g, h, count = left[:, 0] / UNIT, left[:, 1] / UNIT, left[:, 2]
                score = lambda a, b: a * a / (b + ridge)
                gain = score(g[:-1], h[:-1]) + score(g[-1] - g[:-1], h[-1] - h[:-1]) - score(g[-1], h[-1])
                gain = np.where(_cuts(left, count, least), np.round(gain, 9), -1.0)
                return gain.max(), gain.argmax()

            for (m, c, node), (feature, cut, gain, total) in _best(_histograms(state, dims, groups, 3), judge).items():
                leaf = -rate * (total[0] / UNIT) / (total[1] / UNIT + ridge)
                grown[m * classes + c][node] = Split(feature, cut, ()) if gain > 0 and level < depth else Split(-1, 0, (leaf,))
        trees |= {(m, r * classes + c): grown[m * classes + c] for m in range(folds) for c in range(classes)}
        state = materialize(_add(state, grown, folds, classes, dims))
    at = F.col("fold") * classes
    own = F.slice("scores", F.coalesce(at.cast("int"), F.lit(0)) + 1, classes)
    return state.where("copy = 0").withColumn("scores", own), trees


def _add(state: DataFrame, grown: dict[int, dict[int, Split]], folds: int, classes: int, dims: int) -> DataFrame:
    """state with the new trees' leaves added to the scores."""
    names = state.columns

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bins = _matrix(b.column("bins"), dims, np.int64)
            scores = _matrix(b.column("scores"), folds * classes, float).copy()
            for t, nodes in grown.items():
                scores[:, t] += _values(nodes, _route(nodes, bins), 1)[:, 0]
            cols = [pa.array(list(scores), pa.list_(pa.float64())) if c == "scores" else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return state.mapInArrow(run, state.schema)


def softmax(scores: str):
    """The shares that exponentials of an array's numbers have."""
    e = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, x: s + x))


def turn(a, b):
    """A number below 1000 by two ids: the same draw in any engine."""
    return (a * 7919 + b * 104729 + a * b * 31) % 1000


def forest(rows: DataFrame, key: str, label: str, classes: int, dims: int, folds: int, trees: int = 5, depth: int = 3, tried: int = 8, least: int = 1) -> tuple[DataFrame, Trees]:
    """A random forest: rows with `p`, the average leaf shares of their own fold's trees, and the trees.

    A tree counts each training row 0 to 4 times, by a draw of its key; every node
    tries `tried` features, by a draw of its number; splits lower the Gini impurity
    of classes weighted to weigh the same, and leaves hold weighted class shares.
    """
    n = class_counts(rows, label, folds, classes)
    weight = np.divide(n.sum(1, keepdims=True), n * classes, out=np.zeros(n.shape), where=n > 0)
    state = materialize(rows)
    grown: Trees = {(m, t): {} for m in range(folds) for t in range(trees)}
    for level in range(depth + 1):

        def groups(b: pa.RecordBatch, bins: np.ndarray, level=level):
            fold, y = b.column("fold").to_numpy(), b.column(label).to_numpy(zero_copy_only=False)
            train, ids = b.column("train").to_numpy(zero_copy_only=False).astype(bool), b.column(key).to_numpy().astype(np.int64)
            for t in range(trees):
                times = np.searchsorted(np.array(COPIES), turn(ids, t), "right")
                for m in range(folds):
                    rows = np.flatnonzero(train & (fold != m) & (times > 0))
                    at = _route(grown[m, t], bins[rows])
                    values = np.zeros((len(rows), classes), np.int64)
                    values[np.arange(len(rows)), y[rows].astype(np.int64)] = times[rows]
                    for node in range(2**level - 1, 2 ** (level + 1) - 1):
                        here = at == node
                        if here.any():
                            few = np.argsort(turn(np.arange(dims), np.int64(t * 64 + node + 1)), kind="stable")[:tried]
                            yield m, t, node, rows[here], few if level < depth else few[:1], values[here]

        def judge(table: np.ndarray, m: int):
            left = table.cumsum(0)
            w = left * weight[m]
            gini = lambda x: x.sum(-1) - np.divide((x * x).sum(-1), x.sum(-1), out=np.zeros(x.shape[:-1]), where=x.sum(-1) > 0)
            gain = gini(w[-1]) - gini(w[:-1]) - gini(w[-1] - w[:-1])
            gain = np.where(_cuts(left, left.sum(1), least), np.round(gain, 9), -1.0)
            return gain.max(), gain.argmax()

        for (m, t, node), (feature, cut, gain, total) in _best(_histograms(state, dims, groups, classes), judge).items():
            share = np.array(total) * weight[m]
            grown[m, t][node] = Split(feature, cut, ()) if gain > 0 and level < depth else Split(-1, 0, tuple((share / share.sum()).tolist()))
    names = [c for c in rows.columns if c != "bins"]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            bins, fold = _matrix(b.column("bins"), dims, np.int64), b.column("fold").to_numpy()
            p = np.zeros((b.num_rows, classes))
            for (m, _), nodes in grown.items():
                here = np.flatnonzero(fold == m)
                p[here] += _values(nodes, _route(nodes, bins[here]), classes) / trees
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(list(p), pa.list_(pa.float64()))], names=[*names, "p"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c != "bins") + ", p array<double>"
    return state.where("copy = 0").mapInArrow(run, schema), grown
