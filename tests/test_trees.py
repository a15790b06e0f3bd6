"""Trees against splits found by hand, and out of fold on rows that a fold's model must not know."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtab.operators import trees as T


def rows(spark, n=120, seed=1):
    r = random.Random(seed)
    data = []
    for i in range(n):
        label = r.choice([0, 1, 2])
        x = [r.random() + label, r.random() - label, r.random(), r.random()]
        data.append((i, i % 4, label if r.random() > 0.05 else None, x))
    return spark.createDataFrame(data, "vec_id bigint, fold bigint, label int, x array<double>")


def prepared(d, sided=2):
    return T.binned(T.mirrored(d, "x", "label", sided, "vec_id"), "x", 4)


def test_mirror_images_stay_in_their_fold(spark):
    d = spark.createDataFrame([(1, 3, 0, [1.0, 2.0, 3.0]), (2, 1, 2, [4.0, 5.0, 6.0]), (3, 0, None, None)], "vec_id bigint, fold bigint, label int, x array<double>")
    got = {(r.vec_id, r["copy"]): (r.fold, r.label, r.x, r.train) for r in T.mirrored(d, "x", "label", 2, "vec_id").collect()}
    assert got[1, 1] == (3, 1, [2.0, 1.0, 3.0], True) and got[2, 1] == (1, 2, [5.0, 4.0, 6.0], True) and got[3, 0] == (0, None, None, False)


def test_bins(spark):
    d = spark.createDataFrame([(0.0, 5.0), (1.6, 5.0), (8.0, 5.0), (16.0, 5.0), (None, 5.0)], "a double, b double").select(F.array("a", "b").alias("x"))
    assert [r.bins for r in T.binned(d, "x", 2).collect()] == [[0, 0], [1, 0], [8, 0], [15, 0], [0, 0]]


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_out_of_fold(spark, kind):
    d = rows(spark)
    x = prepared(d)
    if kind == "boosted":
        out, trees = T.boosted(x, "label", 3, 4, 4, rounds=3)
        got = {r.vec_id: int(np.argmax(r.scores)) for r in out.collect()}
        assert len(trees) == 4 * 3 * 3
    else:
        out, trees = T.forest(x, "vec_id", "label", 3, 4, 4, trees=7, tried=3)
        got = {r.vec_id: int(np.argmax(r.p)) for r in out.collect()}
        assert all(abs(sum(r.p) - 1) < 1e-9 for r in out.collect()) and len(trees) == 4 * 7
    want = {r.vec_id: r.label for r in d.collect()}
    assert sorted(got) == sorted(want)
    known = [i for i in want if want[i] is not None]
    assert np.mean([got[i] == want[i] for i in known]) > 0.7
    # A fold's own labels do not matter to its predictions.
    changed = d.withColumn("label", F.when((F.col("fold") == 2) & F.col("label").isNotNull(), (F.col("label") + 1) % 3).otherwise(F.col("label")))
    y = prepared(changed)
    again, _ = T.boosted(y, "label", 3, 4, 4, rounds=3) if kind == "boosted" else T.forest(y, "vec_id", "label", 3, 4, 4, trees=7, tried=3)
    column = "scores" if kind == "boosted" else "p"
    same = {r.vec_id: r[column] for r in out.where("fold = 2").collect()}
    assert {r.vec_id: r[column] for r in again.where("fold = 2").collect()} == same


def test_first_split_is_the_best_one(spark):
    data = [(i, 1, int(i >= 5), [float(i), 0.0]) for i in range(16)] + [(99, 0, None, [3.0, 0.0])]
    d = spark.createDataFrame(data, "vec_id bigint, fold bigint, label int, x array<double>")
    x = T.binned(d.withColumn("copy", F.lit(0)).withColumn("train", F.col("label").isNotNull()), "x", 2)
    out, trees = T.boosted(x, "label", 2, 2, 2, rounds=1, depth=1)
    root = trees[0, 0][0]
    assert (root.feature, root.cut) == (0, 4)
    weight = {0: 16 / 2 / 5, 1: 16 / 2 / 11}
    g, h = -5 * weight[0] * 0.5, 5 * weight[0] * 0.25
    assert trees[0, 0][1].values[0] == pytest.approx(-0.3 * g / (h + 1), abs=1e-5)
    assert out.where("vec_id = 99").first().scores[0] > 0


def test_no_rows(spark):
    d = rows(spark, 0)
    out, trees = T.boosted(prepared(d), "label", 3, 4, 4, rounds=1, depth=1)
    assert out.count() == 0 and not any(trees.values())
