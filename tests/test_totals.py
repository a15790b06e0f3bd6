"""Exact percentiles over ranges against numpy, and running numbers of folds and resamples."""

import numpy as np

from voxtab.operators.experiments import bootstrap_weights, group_kfold
from voxtab.plans.totals import quantiles


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in rng.normal(size=501)] + [("b", float(v)) for v in rng.integers(0, 4, 300)] + [("c", 2.5), ("d", None), (None, 1.0)]
    got = {r.g: (r.p, r.q, r.r) for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"p": 0.005, "q": 0.5, "r": 0.995}).collect()}
    assert set(got) == {"a", "b", "c"}  # no values, or no group
    for g, found in got.items():
        want = np.quantile([v for k, v in rows if k == g], [0.005, 0.5, 0.995])
        assert np.allclose(found, want, atol=1e-12)
    assert quantiles(spark.createDataFrame([], "g string, v double"), "g", "v", {"p": 0.5}).count() == 0


def test_values_may_come_counted(spark):
    from voxtab.plans.catalog import QUERIES

    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", None, 7), ("b", 4.0, 2), ("b", 8.0, 1), ("b", 8.0, 1)]
    counted = spark.createDataFrame(rows, "g string, v double, n long")
    assert {r.g: r.p for r in quantiles(counted, "g", "v", {"p": 0.5}, "n").collect()} == {"a": 1.0, "b": 6.0}
    logical = QUERIES["profile_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("Expand") == 1 and "count(1)" not in logical.split("Expand")[0]  # rows are counted once a case before the levels


def test_patients_take_turns_by_size_then_id(spark):
    rows = [(1, 30), (2, 30), (3, 30), (4, 10), (5, 10), (6, 20), (7, 20), (8, 5)]
    got = {r.patient_id: r.fold for r in group_kfold(spark.createDataFrame(rows, "case_id bigint, patient_id bigint"), 3).collect()}
    assert got == {30: 0, 10: 1, 20: 2, 5: 0}


def test_resamples_draw_as_many_as_there_are(spark):
    w = bootstrap_weights(spark.createDataFrame([(n,) for n in (*range(50), 7, 7, None)], "id bigint"), "id", 4)
    assert {r.b: r.n for r in w.groupBy("b").agg({"w": "sum"}).withColumnRenamed("sum(w)", "n").collect()} == dict.fromkeys(range(4), 50)
