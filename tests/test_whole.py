"""Steps that once left part of their job out: far partners, ends of blocks, counts that a method names."""

import random

from pyspark.sql import functions as F

from voxtab.operators import learning as L
from voxtab.operators import necks as K
from voxtab.operators import scoring as S
from voxtab.operators.space import least_distances, nearest_always
from voxtab.plans.lineage import stored

UNIT = (1.0, 1.0, 1.0)
PLACE = "case_id int, i int, j int, k int"


def test_the_nearest_is_found_however_far(spark):
    draw = random.Random(1)
    cell = lambda: tuple(draw.randrange(0, 200) for _ in range(3))
    left = sorted({(c, *cell()) for c in (0, 1) for _ in range(20)}) + [(2, 0, 0, 0), (None, 0, 0, 0), (0, None, 0, 0)]
    right = sorted({(c, *cell(), draw.randrange(9)) for c in (0, 1) for _ in range(5)}) + [(2, None, 0, 0, 1), (None, 0, 0, 0, 1)]
    got = nearest_always(spark.createDataFrame(left, PLACE), spark.createDataFrame(right, PLACE + ", cls int"), 1.0, UNIT).collect()
    want = []
    for c, *x in left:
        near = min(((round(sum((a - b) ** 2 for a, b in zip(x, y)) ** 0.5, 9), y, v) for d, *y, v in right if c in (0, 1) and d == c and None not in x), default=None)
        want.append((c, *x, near and near[0], near and near[2]))
    assert sorted(((*r[:4], r[4] if r[4] is None else round(r[4], 9), r[5]) for r in got), key=str) == sorted(want, key=str)


def test_false_blobs_know_how_far_the_truth_is(spark):
    comps = stored(spark.createDataFrame([(0, 0, 0, 0, 0, 1), (0, 7, 500, 0, 0, 1), (0, 7, 501, 0, 0, 1), (1, 3, 0, 0, 0, 2)], "case_id int, comp_id bigint, i int, j int, k int, cls int"))
    truth = spark.createDataFrame([(0, 0, 0, 0), (0, None, 0, 0)], PLACE)
    assert {(r["case_id"], r["comp_id"], r["gt_mm"]) for r in K.false_blobs(comps, truth, None, UNIT).collect()} == {(0, 7, 500.0), (1, 3, None)}
    assert [tuple(r) for r in least_distances(comps, truth, ["case_id", "comp_id"], 1.0, UNIT, "d").orderBy("comp_id").collect()] == [(0, 0, 0.0), (0, 7, 500.0)]


def test_the_last_row_of_a_block_has_a_next_one(spark):
    draw = random.Random(2)
    ids = sorted(draw.sample(range(50_000), 300))
    rows = [(n, n % 2, [float(n)]) for n in ids] + [(None, 0, [1.0]), (None, 0, [1.0])]
    e = spark.createDataFrame(rows, "vec_id bigint, label int, x array<double>")
    got = {(r.vec_id, r.label): r.x[0] for r in L.interpolated_rows(e, spark.createDataFrame([(0,), (1,)], "label int"), 0.5).collect()}
    own = [[n for n in ids if n % 2 == c] for c in (0, 1)]
    assert got == {(a, c): (a + b) / 2 for c in (0, 1) for a, b in zip(own[c], own[c][1:])} | {(None, 0): 1.0}


def test_instances_have_all_four_counts(spark):
    found = spark.createDataFrame([(1, 3, 2), (2, 0, 1)], "cls int, tp bigint, fp bigint")
    truth = spark.createDataFrame([(1, 2), (3, 4)], "cls int, n bigint")
    assert {tuple(r) for r in S.instance_counts(found, truth).collect()} == {(1, 3, 2, -1, 4), (2, 0, 1, 0, 6), (3, 0, 0, 4, 2)}


def test_queries_do_their_whole_job(spark):
    from voxtab.plans import queries_graphs, queries_lesions
    from voxtab.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    kinds = {r["kind"] for r in QUERIES["match_nodes"](spark, sf).collect()}
    assert kinds == {"true", "false", "missed"}
    assert QUERIES["geodesic"](spark, sf).agg(F.max("dist")).first()[0] > 2 and queries_graphs.SPUR == 2.0
    assert queries_lesions.derived_channels(spark, sf).where("proximity = 0").isEmpty()
