"""Golden micro-cases and invariants of the voxel operators."""

import pytest

from voxtab.operators import components as C
from voxtab.operators import graph as G
from voxtab.operators import morphology as M
from voxtab.operators import probability as P
from voxtab.operators import scoring as S
from voxtab.operators.experiments import group_kfold, leaks
from voxtab.operators.space import ball_offsets, box_offsets, cross_offsets, half_neighbours, voxel_key

SCHEMA = "case_id int, i int, j int, k int, cls int"


def voxels(spark, points, cls=1, case=1):
    return spark.createDataFrame([(case, *p, cls) for p in points], SCHEMA)


def n_components(df):
    return df.select("case_id", "comp_id").distinct().count()


def test_corner_contact(spark):
    v = voxels(spark, [(0, 0, 0), (1, 1, 1)])
    assert n_components(C.components(v, 26)) == 1
    assert n_components(C.components(v, 6)) == 2
    with pytest.raises(ValueError):
        half_neighbours(18)


def test_components_do_not_cross_cases_and_empty_tables(spark):
    v = voxels(spark, [(0, 0, 0)], case=1).unionByName(voxels(spark, [(0, 0, 1)], case=2))
    assert n_components(C.components(v, 26)) == 2
    assert C.components(voxels(spark, [])).count() == 0


@pytest.mark.parametrize("connectivity", [6, 26])
def test_components_across_blocks_against_a_search(spark, monkeypatch, connectivity):
    import random

    from voxtab.operators import pieces

    monkeypatch.setattr(pieces, "ROWS", 50)
    draw = random.Random(connectivity)
    near = half_neighbours(connectivity)
    at = {(c, s, draw.randrange(-70, 70), draw.randrange(-4, 4), draw.randrange(60, 68)) for c in (0, 1) for s in "RL" for _ in range(1500)}
    rows = sorted(at) + sorted(at)[:40] + [(None, "R", 0, 0, 0), (None, "R", 0, 0, 1), (0, None, 0, 0, 0), (0, "R", None, 0, 0), (0, "R", None, 0, 1)]
    got = C.components(spark.createDataFrame(rows, "case_id int, side string, i int, j int, k int"), connectivity, ("case_id", "side"))
    key = lambda i, j, k: None if i is None else i * (1 << 42) + j * (1 << 21) + k
    want = {}
    for start in sorted(at):
        todo = [start] if start not in want else []
        while todo:
            c, s, i, j, k = x = todo.pop()
            want[x] = key(*start[2:])
            todo += [y for a, b, d in near for t in (1, -1) if (y := (c, s, i + t * a, j + t * b, k + t * d)) in at and y not in want]
    wanted = sorted(((*r, want.get(r, key(*r[2:]))) for r in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == wanted and got.columns == ["case_id", "side", "i", "j", "k", "comp_id"]
    assert len({w[-1] for w in wanted}) < len(rows) * 2 / 3


def test_small_cases_are_not_contracted_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "connected_components", lambda *_, **__: pytest.fail("one block's pieces went in rounds"))
    assert n_components(C.components(voxels(spark, [(x, 0, 0) for x in range(50) if x % 10]))) == 5


def test_long_line_is_one_component(spark):
    v = voxels(spark, [(x, 0, 0) for x in range(300)])
    assert n_components(C.components(v, 6)) == 1


def test_closing_joins_two_cubes(spark):
    cube = [(a, b, c) for a in range(3) for b in range(3) for c in range(3)]
    v = voxels(spark, cube + [(a + 4, b, c) for a, b, c in cube])
    assert n_components(C.components(v, 26)) == 2
    closed = M.close_mm(v, 1.0, (1.0, 1.0, 1.0)).selectExpr("*", "1 as cls")
    assert n_components(C.components(closed, 26)) == 1
    assert v.select("case_id", "i", "j", "k").exceptAll(closed.drop("cls")).count() == 0


def test_erosion_undoes_box_dilation(spark):
    v = voxels(spark, [(0, 0, 0), (5, 5, 5)])
    back = M.erode(M.dilate(v, box_offsets(1)), box_offsets(1))
    assert back.exceptAll(v.drop("cls")).count() == 0 and back.count() == 2


def test_growth_adds_the_rounded_number(spark):
    v = voxels(spark, [(a, b, 0) for a in range(4) for b in range(5)])
    assert M.grow_volume(v, 1.32, reach=2).count() == 26


def test_scorers_disagree_on_classes_that_never_touch(spark):
    gt, pred = voxels(spark, [(0, 0, 0)]), voxels(spark, [(9, 9, 9)])
    n, cases = S.overlap_counts(gt, pred), gt.select("case_id")
    one = S.presence_v1(cases, n, 1).first()
    two = S.presence_v2(cases, n, 1).first()
    assert (one.tp, one.fp, one.fn) == (0, 1, 1)
    assert (two.tp, two.fp, two.fn) == (1, 0, 0)


def test_unknown_criterion_is_an_error(spark):
    with pytest.raises(ValueError):
        S.check_tp(spark.range(1), "area", 0.5)


def test_distances_of_an_empty_side(spark):
    assert M.directed_distances(voxels(spark, [(0, 0, 0)]), voxels(spark, []), 2.0).count() == 0


def test_surface_distance_and_its_conventions(spark):
    cube = [(x, y, z) for x in range(5) for y in range(5) for z in range(5)]
    far = [(x + 1, y, z) for x, y, z in cube]
    rows = [(1, *p) for p in cube] + [(2, 0, 0, 0)], [(1, *p) for p in far] + [(3, 0, 0, 0)]
    a, b = (spark.createDataFrame(r, "case_id int, i int, j int, k int") for r in rows)
    groups = spark.createDataFrame([(1,), (2,), (3,), (4,)], "case_id int")
    got = {r.case_id: r.hd for r in M.surface_distance(a, b, groups, (3, 4, 0)).collect()}
    assert got == {1: 1 / 5, 2: 1.0, 3: 1.0, 4: 0.0}


def test_distance_to_class_voxels_outside(spark):
    from voxtab.operators.lesions import distance_table

    comps = spark.createDataFrame([(1, 7, x, 0, 0) for x in range(3)], "case_id int, comp_id int, i int, j int, k int")
    labels = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 1, 1, 0, 1), (1, 2, 0, 0, 2), (1, 4, 0, 0, 3), (1, 9, 0, 0, 4)], "case_id int, i int, j int, k int, cls int")
    got = {r.cls: r.dist for r in distance_table(comps, labels, 2.5, (1.0, 1.0, 1.0)).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 2.0}  # one step away; wholly under the lesion; two steps; out of reach


def test_geodesic_goes_round_a_gap(spark):
    # A U of voxels: the straight way between its tips is empty.
    path = [(0, y, 0) for y in range(5)] + [(x, 4, 0) for x in range(1, 5)] + [(4, y, 0) for y in range(3, -1, -1)]
    v = voxels(spark, path)
    edges = G.skeleton_edges(v, (1.0, 1.0, 1.0))
    source = v.where("i = 0 and j = 0").select("case_id", voxel_key().alias("u"))
    far = G.geodesic(edges, source).agg({"dist": "max"}).first()[0]
    assert 10 < far < 12


def test_probabilities_sum_to_one(spark):
    x = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.8), (2, 0, 0.5), (2, 1, 0.5)], "lesion int, cls int, p double")
    prior = spark.createDataFrame([(0, 4), (1, 9)], "cls int, n int")
    for out in (P.prior_correct(x, prior, 0.5, ("lesion",)), P.gated_prior(x, prior, 0.6, 0.5, ("lesion",))):
        assert all(abs(r[0] - 1) < 1e-12 for r in out.groupBy("lesion").sum("p").select("sum(p)").collect())


def test_assignment_refuses_many_lesions(spark):
    with pytest.raises(ValueError):
        P.assign_unique(spark.range(1), 6, ("case_id",))


def test_folds_do_not_leak(spark):
    cases = spark.range(500).selectExpr("id as case_id", "id % 61 as patient_id")
    folded = group_kfold(cases, 5)
    assert folded.count() == 500 and leaks(folded).count() == 0


def test_offsets():
    assert len(cross_offsets(1)) == 7 and len(box_offsets(1)) == 27 and len(half_neighbours(26)) == 13
    assert len(ball_offsets(1.0, (1.0, 1.0, 1.0))) == 7
