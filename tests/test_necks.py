"""Micro-cases of necks, thickness, false blobs and bridges: thick bodies, ties, repeated rows, empty tables."""

from itertools import product

import pytest

from voxtab.operators.bridges import bridge_components
from voxtab.operators.necks import false_blobs, inner_distance, neck_set, protrusion

UNIT = (1.0, 1.0, 1.0)
VOX = "case_id bigint, i int, j int, k int, cls int"
LES = "case_id bigint, comp_id bigint, i int, j int, k int, cls int"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_inner_distance_of_a_thick_cube_and_of_repeated_voxels(spark):
    cube = [(1, i, j, k, 1) for i, j, k in product(range(7), repeat=3)]
    got = {r[:3]: r[3] for r in rows(inner_distance(spark.createDataFrame(cube + cube, VOX), UNIT), "i", "j", "k", "inner")}
    assert len(got) == 343
    assert all(d == min(1 + min(p), 7 - max(p)) for p, d in got.items())


def test_neck_is_the_largest_piece_or_the_whole_lesion(spark):
    lesion = spark.createDataFrame([(1, 5, i, 0, 0, 1) for i in range(8)] + [(1, 9, 20, 0, 0, 1)], LES)
    vessel = spark.createDataFrame([(1, i, 0, 0, 2) for i in (0, 1, 4, 5, 6)] * 2, VOX)
    got = rows(neck_set(lesion, vessel), "comp_id", "i", "whole")
    assert got == [(5, 4, False), (5, 5, False), (5, 6, False), (9, 20, True)]


def test_protrusion_points_away_from_the_vessel(spark):
    lesion = spark.createDataFrame([(1, 5, 0, 0, k, 1) for k in range(1, 5)] + [(1, 6, 50, 0, 0, 1)], LES)
    vessel = spark.createDataFrame([(1, 0, 0, 0, 3), (1, 1, 0, 0, 2)], VOX)
    (r,) = protrusion(lesion, vessel, 6.0, UNIT).collect()
    assert (r.comp_id, r.parent, r.length, r.ui, r.uj, r.uk) == (5, 3, 3.0, 0.0, 0.0, 1.0)


def test_false_blobs_rank_two_classes_with_ties_to_the_smaller(spark):
    found = spark.createDataFrame([(1, 5, 0, 0, k, c) for k, c in enumerate((4, 4, 2, 3))] + [(1, 6, 9, 0, 0, 1)], LES)
    truth = spark.createDataFrame([(1, 9, 0, 0, 1), (1, 0, 0, 5, 1)], VOX)
    assert rows(false_blobs(found, truth, 3.0, UNIT), "comp_id", "rank", "cls", "n", "n_vox", "gt_mm") == [(5, 1, 4, 2, 4, 2.0), (5, 2, 2, 1, 4, 2.0)]


@pytest.mark.parametrize("turn", [1, -1])
def test_bridges_are_those_of_an_ascending_pass(spark, turn):
    at = {10: 0, 20: 3, 30: 5, 40: 8, 50: 40}  # gaps 3, 2, 3; 50 is out of reach
    points = spark.createDataFrame([(1, c, turn * i, 0, 0) for c, i in at.items()], "case_id bigint, comp_id bigint, i int, j int, k int")
    got = rows(bridge_components(points.unionByName(points), 5.0, UNIT), "a", "b", "w", "bridged")
    assert got == [(10, 20, 3.0, 10), (20, 30, 2.0, 10), (30, 40, 3.0, 10)]


def test_empty_tables(spark):
    lesion, vessel = spark.createDataFrame([], LES), spark.createDataFrame([], VOX)
    full = spark.createDataFrame([(1, 5, 0, 0, 0, 1)], LES)
    assert neck_set(lesion, vessel).count() == 0
    assert rows(neck_set(full, vessel), "comp_id", "whole") == [(5, True)]
    assert inner_distance(vessel, UNIT).count() == 0
    assert protrusion(full, vessel, 2.0, UNIT).count() == 0
    assert rows(false_blobs(full, vessel, 2.0, UNIT), "comp_id", "gt_mm") == [(5, None)]
    assert bridge_components(full.drop("cls"), 2.0, UNIT).count() == 0
