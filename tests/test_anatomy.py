"""Golden micro-cases of landmark frames, the atlas, mirrored nodes, conventions, bone and synthetic balls."""

from math import sqrt

from voxtab.operators import anatomy as A
from voxtab.operators import bone as B
from voxtab.operators import synthetic as Y
from voxtab.operators.space import cross_offsets

NODES = "case_id bigint, node_id bigint, class_ids array<int>, x double, y double, z double"
RIGHT, LEFT, BASE = [(2, 4)], [(3, 5)], [(1, 4)]
ONE = (1.0, 1.0, 1.0)
#: Right landmark at x = 0, left at x = 8, base at y = 6 between them: the origin is (4, 2, 0), the scale 8.
FIRST = [(1, 0, [2, 4], 0.0, 0.0, 0.0), (1, 1, [3, 5], 8.0, 0.0, 0.0), (1, 2, [1, 4], 4.0, 6.0, 0.0)]


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODES)


def frame(spark, rows):
    return A.frames(nodes(spark, rows), RIGHT, LEFT, BASE)


def test_frame_axes_and_positions(spark):
    f = frame(spark, FIRST)
    r = f.first()
    assert (r.ox, r.oy, r.oz, r.s) == (4.0, 2.0, 0.0, 8.0)
    assert [(r["u" + c], r["v" + c], r["w" + c]) for c in "xyz"] == [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    p = A.positions(spark.createDataFrame([(1, 8.0, 2.0, 4.0), (2, 0.0, 0.0, 0.0)], "case_id bigint, x double, y double, z double"), f).collect()
    assert len(p) == 1 and (p[0].px, p[0].py, p[0].pz) == (0.5, 0.0, 0.5)
    assert abs(p[0].dl - sqrt(20) / 8) < 1e-12


def test_no_frame_without_three_landmarks_or_on_a_line(spark):
    assert frame(spark, FIRST[:2]).count() == 0
    assert frame(spark, [*FIRST[:2], (1, 2, [1, 4], 4.0, 0.0, 0.0)]).count() == 0
    assert frame(spark, [FIRST[0], (1, 1, [3, 5], 0.0, 0.0, 0.0), FIRST[2]]).count() == 0
    assert frame(spark, []).count() == 0


def test_first_landmark_by_id(spark):
    assert frame(spark, [*FIRST, (1, 9, [2, 4], 5.0, 5.0, 5.0)]).first().rx == 0.0


def test_atlas_fills_missing_nodes(spark):
    rows = [(c, n, k, x, y, z) for c in (1, 2, 3) for _, n, k, x, y, z in FIRST] + [(1, 5, [6, 7], 4.0, 2.0, 8.0), (2, 5, [6, 7], 4.0, 2.0, 8.0)]
    n, f = nodes(spark, rows), frame(spark, rows)
    types = A.atlas(n.where("size(class_ids) = 2 and class_ids[0] = 6"), f, 2)
    assert [(t.sig, t.n, t.px, t.py, t.pz) for t in types.collect()] == [("6,7", 2, 0.0, 0.0, 1.0)]
    got = A.node_distances(spark.createDataFrame([(c, 9, 4.0, 2.0, 5.0) for c in (1, 2, 3)], "case_id bigint, comp_id bigint, x double, y double, z double"), A.filled_nodes(n, f, types))
    assert sorted((r.case_id, r.dist, r.missing) for r in got.collect()) == [(1, 3.0, False), (2, 3.0, False), (3, 3.0, True)]


def test_mirrored_nodes_snap_within_reach(spark):
    rows = [*FIRST, (1, 7, [2, 6], 1.0, 3.0, 0.0)]
    vox = lambda *p: spark.createDataFrame([(1, 3, *q) for q in p], "case_id bigint, cls int, i int, j int, k int")
    run = lambda labels: [(r.trunk, r.branch, r.node_id, r.i, r.j, r.k, r.snap_mm) for r in A.mirror_nodes(nodes(spark, rows), frame(spark, rows), labels, [(2, 6), (3, 7)], {2: 3, 3: 2, 6: 7, 7: 6}, 2.0, ONE).collect()]
    assert run(vox((7, 4, 0), (7, 2, 0), (1, 3, 0))) == [(3, 7, 7, 7, 2, 0, 1.0)]  # the smaller key of two at 1 mm
    assert run(vox((7, 6, 0))) == []  # 3 mm away
    rows.append((1, 8, [3, 7], 7.0, 3.0, 0.0))
    assert run(vox((7, 3, 0))) == []  # both sides are there


def test_conventions(spark):
    s = spark.createDataFrame([(1, 1, 0, 0.5), (1, 1, 1, 0.4), (1, 1, 2, 0.1), (1, 2, 1, 0.5), (1, 2, 2, 0.5), (1, 3, 1, 0.9), (1, 3, 2, 0.1)], "case_id bigint, comp_id bigint, cls int, share double")
    named = A.conventions(s, [1, 0], {0: 10, 1: 11}, {(1, 0): 7})
    assert sorted(tuple(r) for r in named.collect()) == [(1, 1, 10, 11, 7), (1, 2, 11, 11, None)]
    truth = spark.createDataFrame([(1, 1, 7, True), (1, 2, 11, True)], "case_id bigint, comp_id bigint, cls int, large boolean")
    r = A.convention_accuracy(named, truth, "large", least=2, rate=0.5).first()
    assert (r.n, r.major, r.proximal, r.joint, r.neither, r.best, r.is_rule) == (2, 1, 1, 1, 0, "major", True)


def test_class_shares_count_the_shell(spark):
    c = spark.createDataFrame([(1, 5, 0, 0, 0)], "case_id bigint, comp_id bigint, i int, j int, k int")
    labels = spark.createDataFrame([(1, 0, 0, 0, 2), (1, 1, 0, 0, 3), (1, 0, 1, 0, 3), (1, 1, 1, 0, 4)], "case_id bigint, i int, j int, k int, cls int")
    got = {r.cls: round(r.share, 6) for r in A.class_shares(c, labels, cross_offsets(1)).collect()}
    assert got == {2: 0.333333, 3: 0.666667}


def test_calibration_by_two_peaks(spark):
    values = [-10.0] * 2 + [0.0] * 40 + [1.0] + [100.0] * 60 + [99.0, 130.0]
    v = spark.createDataFrame([(1, n, 0, 0, x) for n, x in enumerate(values)] + [(2, n, 0, 0, 5.0) for n in range(9)], "case_id bigint, i int, j int, k int, value double")
    hu = {r.value: r.hu for r in B.calibrated(v).where("case_id = 1").collect()}
    assert abs(hu[0.0] + 1000) < 10 and abs(hu[100.0] - 40) < 10 and hu[130.0] > 300
    assert B.calibrated(v).where("case_id = 2").count() == 0  # a flat case has no peaks


def test_bone_distance_and_share(spark):
    rows = [(1, i, 0, 0, 900.0) for i in (5, 6, 7)] + [(1, 0, 5, 0, 900.0), (1, 1, 0, 0, 0.0)]
    bone = B.bone_voxels(spark.createDataFrame(rows, "case_id bigint, i int, j int, k int, hu double"), 700.0, 3.0, ONE)
    assert sorted(r.i for r in bone.collect()) == [5, 6, 7]  # the single voxel is too small
    comps = spark.createDataFrame([(1, 1, 3, 0, 0), (2, 2, 0, 0, 0)], "case_id bigint, comp_id bigint, i int, j int, k int")
    got = {r.case_id: (r.bone_mm, round(r.bone_share, 6)) for r in B.bone_features(comps, bone, (10, 1, 1), 25.0, 2.0, ONE).collect()}
    assert got == {1: (2.0, 0.2), 2: (25.0, 0.0)}  # of the voxels 1 to 5 one is bone


def test_synthetic_balls(spark):
    n = nodes(spark, [(1, 0, [2, 4], 2.0, 2.0, 2.0), (1, 1, [3, 5], 7.0, 2.0, 2.0), (1, 2, [3, 5], 0.0, 0.0, 0.0), (1, 3, [2, 6], 2.0, 2.0, 2.0)])
    marks = Y.targets(n, [(2, (2, 4)), (3, (3, 5)), (6, (2, 6))])
    assert sorted((m.kind, m.cls, m.x) for m in marks.collect()) == [(0, 2, 2.0), (1, 3, 7.0), (2, 6, 2.0)]
    radii = spark.createDataFrame([(0, 1.0)], "place bigint, radius double")
    b = Y.balls(marks, radii, (10, 5, 5), 1.0, ONE)
    assert {r.kind: r["count"] for r in b.groupBy("kind").count().collect()} == {0: 7, 1: 7}  # the third lies in the first
    labels = spark.createDataFrame([(1, 2, 2, 2, 4)], "case_id bigint, i int, j int, k int, cls int")
    rows = Y.synthetic_rows(b, marks, labels, 3.0, 1.0, ONE).collect()
    assert sorted((r.cls, r.n_vox, tuple(r.overlap.items())) for r in rows) == [(2, 7, ((4, 1),)), (3, 7, ())]
    assert Y.balls(marks, radii.where("place > 0"), (10, 5, 5), 1.0, ONE).count() == 0


def test_radius_table_is_in_order(spark):
    c = spark.createDataFrame([(1, 1, i, 0, 0) for i in range(8)] + [(1, 2, 0, 3, 0), (2, 1, 0, 0, 0), (2, 1, 1, 0, 0)], "case_id bigint, comp_id bigint, i int, j int, k int")
    got = sorted(tuple(r) for r in Y.radius_table(c, ONE, 0.7, 1.0).collect())
    assert [p for p, _ in got] == [0, 1, 2] and [round(r, 4) for _, r in got] == [0.7, 0.7816, 1.0]
