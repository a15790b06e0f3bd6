"""Steps whose work grows no faster than the rows: few copies of a voxel, rows read once."""

import random

import pytest

from voxtab.operators import morphology as M
from voxtab.operators import space as S

SPACING = (0.4, 0.4, 0.6)


def mm(a, b):
    return sum(((x - y) * s) ** 2 for x, y, s in zip(a, b, SPACING)) ** 0.5


def cloud(seed, n, width):
    draw = random.Random(seed)
    return sorted({tuple(draw.randrange(-width, width) for _ in range(3)) for _ in range(n)})


@pytest.mark.parametrize("radius, kind", [(0.6, "int"), (1.5, "int"), (1.5, "double")])
def test_range_join_gives_each_voxel_to_eight_blocks_at_most(spark, monkeypatch, radius, kind):
    copies, hinted = [], S.by_shuffle
    monkeypatch.setattr(S, "by_shuffle", lambda df: copies.append(df.count()) or hinted(df))
    a, b = cloud(1, 150, 7), cloud(2, 150, 7)
    schema = f"case_id int, i {kind}, j {kind}, k {kind}"
    cast = float if kind == "double" else int
    table = lambda rows: spark.createDataFrame([(0, *map(cast, r)) for r in rows], schema)
    got = [(r["l_i"], r["l_j"], r["l_k"], r["r_i"], r["r_j"], r["r_k"]) for r in S.range_join(table(a), table(b), radius, SPACING).collect()]
    assert sorted(got) == sorted((*x, *y) for x in a for y in b if mm(x, y) <= radius + 1e-9)
    assert copies[0] <= 8 * len(b)


def test_labels_are_dilated_without_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "nearest", lambda *_: pytest.fail("voxels were met in pairs"))
    old = {x: n % 5 - 2 for n, x in enumerate(cloud(3, 60, 4))}
    v = spark.createDataFrame([(0, *x, c) for x, c in old.items()], "case_id int, i int, j int, k int, cls int")
    far = S.cross_offsets(1) + [(0, 0, 2)]
    got = {(r["i"], r["j"], r["k"]): r["cls"] for r in M.dilate_labels(v, far, SPACING, 0.6).collect()}
    want = {}
    for p in {tuple(x + o for x, o in zip(at, off)) for at in old for off in far}:
        near = min((round(mm(p, x), 9), x) for x in old)
        want[p] = old[near[1]] if near[0] <= 0.6 + 1e-9 else None
    assert got == want | old


@pytest.mark.parametrize("block", [7, 1000])
def test_cosine_neighbours_meet_in_blocks_of_queries_and_rows(spark, block):
    from voxtab.operators.classify import knn_cosine

    draw = random.Random(5)
    vecs = {n: [draw.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(3)] for n in range(40)} | {40: None, 41: [0.0, 0.0, 0.0], 42: [1.0, None, 1.0]}
    rows = [(n, x, n % 3, n % 4) for n, x in vecs.items()]
    e = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, fold int")
    got = knn_cosine(e, e.where("vec_id < 20 or vec_id > 39"), 5, 2, block)
    want = {}
    for n, x, _, fold in rows:
        if n >= 20 or not any(x):
            continue
        norm = lambda v: sum(c * c for c in v) ** 0.5
        sims = [(round(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), 9), -m, label) for m, y, label, f in rows if m < 40 and any(y) and f != fold]
        votes = {}
        for s, _, label in sorted((s for s in sims if s[0] > 0), reverse=True)[:5]:
            votes[label] = votes.get(label, 0) + s * s
        pred, w = min(votes.items(), key=lambda v: (-round(v[1], 6), v[0]))
        want[n] = (n % 3, pred, round(w, 6))
    assert {r["vec_id"]: (r["truth"], r["pred"], round(r["w"], 6)) for r in got.collect()} == want
    assert got._jdf.queryExecution().toString().count("CoGroup") > 0


def test_rows_of_a_regression_are_written_before_its_steps(spark, monkeypatch):
    from voxtab.operators import logistic as R

    written, write = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df: written.append(write(df)) or written[-1])
    rows = spark.createDataFrame([([float(n % 7)], [1] if n % 3 else []) for n in range(30)], "x array<double>, present array<int>")
    model = R.fit_presence(rows, 1, [1], 1.0)
    assert len(model[1]) == 2 and [df.count() for df in written] == [30]


def test_components_that_meet_no_truth_are_not_broadcast(spark):
    from voxtab.operators.components import drop_orphans
    from voxtab.operators.necks import false_blobs
    from voxtab.plans.lineage import stored

    rows = [(0, n, 3 * n + x, 0, 0, n % 2) for n in range(4) for x in range(2)]
    comps = stored(spark.createDataFrame(rows, "case_id int, comp_id bigint, i int, j int, k int, cls int"))
    blobs = false_blobs(comps, comps.where("comp_id = 0"), 2.5, (1.0, 1.0, 1.0))
    assert {(r["comp_id"], r["n_vox"], r["gt_mm"]) for r in blobs.collect()} == {(1, 2, 2.0), (2, 2, None), (3, 2, None)}
    allowed = spark.createDataFrame([(0, 2)], "cls int, other_cls int")
    kept = drop_orphans(comps, allowed)
    assert kept.count() == 4
    for df, most in ((blobs, 0), (kept, 2)):
        assert df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") <= most


@pytest.mark.parametrize("n, block", [(60, 7), (4500, 1000)])
def test_rare_labels_may_have_many_rows(spark, n, block):
    from voxtab.operators.picks import rare_similarity

    draw = random.Random(6)
    vecs = [[draw.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(3)] for _ in range(n)] + [None, [0.0, 0.0, 0.0], [1.0, None, 1.0]]
    rows = [(i % 50 if n == 60 else i, x, i % 3 if i % 9 else None, i % 4 if i % 11 else None) for i, x in enumerate(vecs)]
    e = spark.createDataFrame(rows, "vec_id bigint, x array<double>, label int, fold int")
    got = {(r["vec_id"], r["cls"]): round(r["sim"], 9) for r in rare_similarity(e, spark.createDataFrame([(1,), (2,)], "cls int"), block).collect()}
    usable = [(v, tuple(x), c, f) for v, x, c, f in rows if x and any(x) and None not in x and f is not None]
    few = {(x, c, f) for _, x, c, f in usable if c in (1, 2)}
    norm = lambda v: sum(c * c for c in v) ** 0.5
    near = {}
    for x, f in {(x, f) for _, x, _, f in usable}:
        for y, c, g in few:
            if f != g:
                near[x, f, c] = max(near.get((x, f, c), -2), round(sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y), 9))
    want = {}
    for v, x, _, f in usable:
        for c in (1, 2):
            want[v, c] = max(want.get((v, c), -2), near[x, f, c])
    assert got == want


@pytest.mark.parametrize("radius", [0.8, 1.3])
def test_closing_happens_inside_tiles(spark, monkeypatch, radius):
    monkeypatch.setattr(M, "TILE", 5)
    draw, schema = random.Random(7), "case_id int, i int, j int, k int"
    at = sorted({(c, draw.randrange(-9, 9), draw.randrange(-9, 9), draw.randrange(40, 70) - 40 * c) for c in (0, 1) for _ in range(2500)})
    odd = [(None, 0, j, 0) for j in range(0, 6, 2)] + [(0, None, j, 0) for j in range(0, 6, 2)] + [(0, 0, j, None) for j in range(0, 6, 2)]
    shut = [(c, i, j, k) for c in (0, 1, None) for i in range(-9, 0) for j in range(-9, 9) for k in range(-10, 70)] + [(0, None, 1, 0)]
    voxels, blocked = spark.createDataFrame(at + odd + at[:9], schema), spark.createDataFrame(shut, schema)
    ball = S.ball_offsets(radius, SPACING)
    for b in (blocked, None):
        got, want = M.close_mm(voxels, radius, SPACING, b), M._close_apart(voxels, ball, b)
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.schema == want.schema
        assert got.count() > len(at) + len(odd)
    plan = M._close_tiles(voxels.where("i is not null and k is not null"), ball, blocked.where("i is not null"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
