"""Branches, spurs, ways, arcs and axes on micro-cases, and unique classes against all choices."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from voxtab.operators import assignment as A
from voxtab.operators import branches as B
from voxtab.operators import graph as G
from voxtab.operators import positions as P
from voxtab.plans.totals import running_total

UNIT = (1.0, 1.0, 1.0)


def voxels(spark, points, **more):
    extra = "".join(f", {k} {'string' if isinstance(v, str) else 'int'}" for k, v in more.items())
    return spark.createDataFrame([(1, *p, *more.values()) for p in points], f"case_id int, i int, j int, k int{extra}")


def key(i, j, k):
    return i * (1 << 42) + j * (1 << 21) + k


def at(df):
    return sorted((r.i, r.j, r.k) for r in df.collect())


def test_a_short_twig_goes_and_the_line_stays(spark):
    line = [(i, 5, 0) for i in range(10)]
    twig = [(5, 7, 0), (5, 8, 0)]  # (5, 6, 0) is the junction voxel that the line touches
    got = at(B.prune_spurs(voxels(spark, [*line, (5, 6, 0), *twig]), 3.0, UNIT))
    assert got == line


def test_short_pieces_go_and_single_voxels_stay(spark):
    short, long, lone = [(0, 0, k) for k in range(3)], [(0, 9, k) for k in range(6)], [(0, 20, 0)]
    assert at(B.prune_spurs(voxels(spark, short + long + lone), 3.0, UNIT)) == sorted(long + lone)
    assert B.prune_spurs(voxels(spark, []), 3.0, UNIT).count() == 0


def test_branches_of_a_star_with_a_ring(spark):
    pairs = [("c", f"a{n}") for n in range(3)] + [("a0", "x"), ("x", "y"), ("y", "a1"), ("a2", "z")]  # c - a0 - x - y - a1 - c, and c - a2 - z
    names = sorted({v for p in pairs for v in p})
    no = {v: i for i, v in enumerate(names)}
    edges = spark.createDataFrame([(1, no[a], no[b], 1.5) for p in pairs for a, b in (p, p[::-1])], "case_id int, u bigint, v bigint, w double")
    got = sorted((r.a, r.b, r.len, r.n, r.degree_a, r.degree_b) for r in B.branches(edges).collect())
    assert got == sorted([(no["c"], no["c"], 7.5, 4, 3, 3), (no["c"], no["z"], 3.0, 1, 3, 1)])


def test_long_chains_take_few_rounds(spark):
    n = 300
    edges = spark.createDataFrame([(1, a, b, 1.0) for i in range(n) for a, b in ((i, i + 1), (i + 1, i))], "case_id int, u bigint, v bigint, w double")
    assert [(r.a, r.b, r.len, r.n) for r in B.branches(edges).collect()] == [(0, n, float(n), n - 1)]


def random_graph(spark, seed, n=30, m=45):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(n), 2))): r.randint(1, 9) / 2 for _ in range(m)}
    rows = [(1, a, b, w) for (x, y), w in pairs.items() for a, b in ((x, y), (y, x))]
    return pairs, spark.createDataFrame(rows, "case_id int, u bigint, v bigint, w double")


def all_ways(pairs, n):
    d = {(a, b): (0 if a == b else math.inf) for a in range(n) for b in range(n)}
    for (a, b), w in pairs.items():
        d[a, b] = d[b, a] = min(w, d[a, b])
    for k, a, b in itertools.product(range(n), repeat=3):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return d


def test_two_nearest_sources(spark):
    pairs, edges = random_graph(spark, 3)
    d = all_ways(pairs, 30)
    src = spark.createDataFrame([(1, g, s, s) for g, s in ((0, 2), (0, 7), (0, 11), (1, 4))], "case_id int, grp int, u bigint, src bigint")
    got = {}
    for r in G.two_nearest(edges, src, by=("grp",)).collect():
        got.setdefault((r.grp, r.u), {})[r["rank"]] = (r.dist, r.src)
    for g, own in ((0, (2, 7, 11)), (1, (4,))):
        for u in range(30):
            best = sorted((d[s, u], s) for s in own if d[s, u] < math.inf)[:2]
            assert [got.get((g, u), {}).get(k) for k in range(1, len(best) + 1)] == best and len(got.get((g, u), {})) == len(best)


def test_ways_by_group_and_limit(spark):
    pairs, edges = random_graph(spark, 4)
    d = all_ways(pairs, 30)
    src = spark.createDataFrame([(1, 0, 1), (1, 1, 5)], "case_id int, mark int, u bigint")
    for hops in (1, 3):
        got = {(r.mark, r.u): r.dist for r in G.geodesic(edges, src, limit=6.0, by=("mark",), hops=hops).collect()}
        assert got == {(m, u): d[s, u] for m, s in ((0, 1), (1, 5)) for u in range(30) if d[s, u] <= 6.0}


def many_graphs(spark):
    """The ways and the edges of random graphs of two cases."""
    pairs, rows = {}, []
    for case, seed in ((1, 5), (2, 6)):
        own, edges = random_graph(spark, seed)
        pairs[case] = all_ways(own, 30)
        rows += [(case, *e[1:]) for e in edges.collect()]
    edges = spark.createDataFrame(rows, "case_id int, u bigint, v bigint, w double")
    return pairs, edges


@pytest.mark.parametrize("most", [0, 10**6])
def test_ways_in_tasks_and_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(G, "MOST_EDGES", most)
    if most:
        for name in ("_rounds", "_two_rounds"):
            monkeypatch.setattr(G, name, lambda *_: pytest.fail("small graphs went in rounds"))
    pairs, edges = many_graphs(spark)
    sources = [(1, 0, 3), (1, 0, 9), (1, 7, 4), (2, 7, 1), (3, 0, 5), (2, 0, 77)]  # no edge leads from the last two
    src = spark.createDataFrame(sources, "case_id int, mark int, u bigint")
    want = {}
    for c, m, s in sources:
        for u in range(30) if c < 3 and s < 30 else [s]:
            d = pairs[c][s, u] if u < 30 and c < 3 else 0.0
            if d < math.inf:
                want[c, m, u] = min(d, want.get((c, m, u), math.inf))
    got = [((r.case_id, r.mark, r.u), r.dist) for r in G.geodesic(edges, src, by=("mark",)).collect()]
    assert dict(got) == want and len(got) == len(want)
    ends = spark.createDataFrame([(1, 2), (1, 2), (2, 20), (3, 5), (3, 6)], "case_id int, u bigint")
    got = [((r.case_id, r.mark, r.u), r.dist) for r in G.geodesic(edges, src, by=("mark",), ends=ends).collect()]
    assert sorted(got) == sorted((k, v) for k, v in want.items() if (k[0], k[2]) in {(1, 2), (2, 20), (3, 5)})
    src = src.withColumn("src", F.col("u") * 10)
    two = {(r.case_id, r.mark, r.u, r["rank"]): (r.dist, r.src) for r in G.two_nearest(edges, src, by=("mark",)).collect()}
    assert {k[:3]: v[0] for k, v in two.items() if k[3] == 1} == want
    assert {(1, 0, u): v for (c, m, u, r), v in two.items() if r == 2} == {(1, 0, u): max((pairs[1][s, u], s * 10) for s in (3, 9)) for u in range(30) if max(pairs[1][s, u] for s in (3, 9)) < math.inf}
    met = G.two_nearest(edges, src, by=("mark",), ends=ends).collect()
    assert sorted((r.case_id, r.mark, r.u, r["rank"], r.dist, r.src) for r in met) == sorted((*k, *v) for k, v in two.items() if (k[0], k[2]) in {(1, 2), (2, 20), (3, 5)})


def test_states_are_held_in_parts(spark, monkeypatch):
    import pyarrow as pa

    from voxtab.operators import ways

    pairs, edges = random_graph(spark, 8)
    d = all_ways(pairs, 30)
    arcs = pa.Table.from_pylist([r.asDict() for r in edges.collect()])
    points = pa.table({"case_id": [1] * 12, "comp": [n // 2 for n in range(12)], "u": list(range(12)), "src": list(range(12)), "_end": [False] * 12})
    whole = ways.least_ways(arcs, points, ["case_id"], ["comp"], None, True).to_pylist()
    assert {(r["comp"], r["u"]): r["dist"] for r in whole} == {(c, u): min(d[2 * c, u], d[2 * c + 1, u]) for c in range(6) for u in range(30) if min(d[2 * c, u], d[2 * c + 1, u]) < math.inf}
    two = ways.two_least_ways(arcs, points, ["case_id"], ["comp"], True).to_pylist()
    monkeypatch.setattr(ways, "HELD", 40)
    order = lambda rows: sorted(tuple(r.values()) for r in rows)
    assert order(ways.least_ways(arcs, points, ["case_id"], ["comp"], None, True).to_pylist()) == order(whole)
    assert order(ways.two_least_ways(arcs, points, ["case_id"], ["comp"], True).to_pylist()) == order(two)


def test_arcs_on_a_line(spark):
    points = [(i, 0, 0) for i in range(11)]
    edges = G.skeleton_edges(voxels(spark, points), UNIT)
    nodes = spark.createDataFrame([(1, 10, [1, 2], 1.0, 0.0, 0.0, key(1, 0, 0)), (1, 20, [2, 3], 7.0, 0.0, 0.0, key(7, 0, 0)), (1, 30, [3, 4], 9.0, 0.0, 0.0, key(9, 0, 0))], "case_id int, node bigint, class_ids array<int>, ci double, cj double, ck double, u bigint")
    lesions = spark.createDataFrame([(1, 5, key(3, 0, 0), 2), (1, 6, key(10, 0, 0), 3), (1, 7, key(3, 0, 0), 4)], "case_id int, comp_id bigint, u bigint, cls int")
    scale = spark.createDataFrame([(1, 2.0)], "case_id int, scale double")
    got = {r.comp_id: (r.share, r.d1, r.d2, r.between) for r in P.arc_position(lesions, nodes, edges, scale).collect()}
    assert got == {5: (2 / 6, 1.0, 2.0, 3.0), 6: (1 / 4, 0.5, 1.5, 2.0), 7: (2 / 6, 1.0, 2.0, 3.0)}  # one junction of class 4: all count
    ref = G.geodesic(edges, spark.createDataFrame([(1, key(0, 0, 0))], "case_id int, u bigint")).withColumnRenamed("dist", "gref")
    got = {r.comp_id: (r.share, r.d1, r.d2) for r in P.arc_signed(lesions, nodes, edges, scale, ref).collect()}
    assert got == {5: (2 / 6, 1.0, 2.0), 6: (-1.0, -1.0, -1.0), 7: (2 / 6, 1.0, 2.0)}  # nothing lies beyond the second
    marks = nodes.where("node = 30").select("case_id", F.lit(0).alias("mark"), "ci", "cj", "ck", "u")
    at_ = lesions.where("comp_id = 5").withColumn("i", F.lit(3.0)).withColumn("j", F.lit(0.0)).withColumn("k", F.lit(0.0))
    assert [(r.geo, r.tortuosity) for r in P.geo_features(at_, marks, edges, scale, UNIT).collect()] == [(3.0, 1.0)]


def test_axis_of_a_tube(spark):
    g = ["case_id", "side"]
    body = voxels(spark, [(i, 0, 0) for i in range(11)] + [(30, 0, 0)], side="R")
    piece = P.bodies(body, g, 3)
    assert piece.count() == 11
    edges = P.body_edges(piece, g, UNIT)
    proximal = voxels(spark, [(13, 0, 0)], side="R")
    branches = voxels(spark, [(8, j, 0) for j in range(1, 6)], side="R", branch=4)
    axis, leave = P.segment_axis(piece, edges, g, proximal, branches, [6], 1.5, UNIT)
    assert {r.i: r.t for r in axis.collect()} == {i: (10 - i) / 10 for i in range(11)}
    assert [(r.branch, r.at) for r in leave.collect()] == [(4, pytest.approx(0.2))]
    cuts = P.cut_points(axis, leave, g, (4, 0.1, 0.4), (6, 0.0, 0.7))
    c = cuts.first()
    assert (c.c1, c.c2, c.by_branches) == (pytest.approx(0.3), 0.7, False)
    part = {r.i: r.part for r in P.split_segment(body, axis, cuts, g, UNIT).collect()}
    assert part == {**{i: 2 for i in range(4)}, **{i: 1 for i in range(4, 8)}, **{i: 0 for i in range(8, 11)}, 30: 0}  # the far voxel inherits the end's t
    turned, _ = P.segment_axis(piece, edges, g, proximal, branches.withColumn("branch", F.lit(6)), [6], 1.5, UNIT)
    assert {r.i: r.t for r in turned.collect()} == {i: pytest.approx(i / 10) for i in range(11)}
    assert P.segment_length(piece, edges, proximal, g, UNIT).first()[2:] == (10.0, 11.0, 11)


def test_rule_and_veto_on_an_axis(spark):
    axis = spark.createDataFrame([(1, "R", i, 0, 0, i / 10) for i in range(11)], "case_id int, side string, i int, j int, k int, t double")
    lesions = spark.createDataFrame([(1, 1, 2, 1, 0), (1, 2, 9, 2, 0), (1, 3, 0, 9, 0)], "case_id int, comp_id int, i int, j int, k int")
    placed = P.lesion_on_axis(lesions, axis, "side", 5.0, 0.5, UNIT)
    assert {r.comp_id: (r.t, r.dmin) for r in placed.collect()} == {1: (0.2, 1.0), 2: (0.9, 2.0)}
    touching = spark.createDataFrame([(1, 1, [4])], "case_id int, comp_id int, classes array<int>")
    named = P.segment_rule(placed, touching, {0: ([(4, "a")], "b"), 1: ([], "c"), 2: ([], "d")}, 0.35, 0.7)
    assert {r.comp_id: r.name for r in named.collect()} == {1: "a", 2: "d"}
    ranked = spark.createDataFrame([(1, 1, 8, 1), (1, 1, 7, 2), (1, 3, 8, 1)], "case_id int, comp_id int, cls int, rk int")
    assert {r.comp_id: r.cls for r in P.segment_veto(ranked, named, {7: 0, 8: 2}).collect()} == {1: 7, 3: 8}


def brute_assignment(cost, lesions, classes):
    best = None
    for picks in itertools.product([*classes, None], repeat=len(lesions)):
        used = [c for c in picks if c is not None]
        if len(set(used)) < len(used) or len(used) < min(len(lesions), len(classes)):
            continue
        total = sum(cost[x, c] for x, c in zip(lesions, picks) if c is not None)
        rank = (total, [len(classes) if c is None else classes.index(c) for c in picks])
        best = min(best or (rank, picks), (rank, picks), key=lambda z: z[0])
    return {x: c for x, c in zip(lesions, best[1]) if c is not None}


def test_unique_classes_against_all_choices():
    r = random.Random(5)
    for n, m in [(1, 1), (2, 3), (3, 3), (4, 2), (5, 3), (6, 4), (3, 6)] * 6:
        lesions, classes = list(range(n)), list(range(m))
        cost = {(x, c): r.randint(0, 4) for x in lesions for c in classes}  # many ties
        assert A.best_classes(cost, lesions, classes) == brute_assignment(cost, lesions, classes)


def test_unique_classes_of_tables(spark):
    r = random.Random(6)
    small = [(1, x, c, r.choice([0.1, 0.2, 0.3])) for x in range(6) for c in range(3)]
    large = [(2, x, c, r.random()) for x in range(40) for c in range(52)]
    hot = [(3, x, c, r.random()) for x in range(3000) for c in range(4)]
    table = spark.createDataFrame([*small, *large, *hot, (4, None, 1, 0.5), (4, 1, 2, 0.5)], "case_id int, lesion int, cls int, p double")
    got = {}
    for x in A.unique_classes(table, ("case_id",)).collect():
        got.setdefault(x.case_id, {})[x.lesion] = x.cls
    cost = {(x, c): round(-math.log(p) * A.UNIT) for _, x, c, p in small}
    assert got[1] == brute_assignment(cost, list(range(6)), [0, 1, 2])
    assert len(got[2]) == 40 == len(set(got[2].values())) and len(got[3]) == 4 and got[4] == {1: 2}
    pairs = {(x, c): round(-math.log(p) * A.UNIT) for _, x, c, p in hot}
    assert sum(pairs[x, c] for x, c in got[3].items()) <= sum(min(v for (x, k), v in pairs.items() if k == c) for c in range(4)) * 1.5
    assert A.unique_classes(table.where("false"), ("case_id",)).count() == 0


def test_running_totals_of_a_hot_group(spark):
    r = random.Random(7)
    rows = [(r.choice(["hot", "hot", "hot", f"g{r.randrange(20)}"]), i, r.randrange(5)) for i in range(2000)]
    table = spark.createDataFrame(rows, "g string, o int, v int")
    seen, want = {}, {}
    for g, o, v in sorted(rows, key=lambda x: x[1]):
        want[o] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + v
    assert {x.o: x.before for x in running_total(table, "g", ["o"], "v").collect()} == want
    assert running_total(table.where("false"), "g", ["o"], "v").count() == 0
