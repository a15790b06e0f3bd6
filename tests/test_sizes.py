"""Tables that grow with the input are shuffled, whatever the size of their files."""

import pytest

from voxtab.operators.components import components, mask_distance
from voxtab.operators.graph import geodesic, skeleton_edges
from voxtab.operators.space import range_join
from voxtab.plans.lineage import FEW, few_or_shuffled, materialize

UNIT = (1.0, 1.0, 1.0)


@pytest.fixture(scope="module")
def line(spark):
    rows = [(c, i, 0, 0) for c in range(3) for i in range(20) if i != 9]
    return materialize(spark.createDataFrame(rows, "case_id int, i int, j int, k int"))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_components_are_not_broadcast(line):
    comps = components(line)
    assert "BroadcastExchange" not in plan(comps.join(line, ["case_id", "i", "j", "k"]))
    assert "BroadcastExchange" not in plan(mask_distance(comps, line, 1.0, UNIT))
    assert "BroadcastExchange" not in plan(range_join(line, line, 1.0, UNIT))
    assert comps.select("case_id", "comp_id").distinct().count() == 6


def test_edges_and_wide_frontiers_are_not_broadcast(line):
    edges = skeleton_edges(line, UNIT)
    assert "BroadcastExchange" not in plan(edges)
    ends = edges.select("case_id", "u").distinct()
    assert "BroadcastExchange" not in plan(few_or_shuffled(ends, FEW + 1).join(edges, ["case_id", "u"]))
    assert "BroadcastExchange" in plan(few_or_shuffled(ends, FEW).join(edges, ["case_id", "u"]))
    reached = geodesic(edges, line.where("i = 0").selectExpr("case_id", "0L as u"))
    assert {r["dist"] for r in reached.collect()} == set(map(float, range(9)))


def test_growth_looks_no_farther_than_it_must(spark, monkeypatch):
    from voxtab.operators import morphology as M

    seen, ring = [], M._ring
    monkeypatch.setattr(M, "_ring", lambda v, r: seen.append((r, v.select("case_id").distinct().count())) or ring(v, r))
    rows = [(0, 0, 0, 0, 1), (0, 9, 0, 0, 2), (1, 0, 0, 0, 3)]
    v = spark.createDataFrame(rows, "case_id int, i int, j int, k int, cls int")
    grown = M.grow_volume(v, 8.0)
    assert dict(grown.groupBy("case_id").count().collect()) == {0: 16, 1: 8}
    assert {r["cls"] for r in grown.where("case_id = 0 and i < 3").collect()} == {1}
    assert seen == [(1, 2), (2, 2)]
    assert seen[:1] and M.grow_volume(v, 4.0).count() == 12 and seen[2:] == [(1, 2)]


def test_rounds_leave_arcs_of_other_vertices_aside(spark, monkeypatch):
    from voxtab.operators import branches as B

    kept, stored = [], B.stored
    monkeypatch.setattr(B, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    ways = [(0, 1), (1, 2), (2, 3), (3, 4), *[(a, b) for a in range(4, 9) for b in range(a + 1, 9)]]  # a chain that ends at a clique of five
    edges = spark.createDataFrame([(0, a, b, 1.0) for x, y in ways for a, b in ((x, y), (y, x))], "case_id int, u long, v long, w double")
    found = {(r["u"], r["at"]): (r["len"], r["steps"]) for r in B.contract(edges).where("done and own <> 2").collect()}
    assert found[0, 4] == found[4, 0] == (4.0, 4) and len(found) == 22
    assert kept[0].count() == 28 and max(df.count() for df in kept[1:]) == 8
    assert {r["own"] for r in B.contract(edges, most=2).collect()} == {1, 2}


def test_nodes_and_frames_are_not_broadcast(spark):
    from voxtab.operators import anatomy as A

    rows = [(c, n, [1, 2] if n else [1, 3], float(n), 0.0, 0.0) for c in range(9) for n in range(c % 3)]
    nodes = materialize(spark.createDataFrame(rows, "case_id int, node_id int, class_ids array<int>, x double, y double, z double"))
    axes = [f"{float(a[1] == 'xyz'['uvw'.find(a[0])]) if a[0] in 'uvw' else 0.0}D as {a}" for a in (n + c for n in "ouvwrlb" for c in "xyz")]
    frame = materialize(nodes.select("case_id").distinct().selectExpr("case_id", "1.0D as s", *axes))
    points = materialize(spark.createDataFrame([(c, 0, 0.0, 0.0, 0.0) for c in range(9)], "case_id int, comp_id int, x double, y double, z double"))
    assert "BroadcastExchange" not in plan(A.positions(points, frame))
    assert "BroadcastExchange" not in plan(A.node_distances(points, materialize(A.node_type(nodes).withColumn("missing", A.F.lit(False)))))
    types = A.atlas(nodes, frame, 3)
    found = A.node_distances(points, A.filled_nodes(nodes, frame, types))
    assert {(r["case_id"], r["sig"]): (r["dist"], r["missing"]) for r in found.collect()} == {(c, s): (float(s == "1,2"), c % 3 == 1 and s == "1,2") for c in (1, 2, 4, 5, 7, 8) for s in ("1,3", "1,2")}


def test_rounds_of_geodesic_read_written_edges(spark, monkeypatch):
    from voxtab.plans import queries_lesions as Q

    seen = []
    monkeypatch.setattr(Q.G, "geodesic", lambda edges, *a, **k: seen.append(edges) or geodesic(edges, *a, **k))
    assert Q.geodesic(spark, "/root/testdata/sf0.001").count()
    assert "Join" not in plan(seen[0]) and "lineitem" not in plan(seen[0])


def test_hits_of_the_sweep_are_not_broadcast(spark, line):
    from voxtab.operators.detection import detection_sweep

    comps, grid = components(line), spark.createDataFrame([(1, 0.5), (10, 0.5)], "min_vox int, max_dist double")
    swept = detection_sweep(comps, comps.where("comp_id > 0"), line, grid, 1.0, UNIT)
    assert {r["min_vox"]: (r["hits"], r["false_comps"]) for r in swept.collect()} == {1: (3, 3), 10: (3, 0)}
    assert "isFinalPlan=true" in plan(swept) and "BroadcastHashJoin [case_id" not in plan(swept)


def test_matched_nodes_are_not_broadcast(spark):
    from voxtab.operators.junctions import match_nodes

    rows = [(c, n, [1, 2], float(c * n), 0.0, 0.0) for c in range(3) for n in range(2)]
    nodes = materialize(spark.createDataFrame(rows, "case_id int, node_id int, class_ids array<int>, x double, y double, z double"))
    found = match_nodes(nodes.where("node_id = 0"), nodes.where("node_id = 1"), 1.0)
    assert {r["case_id"]: r["kind"] for r in found.collect()} == {0: "true", 1: "true", 2: "false"}
    assert "BroadcastExchange" not in plan(found)
