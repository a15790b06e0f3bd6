"""Queries of pruned and contracted graphs, positions along vessels and unique classes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtab.operators import assignment as A
from voxtab.operators import branches as B
from voxtab.operators import graph as G
from voxtab.plans.queries_voxels import ID, dist_sql, sql
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import SPACING, probs, vox, with_tables

#: Branches shorter than this go, in millimetres, as in the reference.
SPUR = 2.0

#: DuckDB: the vessel layer as a graph, 26-neighbours both ways.
VESSEL = {
    "line": f"SELECT case_id, i, j, k, cls, {ID} AS id FROM vox WHERE layer = 'A'",
    "edge": f"SELECT a.case_id, a.id AS u, b.id AS v, {dist_sql('a', 'b')} AS w FROM line a JOIN line b ON a.case_id = b.case_id AND a.id <> b.id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1",
}


def vessel(spark, sf_dir):
    return vox(spark, sf_dir, "A").select("case_id", "i", "j", "k", "cls")


def _prune_sql(rounds: int = 20) -> str:
    parts = {"r0": "SELECT case_id, id FROM line"}
    for r in range(rounds):
        parts |= {
            f"e{r}": f"SELECT e.* FROM edge e SEMI JOIN r{r} a ON a.case_id = e.case_id AND a.id = e.u SEMI JOIN r{r} b ON b.case_id = e.case_id AND b.id = e.v",
            f"g{r}": f"SELECT case_id, u AS id, count(*) AS deg FROM e{r} GROUP BY 1, 2",
            f"w{r}": f"SELECT case_id, id AS e, -1::BIGINT AS prev, id AS cur, 0::DOUBLE AS len, [id] AS path FROM g{r} WHERE deg = 1 UNION ALL"
            f" SELECT w.case_id, w.e, w.cur, x.v, w.len + x.w, list_append(w.path, x.v) FROM w{r} w JOIN e{r} x ON x.case_id = w.case_id AND x.u = w.cur AND x.v <> w.prev JOIN g{r} d ON d.case_id = w.case_id AND d.id = w.cur WHERE (w.cur = w.e OR d.deg = 2) AND round(w.len + x.w, 9) < {SPUR}",
            f"d{r}": f"SELECT DISTINCT w.case_id, unnest(w.path) AS id FROM w{r} w JOIN g{r} d ON d.case_id = w.case_id AND d.id = w.cur WHERE d.deg >= 3 OR (w.cur <> w.e AND d.deg = 1)",
            f"r{r + 1}": f"SELECT * FROM r{r} ANTI JOIN d{r} USING (case_id, id)",
        }
    # Every table but the walks, which refer to themselves, is computed once.
    named = ", ".join(f"{n} AS {'' if n[0] == 'w' else 'MATERIALIZED '}({q})" for n, q in (VESSEL | parts).items())
    return with_tables(f"SELECT case_id, i, j, k, cls FROM line SEMI JOIN r{rounds} USING (case_id, id)", "vox", recursive=True).replace(" SELECT case_id, i, j, k, cls FROM line", f", {named} SELECT case_id, i, j, k, cls FROM line")


@query(_prune_sql())
def prune_spurs(spark, sf_dir):
    """GRA2: the vessel graph without branches shorter than SPUR mm that start at an endpoint."""
    return B.prune_spurs(vessel(spark, sf_dir), SPUR, SPACING)


@query(
    with_tables(
        "SELECT w.case_id, w.a, w.cur AS b, round(w.len, 6) AS len, CAST(w.n - 1 AS INT) AS n, x.deg AS degree_a, y.deg AS degree_b FROM walk w JOIN deg x ON x.case_id = w.case_id AND x.id = w.a JOIN deg y ON y.case_id = w.case_id AND y.id = w.cur WHERE y.deg <> 2 AND (w.a < w.cur OR (w.a = w.cur AND w.first < w.prev))",
        "vox", recursive=True, **VESSEL, deg="SELECT case_id, u AS id, count(*) AS deg FROM edge GROUP BY 1, 2",
        walk="SELECT e.case_id, e.u AS a, e.v AS first, e.u AS prev, e.v AS cur, e.w AS len, 1 AS n FROM edge e JOIN deg d ON d.case_id = e.case_id AND d.id = e.u WHERE d.deg <> 2 UNION ALL SELECT w.case_id, w.a, w.first, w.cur, x.v, w.len + x.w, w.n + 1 FROM walk w JOIN deg d ON d.case_id = w.case_id AND d.id = w.cur AND d.deg = 2 JOIN edge x ON x.case_id = w.case_id AND x.u = w.cur AND x.v <> w.prev",
    )
)
def vessel_branches(spark, sf_dir):
    """GRA2: chains of degree-2 vertices as single edges, with their length and number of inner vertices."""
    return rounded(B.branches(G.skeleton_edges(vessel(spark, sf_dir), SPACING)))


#: DuckDB: of every set of classes taken so far, the cheapest choice, lesion by lesion.
ASSIGN = {
    "p0": "SELECT lesion // {size} AS case_id, lesion, cls, p, CAST(round(-ln(greatest(p, 1e-9)) * 1000000) AS BIGINT) AS cost FROM probs WHERE seed = 0",
    "l": "SELECT *, dense_rank() OVER (PARTITION BY case_id ORDER BY lesion) AS i FROM p0",
    "n": "SELECT case_id, max(i) AS n FROM l GROUP BY 1",
    "best": "SELECT case_id, 0::BIGINT AS i, 0::BIGINT AS mask, {{'cost': 0::BIGINT, 'picks': []::INT[]}} AS v FROM n UNION ALL"
    " SELECT b.case_id, b.i + 1, b.mask | o.bit, min({{'cost': b.v.cost + o.cost, 'picks': list_append(b.v.picks, o.cls)}}) FROM best b JOIN o ON o.case_id = b.case_id AND o.i = b.i + 1 AND (b.mask & o.bit) = 0 GROUP BY 1, 2, 3",
    "o": "SELECT case_id, i, cls, cost, CAST(1 AS BIGINT) << cls AS bit FROM l UNION ALL SELECT DISTINCT case_id, i, 10, 0, 0 FROM l",
    "goal": "SELECT b.case_id, min(b.v).picks AS picks FROM best b JOIN n ON n.case_id = b.case_id AND n.n = b.i WHERE bit_count(b.mask) = least(n.n, 10) GROUP BY 1",
    "u": "SELECT case_id, unnest(picks) AS cls, unnest(range(1, len(picks) + 1)) AS i FROM goal",
}


def _assign_sql(size: int) -> str:
    order = ("p0", "l", "n", "o", "best", "goal", "u")
    return with_tables("SELECT l.case_id, l.lesion, l.cls, round(l.p, 6) AS p FROM l JOIN u ON u.case_id = l.case_id AND u.i = l.i AND u.cls = l.cls", "probs", recursive=True, **{k: ASSIGN[k].format(size=size) for k in order})


@query(_assign_sql(4))
def assign_small_cases(spark, sf_dir):
    """PRB9: cases with fewer lesions than classes; every lesion gets one."""
    x = probs(spark, sf_dir).where("seed = 0").withColumn("case_id", F.floor(F.col("lesion") / 4))
    return rounded(A.unique_classes(x.select("case_id", "lesion", "cls", "p"), ("case_id",)))


@query(_assign_sql(40))
def assign_large_cases(spark, sf_dir):
    """PRB9: cases of 40 lesions and 10 classes; every class goes to one lesion."""
    x = probs(spark, sf_dir).where("seed = 0").withColumn("case_id", F.floor(F.col("lesion") / 40))
    return rounded(A.unique_classes(x.select("case_id", "lesion", "cls", "p"), ("case_id",)))


# ---- positions along vessels ----

GROUP = ["case_id", "side"]
LESION_VOX, SNAP_MM, ARC_MM = 3, 1.5, 3.0

#: DuckDB: shortest ways; every round keeps what got shorter. {src} has the key columns, u and what else the key needs.
WAYS = (
    "SELECT {key}, u, 0::DOUBLE AS d FROM ({src}) UNION SELECT {gkey}, e.v, min(g.d + e.w) FROM {name} g JOIN {edge} e ON {on} AND e.u = g.u LEFT JOIN recurring.{name} r ON {same} AND r.u = e.v"
    " WHERE r.d IS NULL OR g.d + e.w < r.d - 1e-12 GROUP BY ALL"
)


def ways_sql(name: str, src: str, key: list[str], edge: str = "edge", on: list[str] = ["case_id"]) -> dict[str, str]:  # noqa: B006
    """A table (key, u, d) of least path lengths from src (key, u) along edge (on, u, v, w)."""
    text = WAYS.format(key=", ".join(key), src=src, gkey=", ".join(f"g.{k}" for k in key), name=name, edge=edge, on=" AND ".join(f"e.{c} = g.{c}" for c in on), same=" AND ".join(f"r.{k} = g.{k}" for k in key))
    return {f"{name}({', '.join([*key, 'u', 'd'])}) USING KEY ({', '.join([*key, 'u'])})": text}


def _key(p: str) -> str:
    return f"({p}i*4398046511104 + {p}j*2097152 + {p}k)"


def _mm2(a: str, b: str) -> str:
    """Squared millimetres between the positions of a and b, given as prefixes."""
    return " + ".join(f"(({a}{x} - {b}{x}) * {s}::DOUBLE) * (({a}{x} - {b}{x}) * {s}::DOUBLE)" for x, s in zip("ijk", SPACING))


#: DuckDB: a centreline on a grid four times as coarse along i, whose classes are stretches of three planes, as a graph; lesions of
#: LESION_VOX voxels or more on the same grid, snapped to it, with their class; and the junctions between classes.
COARSE = {
    "line": f"SELECT *, {_key('')} AS id FROM (SELECT DISTINCT case_id, i // 4 AS i, j, k, CAST(1 + i // 12 AS INT) AS cls FROM vox WHERE layer = 'A')",
    "edge": VESSEL["edge"],
}
#: The junctions' voxels: those beside another class.
TRANSITION = "SELECT a.case_id, a.i, a.j, a.k, a.cls FROM line a WHERE EXISTS (SELECT 1 FROM line b WHERE b.case_id = a.case_id AND b.cls <> a.cls AND abs(b.i-a.i) <= 1 AND abs(b.j-a.j) <= 1 AND abs(b.k-a.k) <= 1)"
PLACES = {
    "big": f"SELECT case_id, comp_id FROM comp GROUP BY 1, 2 HAVING count(*) >= {LESION_VOX}",
    "les": "SELECT DISTINCT case_id, comp_id, i // 4 AS i, j, k FROM comp SEMI JOIN big USING (case_id, comp_id)",
    "centre": "SELECT case_id, comp_id, avg(i) AS i, avg(j) AS j, avg(k) AS k FROM les GROUP BY 1, 2",
    "snapped": f"SELECT case_id, comp_id, i, j, k, u FROM (SELECT c.case_id, c.comp_id, c.i, c.j, c.k, l.id AS u, row_number() OVER (PARTITION BY c.case_id, c.comp_id ORDER BY round(sqrt({_mm2('c.', 'l.')}), 9), l.id) AS r FROM centre c JOIN line l ON l.case_id = c.case_id WHERE sqrt({_mm2('c.', 'l.')}) <= {SNAP_MM} + 1e-9) WHERE r = 1",
    "seen": f"SELECT case_id, comp_id, cls, coalesce(min(d) FILTER (d > 0), 0) AS d FROM (SELECT c.case_id, c.comp_id, l.cls, l.id, min(sqrt({_mm2('c.', 'l.')})) AS d FROM les c JOIN line l ON l.case_id = c.case_id WHERE sqrt({_mm2('c.', 'l.')}) <= {SNAP_MM} + 1e-9 GROUP BY ALL) GROUP BY 1, 2, 3",
    "under": "SELECT c.case_id, c.comp_id, l.cls, count(*) AS n FROM les c JOIN line l USING (case_id, i, j, k) GROUP BY 1, 2, 3",
    "own": "SELECT case_id, comp_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY case_id, comp_id ORDER BY kind, s, cls) AS r FROM (SELECT case_id, comp_id, cls, 0 AS kind, -n::DOUBLE AS s FROM under UNION ALL SELECT case_id, comp_id, cls, 1, round(d, 9) FROM seen)) WHERE r = 1",
    "place": "SELECT s.*, o.cls FROM snapped s LEFT JOIN own o USING (case_id, comp_id)",
    "jn": "SELECT case_id, comp_id AS node, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM compj GROUP BY 1, 2",
    "jv": f"SELECT case_id, node, ci, cj, ck, u FROM (SELECT n.*, {_key('c.')} AS u, row_number() OVER (PARTITION BY n.case_id, n.node ORDER BY round((c.i-ci)*(c.i-ci) + (c.j-cj)*(c.j-cj) + (c.k-ck)*(c.k-ck), 9), {_key('c.')}) AS r FROM jn n JOIN compj c ON c.case_id = n.case_id AND c.comp_id = n.node) WHERE r = 1",
    "jc": "SELECT DISTINCT c.case_id, c.comp_id AS node, l.cls FROM compj c JOIN line l ON l.case_id = c.case_id AND abs(l.i-c.i) <= 1 AND abs(l.j-c.j) <= 1 AND abs(l.k-c.k) <= 1",
    "scale": "SELECT case_id, CASE WHEN round(s, 9) > 0 THEN s ELSE 100 END AS scale FROM (SELECT case_id, sqrt(var_pop(ci)*0.4*0.4 + var_pop(cj)*0.4*0.4 + var_pop(ck)*0.6*0.6) AS s FROM jn GROUP BY 1)",
}
#: Landmarks: the first junction of each of these pairs of classes.
MARKS = ((1, 2), (2, 3), (4, 5))
MARKED = " UNION ALL ".join(f"SELECT case_id, {m} AS mark, min(node) AS node FROM (SELECT case_id, node FROM jc WHERE cls IN ({a}, {b}) GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1" for m, (a, b) in enumerate(MARKS))


def places_sql(body: str, *parts: dict[str, str]) -> str:
    from voxtab.plans.queries_voxels import comp_tables

    first = {**COARSE, **comp_tables("R", 26), **comp_tables(TRANSITION, 26, "compj")}
    later = {k: v for p in (PLACES, *parts) for k, v in p.items()}
    return with_tables(body, "vox", recursive=True, **first, **later)


def places(spark, sf_dir):
    """Lesions with their vessel vertex and class, the junctions, the graph and the scale of every case."""
    from voxtab.operators import lesions as L
    from voxtab.operators.positions import case_scale, junctions, snap
    from voxtab.plans.lineage import stored
    from voxtab.plans.queries_voxels import comps

    coarse = F.floor(F.col("i") / 4).cast("int").alias("i")
    line = vessel(spark, sf_dir).select("case_id", coarse, "j", "k", (1 + F.floor(F.col("i") / 12)).cast("int").alias("cls")).distinct()
    c = comps(spark, sf_dir)
    c = c.join(c.groupBy("case_id", "comp_id").agg(F.count("*").alias("n")).where(F.col("n") >= LESION_VOX), ["case_id", "comp_id"], "left_semi").select("case_id", "comp_id", coarse, "j", "k").distinct()
    centre = c.groupBy("case_id", "comp_id").agg(*[F.avg(a).alias(a) for a in "ijk"])
    own = L.dominant_class(L.overlap_table(c, line), L.distance_table(c, line, SNAP_MM, SPACING))
    at = stored(snap(centre, line, SNAP_MM, SPACING).join(own, ["case_id", "comp_id"], "left"))
    nodes = stored(junctions(line))
    return at, nodes, stored(G.skeleton_edges(line, SPACING)), case_scale(nodes, SPACING)


def marks(nodes):
    """(case_id, mark, ci, cj, ck, u): the first junction of each pair of classes."""
    both = [F.when(F.array_contains("class_ids", a) & F.array_contains("class_ids", b), F.lit(m)) for m, (a, b) in enumerate(MARKS)]
    x = nodes.withColumn("mark", F.explode(F.array_compact(F.array(*both))))
    return x.groupBy("case_id", "mark").agg(F.min_by(F.struct("ci", "cj", "ck", "u"), "node").alias("n")).select("case_id", "mark", "n.*")


@query(
    places_sql(
        f"SELECT p.case_id, p.comp_id, m.mark, round(coalesce(g.d / s.scale, -1), 6) AS geo, round(CASE WHEN g.d IS NULL THEN -1 WHEN sqrt({_mm2('p.', 'm.c')}) > 1e-6 THEN least(g.d / sqrt({_mm2('p.', 'm.c')}), 5) ELSE 0 END, 6) AS tortuosity"
        " FROM place p JOIN mk m USING (case_id) JOIN scale s USING (case_id) LEFT JOIN g ON g.case_id = p.case_id AND g.mark = m.mark AND g.u = p.u",
        {"mk": f"SELECT m.mark, j.* FROM ({MARKED}) m JOIN jv j USING (case_id, node)", **ways_sql("g", "SELECT case_id, mark, u FROM mk", ["case_id", "mark"])},
    )
)
def geo_features(spark, sf_dir):
    """GRA6: ways from three landmarks to every lesion along the vessel graph, and their tortuosity."""
    from voxtab.operators.positions import geo_features as run

    at, nodes, edges, scale = places(spark, sf_dir)
    return rounded(run(at, marks(nodes), edges, scale, SPACING))


def _arc_sql(d1: str, d2: str, scale: str = "coalesce(scale, 100)") -> str:
    total = f"({d1} + {d2})"
    return ", ".join(
        f"round(coalesce({e}, -1), 6) AS {n}"
        for n, e in (("share", f"CASE WHEN {total} > 1e-6 THEN {d1} / {total} WHEN {total} IS NOT NULL THEN 0 END"), *((n, f"CASE WHEN {total} IS NOT NULL THEN least({d} / {scale}, 3) END") for n, d in (("d1", d1), ("d2", d2), ("between", total))))
    )


FROM_LESIONS = {**ways_sql("gl", "SELECT case_id, comp_id, u FROM place", ["case_id", "comp_id"]), "met": "SELECT g.case_id, g.comp_id, j.node, g.d FROM gl g JOIN jv j ON j.case_id = g.case_id AND j.u = g.u"}


@query(
    places_sql(
        f"SELECT case_id, comp_id, {_arc_sql('coalesce(o1, a1)', 'coalesce(o2, a2)')} FROM (SELECT p.case_id, p.comp_id, s.scale, CASE WHEN len(o.ds) >= 2 THEN o.ds[1] END AS o1, CASE WHEN len(o.ds) >= 2 THEN o.ds[2] END AS o2, CASE WHEN len(a.ds) >= 2 THEN a.ds[1] END AS a1, CASE WHEN len(a.ds) >= 2 THEN a.ds[2] END AS a2"
        " FROM place p LEFT JOIN scale s USING (case_id) LEFT JOIN (SELECT m.case_id, m.comp_id, list(m.d ORDER BY m.d) AS ds FROM met m JOIN place p USING (case_id, comp_id) JOIN jc c ON c.case_id = m.case_id AND c.node = m.node AND c.cls = p.cls GROUP BY 1, 2) o USING (case_id, comp_id)"
        " LEFT JOIN (SELECT case_id, comp_id, list(d ORDER BY d) AS ds FROM met GROUP BY 1, 2) a USING (case_id, comp_id))",
        FROM_LESIONS,
    )
)
def arc_position(spark, sf_dir):
    """GRA7, folded: between the two nearest junctions, whichever way."""
    from voxtab.operators.positions import arc_position as run

    return rounded(run(*places(spark, sf_dir)))


@query(
    places_sql(
        f"SELECT case_id, comp_id, {_arc_sql('p', 'q')} FROM (SELECT x.case_id, x.comp_id, any_value(s.scale) AS scale, min(m.d) FILTER (round(r.gnode, 9) <= round(x.gref, 9) AND (x.k < 2 OR c.cls IS NOT NULL)) AS p, min(m.d) FILTER (round(r.gnode, 9) > round(x.gref, 9) AND (x.k < 2 OR c.cls IS NOT NULL)) AS q"
        " FROM (SELECT p.case_id, p.comp_id, p.cls, h.d AS gref, coalesce(k.k, 0) AS k FROM place p LEFT JOIN g h ON h.case_id = p.case_id AND h.u = p.u LEFT JOIN (SELECT case_id, cls, count(*) AS k FROM jc GROUP BY 1, 2) k ON k.case_id = p.case_id AND k.cls = p.cls) x"
        " LEFT JOIN scale s USING (case_id) LEFT JOIN met m ON m.case_id = x.case_id AND m.comp_id = x.comp_id LEFT JOIN (SELECT j.case_id, j.node, h.d AS gnode FROM jv j JOIN g h ON h.case_id = j.case_id AND h.u = j.u) r ON r.case_id = m.case_id AND r.node = m.node"
        " LEFT JOIN jc c ON c.case_id = m.case_id AND c.node = m.node AND c.cls = x.cls GROUP BY 1, 2)",
        FROM_LESIONS, {"mk": f"SELECT m.mark, j.* FROM ({MARKED}) m JOIN jv j USING (case_id, node)", "ref": "SELECT case_id, arg_min(u, mark) AS u FROM mk GROUP BY 1", **ways_sql("g", "SELECT case_id, u FROM ref", ["case_id"])},
    )
)
def arc_signed(spark, sf_dir):
    """GRA7, signed: junctions nearer to the case's first landmark and beyond."""
    from voxtab.operators.positions import arc_signed as run

    at, nodes, edges, scale = places(spark, sf_dir)
    first = marks(nodes).groupBy("case_id").agg(F.min_by("u", "mark").alias("u"))
    return rounded(run(at, nodes, edges, scale, G.geodesic(edges, first).withColumnRenamed("dist", "gref")))


# ---- segments ----

LEAST_VOX, TOUCH_MM, ON_AXIS_MM, MORE_MM = 3, 0.9, 1.0, 0.4
#: A cut lies at its branch plus an offset, or else here.
FIRST, SECOND = (4, 0.05, 0.35), (6, 0.0, 0.7)


def tube(spark, sf_dir):
    """case_id, side, kind, branch, i, j, k: vessel voxels on a grid four times as coarse along i; the segment itself (classes 1 to 3), what is proximal (5, 7) and its branches (4, 6)."""
    v = vessel(spark, sf_dir).groupBy("case_id", F.floor(F.col("i") / 4).cast("int").alias("i"), "j", "k").agg(F.min("cls").alias("cls"))
    kind = F.when(F.col("cls") <= 3, "segment").when(F.col("cls").isin(4, 6), "branch").otherwise("proximal")
    return v.select("case_id", F.when(F.col("j") < 5, "R").otherwise("L").alias("side"), kind.alias("kind"), F.col("cls").alias("branch"), "i", "j", "k")


TUBE = {
    "tube": "SELECT case_id, CASE WHEN j < 5 THEN 'R' ELSE 'L' END AS side, CASE WHEN cls <= 3 THEN 'segment' WHEN cls IN (4, 6) THEN 'branch' ELSE 'proximal' END AS kind, cls AS branch, i, j, k FROM (SELECT case_id, i // 4 AS i, j, k, min(cls) AS cls FROM vox WHERE layer = 'A' GROUP BY 1, 2, 3, 4)",
}
BODY = {
    "bodies": f"SELECT case_id, side, comp_id FROM (SELECT c.case_id, c.side, c.comp_id, row_number() OVER (PARTITION BY c.case_id, c.side ORDER BY count(*) DESC, c.comp_id) AS r, sum(count(*)) OVER (PARTITION BY c.case_id, c.side) AS n FROM compt c GROUP BY 1, 2, 3) WHERE r = 1 AND n >= {LEAST_VOX}",
    "body": f"SELECT c.case_id, c.side, c.i, c.j, c.k, {_key('c.')} AS u FROM compt c SEMI JOIN bodies b USING (case_id, side, comp_id)",
    "bedge": f"SELECT a.case_id, a.side, a.u, b.u AS v, sqrt({_mm2('a.', 'b.')}) AS w FROM body a JOIN body b ON a.case_id = b.case_id AND a.side = b.side AND a.u <> b.u AND abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1",
}
FAR = "SELECT case_id, side, u, d FROM (SELECT *, row_number() OVER (PARTITION BY case_id, side ORDER BY round(d, 9) DESC, u) AS r FROM {0}) WHERE r = 1"
SIDES = ["case_id", "side"]


def tube_sql(body: str, *parts: dict[str, str]) -> str:
    # Pieces of the segment spread the least key to their neighbours of the same side.
    spread = {
        "seg": f"SELECT case_id, side, i, j, k, {_key('')} AS id FROM tube WHERE kind = 'segment'",
        "sedge": "SELECT a.case_id, a.side, a.id AS u, b.id AS v FROM seg a JOIN seg b ON a.case_id = b.case_id AND a.side = b.side AND abs(a.i-b.i) <= 1 AND abs(a.j-b.j) <= 1 AND abs(a.k-b.k) <= 1",
        "reach": "SELECT case_id, side, u, v FROM sedge UNION SELECT r.case_id, r.side, r.u, e.v FROM reach r JOIN sedge e ON e.case_id = r.case_id AND e.side = r.side AND e.u = r.v",
        "compt": "SELECT s.*, c.comp_id FROM seg s JOIN (SELECT case_id, side, u AS id, min(v) AS comp_id FROM reach GROUP BY 1, 2, 3) c USING (case_id, side, id)",
    }
    return with_tables(body, "vox", recursive=True, **TUBE, **spread, **BODY, **{k: v for p in parts for k, v in p.items()})


def _nearest_sql(points: str, key: str) -> str:
    """Of each key's points the one nearest to the proximal voxels of its case and side."""
    return f"SELECT * FROM (SELECT p.*, round(min(sqrt({_mm2('p.', 't.')})), 9) AS gap FROM {points} p JOIN tube t ON t.kind = 'proximal' AND t.case_id = p.case_id AND t.side = p.side GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY gap, u) = 1"


@query(
    tube_sql(
        "SELECT g.case_id, g.side, round(max(g.d), 6) AS length, round(n.n * 0.4 * 0.4 * 0.6, 6)::DOUBLE AS volume_mm3, n.n AS n_vox FROM g JOIN (SELECT case_id, side, count(*) AS n FROM body GROUP BY 1, 2) n USING (case_id, side) GROUP BY 1, 2, 4, 5 HAVING max(g.d) > 0",
        {"seed": _nearest_sql("body", "case_id, side"), **ways_sql("g", "SELECT case_id, side, u FROM seed", SIDES, "bedge", SIDES)},
    )
)
def segment_length(spark, sf_dir):
    """GRA8: how far a segment's largest piece leads from its proximal end."""
    from voxtab.operators import positions as P

    t = tube(spark, sf_dir)
    body = P.bodies(t.where("kind = 'segment'"), GROUP, LEAST_VOX)
    return rounded(P.segment_length(body, P.body_edges(body, GROUP, SPACING), t.where("kind = 'proximal'"), GROUP, SPACING))


AXIS = {
    **ways_sql("g0", "SELECT case_id, side, min(u) AS u FROM body GROUP BY 1, 2", SIDES, "bedge", SIDES),
    "e1": FAR.format("g0"),
    **ways_sql("g1", "SELECT case_id, side, u FROM e1", SIDES, "bedge", SIDES),
    "e2": FAR.format("g1"),
    "ends": "SELECT b.*, 1 AS no FROM body b SEMI JOIN e1 USING (case_id, side, u) UNION ALL SELECT b.*, 2 FROM body b SEMI JOIN e2 USING (case_id, side, u)",
    "gaps": f"SELECT p.case_id, p.side, p.no, p.u, round(min(sqrt({_mm2('p.', 't.')})), 9) AS gap FROM ends p JOIN tube t ON t.kind = 'proximal' AND t.case_id = p.case_id AND t.side = p.side GROUP BY 1, 2, 3, 4",
    "start": "SELECT e.case_id, e.side, e.u FROM ends e LEFT JOIN (SELECT case_id, side, arg_min(no, struct_pack(a := gap, b := no)) AS no FROM gaps GROUP BY 1, 2) n USING (case_id, side) WHERE e.no = coalesce(n.no, 1)",
    **ways_sql("g2", "SELECT case_id, side, u FROM start", SIDES, "bedge", SIDES),
    "raw": "SELECT b.case_id, b.side, b.i, b.j, b.k, g.d / m.len AS t, m.len AS len_mm FROM body b JOIN g2 g USING (case_id, side, u) JOIN (SELECT case_id, side, max(d) AS len FROM g2 GROUP BY 1, 2 HAVING max(d) > 0) m USING (case_id, side)",
    "leave": f"SELECT case_id, side, branch, median(t) AS pos FROM (SELECT DISTINCT r.case_id, r.side, b.branch, r.i, r.j, r.k, r.t FROM raw r JOIN tube b ON b.kind = 'branch' AND b.case_id = r.case_id AND b.side = r.side WHERE sqrt({_mm2('r.', 'b.')}) <= {TOUCH_MM} + 1e-9 AND (b.case_id, b.side, b.branch) IN (SELECT case_id, side, branch FROM tube WHERE kind = 'branch' GROUP BY 1, 2, 3 HAVING count(*) >= 5)) GROUP BY 1, 2, 3 HAVING count(*) >= 3",
    "turned": "SELECT case_id, side, round(avg(pos), 9) < 0.5 AS turn FROM leave WHERE branch = 6 GROUP BY 1, 2",
    "axis": "SELECT r.case_id, r.side, r.i, r.j, r.k, CASE WHEN coalesce(turn, false) THEN 1 - t ELSE t END AS t, len_mm FROM raw r LEFT JOIN turned USING (case_id, side)",
    "branchat": "SELECT l.case_id, l.side, l.branch, CASE WHEN coalesce(turn, false) THEN 1 - pos ELSE pos END AS pos FROM leave l LEFT JOIN turned USING (case_id, side)",
    "cut0": f"SELECT x.case_id, x.side, a.pos AS a, b.pos AS b, coalesce(a.pos + {FIRST[1]}::DOUBLE, {FIRST[2]}) AS c1, coalesce(b.pos + {SECOND[1]}::DOUBLE, {SECOND[2]}) AS c2 FROM (SELECT DISTINCT case_id, side FROM axis) x LEFT JOIN branchat a ON a.case_id = x.case_id AND a.side = x.side AND a.branch = {FIRST[0]} LEFT JOIN branchat b ON b.case_id = x.case_id AND b.side = x.side AND b.branch = {SECOND[0]}",
    "cuts": f"SELECT case_id, side, CASE WHEN ok THEN c1 ELSE {FIRST[2]} END AS c1, CASE WHEN ok THEN c2 ELSE {SECOND[2]} END AS c2, ok AND a IS NOT NULL AND b IS NOT NULL AS by_branches FROM (SELECT *, c1 > 0 AND c1 < c2 AND c2 < 1 AS ok FROM cut0)",
}


def axes(spark, sf_dir):
    from voxtab.operators import positions as P

    t = tube(spark, sf_dir)
    body = P.bodies(t.where("kind = 'segment'"), GROUP, LEAST_VOX)
    axis, at = P.segment_axis(body, P.body_edges(body, GROUP, SPACING), GROUP, t.where("kind = 'proximal'"), t.where("kind = 'branch'"), [6], TOUCH_MM, SPACING)
    return t, axis, P.cut_points(axis, at, GROUP, FIRST, SECOND)


@query(
    tube_sql(
        f"SELECT case_id, side, i, j, k, round(t, 6) AS t, CASE WHEN round(t, 9) < round(c1, 9) THEN 0 WHEN round(t, 9) < round(c2, 9) THEN 1 ELSE 2 END AS part, by_branches FROM (SELECT s.case_id, s.side, s.i, s.j, s.k, a.t FROM tube s JOIN axis a ON a.case_id = s.case_id AND a.side = s.side WHERE s.kind = 'segment' QUALIFY row_number() OVER (PARTITION BY s.case_id, s.side, s.i, s.j, s.k ORDER BY round(sqrt({_mm2('s.', 'a.')}), 9), {_key('a.')}) = 1) JOIN cuts USING (case_id, side)",
        AXIS,
    )
)
def split_segment(spark, sf_dir):
    """GRA9: every segment voxel with its position on a double-sweep axis, cut in three where branches leave."""
    from voxtab.operators import positions as P

    t, axis, cuts = axes(spark, sf_dir)
    out = P.split_segment(t.where("kind = 'segment'"), axis, cuts, GROUP, SPACING)
    return rounded(out.join(cuts.select(*GROUP, "by_branches"), GROUP))


#: PRB19: per part, the branch that a lesion touches decides, else the part's own name.
NAMES = {0: ([(4, "near branch")], "near"), 1: ([(4, "middle branch 4"), (6, "middle branch 6")], "middle"), 2: ([], "far")}
RULE = {
    "les": "SELECT case_id, i // 4 AS i, j, k, min(case_id * 1000 + j * 10 + k) AS comp_id FROM vox WHERE layer = 'N' GROUP BY 1, 2, 3, 4",
    "pair": f"SELECT l.case_id, l.comp_id, a.side, a.i, a.j, a.k, min(sqrt({_mm2('a.', 'l.')})) AS d, min(a.t) AS t FROM axis a JOIN les l ON l.case_id = a.case_id WHERE sqrt({_mm2('a.', 'l.')}) <= {ON_AXIS_MM + MORE_MM} + 1e-9 GROUP BY 1, 2, 3, 4, 5, 6",
    "least": f"SELECT case_id, comp_id, side, min(d) AS dmin FROM pair GROUP BY 1, 2, 3 HAVING round(min(d), 9) <= {ON_AXIS_MM}",
    "placed": f"SELECT case_id, comp_id, side, t, dmin FROM (SELECT p.case_id, p.comp_id, p.side, m.dmin, median(p.t) AS t FROM pair p JOIN least m USING (case_id, comp_id, side) WHERE round(p.d, 9) <= round(m.dmin + {MORE_MM}, 9) GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY case_id, comp_id ORDER BY round(dmin, 9), side) = 1",
    "touched": f"SELECT l.case_id, l.comp_id, list(DISTINCT b.branch) AS classes FROM les l JOIN tube b ON b.kind = 'branch' AND b.case_id = l.case_id WHERE sqrt({_mm2('l.', 'b.')}) <= {TOUCH_MM} + 1e-9 GROUP BY 1, 2",
}


@query(
    tube_sql(
        "SELECT case_id, comp_id, side, round(t, 6) AS t, round(dmin, 6) AS dmin, part, CASE WHEN part = 0 AND coalesce(list_contains(classes, 4), false) THEN 'near branch' WHEN part = 0 THEN 'near' WHEN part = 1 AND coalesce(list_contains(classes, 4), false) THEN 'middle branch 4' WHEN part = 1 AND coalesce(list_contains(classes, 6), false) THEN 'middle branch 6' WHEN part = 1 THEN 'middle' ELSE 'far' END AS name"
        f" FROM (SELECT p.*, t.classes, CASE WHEN round(p.t, 9) < {FIRST[2]} THEN 0 WHEN round(p.t, 9) < {SECOND[2]} THEN 1 ELSE 2 END AS part FROM placed p LEFT JOIN touched t USING (case_id, comp_id))",
        AXIS, RULE,
    )
)
def segment_rule(spark, sf_dir):
    """PRB19: truth lesions, one per column of the coarse grid, named by where the nearest axis runs past them and which branch they touch."""
    from voxtab.operators import positions as P
    from voxtab.operators.space import range_join

    t, axis, _ = axes(spark, sf_dir)
    les = vox(spark, sf_dir, "N").groupBy("case_id", F.floor(F.col("i") / 4).cast("int").alias("i"), "j", "k").agg(F.min(F.col("case_id") * 1000 + F.col("j") * 10 + F.col("k")).alias("comp_id"))
    placed = P.lesion_on_axis(les, axis, "side", ON_AXIS_MM, MORE_MM, SPACING)
    near = range_join(les.select("case_id", "i", "j", "k", "comp_id"), t.where("kind = 'branch'").select("case_id", "i", "j", "k", "branch"), TOUCH_MM, SPACING)
    touching = near.groupBy("case_id", F.col("l_comp_id").alias("comp_id")).agg(F.collect_set("r_branch").alias("classes"))
    return rounded(P.segment_rule(placed, touching, NAMES, FIRST[2], SECOND[2]))
