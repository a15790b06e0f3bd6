"""Queries over necks, protrusions, thickness, false blobs and bridged centrelines."""

from __future__ import annotations

from voxtab.operators import bridges as B
from voxtab.operators import components as C
from voxtab.operators import graph as G
from voxtab.operators import lesions as L
from voxtab.operators import necks as K
from voxtab.operators.space import AXES, voxel_key
from voxtab.plans.queries_lesions import DI, EDGE, LINE, line
from voxtab.plans.queries_voxels import comp_sql, comp_tables, comps, dist_sql, near_sql
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import SPACING, vox, with_tables

PIECE = comp_tables("SELECT c.case_id, c.i, c.j, c.k, c.comp_id AS cls FROM comp c WHERE EXISTS (SELECT 1 FROM vox v WHERE v.layer='A' AND v.case_id=c.case_id AND v.i=c.i AND v.j=c.j AND v.k=c.k)", 26, "piece", per_class=True)
NECK = PIECE | {
    "top": "SELECT case_id, cls, comp_id FROM (SELECT case_id, cls, comp_id, row_number() OVER (PARTITION BY case_id, cls ORDER BY count(*) DESC, comp_id) AS r FROM piece GROUP BY 1,2,3) WHERE r = 1",
    "neck": "SELECT case_id, cls AS comp_id, i, j, k, false AS whole FROM piece JOIN top USING (case_id, cls, comp_id) UNION ALL SELECT case_id, comp_id, i, j, k, true FROM comp WHERE (case_id, comp_id) NOT IN (SELECT case_id, cls FROM top)",
}


@query(comp_sql("SELECT * FROM neck", extra=NECK))
def neck_set(spark, sf_dir):
    return K.neck_set(comps(spark, sf_dir), vox(spark, sf_dir, "A"))


FLIP = NECK | DI | {
    "din": DI["dis"].replace("FROM comp c", "FROM neck c"),
    "wide": "SELECT case_id, comp_id, cls % 2 AS side FROM (SELECT *, row_number() OVER (PARTITION BY case_id, comp_id ORDER BY round(dist, 9), cls) AS r FROM dis) WHERE r = 1",
    "slim": "SELECT case_id, comp_id, cls % 2 AS side FROM (SELECT *, row_number() OVER (PARTITION BY case_id, comp_id ORDER BY round(dist, 9), cls) AS r FROM din) WHERE r = 1",
}


@query(comp_sql("SELECT d.case_id, d.comp_id, d.cls, round(d.dist, 6) AS whole_mm, round(n.dist, 6) AS neck_mm, coalesce(w.side <> s.side, false) AS flip FROM dis d LEFT JOIN din n USING (case_id, comp_id, cls) JOIN wide w USING (case_id, comp_id) LEFT JOIN slim s USING (case_id, comp_id)", extra=FLIP))
def neck_side_flip(spark, sf_dir):
    c, v = comps(spark, sf_dir), vox(spark, sf_dir, "A")
    table = lambda x: L.distance_table(x, v, 0.9, SPACING)
    return rounded(K.side_flips(table(c), table(K.neck_set(c, v))))


OUT = {
    "v": "SELECT * FROM vox WHERE layer='A'", "q": "SELECT * FROM comp", "n": near_sql(f"{dist_sql('q', 'v')} <= 1.5"),
    "x": "SELECT q.case_id, q.comp_id, q.i, q.j, q.k, n.d, n.cls AS near, min(n.d) OVER w AS lo, max(n.d) OVER w AS hi FROM q JOIN n USING (case_id, i, j, k) WINDOW w AS (PARTITION BY q.case_id, q.comp_id)",
    "f": "SELECT *, round(d, 9) <= round(lo + 0.6::DOUBLE, 9) AS is_neck, round(d, 9) >= round(hi * 0.8::DOUBLE, 9) AS is_tip FROM x",
    "m": "SELECT case_id, comp_id, " + ", ".join(f"avg({a}*{s}::DOUBLE) FILTER (is_tip) - avg({a}*{s}::DOUBLE) FILTER (is_neck) AS m{a}" for a, s in zip("ijk", SPACING)) + " FROM f GROUP BY 1,2",
    "par": "SELECT case_id, comp_id, near AS parent FROM (SELECT case_id, comp_id, near, row_number() OVER (PARTITION BY case_id, comp_id ORDER BY count(*) DESC, near) AS r FROM f WHERE is_neck GROUP BY 1,2,3) WHERE r = 1",
    "l": "SELECT *, sqrt(mi*mi + mj*mj + mk*mk) AS length FROM m",
}


@query(comp_sql("SELECT case_id, comp_id, parent, round(length, 6) AS length, " + ", ".join(f"round(CASE WHEN length > 1e-9 THEN m{a} / length END, 6) AS u{a}" for a in "ijk") + " FROM l JOIN par USING (case_id, comp_id)", extra=OUT))
def protrusion(spark, sf_dir):
    return rounded(K.protrusion(comps(spark, sf_dir), vox(spark, sf_dir, "A"), 1.5, SPACING))


THICK = {
    "v": "SELECT * FROM vox WHERE layer='A'",
    "o": "SELECT CAST(a AS INT) AS di, CAST(b AS INT) AS dj, CAST(c AS INT) AS dk, sqrt((a*0.4)*(a*0.4) + (b*0.4)*(b*0.4) + (c*0.6)*(c*0.6))::DOUBLE AS d FROM range(-12, 13) x(a), range(-12, 13) y(b), range(-8, 9) z(c) WHERE (a*0.4)*(a*0.4) + (b*0.4)*(b*0.4) + (c*0.6)*(c*0.6) <= 1.44",
    "t": "SELECT v.case_id, v.i, v.j, v.k, min(o.d) AS inner_mm FROM v, o WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.case_id=v.case_id AND b.i=v.i+o.di AND b.j=v.j+o.dj AND b.k=v.k+o.dk) GROUP BY 1,2,3,4",
    "own": f"SELECT c.case_id, c.comp_id, max(v.inner_mm) AS parent_mm FROM comp c JOIN t v ON v.case_id=c.case_id AND abs(c.i-v.i)<=2 AND abs(c.j-v.j)<=2 AND abs(c.k-v.k)<=1 WHERE {dist_sql('c', 'v')} <= 0.9 GROUP BY 1,2",
}


@query(comp_sql("SELECT case_id, comp_id, round(parent_mm, 6) AS parent_mm, round(parent_mm / p95, 6) AS ratio FROM own JOIN (SELECT case_id, quantile_cont(inner_mm, 0.95) AS p95 FROM t GROUP BY 1) USING (case_id)", extra=THICK))
def vessel_thickness(spark, sf_dir):
    return rounded(K.parent_thickness(comps(spark, sf_dir), K.inner_distance(vox(spark, sf_dir, "A"), SPACING), 0.9, SPACING))


FALSE = {
    "fb": "SELECT * FROM comp WHERE (case_id, comp_id) NOT IN (SELECT c.case_id, c.comp_id FROM comp c JOIN vox v ON v.layer='N' AND v.case_id=c.case_id AND v.i=c.i AND v.j=c.j AND v.k=c.k)",
    "gap": f"SELECT c.case_id, c.comp_id, min({dist_sql('c', 'v')}) AS gt_mm FROM fb c JOIN vox v ON v.layer='N' AND v.case_id=c.case_id GROUP BY 1,2",
    "cn": "SELECT case_id, comp_id, cls, count(*) AS n FROM fb GROUP BY 1,2,3",
    "rk": "SELECT *, CAST(sum(n) OVER (PARTITION BY case_id, comp_id) AS BIGINT) AS n_vox, CAST(row_number() OVER (PARTITION BY case_id, comp_id ORDER BY n DESC, cls) AS INT) AS rank FROM cn",
}


@query(comp_sql("SELECT case_id, comp_id, rank, cls, n, n_vox, round(gt_mm, 6) AS gt_mm FROM rk LEFT JOIN gap USING (case_id, comp_id) WHERE rank <= 2", extra=FALSE))
def fp_anatomy(spark, sf_dir):
    return rounded(K.false_blobs(comps(spark, sf_dir), vox(spark, sf_dir, "N"), None, SPACING))


ENDS = comp_tables("SELECT case_id, i, j, k, cls FROM line", 26) | {
    "pts": "SELECT c.* FROM comp c LEFT JOIN (SELECT case_id, u, count(*) AS n FROM edge GROUP BY 1,2) g ON g.case_id=c.case_id AND g.u=c.i*4398046511104 + c.j*2097152 + c.k WHERE coalesce(g.n, 0) <= 1",
    "pr": f"SELECT a.case_id, a.comp_id AS a, b.comp_id AS b, round(min({dist_sql('a', 'b')}), 9) AS w FROM pts a JOIN pts b ON a.case_id=b.case_id AND a.comp_id<b.comp_id WHERE {dist_sql('a', 'b')} <= 0.9 GROUP BY 1,2,3",
    "e": "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY w, a, b) AS eid FROM pr",
    "way": "SELECT case_id, eid, a AS node FROM e UNION SELECT r.case_id, r.eid, CASE WHEN x.a=r.node THEN x.b ELSE x.a END FROM way r JOIN e x ON x.case_id=r.case_id AND x.eid<r.eid AND (x.a=r.node OR x.b=r.node)",
    "yes": "SELECT * FROM e WHERE (case_id, eid, b) NOT IN (SELECT case_id, eid, node FROM way)",
    "one": "SELECT case_id, a AS node, a AS root FROM yes UNION SELECT case_id, b, b FROM yes UNION SELECT o.case_id, CASE WHEN x.a=o.node THEN x.b ELSE x.a END, o.root FROM one o JOIN yes x ON x.case_id=o.case_id AND (x.a=o.node OR x.b=o.node)",
}


@query(with_tables("SELECT y.case_id, y.a, y.b, round(y.w, 6) AS w, min(o.root) AS bridged FROM yes y JOIN one o ON o.case_id=y.case_id AND o.node=y.a GROUP BY 1,2,3,4", "vox", recursive=True, line=LINE, edge=EDGE, **ENDS))
def bridge_components(spark, sf_dir):
    x = line(spark, sf_dir).drop("layer")
    ends = G.degrees(x, G.skeleton_edges(x, SPACING)).where("degree <= 1")
    pieces = C.components(x).withColumn("u", voxel_key())
    return rounded(B.bridge_components(pieces.join(ends, ["case_id", "u"], "left_semi").select("case_id", "comp_id", *AXES), 0.9, SPACING))
