"""Queries of landmark frames, the atlas, mirrored nodes, conventions of naming, bone and synthetic rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtab.operators import anatomy as A
from voxtab.operators import bone as B
from voxtab.operators import synthetic as Y
from voxtab.operators.space import AXES, box_offsets
from voxtab.plans.lineage import materialize
from voxtab.plans.queries_lesions import DI, OV
from voxtab.plans.queries_voxels import BOX, comp_sql, comp_tables, comps, dist_sql
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import SPACING, SQL, intensity, nodes, vox, with_tables

SI, SJ, SK = SPACING
#: Positions i, j, k run below these.
SHAPE = (51, 11, 9)
#: Class 1 lies in the middle; 2 and 3, 4 and 5, 6 and 7 are right and left of each other.
RIGHT, LEFT, BASE = [(2, 4), (2, 6)], [(3, 5), (3, 7)], [(1, 4), (1, 5)]
MIRROR = {2: 3, 3: 2, 4: 5, 5: 4, 6: 7, 7: 6}
PAIRS = [(2, 4), (2, 6), (3, 5), (3, 7)]


def _any(patterns) -> str:
    return "(" + " OR ".join("(" + " AND ".join(f"list_contains(class_ids, {c})" for c in p) + ")" for p in patterns) + ")"


_MARKS = ", ".join(f"arg_min({c}, node_id) FILTER {n} AS {p}{c}" for p, n in (("r", f"(WHERE {_any(RIGHT)})"), ("l", f"(WHERE {_any(LEFT)})"), ("q", f"(WHERE {_any(BASE)})")) for c in "xyz")
FRAME = {
    "lm": f"SELECT case_id, {_MARKS} FROM nodes GROUP BY 1",
    "f1": "SELECT *, (rx+lx+qx)/3 AS ox, (ry+ly+qy)/3 AS oy, (rz+lz+qz)/3 AS oz, sqrt((lx-rx)*(lx-rx)+(ly-ry)*(ly-ry)+(lz-rz)*(lz-rz)) AS s FROM lm WHERE rx IS NOT NULL AND lx IS NOT NULL AND qx IS NOT NULL",
    "f2": "SELECT *, (lx-rx)/s AS ux, (ly-ry)/s AS uy, (lz-rz)/s AS uz FROM f1 WHERE s >= 1e-6",
    "f3": "SELECT *, qx-ox-d*ux AS tx, qy-oy-d*uy AS ty, qz-oz-d*uz AS tz FROM (SELECT *, (qx-ox)*ux+(qy-oy)*uy+(qz-oz)*uz AS d FROM f2)",
    "f4": "SELECT *, tx/n AS vx, ty/n AS vy, tz/n AS vz FROM (SELECT *, sqrt(tx*tx+ty*ty+tz*tz) AS n FROM f3) WHERE n >= 1e-6",
    "frame": "SELECT *, uy*vz-uz*vy AS wx, uz*vx-ux*vz AS wy, ux*vy-uy*vx AS wz FROM f4",
}


def _in_frame(p: str = "n", f: str = "f") -> str:
    dots = ", ".join(f"(({p}.x-{f}.ox)*{f}.{a}x + ({p}.y-{f}.oy)*{f}.{a}y + ({p}.z-{f}.oz)*{f}.{a}z)/{f}.s AS p{c}" for a, c in zip("uvw", "xyz"))
    far = ", ".join(f"sqrt(({p}.x-{f}.{m}x)*({p}.x-{f}.{m}x) + ({p}.y-{f}.{m}y)*({p}.y-{f}.{m}y) + ({p}.z-{f}.{m}z)*({p}.z-{f}.{m}z))/{f}.s AS d{m.replace('q', 'b')}" for m in "rlq")
    return f"{dots}, {far}"


def frames(spark, sf_dir):
    return A.frames(nodes(spark, sf_dir), RIGHT, LEFT, BASE)


_SIX = ", ".join(f"round({c}, 6) AS {c}" for c in ("px", "py", "pz", "dr", "dl", "db"))


@query(with_tables(f"SELECT case_id, node_id, {_SIX} FROM (SELECT n.case_id, n.node_id, {_in_frame()} FROM nodes n JOIN frame f USING (case_id))", "nodes", **FRAME))
def landmark_axes(spark, sf_dir):
    """GRA14: six values of each node in the frame of three landmarks."""
    return rounded(A.positions(nodes(spark, sf_dir).select("case_id", "node_id", "x", "y", "z"), frames(spark, sf_dir)).drop("x", "y", "z"))


ATLAS = {
    "typed": "SELECT *, array_to_string(class_ids, ',') AS sig FROM nodes WHERE len(class_ids) = 2",
    "atlas": f"SELECT sig, count(*) AS n, median(px) AS px, median(py) AS py, median(pz) AS pz FROM (SELECT n.sig, {_in_frame()} FROM typed n JOIN frame f USING (case_id)) GROUP BY 1 HAVING count(*) >= 5",
}


@query(
    comp_sql(
        "SELECT c.case_id, c.comp_id, t.sig, round(min(sqrt((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y)+(c.z-t.z)*(c.z-t.z))), 6) AS dist, max(t.missing) AS missing FROM cen c JOIN tgt t USING (case_id) GROUP BY 1, 2, 3",
        extra={
            "nodes": SQL["nodes"], **FRAME, **ATLAS,
            "cen": f"SELECT case_id, comp_id, avg(i)*{SI}::DOUBLE AS x, avg(j)*{SJ}::DOUBLE AS y, avg(k)*{SK}::DOUBLE AS z FROM comp GROUP BY 1, 2",
            "own": "SELECT t.case_id, t.sig, t.x, t.y, t.z FROM typed t JOIN frame USING (case_id) WHERE t.sig IN (SELECT sig FROM atlas)",
            "tgt": "SELECT *, false AS missing FROM own UNION ALL SELECT f.case_id, a.sig, f.ox + f.s*(a.px*f.ux+a.py*f.vx+a.pz*f.wx), f.oy + f.s*(a.px*f.uy+a.py*f.vy+a.pz*f.wy), f.oz + f.s*(a.px*f.uz+a.py*f.vz+a.pz*f.wz), true FROM frame f, atlas a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.case_id = f.case_id AND o.sig = a.sig)",
        },
    )
)
def atlas_distances(spark, sf_dir):
    """GRA15: from each component's centre to every node type of two classes; a case without one has the atlas's place for it."""
    n = nodes(spark, sf_dir).where(F.size("class_ids") == 2)
    frame = materialize(frames(spark, sf_dir))
    types = A.atlas(n, frame, 5)
    centre = comps(spark, sf_dir).groupBy("case_id", "comp_id").agg(*[(F.avg(a) * s).alias(c) for a, s, c in zip(AXES, SPACING, "xyz")])
    return rounded(A.node_distances(centre, A.filled_nodes(n, frame, types)))


@query(
    with_tables(
        "SELECT case_id, t AS trunk, b AS branch, node_id, i, j, k, round(d, 6) AS snap_mm FROM (SELECT *, row_number() OVER (PARTITION BY case_id, t, b ORDER BY round(d, 9), i, j, k) AS r FROM near) WHERE r = 1",
        "vox", "nodes", **FRAME,
        have="SELECT case_id, t, b, min(node_id) AS node_id, arg_min(x, node_id) AS x, arg_min(y, node_id) AS y, arg_min(z, node_id) AS z FROM nodes, (VALUES (2, 4), (2, 6), (3, 5), (3, 7)) p(t, b) WHERE list_contains(class_ids, t) AND list_contains(class_ids, b) AND n_transition_vox >= 3 GROUP BY 1, 2, 3",
        lost="SELECT * FROM (SELECT case_id, xor(t, 1) AS t, xor(b, 1) AS b, node_id, x, y, z FROM have) h WHERE NOT EXISTS (SELECT 1 FROM have o WHERE o.case_id = h.case_id AND o.t = h.t AND o.b = h.b)",
        refl=f"SELECT case_id, t, b, node_id, (x - 2*a*ux)/{SI} AS i, (y - 2*a*uy)/{SJ} AS j, (z - 2*a*uz)/{SK} AS k FROM (SELECT l.*, f.ux, f.uy, f.uz, (x-ox)*ux+(y-oy)*uy+(z-oz)*uz AS a FROM lost l JOIN frame f USING (case_id))",
        near=f"SELECT q.case_id, q.t, q.b, q.node_id, v.i, v.j, v.k, {dist_sql('q', 'v')} AS d FROM refl q JOIN vox v ON v.layer = 'A' AND v.case_id = q.case_id AND v.cls = q.t WHERE {dist_sql('q', 'v')} <= 6",
    )
)
def mirror_nodes(spark, sf_dir):
    """GRA16: nodes of three transition voxels or more that a case has on one side only, reflected and snapped within 6 mm."""
    valid = nodes(spark, sf_dir).where("n_transition_vox >= 3")
    return rounded(A.mirror_nodes(valid, frames(spark, sf_dir), vox(spark, sf_dir, "A"), PAIRS, MIRROR, 6.0, SPACING))


#: Families (class // 2) from near to far, the class of a family's trunk, and of the junction of two families.
ORDER = [0, 2, 1, 3]
TRUNK = {0: 1, 1: 2, 2: 4, 3: 6}
JUNCTION = {(0, 1): 3, (0, 2): 5, (0, 3): 7, (1, 2): 3, (2, 3): 5}


@query(
    comp_sql(
        "SELECT large, n, major, proximal, joint, neither, CASE WHEN major = top THEN 'major' WHEN proximal = top THEN 'proximal' ELSE 'joint' END AS best, n >= 10 AND top >= n * 0.8 AS is_rule FROM (SELECT *, greatest(major, proximal, joint) AS top FROM"
        " (SELECT large, count(*) AS n, count(*) FILTER (m = cls) AS major, count(*) FILTER (p = cls) AS proximal, count(*) FILTER (j = cls) AS joint, count(*) FILTER (NOT (coalesce(m = cls, false) OR coalesce(p = cls, false) OR coalesce(j = cls, false))) AS neither FROM named JOIN truth USING (case_id, comp_id) GROUP BY 1))",
        extra={
            "reg": f"SELECT DISTINCT case_id, comp_id, i+di AS i, j+dj AS j, k+dk AS k FROM comp, {BOX}",
            "sh": "SELECT case_id, comp_id, fam, n / sum(n) OVER (PARTITION BY case_id, comp_id) AS share FROM (SELECT r.case_id, r.comp_id, v.cls // 2 AS fam, count(*) AS n FROM reg r JOIN vox v USING (case_id, i, j, k) WHERE v.layer = 'A' GROUP BY 1, 2, 3)",
            "sp": "SELECT case_id, comp_id, list(fam ORDER BY round(share, 9) DESC, fam) AS span, arg_min(fam, CASE fam WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS prox FROM sh WHERE round(share, 9) >= 0.15 GROUP BY 1, 2 HAVING count(*) >= 2",
            "named": "SELECT s.case_id, s.comp_id, a.v AS m, b.v AS p, c.v AS j FROM sp s LEFT JOIN (VALUES (0, 1), (1, 2), (2, 4), (3, 6)) a(f, v) ON a.f = span[1] LEFT JOIN (VALUES (0, 1), (1, 2), (2, 4), (3, 6)) b(f, v) ON b.f = prox LEFT JOIN (VALUES (0, 1, 3), (0, 2, 5), (0, 3, 7), (1, 2, 3), (2, 3, 5)) c(f, g, v) ON c.f = least(span[1], span[2]) AND c.g = greatest(span[1], span[2])",
            "truth": "SELECT case_id, comp_id, cls, large FROM (SELECT c.case_id, c.comp_id, v.cls, any_value(s.n >= 4) AS large, row_number() OVER (PARTITION BY c.case_id, c.comp_id ORDER BY count(*) DESC, v.cls) AS r FROM comp c JOIN vox v USING (case_id, i, j, k) JOIN (SELECT case_id, comp_id, count(*) AS n FROM comp GROUP BY 1, 2) s ON s.case_id = c.case_id AND s.comp_id = c.comp_id WHERE v.layer = 'N' GROUP BY 1, 2, 3) WHERE r = 1",
        },
    )
)
def convention_accuracy(spark, sf_dir):
    """EXP15: which of three conventions names components that span families of classes, for small and large ones."""
    c = comps(spark, sf_dir)
    labels = vox(spark, sf_dir, "A").withColumn("cls", F.floor(F.col("cls") / 2).cast("int"))
    named = A.conventions(A.class_shares(c, labels, box_offsets(1)), ORDER, TRUNK, JUNCTION)
    met = c.select("case_id", "comp_id", *AXES).join(vox(spark, sf_dir, "N"), ["case_id", *AXES]).groupBy("case_id", "comp_id", "cls").agg(F.count("*").alias("n"))
    truth = met.groupBy("case_id", "comp_id").agg(F.min_by("cls", F.struct(-F.col("n"), "cls")).alias("cls"))
    sizes = c.groupBy("case_id", "comp_id").agg((F.count("*") >= 4).alias("large"))
    return A.convention_accuracy(named, truth.join(sizes, ["case_id", "comp_id"]), "large")


HU, BONE_MM3, REACH, BALL = 300.0, 0.3, 3.0, 1.5


def _peak_sql(rows: str, low: str, high: str, name: str) -> str:
    inside = f"SELECT case_id, value FROM {rows} WHERE value > {low} AND value < {high}"
    binned = f"SELECT v.case_id, e.a, e.b, CASE WHEN e.b > e.a THEN least(floor((v.value - e.a) / (e.b - e.a) * 200), 199) ELSE 0 END AS bin, count(*) AS n FROM ({inside}) v JOIN (SELECT case_id, min(value) AS a, max(value) AS b FROM ({inside}) GROUP BY 1) e USING (case_id) GROUP BY 1, 2, 3, 4"
    return f"SELECT case_id, a + (bin + 0.5::DOUBLE) * (b - a) / 200 AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, bin) AS r FROM ({binned})) WHERE r = 1"


_OFF = "(SELECT a.a AS di, b.b AS dj, c.c AS dk FROM range(-7, 8) a(a), range(-7, 8) b(b), range(-5, 6) c(c))"


@query(
    with_tables(
        f"SELECT c.case_id, c.comp_id, round(coalesce(d.d, {REACH}), 6)::DOUBLE AS bone_mm, round(coalesce(s.share, 0), 6)::DOUBLE AS bone_share FROM (SELECT DISTINCT case_id, comp_id FROM comp) c LEFT JOIN dmin d USING (case_id, comp_id) LEFT JOIN ball s USING (case_id, comp_id)",
        "vox", "inten", recursive=True,
        val="SELECT case_id, i, j, k, max(value) AS value FROM inten WHERE modality = 'CT' GROUP BY 1, 2, 3, 4",
        q="SELECT case_id, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.999), 6) AS top FROM val GROUP BY 1",
        v1="SELECT * FROM val JOIN q USING (case_id)", tis=_peak_sql("v1", "p25", "top", "tissue"),
        v2="SELECT val.*, t.tissue, q.p5 - 0.1::DOUBLE * (t.tissue - q.p5) AS lo, q.p5 + 0.5::DOUBLE * (t.tissue - q.p5) AS hi FROM val JOIN q USING (case_id) JOIN tis t USING (case_id)", air=_peak_sql("v2", "lo", "hi", "air"),
        hu="SELECT v.case_id, v.i, v.j, v.k, -1000 + (v.value - a.air) * (1040 / (t.tissue - a.air)) AS hu FROM val v JOIN tis t USING (case_id) JOIN air a USING (case_id) WHERE t.tissue <> a.air",
        **comp_tables(f"SELECT *, 0 AS cls FROM hu WHERE hu > {HU}", 26, "bp"),
        bone="SELECT b.case_id, b.i, b.j, b.k FROM bp b JOIN (SELECT case_id, comp_id FROM bp GROUP BY 1, 2 HAVING count(*) >= 4) USING (case_id, comp_id)",
        **comp_tables("SELECT * FROM vox WHERE layer = 'R' AND case_id % 2 = 0", 26),
        dmin=f"SELECT c.case_id, c.comp_id, min({dist_sql('c', 'b')}) AS d FROM comp c JOIN bone b ON b.case_id = c.case_id AND abs(c.i-b.i) <= 8 AND abs(c.j-b.j) <= 8 AND abs(c.k-b.k) <= 5 WHERE {dist_sql('c', 'b')} <= {REACH} + 1e-9 GROUP BY 1, 2",
        cen="SELECT case_id, comp_id, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM comp GROUP BY 1, 2",
        cell=f"SELECT * FROM (SELECT c.*, CAST(round(ci) AS INT) + di AS i, CAST(round(cj) AS INT) + dj AS j, CAST(round(ck) AS INT) + dk AS k FROM cen c, {_OFF}) WHERE i BETWEEN 0 AND {SHAPE[0] - 1} AND j BETWEEN 0 AND {SHAPE[1] - 1} AND k BETWEEN 0 AND {SHAPE[2] - 1}"
        f" AND round(sqrt(((i-ci)*{SI}::DOUBLE)*((i-ci)*{SI}::DOUBLE) + ((j-cj)*{SJ}::DOUBLE)*((j-cj)*{SJ}::DOUBLE) + ((k-ck)*{SK}::DOUBLE)*((k-ck)*{SK}::DOUBLE)), 9) <= {BALL}",
        ball="SELECT c.case_id, c.comp_id, count(b.case_id) / count(*) AS share FROM cell c LEFT JOIN bone b ON b.case_id = c.case_id AND b.i = c.i AND b.j = c.j AND b.k = c.k GROUP BY 1, 2",
    )
)
def bone_proximity(spark, sf_dir):
    """FEA20 for components of CT cases: voxels over 300 HU in pieces of 0.3 mm3 or more, within 3 mm, and their share in a ball of 1.5 mm."""
    values = intensity(spark, sf_dir).where("modality = 'CT'").groupBy("case_id", *AXES).agg(F.max("value").alias("value"))
    bone = materialize(B.bone_voxels(B.calibrated(materialize(values)), HU, BONE_MM3, SPACING))
    lesions = comps(spark, sf_dir).where("case_id % 2 = 0")
    return rounded(B.bone_features(lesions, bone, SHAPE, REACH, BALL, SPACING))


#: Class and node classes of each synthetic kind; the radii of balls in millimetres.
KINDS = [(2, (2, 4)), (3, (3, 5)), (6, (2, 6)), (7, (3, 7))]
LOW, HIGH = 0.5, 1.2


@query(
    comp_sql(
        "SELECT f.case_id, f.comp_id, f.n_vox, f.overlap, f.dist_mm, n.cls FROM feat f JOIN named n USING (case_id, comp_id)",
        extra={
            "nodes": SQL["nodes"],
            "rad": f"SELECT row_number() OVER (ORDER BY radius, case_id, comp_id) - 1 AS place, radius FROM (SELECT case_id, comp_id, round(least(greatest(pow(count(*) * 0.096 * 3 / (4 * pi()), 1 / 3.0::DOUBLE), {LOW}), {HIGH}), 9) AS radius FROM comp GROUP BY 1, 2)",
            "tg": "SELECT case_id, kind, cls, arg_min(x, node_id) AS x, arg_min(y, node_id) AS y, arg_min(z, node_id) AS z FROM nodes, (VALUES (0, 2, 2, 4), (1, 3, 3, 5), (2, 6, 2, 6), (3, 7, 3, 7)) q(kind, cls, a, b) WHERE list_contains(class_ids, a) AND list_contains(class_ids, b) GROUP BY 1, 2, 3",
            "dr": "SELECT t.*, r.radius FROM tg t, (SELECT count(*) AS n FROM rad) c, rad r WHERE r.place = (t.case_id * 7919 + t.kind * 104729) % c.n",
            "cell": f"SELECT case_id, kind, CAST(round(round(x / {SI}, 6)) AS INT) + di AS i, CAST(round(round(y / {SJ}, 6)) AS INT) + dj AS j, CAST(round(round(z / {SK}, 6)) AS INT) + dk AS k FROM dr, {_OFF} WHERE round((di*{SI}::DOUBLE)*(di*{SI}::DOUBLE) + (dj*{SJ}::DOUBLE)*(dj*{SJ}::DOUBLE) + (dk*{SK}::DOUBLE)*(dk*{SK}::DOUBLE), 9) <= round(radius * radius, 9)",
            "own": f"SELECT case_id, i, j, k, min(kind) AS cls FROM cell WHERE i BETWEEN 0 AND {SHAPE[0] - 1} AND j BETWEEN 0 AND {SHAPE[1] - 1} AND k BETWEEN 0 AND {SHAPE[2] - 1} GROUP BY 1, 2, 3, 4",
            "bl": "SELECT o.* FROM own o JOIN (SELECT case_id, cls FROM own GROUP BY 1, 2 HAVING count(*) >= 3) USING (case_id, cls)",
            **comp_tables("SELECT * FROM bl", 26, "bc"),
            "cen": f"SELECT case_id, comp_id, avg(i) * {SI}::DOUBLE AS x, avg(j) * {SJ}::DOUBLE AS y, avg(k) * {SK}::DOUBLE AS z FROM bc GROUP BY 1, 2",
            "named": "SELECT case_id, comp_id, cls FROM (SELECT c.case_id, c.comp_id, t.cls, row_number() OVER (PARTITION BY c.case_id, c.comp_id ORDER BY round(sqrt((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y)+(c.z-t.z)*(c.z-t.z)), 9), t.kind) AS r FROM cen c JOIN tg t USING (case_id) WHERE sqrt((c.x-t.x)*(c.x-t.x)+(c.y-t.y)*(c.y-t.y)+(c.z-t.z)*(c.z-t.z)) < 3 AND (t.case_id, t.kind) IN (SELECT case_id, cls FROM bl)) WHERE r = 1",
            "ovl": OV["ovl"].replace("comp c", "bc c"), "dis": DI["dis"].replace("comp c", "bc c"),
            "feat": "SELECT b.case_id, b.comp_id, b.n_vox, coalesce(o.t, '') AS overlap, coalesce(d.t, '') AS dist_mm FROM (SELECT case_id, comp_id, count(*) AS n_vox FROM bc GROUP BY 1, 2) b LEFT JOIN (SELECT case_id, comp_id, string_agg(cls || ':' || n, ',' ORDER BY cls) AS t FROM ovl GROUP BY 1, 2) o USING (case_id, comp_id) LEFT JOIN (SELECT case_id, comp_id, string_agg(cls || ':' || CAST(round(dist*1000) AS INT), ',' ORDER BY cls) AS t FROM dis GROUP BY 1, 2) d USING (case_id, comp_id)",
        },
    )
)
def synthesise_balls(spark, sf_dir):
    """FEA15: feature rows of balls at junctions, of radii drawn from those of the real components."""
    marks = materialize(Y.targets(nodes(spark, sf_dir), KINDS))
    radii = materialize(Y.radius_table(comps(spark, sf_dir), SPACING, LOW, HIGH))
    drawn = materialize(Y.balls(marks, radii, SHAPE, HIGH, SPACING))
    f = Y.synthetic_rows(drawn, marks, vox(spark, sf_dir, "A"), 3.0, 0.9, SPACING)
    text = lambda m, v: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"].cast("string"), v(e["value"]).cast("string"))), ",")
    return f.select("case_id", "comp_id", "n_vox", text("overlap", lambda x: x).alias("overlap"), text("dist_mm", lambda x: F.round(x * 1000).cast("int")).alias("dist_mm"), "cls")
