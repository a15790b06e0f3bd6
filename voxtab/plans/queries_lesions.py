"""Queries over lesions and centreline graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtab.operators import classify as K
from voxtab.operators import components as C
from voxtab.operators import graph as G
from voxtab.operators import lesions as L
from voxtab.operators.space import AXES, box_offsets, cross_offsets, nearest, nearest_always, voxel_key
from voxtab.plans.lineage import stored
from voxtab.plans.queries_graphs import VESSEL, ways_sql
from voxtab.plans.queries_voxels import CROSS, ID, comp_sql, comp_tables, comps, dist_sql, near_sql, sql
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import SPACING, intensity, vox, with_tables

OV = {"ovl": "SELECT c.case_id, c.comp_id, v.cls, count(*) AS n FROM comp c JOIN vox v USING (case_id,i,j,k) WHERE v.layer='A' GROUP BY 1,2,3"}
DI = {"dis": f"SELECT case_id, comp_id, cls, coalesce(min(d) FILTER (d > 0), 0) AS dist FROM (SELECT c.case_id, c.comp_id, v.cls, v.i, v.j, v.k, min({dist_sql('c', 'v')}) AS d FROM comp c JOIN vox v ON v.layer='A' AND v.case_id=c.case_id AND abs(c.i-v.i)<=2 AND abs(c.j-v.j)<=2 AND abs(c.k-v.k)<=1 WHERE {dist_sql('c', 'v')} <= 0.9 GROUP BY ALL) GROUP BY 1,2,3"}


def tables(spark, sf_dir):
    c, v = comps(spark, sf_dir), vox(spark, sf_dir, "A")
    return c, L.overlap_table(c, v), L.distance_table(c, v, 0.9, SPACING)


@query(comp_sql("SELECT b.case_id, b.comp_id, b.n_vox, coalesce(o.t, '') AS overlap, coalesce(d.t, '') AS dist_mm FROM (SELECT case_id, comp_id, count(*) AS n_vox FROM comp GROUP BY 1,2) b LEFT JOIN (SELECT case_id, comp_id, string_agg(cls || ':' || n, ',' ORDER BY cls) AS t FROM ovl GROUP BY 1,2) o USING (case_id, comp_id) LEFT JOIN (SELECT case_id, comp_id, string_agg(cls || ':' || CAST(round(dist*1000) AS INT), ',' ORDER BY cls) AS t FROM dis GROUP BY 1,2) d USING (case_id, comp_id)", extra=OV | DI))
def lesion_features(spark, sf_dir):
    f = L.lesion_features(comps(spark, sf_dir), vox(spark, sf_dir, "A"), 0.9, SPACING)
    text = lambda m, v: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(":", e["key"].cast("string"), v(e["value"]).cast("string"))), ",")
    return f.select("case_id", "comp_id", "n_vox", text("overlap", lambda x: x).alias("overlap"), text("dist_mm", lambda x: F.round(x * 1000).cast("int")).alias("dist_mm"))


DOM = {"dom": "SELECT case_id, comp_id, cls FROM (SELECT *, row_number() OVER (PARTITION BY case_id, comp_id ORDER BY kind, s, cls) AS r FROM (SELECT case_id, comp_id, cls, 0 AS kind, -n::DOUBLE AS s FROM ovl UNION ALL SELECT case_id, comp_id, cls, 1, round(dist, 9) FROM dis)) WHERE r = 1"}


@query(comp_sql("SELECT * FROM dom", extra=OV | DI | DOM))
def dominant_class(spark, sf_dir):
    _, o, d = tables(spark, sf_dir)
    return L.dominant_class(o, d)


@query(comp_sql("SELECT case_id, comp_id, string_agg(DISTINCT cls::VARCHAR, ',' ORDER BY cls::VARCHAR) AS sig FROM dis WHERE (case_id, comp_id, cls) NOT IN (SELECT case_id, comp_id, cls FROM dom) AND dist <= 0.7 GROUP BY 1,2", extra=OV | DI | DOM))
def signature(spark, sf_dir):
    _, o, d = tables(spark, sf_dir)
    return L.signature(d, 0.7, L.dominant_class(o, d))


#: Components with a true class (that of most truth voxels under them), their dominant class and their signature.
RULE = {
    "tru": "SELECT case_id, comp_id, cls AS truth FROM (SELECT c.case_id, c.comp_id, v.cls, row_number() OVER (PARTITION BY c.case_id, c.comp_id ORDER BY count(*) DESC, v.cls) AS r FROM comp c JOIN vox v USING (case_id,i,j,k) WHERE v.layer='N' GROUP BY 1,2,3) WHERE r = 1",
    "sg": "SELECT case_id, comp_id, string_agg(DISTINCT cls::VARCHAR, ',' ORDER BY cls::VARCHAR) AS sig FROM dis WHERE (case_id, comp_id, cls) NOT IN (SELECT case_id, comp_id, cls FROM dom) AND dist <= 0.7 GROUP BY 1,2",
    "rl": "SELECT t.case_id, t.comp_id, t.truth, d.cls AS own, coalesce(s.sig, '') AS sig FROM tru t JOIN dom d USING (case_id, comp_id) LEFT JOIN sg s USING (case_id, comp_id)",
    "tr": "SELECT * FROM rl WHERE case_id % 2 = 0",
}


def rule_rows(spark, sf_dir):
    c, o, d = tables(spark, sf_dir)
    own = L.dominant_class(o, d)
    met = c.select("case_id", "comp_id", *AXES).join(vox(spark, sf_dir, "N"), ["case_id", *AXES]).groupBy("case_id", "comp_id", "cls").agg(F.count("*").alias("n"))
    truth = met.groupBy("case_id", "comp_id").agg(F.min_by("cls", F.struct(-F.col("n"), "cls")).alias("truth"))
    y = truth.join(own.withColumnRenamed("cls", "own"), ["case_id", "comp_id"]).join(L.signature(d, 0.7, own), ["case_id", "comp_id"], "left")
    return stored(y.withColumn("sig", F.coalesce("sig", F.lit(""))))


def _majority(keys: str) -> str:
    by = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT {by}truth AS best FROM (SELECT {by}truth, row_number() OVER ({part}ORDER BY count(*) DESC, truth) AS r FROM tr GROUP BY {by}truth) WHERE r = 1"


@query(comp_sql(f"SELECT r.case_id, r.comp_id, r.truth, coalesce(a.best, b.best, g.best) AS pred_rule, CASE WHEN a.best IS NOT NULL THEN 0 WHEN b.best IS NOT NULL THEN 1 ELSE 2 END AS level FROM rl r LEFT JOIN ({_majority('own, sig')}) a USING (own, sig) LEFT JOIN ({_majority('own')}) b USING (own) LEFT JOIN ({_majority('')}) g ON true", extra=OV | DI | DOM | RULE))
def signature_lookup(spark, sf_dir):
    """CLF1: learned on every other case, by dominant class and neighbour set, else by dominant class, else from all."""
    rows = rule_rows(spark, sf_dir)
    out = K.lookup_levels(rows, rows.where("case_id % 2 = 0"), [["own", "sig"], ["own"]])
    return out.select("case_id", "comp_id", "truth", "pred_rule", "level")


@query(comp_sql("SELECT sig, round(avg((best = truth)::INT), 6) AS acc, count(*) AS n FROM (SELECT x.sig, x.truth, (SELECT y.truth FROM rl y WHERE y.sig = x.sig AND (y.case_id, y.comp_id) <> (x.case_id, x.comp_id) GROUP BY y.truth ORDER BY count(*) DESC, y.truth LIMIT 1) AS best FROM rl x) GROUP BY 1", extra=OV | DI | DOM | RULE))
def signature_loo(spark, sf_dir):
    """CLF2: accuracy of the majority rule of each neighbour set with the component left out."""
    return rounded(K.leave_one_out(rule_rows(spark, sf_dir), "sig"))


@query(sql("SELECT case_id, " + ", ".join(f"round(ln(1 + coalesce(sum((cls={c})::INT), 0) * 0.096::DOUBLE), 6) AS v{c}" for c in range(1, 8)) + " FROM vox WHERE layer='A' GROUP BY 1"))
def case_volumes(spark, sf_dir):
    p = vox(spark, sf_dir, "A").groupBy("case_id").pivot("cls", list(range(1, 8))).agg(F.count("cls"))
    return rounded(p.select("case_id", *[F.log1p(F.coalesce(F.col(str(c)), F.lit(0)) * 0.096).alias(f"v{c}") for c in range(1, 8)]))


@query(comp_sql("SELECT t.case_id, t.cls, round(least(2.0, t.n / m.med), 6) AS confidence FROM (SELECT case_id, cls, max(n) AS n FROM (SELECT case_id, cls, comp_id, count(*) AS n FROM comp GROUP BY 1,2,3) GROUP BY 1,2) t JOIN (SELECT cls, median(n) AS med FROM (SELECT case_id, cls, max(n) AS n FROM (SELECT case_id, cls, comp_id, count(*) AS n FROM comp GROUP BY 1,2,3) GROUP BY 1,2) WHERE case_id % 2 = 0 GROUP BY 1) m USING (cls)", layer="A", per_class=True))
def class_confidence(spark, sf_dir):
    top = C.largest_component(comps(spark, sf_dir, "A", per_class=True), ("case_id", "cls"))
    med = top.where("case_id % 2 = 0").groupBy("cls").agg(F.percentile("n_vox", F.lit(0.5)).alias("med"))
    return rounded(top.join(F.broadcast(med), "cls").select("case_id", "cls", F.least(F.lit(2.0), F.col("n_vox") / F.col("med")).alias("confidence")))


def moment(a: str, b: str, sa: float, sb: float) -> str:
    return f"avg({a}*{sa}::DOUBLE*{b}*{sb}::DOUBLE) - avg({a}*{sa}::DOUBLE)*avg({b}*{sb}::DOUBLE)"


@query(comp_sql("SELECT case_id, comp_id, count(*) AS n, " + ", ".join(f"round({moment(a, b, x, y)}, 8) AS {n}" for a, b, x, y, n in (("i", "i", .4, .4, "vi"), ("j", "j", .4, .4, "vj"), ("k", "k", .6, .6, "vk"), ("i", "j", .4, .4, "cij"), ("i", "k", .4, .6, "cik"), ("j", "k", .4, .6, "cjk"))) + " FROM comp GROUP BY 1,2 HAVING count(*) >= 4"))
def shape_moments(spark, sf_dir):
    m = rounded(L.second_moments(comps(spark, sf_dir), SPACING).where("n >= 4"), 8)
    return m


@query(comp_sql("SELECT case_id, comp_id, count(*) AS n_vox FROM comp c WHERE NOT EXISTS (SELECT 1 FROM comp d JOIN vox v USING (case_id,i,j,k) WHERE v.layer='R' AND d.case_id=c.case_id AND d.comp_id=c.comp_id) GROUP BY 1,2 HAVING count(*) <= 3", layer="N"))
def recover_blobs(spark, sf_dir):
    return L.recover(vox(spark, sf_dir, "R"), comps(spark, sf_dir, "N"), 3)


@query(comp_sql("SELECT case_id, comp_id, cls, n FROM (SELECT d.case_id, d.comp_id, v.cls, count(*) AS n, row_number() OVER (PARTITION BY d.case_id, d.comp_id ORDER BY count(*) DESC, v.cls) AS r FROM (SELECT DISTINCT case_id, comp_id, i+di AS i, j+dj AS j, k+dk AS k FROM comp, " + CROSS + ") d JOIN vox v ON v.layer='N' AND v.case_id=d.case_id AND v.i=d.i AND v.j=d.j AND v.k=d.k GROUP BY 1,2,3) WHERE r = 1"))
def dominant_label(spark, sf_dir):
    from voxtab.operators.space import shifted

    wide = shifted(comps(spark, sf_dir).select("case_id", "comp_id", *AXES), cross_offsets(1)).distinct()
    n = L.overlap_table(wide, vox(spark, sf_dir, "N"))
    best = n.groupBy("case_id", "comp_id").agg(F.min_by(F.struct("cls", "n"), F.struct(-F.col("n"), "cls")).alias("b"))
    return best.select("case_id", "comp_id", "b.cls", "b.n")


@query(comp_sql(f"SELECT c.case_id, c.comp_id, CAST(floor(round((v.i-c.i)*0.4/0.8,6)) AS INT) AS a, CAST(floor(round((v.j-c.j)*0.4/0.8,6)) AS INT) AS b, CAST(floor(round((v.k-c.k)*0.6/0.8,6)) AS INT) AS c, round(avg(v.value),6) AS v FROM (SELECT case_id, comp_id, CAST(round(avg(i)) AS INT) AS i, CAST(round(avg(j)) AS INT) AS j, CAST(round(avg(k)) AS INT) AS k FROM comp GROUP BY 1,2 HAVING count(*) >= 5) c JOIN ({{inten}}) v ON v.case_id=c.case_id WHERE abs(v.i-c.i)*0.4 <= 1.2 AND abs(v.j-c.j)*0.4 <= 1.2 AND abs(v.k-c.k)*0.6 <= 1.2 GROUP BY 1,2,3,4,5".replace("{inten}", __import__("voxtab.sources.fixtures", fromlist=["SQL"]).SQL["inten"])))
def crop_windows(spark, sf_dir):
    c = comps(spark, sf_dir)
    large = c.groupBy("case_id", "comp_id").agg(F.count("*").alias("n")).where("n >= 5")
    return rounded(L.crop_windows(c.join(large, ["case_id", "comp_id"], "left_semi"), intensity(spark, sf_dir), 1.2, SPACING, 0.8))


@query(comp_sql("SELECT case_id, comp_id, i, j, k FROM (SELECT *, row_number() OVER (PARTITION BY case_id, comp_id ORDER BY round(((i-ci)*0.4)*((i-ci)*0.4)+((j-cj)*0.4)*((j-cj)*0.4)+((k-ck)*0.6)*((k-ck)*0.6), 9), i, j, k) AS r FROM (SELECT *, avg(i) OVER w AS ci, avg(j) OVER w AS cj, avg(k) OVER w AS ck, count(*) OVER w AS n FROM comp WINDOW w AS (PARTITION BY case_id, comp_id))) WHERE r <= ceil(round(n * 0.35, 9))"))
def emit_topk_voxels(spark, sf_dir):
    return L.pick_nearest_voxels(comps(spark, sf_dir), SPACING, 0.35)


@query(with_tables("SELECT case_id, pred_comp, round(np * 1.0 / ng, 6) AS ratio FROM (SELECT p.case_id, p.comp_id AS pred_comp, arg_min(g.comp_id, struct_pack(a := -g.shared, b := g.comp_id)) AS gt_comp FROM (SELECT DISTINCT case_id, comp_id FROM comp) p JOIN (SELECT p.case_id, p.comp_id AS pc, g.comp_id, count(*) AS shared FROM comp p JOIN compn g USING (case_id,i,j,k) GROUP BY 1,2,3) g ON g.case_id=p.case_id AND g.pc=p.comp_id GROUP BY 1,2) m JOIN (SELECT case_id, comp_id AS pred_comp, count(*) AS np FROM comp GROUP BY 1,2) USING (case_id, pred_comp) JOIN (SELECT case_id, comp_id AS gt_comp, count(*) AS ng FROM compn GROUP BY 1,2) USING (case_id, gt_comp)", "vox", recursive=True, **comp_tables("R", 26), **comp_tables("N", 26, "compn")))
def volume_ratio(spark, sf_dir):
    p, g = comps(spark, sf_dir, "R"), comps(spark, sf_dir, "N")
    size = lambda c, n, m: c.groupBy("case_id", F.col("comp_id").alias(n)).agg(F.count("*").alias(m))
    met = p.select("case_id", *AXES, F.col("comp_id").alias("pred_comp")).join(g.select("case_id", *AXES, F.col("comp_id").alias("gt_comp")), ["case_id", *AXES]).groupBy("case_id", "pred_comp", "gt_comp").agg(F.count("*").alias("s"))
    best = met.groupBy("case_id", "pred_comp").agg(F.min_by("gt_comp", F.struct(-F.col("s"), "gt_comp")).alias("gt_comp"))
    return rounded(best.join(size(p, "pred_comp", "np"), ["case_id", "pred_comp"]).join(size(g, "gt_comp", "ng"), ["case_id", "gt_comp"]).select("case_id", "pred_comp", (F.col("np") / F.col("ng")).alias("ratio")))


@query(sql("SELECT count(*) FILTER (a.cls IS NULL) AS added, count(*) FILTER (b.cls IS NULL) AS missing, count(*) FILTER (a.cls <> b.cls) AS changed, count(*) FILTER (a.cls = b.cls) AS equal FROM (SELECT * FROM vox WHERE layer='R') a FULL JOIN (SELECT * FROM vox WHERE layer='A') b USING (case_id,i,j,k)"))
def compare_runs(spark, sf_dir):
    a, b = vox(spark, sf_dir, "R").withColumnRenamed("cls", "a"), vox(spark, sf_dir, "A").withColumnRenamed("cls", "b")
    x = a.drop("layer").join(b.drop("layer"), ["case_id", *AXES], "full_outer")
    return x.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a") == F.col("b")).alias("equal"))


@query(sql("SELECT case_id, round(2*tp*ts/(tp+ts), 6) AS cldice FROM (SELECT case_id, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) FILTER (layer='R') AS tp, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) FILTER (layer='N') AS ts FROM (SELECT v.case_id, v.layer, o.case_id IS NOT NULL AS hit FROM vox v LEFT JOIN (SELECT * FROM vox WHERE layer IN ('R','N')) o ON o.case_id=v.case_id AND o.i=v.i AND o.j=v.j AND o.k=v.k AND o.layer <> v.layer WHERE v.layer IN ('R','N') AND v.i % 2 = 0) GROUP BY 1) WHERE tp + ts > 0"))
def cldice(spark, sf_dir):
    v = vox(spark, sf_dir).where("layer in ('R', 'N')")
    other = v.select("case_id", *AXES, F.when(F.col("layer") == "R", "N").otherwise("R").alias("layer"), F.lit(1.0).alias("hit"))
    x = v.where("i % 2 = 0").join(other, ["case_id", *AXES, "layer"], "left").fillna(0.0, ["hit"])
    of = lambda n: F.avg(F.when(F.col("layer") == n, F.col("hit")))
    t = x.groupBy("case_id").agg(of("R").alias("tp"), of("N").alias("ts")).where("tp + ts > 0")
    return rounded(t.select("case_id", (2 * F.col("tp") * F.col("ts") / (F.col("tp") + F.col("ts"))).alias("cldice")))


@query(sql("SELECT cls, part, round(2*sum(n_both)/sum(n_gt+n_pred), 6) AS dice FROM (SELECT cls, CASE WHEN case_id % 3 = 0 THEN 'held out' ELSE 'in sample' END AS part, (g=cls AND p=cls)::INT AS n_both, (g=cls)::INT AS n_gt, (p=cls)::INT AS n_pred FROM (SELECT case_id, coalesce(g.cls,-1) AS g, coalesce(p.cls,-1) AS p FROM (SELECT * FROM vox WHERE layer='N') g FULL JOIN (SELECT * FROM vox WHERE layer='A') p USING (case_id,i,j,k)), (SELECT CAST(c AS INT) AS cls FROM range(1,8) t(c))) GROUP BY 1,2 HAVING sum(n_gt+n_pred) > 0"))
def insample_gap(spark, sf_dir):
    from voxtab.operators.scoring import overlap_counts

    part = F.when(F.col("case_id") % 3 == 0, "held out").otherwise("in sample")
    n = overlap_counts(vox(spark, sf_dir, "N"), vox(spark, sf_dir, "A")).groupBy("cls", part.alias("part"))
    return rounded(n.agg((2 * F.sum("n_both") / F.sum(F.col("n_gt") + F.col("n_pred"))).alias("dice")))


# ---- channels ----

NEAR_A = {"q": "SELECT case_id, i, j, k FROM vox WHERE layer='N'", "v": "SELECT * FROM vox WHERE layer='A'", "n": near_sql(f"{dist_sql('q', 'v')} <= 1.3")}


@query(sql("SELECT case_id, i, j, k FROM n WHERE d <= 1.0 AND cls NOT IN (2, 5)", **NEAR_A))
def mask_by_distance(spark, sf_dir):
    x = nearest(vox(spark, sf_dir, "N").select("case_id", *AXES), vox(spark, sf_dir, "A"), 1.3, SPACING)
    return x.where("d <= 1.0 and nearest_cls not in (2, 5)").select("case_id", *AXES)


@query(sql("SELECT q.case_id, q.i, q.j, q.k, round(coalesce(exp(-d/0.8), 0), 6) AS proximity, round(coalesce(cls/5.0, 0), 6) AS territory, CASE WHEN cls % 2 = 0 THEN 1 WHEN cls % 2 = 1 THEN -1 ELSE 0 END AS side FROM q LEFT JOIN n USING (case_id, i, j, k)", **(NEAR_A | {"n": near_sql("true")})))
def derived_channels(spark, sf_dir):
    x = nearest_always(vox(spark, sf_dir, "N").select("case_id", *AXES), vox(spark, sf_dir, "A"), 1.3, SPACING)
    side = F.when(F.col("nearest_cls") % 2 == 0, 1).when(F.col("nearest_cls") % 2 == 1, -1).otherwise(0)
    return rounded(x.select("case_id", *AXES, F.coalesce(F.exp(-F.col("d") / 0.8), F.lit(0.0)).alias("proximity"), F.coalesce(F.col("nearest_cls") / 5.0, F.lit(0.0)).alias("territory"), side.alias("side")))


@query(with_tables("SELECT a.case_id, a.i, a.j, a.k, round(a.v - b.v, 6) AS diff FROM m a JOIN m b ON a.case_id=b.case_id AND a.j=b.j AND a.k=b.k AND b.i = 51 - a.i", "inten", m="SELECT case_id, i, j, k, avg(value) AS v FROM inten GROUP BY 1,2,3,4"))
def symmetry_diff(spark, sf_dir):
    m = intensity(spark, sf_dir).groupBy("case_id", *AXES).agg(F.avg("value").alias("v"))
    other = m.select("case_id", (51 - F.col("i")).alias("i"), "j", "k", F.col("v").alias("o"))
    return rounded(m.join(other, ["case_id", *AXES]).select("case_id", *AXES, (F.col("v") - F.col("o")).alias("diff")))


# ---- graphs ----

LINE = f"SELECT case_id, i, j, k, cls, {ID} AS id FROM vox WHERE layer='A' AND (i + j) % 3 = 0"
EDGE = f"SELECT a.case_id, a.id AS u, b.id AS v, {dist_sql('a', 'b')} AS w, a.cls AS cu, b.cls AS cv FROM line a JOIN line b ON a.case_id=b.case_id AND a.id<>b.id AND abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1"


def line(spark, sf_dir):
    return vox(spark, sf_dir, "A").where("(i + j) % 3 = 0")


@query(sql("SELECT l.case_id, l.id AS u, count(e.v) AS degree, count(e.v) = 1 AS endpoint FROM line l LEFT JOIN edge e ON e.case_id=l.case_id AND e.u=l.id GROUP BY 1,2", line=LINE, edge=EDGE))
def graph_degree(spark, sf_dir):
    x = line(spark, sf_dir)
    return G.degrees(x, G.skeleton_edges(x, SPACING)).withColumn("endpoint", F.col("degree") == 1)


@query(sql("SELECT cu AS a, cv AS b, count(*) AS n, round(avg(w),6) AS w FROM edge WHERE cu < cv GROUP BY 1,2", line=LINE, edge=EDGE))
def class_transitions(spark, sf_dir):
    x = line(spark, sf_dir)
    cls = x.select("case_id", voxel_key().alias("u"), "cls")
    e = G.skeleton_edges(x, SPACING).join(cls.withColumnRenamed("cls", "a"), ["case_id", "u"]).join(cls.select("case_id", F.col("u").alias("v"), F.col("cls").alias("b")), ["case_id", "v"])
    return rounded(e.where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg("w").alias("w")))


@query(with_tables("SELECT case_id, u, round(d, 6) AS dist FROM g", "vox", recursive=True, **VESSEL, **ways_sql("g", "SELECT case_id, id AS u FROM line WHERE cls = 1", ["case_id"])))
def geodesic(spark, sf_dir):
    """GRA5: on the whole vessel graph, however long the way."""
    x = stored(vox(spark, sf_dir, "A").select("case_id", *AXES, "cls"))
    return rounded(G.geodesic(stored(G.skeleton_edges(x, SPACING)), x.where("cls = 1").select("case_id", voxel_key().alias("u"))))


@query(with_tables(f"SELECT c.case_id, c.comp_id, list_sort(list_distinct(list(v.cls))) AS class_ids, count(DISTINCT {ID.replace('i*', 'c.i*').replace('j*', 'c.j*').replace('+ k', '+ c.k')}) AS n_transition_vox FROM comp c JOIN line v ON v.case_id=c.case_id AND abs(v.i-c.i)<=1 AND abs(v.j-c.j)<=1 AND abs(v.k-c.k)<=1 GROUP BY 1,2", "vox", recursive=True, line=LINE, edge=EDGE, **comp_tables("SELECT l.* FROM line l WHERE EXISTS (SELECT 1 FROM edge e WHERE e.case_id=l.case_id AND e.u=l.id AND e.cu<>e.cv)", 26)))
def junction_nodes(spark, sf_dir):
    from voxtab.operators.space import shifted

    x = line(spark, sf_dir).select("case_id", *AXES, "cls")
    other = x.select("case_id", *AXES, F.col("cls").alias("o"))
    edge = shifted(x, [o for o in box_offsets(1) if o != (0, 0, 0)])
    near = edge.join(other, ["case_id", *AXES]).where("cls <> o").select("case_id", *AXES).distinct()
    comp = C.components(x.join(near, ["case_id", *AXES], "left_semi"))
    around = shifted(comp.select("case_id", "comp_id", *AXES), box_offsets(1)).distinct().join(x, ["case_id", *AXES])
    classes = around.groupBy("case_id", "comp_id").agg(F.sort_array(F.collect_set("cls")).alias("class_ids"))
    return classes.join(comp.groupBy("case_id", "comp_id").agg(F.count("*").alias("n_transition_vox")), ["case_id", "comp_id"])
