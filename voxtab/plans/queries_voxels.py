"""Queries over voxel and intensity tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.operators import components as C
from voxtab.operators import intensity as N
from voxtab.operators import morphology as M
from voxtab.operators import scoring as S
from voxtab.operators.space import AXES, ball_offsets, box_offsets, cross_offsets, nearest, range_join
from voxtab.plans.lineage import by_shuffle
from voxtab.plans.registry import query, rounded
from voxtab.plans.totals import quantiles
from voxtab.sources.fixtures import SPACING, intensity, table, vox, with_tables

SI, SJ, SK = SPACING
ID = "i*4398046511104 + j*2097152 + k"


def sql(body: str, **more: str) -> str:
    return with_tables(body, "vox", **more)


def comp_tables(layer: str, connectivity: int, name: str = "comp", per_class: bool = False) -> dict[str, str]:
    """DuckDB tables that end in <name>(case_id, i, j, k, cls, comp_id) by a recursive closure."""
    near = "abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1" if connectivity == 26 else "abs(a.i-b.i)+abs(a.j-b.j)+abs(a.k-b.k)=1"
    same = " AND a.cls=b.cls" if per_class else ""
    source = layer if " " in layer else f"SELECT * FROM vox WHERE layer='{layer}'"
    return {
        f"v_{name}": f"SELECT case_id, {ID} AS id, i, j, k, cls FROM ({source})",
        f"e_{name}": f"SELECT a.case_id, a.id AS u, b.id AS w FROM v_{name} a JOIN v_{name} b ON a.case_id=b.case_id AND a.id<>b.id AND {near}{same}",
        f"r_{name}": f"SELECT case_id, id AS u, id AS root FROM v_{name} UNION SELECT r.case_id, e.w, r.root FROM r_{name} r JOIN e_{name} e ON r.case_id=e.case_id AND r.u=e.u",
        name: f"SELECT v.case_id, v.i, v.j, v.k, v.cls, m.comp_id FROM v_{name} v JOIN (SELECT case_id, u, min(root) AS comp_id FROM r_{name} GROUP BY 1,2) m ON v.case_id=m.case_id AND v.id=m.u",
    }


def comp_sql(body: str, layer: str = "R", connectivity: int = 26, per_class: bool = False, extra: dict | None = None) -> str:
    return with_tables(body, "vox", recursive=True, **comp_tables(layer, connectivity, per_class=per_class), **(extra or {}))


def comps(spark, sf_dir, layer="R", connectivity=26, per_class=False):
    v = vox(spark, sf_dir, layer).drop("layer")
    return C.components(v, connectivity, ("case_id", "cls") if per_class else ("case_id",))


def dist_sql(a: str, b: str) -> str:
    return f"sqrt((({a}.i-{b}.i)*{SI})*(({a}.i-{b}.i)*{SI}) + (({a}.j-{b}.j)*{SJ})*(({a}.j-{b}.j)*{SJ}) + (({a}.k-{b}.k)*{SK})*(({a}.k-{b}.k)*{SK}))::DOUBLE"


# ---- sources ----


@query(sql("SELECT case_id, layer, count(*) AS n, count(DISTINCT cls) AS classes FROM vox GROUP BY 1, 2"))
def scan_voxels(spark, sf_dir):
    return vox(spark, sf_dir).groupBy("case_id", "layer").agg(F.count("*").alias("n"), F.countDistinct("cls").alias("classes"))


@query("SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#', 1) AS modality, CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS number, CASE WHEN CAST(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) % 2 = 0 THEN 'CT' ELSE 'MR' END AS center FROM customer")
def parse_case_id(spark, sf_dir):
    number = F.regexp_extract("c_name", "#0*([0-9]+)$", 1).cast("bigint")
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract("c_name", "^([A-Za-z]+)#", 1).alias("modality"), number.alias("number"), F.when(number % 2 == 0, "CT").otherwise("MR").alias("center"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing FROM events")
def json_props(spark, sf_dir):
    parsed = F.from_json("props", "k INT, missing DOUBLE")
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("x")).select("event_id", "x.k", "x.missing")


@query(with_tables("SELECT split, count(*) AS n, min(case_id) AS first_case FROM (SELECT case_id, coalesce(CASE WHEN patient_id % 10 = 0 THEN 'test' END, CASE WHEN patient_id % 10 = 1 THEN 'val' END, 'train') AS split FROM folds) GROUP BY 1", "folds"))
def load_split(spark, sf_dir):
    from voxtab.sources.fixtures import folds

    p = F.col("patient_id") % 10
    split = F.coalesce(F.when(p == 0, "test"), F.when(p == 1, "val"), F.lit("train"))
    return folds(spark, sf_dir).select("case_id", split.alias("split")).groupBy("split").agg(F.count("*").alias("n"), F.min("case_id").alias("first_case"))


@query("SELECT s_suppkey AS case_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_discount < 0.02)")
def negative_cases(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 45 and l_discount < 0.02").select(F.col("l_suppkey").alias("case_id"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id")).join(found, "case_id", "left_anti")


@query(sql("SELECT case_id, i, j, k, arg_max(CASE layer WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 3 END, CASE layer WHEN 'R' THEN 3 WHEN 'N' THEN 2 ELSE 1 END) AS cls3 FROM vox GROUP BY 1,2,3,4"))
def compose_mask(spark, sf_dir):
    v = vox(spark, sf_dir)
    value = F.when(F.col("layer") == "R", 2).when(F.col("layer") == "A", 1).otherwise(3)
    paint = F.when(F.col("layer") == "R", 3).when(F.col("layer") == "N", 2).otherwise(1)
    return v.groupBy("case_id", *AXES).agg(F.max_by(value, paint).alias("cls3"))


@query(sql("SELECT case_id, cls, CAST(dense_rank() OVER (ORDER BY cls) AS INT) AS dense FROM (SELECT DISTINCT case_id, cls FROM vox WHERE layer='A' AND cls <> 3)"))
def remap_dense(spark, sf_dir):
    v = vox(spark, sf_dir, "A").where("cls <> 3").select("case_id", "cls").distinct()
    # The class table is as small as the taxonomy; only it is ranked in one task, and it is broadcast.
    ids = v.select("cls").distinct().withColumn("dense", F.dense_rank().over(W.orderBy("cls")))
    return v.join(F.broadcast(ids), "cls").select("case_id", "cls", "dense")


@query(sql("SELECT CASE WHEN cls <= 2 THEN 'anterior' WHEN cls <= 4 THEN 'middle' ELSE 'posterior' END AS region, layer, count(*) AS n FROM vox GROUP BY 1, 2"))
def region_of(spark, sf_dir):
    region = F.when(F.col("cls") <= 2, "anterior").when(F.col("cls") <= 4, "middle").otherwise("posterior")
    return vox(spark, sf_dir).groupBy(region.alias("region"), "layer").agg(F.count("*").alias("n"))


@query(sql("SELECT case_id, i, j, k, count(*) AS n, count(*) > 1 AS clash FROM (SELECT * FROM vox WHERE layer='R' UNION ALL SELECT * FROM vox WHERE layer='N') GROUP BY 1,2,3,4"))
def combine_sets(spark, sf_dir):
    both = vox(spark, sf_dir, "R").unionByName(vox(spark, sf_dir, "N"))
    return both.groupBy("case_id", *AXES).agg(F.count("*").alias("n"), (F.count("*") > 1).alias("clash"))


@query(sql("SELECT case_id, layer, i, j, k, cls FROM vox WHERE layer = 'N'"))
def write_labels(spark, sf_dir):
    from voxtab.plans.lineage import materialize

    return materialize(vox(spark, sf_dir, "N"))


@query(sql("SELECT s.s_suppkey AS case_id, l.layer, CASE WHEN v.n IS NULL THEN 'missing' ELSE 'too few' END AS reason FROM supplier s CROSS JOIN (VALUES ('A'),('N'),('R')) l(layer) LEFT JOIN (SELECT case_id, layer, count(*) AS n FROM vox GROUP BY 1,2) v ON v.case_id = s.s_suppkey AND v.layer = l.layer WHERE coalesce(v.n, 0) < 200"))
def preflight(spark, sf_dir):
    want = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.explode(F.array(*[F.lit(x) for x in "ANR"])).alias("layer"))
    n = vox(spark, sf_dir).groupBy("case_id", "layer").agg(F.count("*").alias("n"))
    lacking = want.join(n, ["case_id", "layer"], "left").where(F.coalesce("n", F.lit(0)) < 200)
    return lacking.select("case_id", "layer", F.when(F.col("n").isNull(), "missing").otherwise("too few").alias("reason"))


# ---- joins and predicates ----


@query(sql("SELECT a.case_id, a.cls AS cls_a, b.cls AS cls_b, count(*) AS n FROM vox a JOIN vox b USING (case_id, i, j, k) WHERE a.layer='R' AND b.layer='N' GROUP BY 1,2,3"))
def overlap_counts(spark, sf_dir):
    a, b = vox(spark, sf_dir, "R").withColumnRenamed("cls", "cls_a"), vox(spark, sf_dir, "N").withColumnRenamed("cls", "cls_b")
    return a.join(b, ["case_id", *AXES]).groupBy("case_id", "cls_a", "cls_b").agg(F.count("*").alias("n"))


@query(comp_sql("SELECT case_id, comp_id, count(*) AS n FROM comp c WHERE NOT EXISTS (SELECT 1 FROM comp d JOIN vox v USING (case_id,i,j,k) WHERE v.layer='N' AND d.case_id=c.case_id AND d.comp_id=c.comp_id) GROUP BY 1,2"))
def keep_components(spark, sf_dir):
    c = comps(spark, sf_dir)
    hit = c.join(vox(spark, sf_dir, "N").select("case_id", *AXES), ["case_id", *AXES], "left_semi").select("case_id", "comp_id").distinct()
    return c.join(hit, ["case_id", "comp_id"], "left_anti").groupBy("case_id", "comp_id").agg(F.count("*").alias("n"))


@query(comp_sql("SELECT DISTINCT g.case_id, g.comp_id FROM comp g JOIN vox v USING (case_id,i,j,k) WHERE v.layer='R'", layer="N"))
def covered_gt(spark, sf_dir):
    return comps(spark, sf_dir, "N").join(vox(spark, sf_dir, "R").select("case_id", *AXES), ["case_id", *AXES], "left_semi").select("case_id", "comp_id").distinct()


@query(comp_sql(f"SELECT c.case_id, c.comp_id, v.cls, round(min({dist_sql('c', 'v')}), 6) AS dist FROM (SELECT c.* FROM comp c JOIN (SELECT case_id, comp_id FROM comp GROUP BY 1,2 HAVING count(*) >= 4) b USING (case_id, comp_id)) c JOIN vox v ON v.case_id=c.case_id AND v.layer='A' AND abs(c.i-v.i) <= 3 AND abs(c.j-v.j) <= 3 AND abs(c.k-v.k) <= 3 WHERE {dist_sql('c', 'v')} <= 1.2 AND NOT EXISTS (SELECT 1 FROM comp o WHERE o.case_id=c.case_id AND o.comp_id=c.comp_id AND o.i=v.i AND o.j=v.j AND o.k=v.k) GROUP BY 1,2,3"))
def dist_to_class(spark, sf_dir):
    c = comps(spark, sf_dir)
    large = c.groupBy("case_id", "comp_id").agg(F.count("*").alias("n")).where("n >= 4")
    c = c.join(large, ["case_id", "comp_id"], "left_semi").select("case_id", "comp_id", *AXES)
    pairs = range_join(c, vox(spark, sf_dir, "A").select("case_id", *AXES, "cls"), 1.2, SPACING)
    own = c.select("case_id", F.col("comp_id").alias("l_comp_id"), *[F.col(a).alias("r_" + a) for a in AXES])
    outside = pairs.join(by_shuffle(own), ["case_id", "l_comp_id", *["r_" + a for a in AXES]], "left_anti")
    return rounded(outside.groupBy("case_id", F.col("l_comp_id").alias("comp_id"), F.col("r_cls").alias("cls")).agg(F.min("d").alias("dist")))


@query(sql(f"SELECT DISTINCT a.case_id, a.i, a.j, a.k FROM vox a JOIN vox b ON a.case_id=b.case_id AND abs(a.i-b.i)<=2 AND abs(a.j-b.j)<=2 AND abs(a.k-b.k)<=1 WHERE a.layer='R' AND b.layer='A' AND {dist_sql('a', 'b')} <= 0.8000001"))
def within_distance(spark, sf_dir):
    reach = M.dilate(vox(spark, sf_dir, "A"), ball_offsets(0.8, SPACING))
    return vox(spark, sf_dir, "R").select("case_id", *AXES).join(reach, ["case_id", *AXES], "left_semi")


@query(sql(f"SELECT n.case_id, n.i, n.j, n.k, list_sort(list_distinct(list(v.cls))) AS classes FROM vox n JOIN vox v ON n.case_id=v.case_id AND abs(n.i-v.i)<=3 AND abs(n.j-v.j)<=3 AND abs(n.k-v.k)<=2 WHERE n.layer='N' AND n.cls=1 AND v.layer='A' AND {dist_sql('n', 'v')} <= 1.2000001 GROUP BY 1,2,3,4"))
def classes_in_ball(spark, sf_dir):
    n = vox(spark, sf_dir, "N").where("cls = 1").select("case_id", *AXES)
    pairs = range_join(n, vox(spark, sf_dir, "A").select("case_id", *AXES, "cls"), 1.2000001, SPACING)
    return pairs.groupBy("case_id", *[F.col("l_" + a).alias(a) for a in AXES]).agg(F.sort_array(F.collect_set("r_cls")).alias("classes"))


@query(comp_sql(f"SELECT a.case_id, a.comp_id AS comp_a, b.comp_id AS comp_b, round(min({dist_sql('a', 'b')}), 6) AS gap FROM comp a JOIN comp b ON a.case_id=b.case_id AND a.comp_id < b.comp_id AND abs(a.i-b.i)<=2 AND abs(a.j-b.j)<=2 AND abs(a.k-b.k)<=1 WHERE {dist_sql('a', 'b')} <= 0.9 GROUP BY 1,2,3"))
def endpoint_pairs(spark, sf_dir):
    c = comps(spark, sf_dir).select("case_id", *AXES, "comp_id")
    pairs = range_join(c, c, 0.9, SPACING).where("l_comp_id < r_comp_id")
    return rounded(pairs.groupBy("case_id", F.col("l_comp_id").alias("comp_a"), F.col("r_comp_id").alias("comp_b")).agg(F.min("d").alias("gap")))


@query(with_tables(
    "SELECT g.case_id, g.comp_id AS gt_comp, p.comp_id AS pred_comp, count(*) AS shared FROM compn g JOIN comp p USING (case_id,i,j,k) GROUP BY 1,2,3",
    "vox", recursive=True, **comp_tables("R", 26), **comp_tables("N", 26, "compn")))
def hit_matrix(spark, sf_dir):
    g, p = (comps(spark, sf_dir, x).select("case_id", *AXES, F.col("comp_id").alias(n)) for x, n in (("N", "gt_comp"), ("R", "pred_comp")))
    return g.join(p, ["case_id", *AXES]).groupBy("case_id", "gt_comp", "pred_comp").agg(F.count("*").alias("shared"))


@query(comp_sql("SELECT case_id, comp_id, cls AS truth, n FROM (SELECT c.case_id, c.comp_id, v.cls, count(*) AS n, row_number() OVER (PARTITION BY c.case_id, c.comp_id ORDER BY count(*) DESC, v.cls) AS r FROM comp c JOIN vox v USING (case_id,i,j,k) WHERE v.layer='N' GROUP BY 1,2,3) WHERE r = 1"))
def assign_truth(spark, sf_dir):
    c = comps(spark, sf_dir).select("case_id", "comp_id", *AXES)
    n = c.join(vox(spark, sf_dir, "N"), ["case_id", *AXES]).groupBy("case_id", "comp_id", F.col("cls").alias("truth")).agg(F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy("case_id", "comp_id").orderBy(F.desc("n"), "truth"))
    return n.withColumn("r", r).where("r = 1").drop("r")


@query(sql("SELECT case_id, i, j, k, CASE WHEN o.cls IS NULL THEN 'added' WHEN n.cls IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT * FROM vox WHERE layer='R') o FULL JOIN (SELECT * FROM vox WHERE layer='N') n USING (case_id, i, j, k) WHERE o.cls IS DISTINCT FROM n.cls"))
def diff_snapshots(spark, sf_dir):
    old, new = vox(spark, sf_dir, "R").withColumnRenamed("cls", "o").drop("layer"), vox(spark, sf_dir, "N").withColumnRenamed("cls", "n").drop("layer")
    both = old.join(new, ["case_id", *AXES], "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    return both.select("case_id", *AXES, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed").alias("change"))


@query(comp_sql("SELECT DISTINCT case_id, i, j, k FROM (SELECT a.case_id, a.i, a.j, a.k FROM compn a WHERE EXISTS (SELECT 1 FROM compn x JOIN comp d USING (case_id,i,j,k) WHERE x.case_id=a.case_id AND x.comp_id=a.comp_id) UNION ALL SELECT d.case_id, d.i, d.j, d.k FROM comp d WHERE NOT EXISTS (SELECT 1 FROM comp y JOIN compn n USING (case_id,i,j,k) WHERE y.case_id=d.case_id AND y.comp_id=d.comp_id))", extra=comp_tables("N", 26, "compn")))
def replace_boundary(spark, sf_dir):
    det, alt = comps(spark, sf_dir, "R"), comps(spark, sf_dir, "N")
    key = ["case_id", *AXES]
    met = det.select(*key, F.col("comp_id").alias("d")).join(alt.select(*key, F.col("comp_id").alias("a")), key).select("case_id", "d", "a")
    taken = alt.join(met.select("case_id", F.col("a").alias("comp_id")).distinct(), ["case_id", "comp_id"], "left_semi").select(*key)
    left = det.join(met.select("case_id", F.col("d").alias("comp_id")).distinct(), ["case_id", "comp_id"], "left_anti").select(*key)
    return taken.unionByName(left).distinct()


# ---- components ----


@query(comp_sql("SELECT case_id, i, j, k, comp_id FROM comp"))
def components26(spark, sf_dir):
    return comps(spark, sf_dir).select("case_id", *AXES, "comp_id")


@query(comp_sql("SELECT case_id, i, j, k, comp_id FROM comp", connectivity=6))
def components6(spark, sf_dir):
    return comps(spark, sf_dir, connectivity=6).select("case_id", *AXES, "comp_id")


VOL = "count(*)*(0.4*0.4*0.6)::DOUBLE"


@query(comp_sql(f"SELECT case_id, comp_id, count(*) AS n_vox, round(avg(i),6) AS ci, round(avg(j),6) AS cj, round(avg(k),6) AS ck, min(i) AS min_i, min(j) AS min_j, min(k) AS min_k, max(i) AS max_i, max(j) AS max_j, max(k) AS max_k, round({VOL},6) AS vol_mm3, round(2*pow({VOL}*(3/(4*pi())), 1/3.0),6) AS diameter_mm, round(log10({VOL}),6) AS log_vol FROM comp GROUP BY 1,2"))
def component_stats(spark, sf_dir):
    return rounded(C.component_stats(comps(spark, sf_dir), SPACING))


@query(comp_sql(f"SELECT DISTINCT c.case_id, c.comp_id FROM comp c JOIN (SELECT case_id, comp_id FROM comp GROUP BY 1,2 HAVING count(*) >= 3) b USING (case_id, comp_id) JOIN vox v ON v.case_id=c.case_id AND v.layer='A' WHERE abs(c.i-v.i)<=2 AND abs(c.j-v.j)<=2 AND abs(c.k-v.k)<=1 AND {dist_sql('c', 'v')} <= 0.8000001"))
def detect_filter(spark, sf_dir):
    kept = C.filter_components(comps(spark, sf_dir), vox(spark, sf_dir, "A"), 3, 0.8, SPACING)
    return kept.select("case_id", "comp_id").distinct()


@query(comp_sql(f"SELECT c.case_id, c.comp_id, round(min({dist_sql('c', 'v')}),6) AS dist FROM comp c JOIN vox v ON v.case_id=c.case_id AND v.layer='A' WHERE abs(c.i-v.i)<=3 AND abs(c.j-v.j)<=3 AND abs(c.k-v.k)<=2 AND {dist_sql('c', 'v')} <= 1.3 GROUP BY 1,2"))
def comp_mask_distance(spark, sf_dir):
    return rounded(C.mask_distance(comps(spark, sf_dir), vox(spark, sf_dir, "A"), 1.3, SPACING))


@query(comp_sql("SELECT case_id, cls, comp_id, n_vox FROM (SELECT case_id, cls, comp_id, count(*) AS n_vox, row_number() OVER (PARTITION BY case_id, cls ORDER BY count(*) DESC, comp_id) AS r FROM comp GROUP BY 1,2,3) WHERE r=1", layer="A", per_class=True))
def largest_component(spark, sf_dir):
    return C.largest_component(comps(spark, sf_dir, "A", per_class=True), ("case_id", "cls"))


LEARN = "SELECT cls, quantile_cont(n, 0.05) AS min_cc_vox FROM (SELECT case_id, cls, comp_id, count(*) AS n FROM comp GROUP BY 1,2,3) GROUP BY 1"


@query(comp_sql("SELECT case_id, cls, comp_id, n_vox FROM (SELECT *, max(ok::INT) OVER (PARTITION BY case_id, cls) AS anyok, row_number() OVER (PARTITION BY case_id, cls ORDER BY n_vox DESC, comp_id) AS r FROM (SELECT s.*, n_vox >= greatest(2, least(l.min_cc_vox, 0.05 * max(n_vox) OVER (PARTITION BY case_id, s.cls))) AS ok FROM (SELECT case_id, cls, comp_id, count(*) AS n_vox FROM comp GROUP BY 1,2,3) s JOIN learned l USING (cls))) WHERE ok OR (anyok = 0 AND r = 1)", layer="A", per_class=True, extra={"learned": LEARN}))
def prune_small(spark, sf_dir):
    c = comps(spark, sf_dir, "A", per_class=True)
    sizes = c.groupBy("case_id", "cls", "comp_id").agg(F.count("*").alias("n"))
    learned = sizes.groupBy("cls").agg(F.percentile("n", F.lit(0.05)).alias("min_cc_vox"))
    return C.prune_small(c, learned, floor_vox=2)


CONTACT = "SELECT a.cls, b.cls AS other, count(*) AS n FROM comp a JOIN comp b ON a.case_id=b.case_id AND a.cls<>b.cls AND abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1 GROUP BY 1,2"


@query(comp_sql("SELECT s.cls, round(greatest(5, quantile_cont(s.n, 0.05)),6) AS min_cc_vox, round(median(s.n),6) AS median_cc_vox, any_value(t.neighbors) AS neighbors FROM (SELECT case_id, cls, comp_id, count(*) AS n FROM comp GROUP BY 1,2,3) s LEFT JOIN (SELECT cls, list_sort(list(other)) AS neighbors FROM (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY cls) AS share FROM contact) WHERE share >= 0.15 GROUP BY 1) t USING (cls) GROUP BY 1", layer="A", per_class=True, extra={"contact": CONTACT}))
def fit_params(spark, sf_dir):
    c = comps(spark, sf_dir, "A", per_class=True)
    n = c.groupBy("case_id", "cls", "comp_id").agg(F.count("*").alias("n")).groupBy("cls")
    sizes = n.agg(F.greatest(F.lit(5.0), F.percentile("n", F.lit(0.05))).alias("min_cc_vox"), F.percentile("n", F.lit(0.5)).alias("median_cc_vox"))
    met = C.touching(c).groupBy("cls", "other_cls").agg(F.sum("contacts").alias("n"))
    near = met.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cls"))).where("share >= 0.15")
    near = near.groupBy("cls").agg(F.sort_array(F.collect_list("other_cls")).alias("neighbors"))
    return rounded(sizes.join(near, "cls", "left"))


@query(comp_sql("SELECT DISTINCT case_id, cls, comp_id FROM comp c WHERE NOT (EXISTS (SELECT 1 FROM met m WHERE m.case_id=c.case_id AND m.comp_id=c.comp_id AND m.cls=c.cls) AND NOT EXISTS (SELECT 1 FROM met m WHERE m.case_id=c.case_id AND m.comp_id=c.comp_id AND m.cls=c.cls AND abs(m.cls-m.other)=1) AND NOT EXISTS (SELECT 1 FROM top t WHERE t.case_id=c.case_id AND t.cls=c.cls AND t.comp_id=c.comp_id))", layer="A", per_class=True, extra={
    "met": "SELECT DISTINCT a.case_id, a.comp_id, a.cls, b.cls AS other FROM comp a JOIN comp b ON a.case_id=b.case_id AND a.cls<>b.cls AND abs(a.i-b.i)<=1 AND abs(a.j-b.j)<=1 AND abs(a.k-b.k)<=1",
    "top": "SELECT case_id, cls, comp_id FROM (SELECT case_id, cls, comp_id, row_number() OVER (PARTITION BY case_id, cls ORDER BY count(*) DESC, comp_id) AS r FROM comp GROUP BY 1,2,3) WHERE r=1"}))
def drop_orphans(spark, sf_dir):
    c = comps(spark, sf_dir, "A", per_class=True)
    classes = F.sequence(F.lit(1), F.lit(7))
    allowed = spark.range(1).select(F.explode(classes).alias("cls")).select("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls") + 1)).alias("other_cls"))
    return C.drop_orphans(c, allowed)


@query(comp_sql("SELECT CAST(ceil((quantile_cont(max_i, 0.99)*0.4 + 2*3.0) / 32) * 32 AS BIGINT) AS window_i, round(quantile_cont(max_i*0.4::DOUBLE, 0.95),6) AS p95_i, round(quantile_cont(max_j*0.4::DOUBLE, 0.95),6) AS p95_j, round(max(max_k*0.6::DOUBLE),6) AS max_k FROM (SELECT max(i)-min(i)+1 AS max_i, max(j)-min(j)+1 AS max_j, max(k)-min(k)+1 AS max_k FROM comp GROUP BY case_id, comp_id)"))
def extent_window(spark, sf_dir):
    size = comps(spark, sf_dir).groupBy("case_id", "comp_id").agg(*[(F.max(a) - F.min(a) + 1).alias(a) for a in AXES])
    mm = {a: F.col(a) * s for a, s in zip(AXES, SPACING)}
    window = (F.ceil((F.percentile(mm["i"], F.lit(0.99)) + 2 * 3.0) / 32) * 32).cast("bigint")
    return rounded(size.agg(window.alias("window_i"), F.percentile(mm["i"], F.lit(0.95)).alias("p95_i"), F.percentile(mm["j"], F.lit(0.95)).alias("p95_j"), F.max(mm["k"]).alias("max_k")))


# ---- morphology, distance, growth, votes ----

BOX = "(SELECT x.x AS di, y.y AS dj, z.z AS dk FROM range(-1,2) x(x), range(-1,2) y(y), range(-1,2) z(z))"
CROSS = f"(SELECT * FROM {BOX} WHERE abs(di)+abs(dj)+abs(dk) <= 1)"


def dil(src: str, offs: str) -> str:
    return f"SELECT DISTINCT case_id, CAST(i+di AS INT) AS i, CAST(j+dj AS INT) AS j, CAST(k+dk AS INT) AS k FROM {src}, {offs}"


@query(sql(dil("(SELECT * FROM vox WHERE layer='R')", BOX)))
def dilate(spark, sf_dir):
    return M.dilate(vox(spark, sf_dir, "R"), box_offsets(1))


@query(sql(f"SELECT case_id, i, j, k FROM (SELECT v.case_id, v.i-o.di AS i, v.j-o.dj AS j, v.k-o.dk AS k FROM (SELECT DISTINCT case_id, i, j, k FROM vox) v, {CROSS} o) GROUP BY 1,2,3,4 HAVING count(*) = 7"))
def erode(spark, sf_dir):
    return M.erode(vox(spark, sf_dir), cross_offsets(1)).select("case_id", *[F.col(a).cast("bigint").alias(a) for a in AXES])


BALL = f"(SELECT * FROM (SELECT x.x AS di, y.y AS dj, z.z AS dk FROM range(-2,3) x(x), range(-2,3) y(y), range(-1,2) z(z)) WHERE (di*{SI})*(di*{SI})+(dj*{SJ})*(dj*{SJ})+(dk*{SK})*(dk*{SK}) <= 0.64000001)"


@query(sql(f"SELECT case_id, i, j, k FROM (SELECT case_id, i-di AS i, j-dj AS j, k-dk AS k FROM grown, {BALL} GROUP BY 1,2,3,4 HAVING count(*) = (SELECT count(*) FROM {BALL})) WHERE (case_id,i,j,k) NOT IN (SELECT case_id,i,j,k FROM vox WHERE layer='A') UNION SELECT case_id, i, j, k FROM vox WHERE layer='R'", grown=dil("(SELECT * FROM vox WHERE layer='R')", BALL)))
def close_mm(spark, sf_dir):
    out = M.close_mm(vox(spark, sf_dir, "R"), 0.8, SPACING, vox(spark, sf_dir, "A"))
    return out.select("case_id", *[F.col(a).cast("bigint").alias(a) for a in AXES])


@query(sql(f"SELECT a.case_id, a.i, a.j, a.k FROM (SELECT DISTINCT case_id, i, j, k FROM vox) a LEFT JOIN (SELECT DISTINCT case_id, i, j, k FROM vox) b ON a.case_id=b.case_id AND abs(a.i-b.i)+abs(a.j-b.j)+abs(a.k-b.k)=1 GROUP BY 1,2,3,4 HAVING count(b.i) < 6"))
def surface(spark, sf_dir):
    return M.surface(vox(spark, sf_dir))


@query(comp_sql(f"SELECT case_id, comp_id, cls, round(share,6) AS share, share >= 0.15 AS spans, round(sum(-share*ln(share)) OVER (PARTITION BY case_id, comp_id),6) AS entropy FROM (SELECT s.case_id, s.comp_id, v.cls, count(*) / sum(count(*)) OVER (PARTITION BY s.case_id, s.comp_id) AS share FROM (SELECT case_id, comp_id, i, j, k FROM (SELECT DISTINCT case_id, comp_id, i+di AS i, j+dj AS j, k+dk AS k FROM comp, {BOX}) EXCEPT SELECT case_id, comp_id, i, j, k FROM comp) s JOIN vox v ON v.layer='A' AND v.case_id=s.case_id AND v.i=s.i AND v.j=s.j AND v.k=s.k GROUP BY 1,2,3)"))
def shell_composition(spark, sf_dir):
    return rounded(M.shell_composition(comps(spark, sf_dir), vox(spark, sf_dir, "A"), box_offsets(1)))


def near_sql(reach: str) -> str:
    return f"SELECT case_id, i, j, k, d, cls FROM (SELECT q.case_id, q.i, q.j, q.k, {dist_sql('q', 'v')} AS d, v.cls, row_number() OVER (PARTITION BY q.case_id, q.i, q.j, q.k ORDER BY round({dist_sql('q', 'v')}, 9), v.i, v.j, v.k) AS r FROM q JOIN v ON q.case_id=v.case_id AND {reach}) WHERE r = 1"


@query(sql("SELECT q.case_id, q.i, q.j, q.k, round(n.d,6) AS d, n.cls AS nearest_cls FROM q LEFT JOIN n USING (case_id, i, j, k)", q="SELECT case_id, i, j, k FROM vox WHERE layer='R'", v="SELECT * FROM vox WHERE layer='A'", n=near_sql(f"{dist_sql('q', 'v')} <= 1.5")))
def nearest_label(spark, sf_dir):
    return rounded(nearest(vox(spark, sf_dir, "R").select("case_id", *AXES), vox(spark, sf_dir, "A"), 1.5, SPACING))


@query(sql("SELECT case_id, i, j, k, cls FROM v UNION ALL SELECT case_id, i, j, k, cls FROM n", v="SELECT case_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, cls FROM vox WHERE layer='N'", q=f"SELECT DISTINCT case_id, i+di AS i, j+dj AS j, k+dk AS k FROM v, {CROSS} EXCEPT SELECT case_id, i, j, k FROM v", n=near_sql(f"abs(q.i-v.i)<=1 AND abs(q.j-v.j)<=1 AND abs(q.k-v.k)<=1 AND {dist_sql('q', 'v')} <= 0.6000001")))
def dilate_labels(spark, sf_dir):
    out = M.dilate_labels(vox(spark, sf_dir, "N"), cross_offsets(1), SPACING, 0.6)
    return out.select("case_id", *[F.col(a).cast("bigint").alias(a) for a in AXES], "cls")


@query(sql("SELECT case_id, i, j, k, cls FROM v UNION ALL SELECT case_id, i, j, k, cls FROM (SELECT n.*, row_number() OVER (PARTITION BY case_id ORDER BY round(d,9), i, j, k) AS r FROM n) JOIN (SELECT case_id, round_even(count(*)*1.3, 0) - count(*) AS need FROM v GROUP BY 1) USING (case_id) WHERE r <= need",
           v="SELECT case_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, cls FROM vox WHERE layer='N'",
           q="SELECT DISTINCT case_id, i+di AS i, j+dj AS j, k+dk AS k FROM v, (SELECT x.x AS di, y.y AS dj, z.z AS dk FROM range(-2,3) x(x), range(-2,3) y(y), range(-2,3) z(z) WHERE x.x*x.x+y.y*y.y+z.z*z.z <= 4) EXCEPT SELECT case_id, i, j, k FROM v",
           n="SELECT case_id, i, j, k, d, cls FROM (SELECT q.case_id, q.i, q.j, q.k, sqrt((q.i-v.i)*(q.i-v.i)+(q.j-v.j)*(q.j-v.j)+(q.k-v.k)*(q.k-v.k)) AS d, v.cls, row_number() OVER (PARTITION BY q.case_id, q.i, q.j, q.k ORDER BY (q.i-v.i)*(q.i-v.i)+(q.j-v.j)*(q.j-v.j)+(q.k-v.k)*(q.k-v.k), v.i, v.j, v.k) AS r FROM q JOIN v ON q.case_id=v.case_id AND abs(q.i-v.i)<=2 AND abs(q.j-v.j)<=2 AND abs(q.k-v.k)<=2) WHERE r = 1"))
def grow_volume(spark, sf_dir):
    out = M.grow_volume(vox(spark, sf_dir, "N"), 1.3, reach=2)
    return out.select("case_id", *[F.col(a).cast("bigint").alias(a) for a in AXES], "cls")


#: Steps along each axis of a volume.
SHAPE = (50, 11, 9)


def _surface_sql(layer: str) -> str:
    return f"SELECT v.* FROM vox v WHERE layer = '{layer}' AND (SELECT count(*) FROM vox o WHERE o.layer = v.layer AND o.case_id = v.case_id AND o.cls = v.cls AND abs(o.i-v.i) + abs(o.j-v.j) + abs(o.k-v.k) = 1) < 6"


def _directed_sql(a: str, b: str) -> str:
    return f"SELECT case_id, cls, quantile_cont(d, 0.95) AS q FROM (SELECT a.case_id, a.cls, min(sqrt((a.i-b.i)*(a.i-b.i)+(a.j-b.j)*(a.j-b.j)+(a.k-b.k)*(a.k-b.k))) AS d FROM {a} a JOIN {b} b USING (case_id, cls) GROUP BY a.case_id, a.cls, a.i, a.j, a.k) GROUP BY 1, 2"


@query(
    sql(
        f"SELECT g.case_id, g.cls, round(CASE WHEN a.cls IS NULL AND b.cls IS NULL THEN 0 WHEN a.cls IS NULL OR b.cls IS NULL THEN 1 ELSE greatest(p.q, r.q) / sqrt({SHAPE[0] ** 2 + SHAPE[1] ** 2 + SHAPE[2] ** 2}) END, 6)::DOUBLE AS hd95 FROM (SELECT DISTINCT case_id, CAST(c AS INT) AS cls FROM vox, range(1, 9) t(c)) g"
        " LEFT JOIN (SELECT DISTINCT case_id, cls FROM sn) a USING (case_id, cls) LEFT JOIN (SELECT DISTINCT case_id, cls FROM sr) b USING (case_id, cls) LEFT JOIN p USING (case_id, cls) LEFT JOIN r USING (case_id, cls)",
        sn=_surface_sql("N"), sr=_surface_sql("R"), p=_directed_sql("sn", "sr"), r=_directed_sql("sr", "sn"),
    )
)
def hd95(spark, sf_dir):
    """DST3: per case and class (8 is one that no volume has), between the surfaces of truth and prediction."""
    v = vox(spark, sf_dir)
    groups = v.select("case_id").distinct().withColumn("cls", F.explode(F.sequence(F.lit(1), F.lit(8))))
    side = lambda n: v.where(F.col("layer") == n).select("case_id", "cls", *AXES)
    return rounded(M.surface_distance(side("N"), side("R"), groups, SHAPE, by=("case_id", "cls")).withColumnRenamed("hd", "hd95"))


@query(sql("SELECT case_id, i, j, k, count(DISTINCT layer) AS votes FROM vox GROUP BY 1,2,3,4 HAVING count(DISTINCT layer) >= 2"))
def consensus_voxel(spark, sf_dir):
    return vox(spark, sf_dir).groupBy("case_id", *AXES).agg(F.countDistinct("layer").alias("votes")).where("votes >= 2")


@query(comp_sql("SELECT case_id, comp_id, count(*) AS n_vox, max(cls) AS votes FROM comp GROUP BY 1,2 HAVING max(cls) >= 2", layer="SELECT case_id, i, j, k, CAST(count(DISTINCT layer) AS INT) AS cls FROM vox WHERE layer IN ('R','N') GROUP BY 1,2,3,4", connectivity=6))
def consensus_lesion(spark, sf_dir):
    v = vox(spark, sf_dir).where("layer in ('R','N')").groupBy("case_id", *AXES).agg(F.countDistinct("layer").cast("int").alias("cls"))
    return C.components(v, 6).groupBy("case_id", "comp_id").agg(F.count("*").alias("n_vox"), F.max("cls").alias("votes")).where("votes >= 2")


@query(comp_sql("SELECT case_id, comp_id, n FROM (SELECT case_id, comp_id, count(*) AS n, avg((i*7+j*3+k) % 10) AS score FROM comp GROUP BY 1,2) WHERE score >= 4.5"))
def filter_by_score(spark, sf_dir):
    c = comps(spark, sf_dir)
    scores = c.groupBy("case_id", "comp_id").agg(F.avg((F.col("i") * 7 + F.col("j") * 3 + F.col("k")) % 10).alias("score"))
    kept = scores.where("score >= 4.5")
    return c.join(kept, ["case_id", "comp_id"], "left_semi").groupBy("case_id", "comp_id").agg(F.count("*").alias("n"))


# ---- scoring ----

COUNTS = {
    "ov": "SELECT case_id, coalesce(g.cls, -1) AS g, coalesce(p.cls, -1) AS p FROM (SELECT * FROM vox WHERE layer='N') g FULL JOIN (SELECT * FROM vox WHERE layer='R') p USING (case_id, i, j, k)",
    "counts": "SELECT case_id, cls, sum((g=cls)::INT)::BIGINT AS n_gt, sum((p=cls)::INT)::BIGINT AS n_pred, sum((g=cls AND p=cls)::INT)::BIGINT AS n_both FROM ov, (SELECT CAST(c AS INT) AS cls FROM range(1,8) t(c)) GROUP BY 1,2 HAVING sum((g=cls)::INT) + sum((p=cls)::INT) > 0",
    "metrics": "SELECT *, CASE WHEN n_gt=0 AND n_pred=0 THEN 1.0 WHEN n_gt=0 OR n_pred=0 THEN 0.0 ELSE 2*n_both/(n_gt+n_pred+1e-6) END AS dice, CASE WHEN n_gt=0 AND n_pred=0 THEN 1.0 WHEN n_gt=0 OR n_pred=0 THEN 0.0 ELSE n_both/(n_gt+n_pred-n_both)+1e-6 END AS iou, CASE WHEN n_gt=0 AND n_pred=0 THEN 1.0 WHEN n_gt=0 OR n_pred=0 THEN 0.0 ELSE 1-abs(n_gt-n_pred)/(n_gt+n_pred+1e-6) END AS volsim FROM counts",
    "grid": "SELECT c.case_id, CAST(t.c AS INT) AS cls FROM (SELECT DISTINCT case_id FROM vox) c, range(1,8) t(c)",
    "v1": "SELECT g.case_id, g.cls, CAST(coalesce(n_both,0)>0 AS INT) AS tp, CAST(coalesce(n_pred,0)>0 AND coalesce(n_both,0)=0 AS INT) AS fp, CAST(coalesce(n_gt,0)>0 AND coalesce(n_both,0)=0 AS INT) AS fn, coalesce(t.gc,0) - CAST(coalesce(n_both,0)>0 AS INT) - CAST(coalesce(n_gt,0)>0 AND coalesce(n_both,0)=0 AS INT) AS tn FROM grid g LEFT JOIN counts USING (case_id, cls) LEFT JOIN (SELECT case_id, count(*) AS gc FROM counts WHERE n_gt>0 GROUP BY 1) t USING (case_id)",
    "v2": "SELECT g.case_id, g.cls, CAST(coalesce(n_gt,0)>0 AND coalesce(n_pred,0)>0 AS INT) AS tp, CAST(coalesce(n_gt,0)=0 AND coalesce(n_pred,0)>0 AS INT) AS fp, CAST(coalesce(n_gt,0)>0 AND coalesce(n_pred,0)=0 AS INT) AS fn, CAST(coalesce(n_gt,0)=0 AND coalesce(n_pred,0)=0 AS INT) AS tn, dice, volsim FROM grid g LEFT JOIN metrics USING (case_id, cls)",
}
SUM = "sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(tn)::DOUBLE AS tn"
ROOT = "sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn))"


def counts(spark, sf_dir):
    return S.overlap_counts(vox(spark, sf_dir, "N"), vox(spark, sf_dir, "R"))


def cases(spark, sf_dir):
    return vox(spark, sf_dir).select("case_id").distinct()


@query(sql("SELECT case_id, cls, n_gt, n_pred, n_both, round(dice,6) AS dice, round(iou,6) AS iou, round(volsim,6) AS volsim FROM metrics", **COUNTS))
def overlap_metrics(spark, sf_dir):
    return rounded(S.overlap_metrics(counts(spark, sf_dir)))


@query(sql("SELECT 'dice' AS method, case_id, cls, CAST(dice > 0.02 AS INT) AS tp FROM metrics UNION ALL SELECT 'iou', case_id, cls, CAST(iou > 0.02 AS INT) FROM metrics UNION ALL SELECT 'intersection', case_id, cls, CAST(n_both > 0 AS INT) FROM metrics", **COUNTS))
def check_tp(spark, sf_dir):
    m, out = S.overlap_metrics(counts(spark, sf_dir)), None
    for method, t in (("dice", 0.02), ("iou", 0.02), ("intersection", 0)):
        x = S.check_tp(m, method, t).select(F.lit(method).alias("method"), "case_id", "cls", "tp")
        out = x if out is None else out.unionByName(x)
    return out


@query(sql("SELECT * FROM v1", **COUNTS))
def score_v1_case(spark, sf_dir):
    return S.presence_v1(cases(spark, sf_dir), counts(spark, sf_dir), 7)


@query(sql(f"SELECT *, round(tp/(tp+fp+1e-6),6) AS precision, round(tp/(tp+fn+1e-6),6) AS recall, round((tp*tn-fp*fn)/({ROOT}+1e-6),6) AS mcc FROM (SELECT cls, {SUM} FROM v1 GROUP BY 1)", **COUNTS))
def score_v1_class(spark, sf_dir):
    return rounded(S.aggregate_v1(S.presence_v1(cases(spark, sf_dir), counts(spark, sf_dir), 7)))


@query(sql("SELECT case_id, cls, tp, fp, fn, tn, round(dice,6) AS dice, round(volsim,6) AS volsim FROM v2", **COUNTS))
def score_v2_case(spark, sf_dir):
    return rounded(S.presence_v2(cases(spark, sf_dir), counts(spark, sf_dir), 7))


V2CLASS = f"SELECT *, tp+fn AS support, tp/nullif(tp+fp,0) AS precision, tp/nullif(tp+fn,0) AS recall, 2*tp/nullif(2*tp+fp+fn,0) AS f1, (tp*tn-fp*fn)/nullif({ROOT},0) AS mcc FROM (SELECT cls, {SUM}, avg(dice) AS dice, avg(volsim) AS volsim FROM v2 GROUP BY 1)"


@query(sql("SELECT cls, tp, fp, fn, tn, round(dice,6) AS dice, round(volsim,6) AS volsim, support, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1, round(mcc,6) AS mcc FROM c2", **COUNTS, c2=V2CLASS))
def score_v2_class(spark, sf_dir):
    return rounded(S.aggregate_v2(S.presence_v2(cases(spark, sf_dir), counts(spark, sf_dir), 7)))


@query(sql("SELECT round(coalesce(avg(mcc),0),6) AS macro_mcc, round(coalesce(avg(precision),0),6) AS macro_precision, round(coalesce(avg(dice),0),6) AS macro_dice, count(mcc) AS valid_mcc, count(precision) AS valid_precision, count(dice) AS valid_dice FROM c2", **COUNTS, c2=V2CLASS))
def score_v2_macro(spark, sf_dir):
    return rounded(S.macro(S.aggregate_v2(S.presence_v2(cases(spark, sf_dir), counts(spark, sf_dir), 7)), ["mcc", "precision", "dice"]))


@query(sql(f"SELECT 'all' AS classes, round(avg(mcc),6) AS mcc, count(*) AS n FROM c1 UNION ALL SELECT 'present', round(avg(mcc),6), count(*) FROM c1 WHERE cls IN (SELECT cls FROM counts WHERE n_gt > 0 AND case_id % 3 = 0)", **COUNTS, c1=f"SELECT cls, (tp*tn-fp*fn)/({ROOT}+1e-6) AS mcc FROM (SELECT cls, {SUM} FROM v1 GROUP BY 1)"))
def macro_average(spark, sf_dir):
    n = counts(spark, sf_dir)
    c1 = S.aggregate_v1(S.presence_v1(cases(spark, sf_dir), n, 7))
    present = c1.join(n.where("n_gt > 0 and case_id % 3 = 0").select("cls").distinct(), "cls", "left_semi")
    mean = lambda df, name: df.agg(F.avg("mcc").alias("mcc"), F.count("*").alias("n")).select(F.lit(name).alias("classes"), "mcc", "n")
    return rounded(mean(c1, "all").unionByName(mean(present, "present")))


@query(with_tables("SELECT c.cls, coalesce(h.tp, 0)::BIGINT AS tp, coalesce(h.fp, 0)::BIGINT AS fp, (coalesce(n.n, 0) - coalesce(h.tp, 0))::BIGINT AS fn, ((SELECT count(DISTINCT (case_id, cls, comp_id)) FROM compn) - coalesce(n.n, 0))::BIGINT AS tn FROM (SELECT cls FROM comp UNION SELECT cls FROM compn) c LEFT JOIN (SELECT cls, count(DISTINCT (case_id, comp_id)) AS n FROM compn GROUP BY 1) n USING (cls) LEFT JOIN (SELECT cls, sum(tp)::BIGINT AS tp, sum(1-tp)::BIGINT AS fp FROM (SELECT p.cls, p.case_id, p.comp_id, CAST(count(g.comp_id) > 0 AS INT) AS tp FROM comp p LEFT JOIN compn g ON p.case_id=g.case_id AND p.i=g.i AND p.j=g.j AND p.k=g.k AND p.cls=g.cls GROUP BY 1,2,3) GROUP BY 1) h USING (cls)", "vox", recursive=True, **comp_tables("R", 6, per_class=True), **comp_tables("N", 6, "compn", per_class=True)))
def instance_score(spark, sf_dir):
    p, g = comps(spark, sf_dir, "R", 6, True), comps(spark, sf_dir, "N", 6, True).select("case_id", "cls", *AXES, F.col("comp_id").alias("gt"))
    hit = p.join(g, ["case_id", "cls", *AXES], "left").groupBy("case_id", "cls", "comp_id").agg((F.count("gt") > 0).cast("int").alias("tp"))
    found = hit.groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum(1 - F.col("tp")).alias("fp"))
    return S.instance_counts(found, g.select("case_id", "cls", "gt").distinct().groupBy("cls").agg(F.count("*").alias("n")))


@query(with_tables(f"SELECT g.min_vox, g.max_dist, (SELECT count(DISTINCT (n.case_id, n.comp_id)) FROM compn n JOIN kept k ON k.min_vox=g.min_vox AND k.max_dist=g.max_dist AND k.case_id=n.case_id JOIN comp c ON c.case_id=k.case_id AND c.comp_id=k.comp_id AND c.i=n.i AND c.j=n.j AND c.k=n.k) AS hits, (SELECT count(*) FROM kept k WHERE k.min_vox=g.min_vox AND k.max_dist=g.max_dist AND (k.case_id,k.comp_id) NOT IN (SELECT c.case_id, c.comp_id FROM comp c JOIN compn n USING (case_id,i,j,k))) AS false_comps FROM grid g", "vox", recursive=True, **comp_tables("R", 26), **comp_tables("N", 26, "compn"),
    cd=f"SELECT c.case_id, c.comp_id, min({dist_sql('c', 'v')}) AS dist FROM comp c JOIN vox v ON v.case_id=c.case_id AND v.layer='A' AND abs(c.i-v.i)<=4 AND abs(c.j-v.j)<=4 AND abs(c.k-v.k)<=3 WHERE {dist_sql('c', 'v')} <= 1.6000001 GROUP BY 1,2",
    cs="SELECT case_id, comp_id, count(*) AS n FROM comp GROUP BY 1,2",
    grid="SELECT m AS min_vox, d::DOUBLE AS max_dist FROM (VALUES (1),(2),(4)) a(m), (VALUES (0.5),(0.9),(1.6)) b(d)",
    kept="SELECT g.min_vox, g.max_dist, cs.case_id, cs.comp_id FROM grid g, cs JOIN cd USING (case_id, comp_id) WHERE n >= min_vox AND dist <= max_dist + 1e-9"))
def detection_sweep(spark, sf_dir):
    from voxtab.operators.detection import detection_sweep as sweep

    grid = spark.createDataFrame([(m, d) for m in (1, 2, 4) for d in (0.5, 0.9, 1.6)], "min_vox int, max_dist double")
    return sweep(comps(spark, sf_dir, "R"), comps(spark, sf_dir, "N"), vox(spark, sf_dir, "A"), grid, 1.6, SPACING)


# ---- intensity ----


def isql(body: str, **more: str) -> str:
    return with_tables(body, "inten", **more)


@query(isql("SELECT case_id, mask, count(*) AS n, round(quantile_cont(value,0.005),9) AS p0_5, round(quantile_cont(value,0.01),9) AS p1, round(quantile_cont(value,0.05),9) AS p5, round(quantile_cont(value,0.95),9) AS p95, round(quantile_cont(value,0.99),9) AS p99, round(quantile_cont(value,0.995),9) AS p99_5 FROM inten GROUP BY 1,2"))
def case_percentiles(spark, sf_dir):
    return rounded(N.case_percentiles(intensity(spark, sf_dir)), 9)


FG = {
    "lim": "SELECT case_id, modality, CASE WHEN modality='CT' THEN -300 ELSE greatest(1, 0.02*quantile_cont(value,0.995)) END AS low FROM inten GROUP BY 1,2",
    "fgc": "SELECT i.case_id, sum((value > low)::INT) AS n FROM inten i JOIN lim USING (case_id) GROUP BY 1",
    "fg": "SELECT i.* FROM inten i JOIN lim USING (case_id) JOIN fgc USING (case_id) WHERE value > low OR n < 100",
}


@query(isql("SELECT case_id, count(*) AS n, round(min(value),6) AS low FROM fg GROUP BY 1", **FG))
def foreground_mask(spark, sf_dir):
    return rounded(N.foreground(intensity(spark, sf_dir)).groupBy("case_id").agg(F.count("*").alias("n"), F.min("value").alias("low")))


@query(isql("SELECT i.case_id, i.i, i.j, i.k, round((value - med)/CASE WHEN iqr >= 1e-6 THEN iqr ELSE coalesce(nullif(sd,0),1) END, 6) AS z FROM inten i JOIN (SELECT case_id, median(value) AS med, quantile_cont(value,0.75)-quantile_cont(value,0.25) AS iqr, stddev_pop(value) AS sd FROM fg GROUP BY 1) s USING (case_id)", **FG))
def robust_z(spark, sf_dir):
    return rounded(N.robust_z(intensity(spark, sf_dir)).select("case_id", *AXES, "z"))


@query(isql("SELECT i.case_id, i.i, i.j, i.k, round((value - m)/coalesce(nullif(s,0),1),6) AS z FROM inten i JOIN (SELECT case_id, coalesce(avg(value) FILTER (mask='vessel'), avg(value)) AS m, coalesce(stddev_pop(value) FILTER (mask='vessel'), stddev_pop(value)) AS s FROM inten GROUP BY 1) USING (case_id)"))
def zscore_in_mask(spark, sf_dir):
    return rounded(N.zscore_in_mask(intensity(spark, sf_dir), "vessel").select("case_id", *AXES, "z"))


@query(isql("SELECT case_id, i, j, k, round(least(greatest((value+200)/1000.0, 0), 1),9) AS v FROM inten"))
def clip_scale(spark, sf_dir):
    return rounded(intensity(spark, sf_dir).select("case_id", *AXES, N.clip_scale(F.col("value"), -200.0, 800.0).alias("v")), 9)


@query(isql("SELECT modality, mask, least(greatest(CAST(floor((value+500)/1100.0*200) AS INT),0),199) AS bin, count(*) AS n, round(count(*)/(sum(count(*)) OVER (PARTITION BY modality, mask))/(1100.0/200),9) AS density FROM inten GROUP BY 1,2,3"))
def density_hist(spark, sf_dir):
    return rounded(N.density_histogram(intensity(spark, sf_dir), ("modality", "mask"), -500.0, 600.0, 200), 9)


@query(isql("SELECT center, modality, count(DISTINCT case_id) AS cases, count(*) AS n, round(median(value),6) AS med FROM (SELECT *, CASE WHEN case_id % 3 = 0 THEN 'a' ELSE 'b' END AS center FROM inten) GROUP BY ROLLUP (center, modality)"))
def profile_rollup(spark, sf_dir):
    x = intensity(spark, sf_dir).withColumn("center", F.when(F.col("case_id") % 3 == 0, "a").otherwise("b"))
    cases = x.groupBy("center", "modality", "case_id").agg(F.count("*").alias("n"))
    counts = cases.rollup("center", "modality").agg(F.countDistinct("case_id").alias("cases"), F.sum("n").alias("n"))
    key = F.concat_ws("|", F.coalesce("center", F.lit("*")), F.coalesce("modality", F.lit("*")))
    levels = F.array(F.concat_ws("|", "center", "modality"), F.concat_ws("|", "center", F.lit("*")), F.lit("*|*"))
    values = x.groupBy("center", "modality", "value").agg(F.count("*").alias("times"))  # counted before they go to three levels
    med = quantiles(values.select(F.explode(levels).alias("key"), "value", "times"), "key", "value", {"med": 0.5}, "times")
    return rounded(counts.withColumn("key", key).join(med, "key", "left").drop("key"))


@query(isql("SELECT modality, mask, case_id, value FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY (i*7919 + j*104729 + k*31337) % 1009, i, j, k, value) AS r FROM inten) WHERE r <= 50"))
def bounded_sample(spark, sf_dir):
    return N.bounded_sample(intensity(spark, sf_dir), 50).select("modality", "mask", "case_id", "value")


@query(isql("SELECT modality, round(min(low),6) AS low, round(max(high),6) AS high, round(avg(cv),6) AS cv FROM (SELECT modality, quantile_cont(value,0.005) AS low, greatest(quantile_cont(value,0.995), quantile_cont(value,0.995) FILTER (mask='vessel')) AS high FROM inten GROUP BY 1) JOIN (SELECT modality, stddev_pop(p)/avg(p) AS cv FROM (SELECT modality, case_id, quantile_cont(value,0.995) AS p FROM inten GROUP BY 1,2) GROUP BY 1) USING (modality) GROUP BY 1"))
def recommend_window(spark, sf_dir):
    return rounded(N.recommend_window(intensity(spark, sf_dir)))


@query(isql("SELECT case_id, i, j, k, CASE WHEN ct THEN CASE WHEN s1 > 0 THEN (least(greatest(value,-200),800) - m1)/s1 ELSE 0 END ELSE CASE WHEN value <= 0 THEN 0 WHEN s2 > 0 THEN (least(greatest(value,lo),hi) - m2)/s2 ELSE 0 END END AS z FROM inten JOIN st USING (case_id) JOIN lohi USING (case_id) LEFT JOIN mr USING (case_id)".replace("CASE WHEN ct", "round(CASE WHEN ct", 1).replace("END END AS z", "END END, 6) AS z"),
    lohi="SELECT case_id, quantile_cont(value,0.005) FILTER (value>0) AS lo, quantile_cont(value,0.999) FILTER (value>0) AS hi, avg((value < -300)::INT) > 0.01 AS ct FROM inten GROUP BY 1",
    st="SELECT case_id, avg(least(greatest(value,-200),800)) FILTER (value > -100) AS m1, stddev_pop(least(greatest(value,-200),800)) FILTER (value > -100) AS s1 FROM inten GROUP BY 1",
    mr="SELECT case_id, avg(least(greatest(value,lo),hi)) AS m2, stddev_pop(least(greatest(value,lo),hi)) AS s2 FROM inten JOIN lohi USING (case_id) WHERE value > 0 GROUP BY 1"))
def adaptive_norm(spark, sf_dir):
    return rounded(N.adaptive_norm(intensity(spark, sf_dir)).select("case_id", *AXES, "z"))


@query(isql("SELECT case_id, CAST(max_by(bin, struct_pack(a := round(score,6), b := -bin)) AS INT) AS otsu_bin FROM (SELECT case_id, bin, CASE WHEN w0 > 0 AND wt - w0 > 0 THEN w0*(wt-w0)*pow(s0/w0 - (st-s0)/(wt-w0), 2) ELSE 0 END AS score FROM (SELECT case_id, bin, sum(n) OVER w AS w0, sum(n*bin) OVER w AS s0, sum(n) OVER (PARTITION BY case_id) AS wt, sum(n*bin) OVER (PARTITION BY case_id) AS st FROM (SELECT case_id, CAST(floor((value+500)/20) AS INT) AS bin, count(*)::DOUBLE AS n FROM inten GROUP BY 1,2) WINDOW w AS (PARTITION BY case_id ORDER BY bin ROWS UNBOUNDED PRECEDING))) GROUP BY 1"))
def otsu_threshold(spark, sf_dir):
    return N.otsu(intensity(spark, sf_dir), -500.0, 20.0)


@query(isql("SELECT case_id, i // 5 AS bi, j // 5 AS bj, k // 3 AS bk, round(avg(value),6) AS v, count(*) AS n FROM inten WHERE i % 5 = 0 GROUP BY 1,2,3,4"))
def coarsen(spark, sf_dir):
    return rounded(N.coarsen(intensity(spark, sf_dir), (5, 5, 3)))
