"""Queries over class probabilities, decisions, embeddings and junction nodes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.operators import classify as K
from voxtab.operators import learning as L
from voxtab.operators import probability as P
from voxtab.operators import scoring as S
from voxtab.plans.queries_learning import embedded
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import SQL, decisions, nodes, probs, table, vox, with_tables

KEY = ("lesion", "seed")


def psql(body: str, **more: str) -> str:
    return with_tables(body, "probs", **more)


def dsql(body: str, **more: str) -> str:
    return with_tables(body, "dec", **more)


PRI = "SELECT truth AS cls, count(DISTINCT lesion) AS n FROM probs GROUP BY 1"
NORM = "SELECT lesion, seed, cls, round(q / sum(q) OVER (PARTITION BY lesion, seed), 6) AS p FROM q"


def prior(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cls")).agg(F.count("*").alias("n"))


@query(psql(NORM, pri=PRI, q="SELECT lesion, seed, cls, p / pow(n, 0.5) AS q FROM probs JOIN pri USING (cls)"))
def prior_correct(spark, sf_dir):
    return rounded(P.prior_correct(probs(spark, sf_dir), prior(spark, sf_dir), 0.5, KEY).select(*KEY, "cls", "p"))


@query(psql(NORM, pri=PRI, q="SELECT lesion, seed, cls, CASE WHEN max(p) OVER (PARTITION BY lesion, seed) < 0.15 THEN p / pow(n, 0.8) ELSE p END AS q FROM probs JOIN pri USING (cls)"))
def gated_beta(spark, sf_dir):
    return rounded(P.gated_prior(probs(spark, sf_dir), prior(spark, sf_dir), 0.15, 0.8, KEY).select(*KEY, "cls", "p"))


@query(psql("SELECT lesion, cls, round(sum(p)/3, 6) AS p FROM probs WHERE NOT (seed = 1 AND cls = 4) GROUP BY 1, 2"))
def prob_ensemble(spark, sf_dir):
    return rounded(P.ensemble(probs(spark, sf_dir).where("not (seed = 1 and cls = 4)"), 3, ("lesion",)))


@query(psql("SELECT lesion, cls, round(avg(p), 6) AS p, avg(p) >= 0.1 AS kept FROM probs GROUP BY 1, 2"))
def prob_average(spark, sf_dir):
    return rounded(probs(spark, sf_dir).groupBy("lesion", "cls").agg(F.avg("p").alias("p"), (F.avg("p") >= 0.1).alias("kept")))


@query(psql("SELECT a.lesion, a.seed, a.cls, round((a.p + coalesce(b.p, 0)) / 2, 6) AS p FROM probs a LEFT JOIN probs b ON a.lesion=b.lesion AND a.seed=b.seed AND b.cls = CASE WHEN a.cls < 8 THEN xor(a.cls, 1) ELSE a.cls END"))
def mirror_tta(spark, sf_dir):
    return rounded(P.mirror_average(probs(spark, sf_dir), KEY, P.mirror_class(F.col("cls"))).select(*KEY, "cls", "p"))


@query(psql("SELECT coalesce(a.lesion,b.lesion) AS lesion, coalesce(a.cls,b.cls) AS cls, round(0.7*coalesce(a.p,0) + 0.3*coalesce(b.p,0), 6) AS p FROM a FULL JOIN b ON a.lesion=b.lesion AND a.cls=b.cls", a="SELECT lesion, cls, p / sum(p) OVER (PARTITION BY lesion) AS p FROM (SELECT lesion, cls, p / pow(n, 0.5) AS p FROM probs JOIN (SELECT truth AS cls, count(DISTINCT lesion) AS n FROM probs GROUP BY 1) USING (cls) WHERE seed=0)", b="SELECT lesion, cls, p / sum(p) OVER (PARTITION BY lesion) AS p FROM probs WHERE seed=1 AND cls <> 5"))
def blend(spark, sf_dir):
    p = probs(spark, sf_dir)
    first = P.prior_correct(p.where("seed = 0"), prior(spark, sf_dir), 0.5, ("lesion",))
    return rounded(P.blend(first, p.where("seed = 1 and cls <> 5"), 0.7, ("lesion",)))


@query(psql(NORM, cp="SELECT case_id, cls, avg(p) AS c FROM probs WHERE seed = 2 GROUP BY 1, 2", q="SELECT lesion, seed, cls, p * pow(greatest(c, 0.05), 0.5) AS q FROM probs JOIN cp USING (case_id, cls)"))
def case_prior(spark, sf_dir):
    p = probs(spark, sf_dir)
    c = p.where("seed = 2").groupBy("case_id", "cls").agg(F.avg("p").alias("c"))
    return rounded(P.case_prior(p, c, 0.5, 0.05, KEY).select(*KEY, "cls", "p"))


@query(psql("SELECT lesion, seed, cls FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(fp,9) DESC, fam, round(p,9) DESC, cls) AS r FROM (SELECT *, sum(p) OVER (PARTITION BY lesion, seed, fam) AS fp FROM (SELECT *, cls // 2 AS fam FROM probs))) WHERE r = 1"))
def hier_argmax(spark, sf_dir):
    return P.hierarchical_argmax(probs(spark, sf_dir), F.floor(F.col("cls") / 2), KEY).select(*KEY, "cls")


def _sinkhorn_sql() -> str:
    parts, last = {"m0": "SELECT lesion, cls, avg(p) AS p, 1.0::DOUBLE AS v FROM probs GROUP BY 1,2", "goal": "SELECT cls, n*1.0/sum(n) OVER () AS g FROM (SELECT truth AS cls, count(DISTINCT lesion) AS n FROM probs GROUP BY 1)"}, "m0"
    for t in range(5):
        parts[f"r{t}"] = f"SELECT lesion, cls, p, v, p*v/sum(p*v) OVER (PARTITION BY lesion) AS q FROM {last}"
        parts[f"c{t}"] = f"SELECT cls, avg(q) AS m FROM r{t} GROUP BY 1"
        last = f"m{t + 1}"
        parts[last] = f"SELECT lesion, cls, p, v * g / m AS v FROM r{t} JOIN c{t} USING (cls) JOIN goal USING (cls)"
    return psql(f"SELECT lesion, cls, round(p*pow(v, 0.5)/sum(p*pow(v, 0.5)) OVER (PARTITION BY lesion), 6) AS p FROM {last}", **parts)


@query(_sinkhorn_sql())
def sinkhorn(spark, sf_dir):
    p = probs(spark, sf_dir).groupBy("lesion", "cls").agg(F.avg("p").alias("p"))
    n = prior(spark, sf_dir)
    total = n.agg(F.sum("n")).first()[0] or 1
    return rounded(P.sinkhorn(p, n.select("cls", (F.col("n") / total).alias("goal")), 5, 0.5))


@query(psql("SELECT case_id, seed, list_sort([l1.lesion * 100 + l1.cls, l2.lesion * 100 + l2.cls, l3.lesion * 100 + l3.cls]) AS picks FROM (SELECT l1, l2, l3, l1.case_id AS case_id, l1.seed AS seed, row_number() OVER (PARTITION BY l1.case_id, l1.seed ORDER BY round(ln(l1.p)+ln(l2.p)+ln(l3.p), 9) DESC, l1.cls, l2.cls, l3.cls) AS r FROM top l1 JOIN top l2 ON l1.case_id=l2.case_id AND l1.seed=l2.seed AND l2.lesion = l1.lesion+1 AND l1.cls<>l2.cls JOIN top l3 ON l3.case_id=l2.case_id AND l3.seed=l2.seed AND l3.lesion=l2.lesion+1 AND l3.cls<>l2.cls AND l3.cls<>l1.cls) WHERE r = 1", top="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS rk FROM probs) WHERE rk <= 3 AND lesion // 3 = case_id"))
def assign_unique(spark, sf_dir):
    p = probs(spark, sf_dir)
    full = p.groupBy("case_id", "seed").agg(F.countDistinct("lesion").alias("n")).where("n = 3")
    out = P.assign_unique(p.join(full, ["case_id", "seed"], "left_semi"), 3, ("case_id", "seed"))
    return out.select("case_id", "seed", F.sort_array(F.transform("picks", lambda x: x["lesion"] * 100 + x["cls"])).alias("picks"))


@query(psql("SELECT lesion, seed, cls, round(CASE WHEN cls IN (2,3) THEN g * e ELSE p END, 6) AS p FROM (SELECT a.lesion, a.seed, a.cls, a.p, sum(a.p) FILTER (a.cls IN (2,3)) OVER (PARTITION BY a.lesion, a.seed) AS g, x.p / sum(x.p) FILTER (x.cls IN (2,3)) OVER (PARTITION BY a.lesion, a.seed) AS e FROM probs a JOIN probs x ON x.lesion = a.lesion AND x.cls = a.cls AND x.seed = (a.seed + 1) % 3)"))
def redistribute(spark, sf_dir):
    """PRB10: inside one group of classes, by the shares that another model (the next seed's) gives there."""
    p = probs(spark, sf_dir)
    expert = p.select("lesion", "cls", ((F.col("seed") + 2) % 3).alias("seed"), F.col("p").alias("_e"))
    inside = F.col("cls").isin(2, 3)
    share = F.col("_e") / F.sum(F.when(inside, F.col("_e"))).over(W.partitionBy(*KEY))
    y = p.join(expert, [*KEY, "cls"]).withColumn("_share", share)
    return rounded(P.redistribute(y, inside, F.col("_share"), KEY).select(*KEY, "cls", "p"))


@query(psql("SELECT lesion, seed, c1, c2, (c1 < 8 AND c2 < 8 AND c1 // 2 = c2 // 2) AND p2 / p1 > 0.5 AND p2 > 0.1 AND (n2 <= 60) AS emit FROM (SELECT lesion, seed, max(cls) FILTER (r=1) AS c1, max(cls) FILTER (r=2) AS c2, max(p) FILTER (r=1) AS p1, max(p) FILTER (r=2) AS p2 FROM ranked GROUP BY 1,2) JOIN (SELECT truth AS c2, count(DISTINCT lesion) AS n2 FROM probs GROUP BY 1) USING (c2)", ranked="SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS r FROM probs"))
def emit_topk_gate(spark, sf_dir):
    return P.second_class_gate(probs(spark, sf_dir), prior(spark, sf_dir), KEY, ratio=0.5, floor=0.1, most=60)


@query(psql("SELECT lesion, seed, cls, CAST(rk AS INT) AS rk FROM ranked JOIN (SELECT truth AS cls, count(DISTINCT lesion) AS n FROM probs GROUP BY 1) USING (cls) WHERE rk BETWEEN 2 AND 3 AND n < 50", ranked="SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS rk FROM probs"))
def emit_rare(spark, sf_dir):
    r = P.ranked(probs(spark, sf_dir), KEY).where("rk between 2 and 3")
    return r.join(F.broadcast(prior(spark, sf_dir).where("n < 50").select("cls")), "cls").select(*KEY, "cls", "rk")


@query(
    psql(
        "SELECT lesion, seed, cls FROM (SELECT p.*, row_number() OVER (PARTITION BY p.lesion, p.seed ORDER BY CASE WHEN f.cls IS NOT NULL THEN 0 ELSE round(p.p,9) END DESC, p.cls) AS r FROM probs p LEFT JOIN forbidden f ON f.case_id = p.case_id AND f.cls = p.cls) WHERE r = 1",
        vox=SQL["vox"],
        there="SELECT case_id, cls, count(*) AS n FROM vox WHERE layer = 'A' GROUP BY 1, 2",
        forbidden="SELECT c.case_id, k.cls FROM (SELECT case_id, sum(n) AS n FROM there GROUP BY 1) c CROSS JOIN (SELECT CAST(x AS INT) AS cls FROM range(1, 8) t(x)) k LEFT JOIN there t ON t.case_id = c.case_id AND t.cls = k.cls WHERE coalesce(t.n, 0) * 10 < c.n",
    )
)
def veto_rules(spark, sf_dir):
    """PRB16: a class whose branch is absent from its case's vessels, or holds less than a tenth of them, is forbidden; cases without vessels forbid nothing."""
    there = vox(spark, sf_dir, "A").groupBy("case_id").pivot("cls", list(range(1, 8))).agg(F.count("cls"))
    each = there.select("case_id", F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.coalesce(F.col(str(c)), F.lit(0)).alias("n")) for c in range(1, 8)])).alias("b"), sum(F.coalesce(F.col(str(c)), F.lit(0)) for c in range(1, 8)).alias("all"))
    forbidden = each.where(F.col("b.n") * 10 < F.col("all")).select("case_id", "b.cls", F.lit(True).alias("_no"))
    p = probs(spark, sf_dir).join(forbidden, ["case_id", "cls"], "left")
    return P.veto(p, F.coalesce("_no", F.lit(False)), KEY).select(*KEY, "cls")


@query(psql("SELECT m.lesion, m.truth, m.pred, round(t.pt,6) AS p_truth, round(u.pp,6) AS p_pred FROM (SELECT lesion, truth, mode_pred AS pred FROM (SELECT lesion, truth, cls AS mode_pred, count(*) AS c, row_number() OVER (PARTITION BY lesion ORDER BY count(*) DESC, cls) AS r FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS rk FROM probs) WHERE rk=1 GROUP BY 1,2,3) WHERE r=1 AND c >= 2) m JOIN (SELECT lesion, cls, avg(p) AS pt FROM probs GROUP BY 1,2) t ON t.lesion=m.lesion AND t.cls=m.truth JOIN (SELECT lesion, cls, avg(p) AS pp FROM probs GROUP BY 1,2) u ON u.lesion=m.lesion AND u.cls=m.pred WHERE m.pred <> m.truth AND t.pt < 0.15 AND u.pp > 0.1"))
def suspect_labels(spark, sf_dir):
    return rounded(P.suspect_labels(probs(spark, sf_dir), below=0.15, above=0.1, agree=2))


@query(dsql("SELECT CASE WHEN a.pred = a.truth AND b.pred = b.truth THEN 'both' WHEN a.pred = a.truth THEN 'first' WHEN b.pred = b.truth THEN 'second' ELSE 'neither' END AS hit, count(*) AS n FROM dec a JOIN dec b USING (lesion) WHERE a.seed=0 AND b.seed=1 GROUP BY 1"))
def agreement_table(spark, sf_dir):
    d = decisions(spark, sf_dir)
    a, b = (d.where(F.col("seed") == s).select("lesion", F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).alias(n)) for s, n in ((0, "a"), (1, "b")))
    hit = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").when(F.col("b"), "second").otherwise("neither")
    return a.join(b, "lesion").groupBy(hit.alias("hit")).agg(F.count("*").alias("n"))


@query(psql("SELECT band, sum((b0 AND NOT a0)::INT)::BIGINT AS fixed, sum((a0 AND NOT b0)::INT)::BIGINT AS broken, count(*) AS n FROM (SELECT t.band, (x.c1 = x.truth) AS a0, (CASE WHEN x.p1 < t.band THEN y.c1 ELSE x.c1 END = x.truth) AS b0 FROM (VALUES (0.10),(0.15),(0.20),(0.40)) t(band), x JOIN y USING (lesion)) GROUP BY 1".replace("t(band)", "t(band)"), ranked="SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS rk FROM probs", x="SELECT lesion, truth, cls AS c1, p AS p1 FROM ranked WHERE rk=1 AND seed=0", y="SELECT lesion, cls AS c1 FROM ranked WHERE rk=1 AND seed=1").replace("SELECT band, sum", "SELECT band::DOUBLE AS band, sum"))
def gate_bands(spark, sf_dir):
    return P.gate_bands(probs(spark, sf_dir), [0.10, 0.15, 0.20, 0.40])


@query(psql("SELECT lesion, seed, cls, round(pg * p / nullif(sum(p) OVER (PARTITION BY lesion, seed, grp), 0), 6) AS p FROM (SELECT *, cls // 2 AS grp, sum(p) OVER (PARTITION BY lesion, seed, cls // 2) AS pg FROM probs)"))
def two_stage_route(spark, sf_dir):
    p = probs(spark, sf_dir)
    group = F.floor(F.col("cls") / 2)
    g = p.groupBy(*KEY, group.alias("grp")).agg(F.sum("p").alias("pg"))
    return rounded(P.two_stage(g, p.withColumn("grp", group), KEY).select(*KEY, "cls", "p"))


@query(psql("SELECT lesion, seed, CASE WHEN fam >= 4 THEN 'mid' WHEN pr >= pl THEN 'R-' || fam ELSE 'L-' || fam END AS name FROM (SELECT lesion, seed, fam, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(sum(p),9) DESC, fam) AS r FROM (SELECT *, CAST(cls // 2 AS INT) AS fam FROM probs) GROUP BY 1,2,3) JOIN (SELECT lesion, seed, round(sum(p) FILTER (cls < 8 AND cls % 2 = 0),9) AS pr, round(sum(p) FILTER (cls < 8 AND cls % 2 = 1),9) AS pl FROM probs GROUP BY 1,2) USING (lesion, seed) WHERE r = 1"))
def canonical_restore(spark, sf_dir):
    return P.canonical_restore(probs(spark, sf_dir), KEY)


@query(
    psql(
        "SELECT t.lesion, t.seed, CASE WHEN t.c1 // 2 = t.c2 // 2 AND t.c1 < 8 AND b.d < a.d THEN t.c2 ELSE t.c1 END AS cls FROM top t LEFT JOIN far a ON a.vec_id = t.lesion AND a.cls = t.c1 LEFT JOIN far b ON b.vec_id = t.lesion AND b.cls = t.c2",
        top="SELECT lesion, seed, max(cls) FILTER (rk=1) AS c1, max(cls) FILTER (rk=2) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS rk FROM probs) GROUP BY 1,2",
        long="SELECT vec_id, label, (vec_id // 3) % 5 AS fold, d, embedding[d]::DOUBLE AS v FROM embeddings, range(1, 65) t(d)",
        means="SELECT f.fold, m.label AS cls, m.d, sum(m.v) FILTER (m.fold <> f.fold) / count(*) FILTER (m.fold <> f.fold) AS mean FROM long m, (SELECT DISTINCT fold FROM long) f GROUP BY ALL",
        far="SELECT l.vec_id, m.cls, round(sum((l.v - m.mean) * (l.v - m.mean)), 9) AS d FROM long l JOIN means m ON m.fold = l.fold AND m.d = l.d GROUP BY 1, 2",
    )
)
def pair_override(spark, sf_dir):
    """CLF10: for two leading classes of one family, a specialist: the nearer of their class means over the other folds."""
    top = P.top_two(probs(spark, sf_dir), KEY)
    e = embedded(spark, sf_dir)
    means = L.means_without_fold(e, [], 64)
    far = F.map_from_entries(F.transform("means", lambda m: F.struct(m["label"], F.round(L.squared(F.col("x"), m["mean"]), 9))))
    near = e.join(F.broadcast(means), "fold").select(F.col("vec_id").alias("lesion"), far.alias("far"))
    confused = (F.floor(F.col("c1") / 2) == F.floor(F.col("c2") / 2)) & (F.col("c1") < 8)
    swap = F.coalesce(F.get("_f", F.lit(1)) < F.get("_f", F.lit(0)), F.lit(False))
    y = top.join(near, "lesion", "left").withColumn("_f", F.array(F.try_element_at("far", F.col("c1").cast("int")), F.try_element_at("far", F.col("c2").cast("int"))))
    return y.select(*KEY, F.when(confused & swap, F.col("c2")).otherwise(F.col("c1")).alias("cls"))


@query(psql("SELECT t::DOUBLE AS t, count(*) FILTER (hit AND p1 >= t) AS tp_kept, count(*) FILTER (NOT hit AND p1 < t) AS fp_removed FROM (SELECT lesion, p AS p1, cls = truth AS hit FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS rk FROM probs) WHERE rk=1), (VALUES (0.1),(0.14),(0.18),(0.25)) v(t) GROUP BY 1"))
def threshold_curve(spark, sf_dir):
    return P.threshold_curve(P.ranked(probs(spark, sf_dir), KEY).where("rk = 1").select("p", (F.col("cls") == F.col("truth")).alias("hit")), [0.1, 0.14, 0.18, 0.25])


@query(psql("SELECT cls, round(w,2) AS w, round(avg((pred=truth)::INT),6) AS top1 FROM (SELECT g.c AS cls, g.w, p.lesion, p.seed, p.truth, arg_max(p.cls, struct_pack(a := round(p.p * CASE WHEN p.cls = g.c THEN g.w ELSE 1 END, 9), b := -p.cls)) AS pred FROM probs p, (SELECT CAST(c AS INT) AS c, w::DOUBLE AS w FROM range(0,10) a(c), (VALUES (0.5),(1.0),(2.0)) b(w)) g GROUP BY 1,2,3,4,5) GROUP BY 1,2"))
def class_weight_step(spark, sf_dir):
    return rounded(P.class_weight_step(probs(spark, sf_dir), [0.5, 1.0, 2.0], KEY))


@query(psql("SELECT n_bucket, k, sum((rk <= k)::INT)::BIGINT AS hits, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS rk FROM probs) r JOIN (SELECT truth, CASE WHEN count(DISTINCT lesion) < 50 THEN 'few' ELSE 'many' END AS n_bucket FROM probs GROUP BY 1) USING (truth), (SELECT CAST(k AS INT) AS k FROM range(1,4) t(k)) WHERE cls = truth GROUP BY 1,2"))
def topk_curve(spark, sf_dir):
    n = prior(spark, sf_dir).select(F.col("cls").alias("truth"), F.when(F.col("n") < 50, "few").otherwise("many").alias("n_bucket"))
    r = P.ranked(probs(spark, sf_dir), KEY).where("cls = truth").join(F.broadcast(n), "truth").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return r.groupBy("n_bucket", "k").agg(F.count_if(F.col("rk") <= F.col("k")).alias("hits"), F.count("*").alias("n"))


# ---- decisions ----


@query(dsql("SELECT seed, coalesce(pred, -2) AS pred, truth, count(*) AS n FROM dec WHERE pred IS DISTINCT FROM truth GROUP BY 1,2,3 ORDER BY n DESC, truth, pred, seed LIMIT 20"))
def confusion_topk(spark, sf_dir):
    d = decisions(spark, sf_dir).withColumn("pred", F.coalesce("pred", F.lit(-2))).where("pred <> truth")
    return d.groupBy("seed", "pred", "truth").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "pred", "seed").limit(20)


@query(dsql("SELECT truth, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM dec WHERE pred IS DISTINCT FROM truth AND truth >= 0 GROUP BY 1"))
def error_mass(spark, sf_dir):
    wrong = decisions(spark, sf_dir).where("truth >= 0 and not (pred <=> truth)").groupBy("truth").agg(F.count("*").alias("n"))
    # One row per class: the total is taken over as few rows as there are classes.
    return rounded(wrong.crossJoin(wrong.agg(F.sum("n").alias("all"))).select("truth", (F.col("n") / F.col("all")).alias("share")))


@query(dsql("SELECT t.seed, round(CASE WHEN (s*s-pp)*(s*s-tt) > 0 THEN (c*s-tp)/sqrt((s*s-pp)*(s*s-tt)) ELSE 0 END, 6) AS mcc FROM (SELECT seed, sum(coalesce(a.n,0)*coalesce(b.n,0))::DOUBLE AS tp, sum(coalesce(a.n,0)*coalesce(a.n,0))::DOUBLE AS tt, sum(coalesce(b.n,0)*coalesce(b.n,0))::DOUBLE AS pp, sum(coalesce(a.n,0))::DOUBLE AS s FROM (SELECT seed, truth AS x, count(*) AS n FROM d GROUP BY 1,2) a FULL JOIN (SELECT seed, pred AS x, count(*) AS n FROM d GROUP BY 1,2) b USING (seed, x) GROUP BY 1) t JOIN (SELECT seed, sum((truth=pred)::INT)::DOUBLE AS c FROM d GROUP BY 1) USING (seed)", d="SELECT seed, truth, coalesce(pred, -1) AS pred FROM dec"))
def mcc_multiclass(spark, sf_dir):
    return rounded(S.multiclass_mcc(decisions(spark, sf_dir).withColumn("pred", F.coalesce("pred", F.lit(-1))), ("seed",)))


@query(dsql("SELECT seed, count(*) AS n, sum((pred IS NULL)::INT)::BIGINT AS abstained, round(avg((pred=truth)::INT),6) AS top1, round(avg((pred//2=truth//2)::INT),6) AS group_acc, round(avg((pred%2=truth%2)::INT) FILTER (truth < 8),6) AS side_acc FROM dec WHERE truth >= 0 GROUP BY 1"))
def class_report(spark, sf_dir):
    d = decisions(spark, sf_dir).where("truth >= 0")
    same = lambda f: f(F.col("pred")) == f(F.col("truth"))
    half = lambda c: F.floor(c / 2)
    return rounded(d.groupBy("seed").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred").isNull()).alias("abstained"), F.avg((F.col("pred") == F.col("truth")).cast("int")).alias("top1"),
        F.avg(same(half).cast("int")).alias("group_acc"), F.avg(F.when(F.col("truth") < 8, same(lambda c: c % 2).cast("int"))).alias("side_acc")))


@query(dsql("SELECT CASE WHEN n < 50 THEN 'few' ELSE 'many' END AS bucket, lesion % 2 AS fidelity, round(avg((coalesce(pred,-2)=truth)::INT),6) AS acc, count(*) AS m FROM dec JOIN (SELECT truth, count(DISTINCT lesion) AS n FROM dec GROUP BY 1) USING (truth) WHERE truth >= 0 GROUP BY CUBE (bucket, fidelity)"))
def headroom_cube(spark, sf_dir):
    d = decisions(spark, sf_dir).where("truth >= 0")
    n = d.groupBy("truth").agg(F.countDistinct("lesion").alias("n"))
    d = d.join(F.broadcast(n), "truth").select(F.when(F.col("n") < 50, "few").otherwise("many").alias("bucket"), (F.col("lesion") % 2).alias("fidelity"), (F.coalesce("pred", F.lit(-2)) == F.col("truth")).cast("int").alias("ok"))
    return rounded(d.cube("bucket", "fidelity").agg(F.avg("ok").alias("acc"), F.count("*").alias("m")))


@query(dsql("SELECT scenario, seed, sum((pred=truth AND truth>=0)::INT)::BIGINT AS tp, sum((pred IS NOT NULL AND pred<>truth)::INT)::BIGINT AS fp, sum((truth>=0 AND (pred IS NULL OR pred<>truth))::INT)::BIGINT AS fn FROM (SELECT scenario, seed, truth, CASE WHEN scenario IN ('fix','both') AND pred IS NOT NULL AND truth >= 0 THEN truth WHEN scenario IN ('noh','both') AND truth = -1 THEN NULL ELSE pred END AS pred FROM dec, (VALUES ('cur'),('fix'),('noh'),('both')) v(scenario)) GROUP BY 1,2"))
def oracle_split(spark, sf_dir):
    return K.oracle_split(decisions(spark, sf_dir))


@query(dsql("SELECT round(avg(mcc),6) AS macro_mcc, count(*) AS classes FROM (SELECT cls, CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END AS mcc FROM (SELECT cls, sum((t AND p)::INT)::DOUBLE AS tp, sum((NOT t AND p)::INT)::DOUBLE AS fp, sum((t AND NOT p)::INT)::DOUBLE AS fn, sum((NOT t AND NOT p)::INT)::DOUBLE AS tn FROM (SELECT c.case_id, k.cls, list_contains(c.ts, k.cls) AS t, list_contains(c.ps, k.cls) AS p FROM (SELECT case_id, list(truth) FILTER (truth>=0) AS ts, list(pred) FILTER (pred IS NOT NULL) AS ps FROM dec WHERE seed=0 GROUP BY 1) c, (SELECT DISTINCT truth AS cls FROM dec WHERE truth >= 0) k) GROUP BY 1))".replace("list_contains(c.ts, k.cls)", "coalesce(list_contains(c.ts, k.cls), false)").replace("list_contains(c.ps, k.cls)", "coalesce(list_contains(c.ps, k.cls), false)").replace("coalesce(coalesce(", "coalesce((")))
def macro_mcc_sets(spark, sf_dir):
    return rounded(K.macro_mcc_sets(decisions(spark, sf_dir).where("seed = 0")))


@query(dsql("SELECT seed, sig, pred_rule, count(*) AS n, sum((pred_rule = truth)::INT)::BIGINT AS ok FROM (SELECT d.*, CAST(lesion % 7 AS BIGINT) AS sig, coalesce(a.truth_best, g.truth_best) AS pred_rule FROM dec d LEFT JOIN (SELECT sig, truth AS truth_best FROM (SELECT lesion % 7 AS sig, truth, row_number() OVER (PARTITION BY lesion % 7 ORDER BY count(*) DESC, truth) AS r FROM dec WHERE seed=0 AND truth>=0 AND lesion % 2 = 0 GROUP BY 1,2) WHERE r=1) a ON a.sig = d.lesion % 7 AND d.lesion % 7 <> 3 CROSS JOIN (SELECT truth AS truth_best FROM (SELECT truth, row_number() OVER (ORDER BY count(*) DESC, truth) AS r FROM dec WHERE seed=0 AND truth>=0 AND lesion % 2 = 0 GROUP BY 1) WHERE r=1) g WHERE d.truth >= 0) GROUP BY 1,2,3"))
def lookup_backoff(spark, sf_dir):
    d = decisions(spark, sf_dir).where("truth >= 0").withColumn("sig", F.col("lesion") % 7)
    train = d.where("seed = 0 and lesion % 2 = 0")
    out = K.lookup_backoff(d, train, "sig", F.col("sig") != 3)
    return out.groupBy("seed", "sig", "pred_rule").agg(F.count("*").alias("n"), F.count_if(F.col("pred_rule") == F.col("truth")).alias("ok"))


@query(dsql("SELECT sig, round(avg((best = truth)::INT),6) AS acc, count(*) AS n FROM (SELECT x.lesion, x.sig, x.truth, (SELECT y.truth FROM d y WHERE y.sig = x.sig AND y.lesion <> x.lesion GROUP BY y.truth ORDER BY count(*) DESC, y.truth LIMIT 1) AS best FROM d x) GROUP BY 1", d="SELECT lesion, lesion % 9 AS sig, truth FROM dec WHERE seed = 0 AND truth >= 0"))
def loo_accuracy(spark, sf_dir):
    d = decisions(spark, sf_dir).where("seed = 0 and truth >= 0").select("lesion", (F.col("lesion") % 9).alias("sig"), "truth")
    return rounded(K.leave_one_out(d, "sig"))


@query(dsql("SELECT lesion, seed, truth, round((SELECT count(DISTINCT lesion) FROM dec WHERE truth>=0)::DOUBLE / (k.classes * c.n), 6) AS weight FROM dec JOIN (SELECT truth, count(DISTINCT lesion) AS n FROM dec WHERE truth>=0 GROUP BY 1) c USING (truth) CROSS JOIN (SELECT count(DISTINCT truth) AS classes FROM dec WHERE truth>=0) k"))
def type_weights(spark, sf_dir):
    d = decisions(spark, sf_dir).where("truth >= 0")
    n = d.groupBy("truth").agg(F.countDistinct("lesion").alias("n"))
    n = n.crossJoin(n.agg(F.sum("n").alias("all"), F.count("*").alias("classes")))
    return rounded(d.join(F.broadcast(n), "truth").select("lesion", "seed", "truth", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight")))


# ---- embeddings ----


@query("SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE * x::DOUBLE)), 5) AS energy, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings")
def block_mask(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(e.select("vec_id", K.energy(F.slice("embedding", 1, 8)).alias("energy"), F.sqrt(K.energy(F.col("embedding"))).alias("norm")), 5)


@query("SELECT vec_id, [round(exp(-(d - list_min(ds))/0.5)/list_sum(list_transform(ds, lambda z: exp(-(z - list_min(ds))/0.5))), 5) FOR d IN ds] AS soft FROM (SELECT vec_id, list_transform(embedding[1:6], lambda x: abs(x::DOUBLE)) AS ds FROM embeddings)")
def relative_encoding(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 6), lambda x: F.abs(x.cast("double"))).alias("ds"))
    return e.select("vec_id", F.transform(K.relative_encoding("ds", 0.5), lambda x: F.round(x, 5)).alias("soft"))


@query("SELECT vec_id, false AS mirrored, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, label FROM embeddings UNION ALL SELECT vec_id, true, embedding[2]::DOUBLE, embedding[1]::DOUBLE, CASE WHEN label < 8 THEN xor(label, 1) ELSE label END FROM embeddings")
def mirror_augment(spark, sf_dir):
    out = K.mirror_rows(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "mirrored", F.get("embedding", F.lit(0)).cast("double").alias("e0"), F.get("embedding", F.lit(1)).cast("double").alias("e1"), "label")


@query("WITH e AS (SELECT vec_id, label, embedding, (vec_id // 3) % 5 AS fold, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE*x::DOUBLE))) AS nrm FROM embeddings), s AS (SELECT a.vec_id, a.label AS truth, b.vec_id AS other, b.label, list_sum([x.a::DOUBLE * x.b::DOUBLE FOR x IN list_transform(range(1,65), lambda i: struct_pack(a := a.embedding[i], b := b.embedding[i]))]) / (a.nrm*b.nrm) AS sim FROM e a JOIN e b ON a.fold <> b.fold WHERE a.vec_id % 100 = 0), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim,9) DESC, other) AS r FROM s WHERE sim > 0), v AS (SELECT vec_id, truth, label, sum(sim*sim) AS w FROM t WHERE r <= 10 GROUP BY 1,2,3) SELECT vec_id, truth, label AS pred, round(w,5) AS w FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(w,9) DESC, label) AS q FROM v) WHERE q = 1")
def knn_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("fold", F.floor(F.col("vec_id") / 3) % 5)
    return rounded(K.knn_cosine(e, e.where("vec_id % 100 = 0"), k=10, power=2), 5)


# ---- junction nodes ----


def nsql(body: str, **more: str) -> str:
    return with_tables(body, "nodes", **more)


@query(nsql("SELECT case_id, node_id, len(class_ids) AS n_classes, list_max(class_ids) - list_min(class_ids) < 2 AS valid FROM nodes WHERE len(class_ids) >= 2"))
def validate_nodes(spark, sf_dir):
    ok = F.array_max("class_ids") - F.array_min("class_ids") < 2
    return nodes(spark, sf_dir).where(F.size("class_ids") >= 2).select("case_id", "node_id", F.size("class_ids").cast("bigint").alias("n_classes"), ok.alias("valid"))


@query(nsql("SELECT a, b, count(DISTINCT case_id) AS cases, round(count(DISTINCT case_id) * 1.0 / (SELECT count(DISTINCT case_id) FROM nodes), 6) AS rate FROM (SELECT n.case_id, x.c AS a, y.c AS b FROM nodes n, unnest(n.class_ids) x(c), unnest(n.class_ids) y(c) WHERE x.c < y.c) GROUP BY 1,2"))
def anchor_rates(spark, sf_dir):
    from voxtab.operators.junctions import anchor_rates as rates

    return rounded(rates(nodes(spark, sf_dir)))


@query(nsql("SELECT a.case_id, a.node_id, CASE WHEN min(b.node_id) IS NULL THEN 'false' ELSE 'true' END AS kind FROM nodes a LEFT JOIN nodes b ON a.case_id=b.case_id AND b.node_id % 2 = 1 AND a.class_ids = b.class_ids AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 2 WHERE a.node_id % 2 = 0 GROUP BY 1,2 UNION ALL SELECT b.case_id, b.node_id, 'missed' FROM nodes b LEFT JOIN nodes a ON a.case_id=b.case_id AND a.node_id % 2 = 0 AND a.class_ids = b.class_ids AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 2 WHERE b.node_id % 2 = 1 GROUP BY 1,2 HAVING min(a.node_id) IS NULL"))
def match_nodes(spark, sf_dir):
    from voxtab.operators.junctions import match_nodes as match

    n = nodes(spark, sf_dir)
    a, b = n.where("node_id % 2 = 0"), n.where("node_id % 2 = 1")
    missed = match(b, a, 2.0).where("kind = 'false'").select("case_id", "node_id", F.lit("missed").alias("kind"))
    return match(a, b, 2.0).unionByName(missed)


@query(nsql("SELECT sig, count(*) AS n, round(median(x),6) AS x, round(median(y),6) AS y, round(median(z),6) AS z FROM (SELECT array_to_string(class_ids, ',') AS sig, x, y, z FROM nodes WHERE len(class_ids) >= 2) GROUP BY 1 HAVING count(*) >= 5"))
def junction_atlas(spark, sf_dir):
    from voxtab.operators.junctions import atlas

    return rounded(atlas(nodes(spark, sf_dir).where(F.size("class_ids") >= 2), 5))


@query(nsql("SELECT a.case_id, a.node_id, count(b.node_id) AS near, count(b.node_id) FILTER (len(b.class_ids) >= 3) AS near3, round(min(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))),6) AS nearest FROM nodes a LEFT JOIN nodes b ON a.case_id=b.case_id AND a.node_id<>b.node_id AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 1.5 GROUP BY 1,2"))
def graph_features(spark, sf_dir):
    from voxtab.operators.junctions import node_neighbourhood

    return rounded(node_neighbourhood(nodes(spark, sf_dir), 1.5))


@query(nsql("SELECT n.case_id, n.node_id, round((n.x - o.x)/o.s,6) AS px, round((n.y - o.y)/o.s,6) AS py, round((n.z - o.z)/o.s,6) AS pz FROM nodes n JOIN (SELECT case_id, avg(x) AS x, avg(y) AS y, avg(z) AS z, CASE WHEN sqrt(var_pop(x)+var_pop(y)+var_pop(z)) > 0 THEN sqrt(var_pop(x)+var_pop(y)+var_pop(z)) ELSE 1 END AS s FROM nodes GROUP BY 1) o USING (case_id)"))
def landmark_pos(spark, sf_dir):
    from voxtab.operators.junctions import landmark_frame

    return rounded(landmark_frame(nodes(spark, sf_dir)))


@query("SELECT vec_id, CAST(label AS INT) AS label, 1.0::DOUBLE AS weight FROM embeddings UNION ALL SELECT vec_id, CAST(label + d AS INT), 0.1::DOUBLE FROM embeddings, (VALUES (-2), (2)) t(d) WHERE label BETWEEN 0 AND 7 AND label + d BETWEEN 0 AND 7")
def soft_label_copies(spark, sf_dir):
    """Neighbours are the segments before and after on the same side."""
    near = spark.createDataFrame([(c, c + d) for c in range(8) for d in (-2, 2) if 0 <= c + d < 8], "a int, b int")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    return K.soft_label_copies(rows, near, "label", 0.1)
