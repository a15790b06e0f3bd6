"""Queries over runs, folds and names."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.operators import experiments as E
from voxtab.operators import probability as P
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import folds, intensity, probs, runs, table, with_tables


def rsql(body: str, **more: str) -> str:
    return with_tables(body, "runs", **more)


TOTAL = "SELECT tag, count(*) AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(value) AS value FROM runs GROUP BY 1"


def totals(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("value").alias("value"))


@query(rsql("SELECT tag, n, tp, fp, fn, round(value,6) AS value, CASE WHEN tp > fp THEN 'good' WHEN tp = fp THEN 'even' ELSE 'poor' END AS status FROM t", t=TOTAL))
def leaderboard(spark, sf_dir):
    t = totals(spark, sf_dir)
    return rounded(t.withColumn("status", F.when(F.col("tp") > F.col("fp"), "good").when(F.col("tp") == F.col("fp"), "even").otherwise("poor")))


RANKS = "SELECT tag, rank() OVER (ORDER BY tp DESC) AS a, rank() OVER (ORDER BY fp) AS b, rank() OVER (ORDER BY fn) AS c, rank() OVER (ORDER BY round(value,9) DESC) AS d FROM t"


def ranks(spark, sf_dir):
    """A rank per tag and measure, over as many rows as there are tags."""
    t = totals(spark, sf_dir)
    order = {"a": F.desc("tp"), "b": F.col("fp"), "c": F.col("fn"), "d": F.desc(F.round("value", 9))}
    return t.select("tag", "tp", "fp", "fn", "value", *[F.rank().over(W.orderBy(o)).alias(n) for n, o in order.items()])


@query(rsql("SELECT tag, round((a+b+c+d)/4.0,6) AS mean_rank FROM r", t=TOTAL, r=RANKS))
def rank_runs(spark, sf_dir):
    return rounded(ranks(spark, sf_dir).select("tag", ((F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4).alias("mean_rank")))


@query(rsql("SELECT tag, round(literal,6) AS literal, round(aligned,6) AS aligned, rank() OVER (ORDER BY round(literal,9) DESC) = rank() OVER (ORDER BY round(aligned,9) DESC) AS agree FROM (SELECT tag, (tp + fp + fn) / n::DOUBLE AS literal, (tp - fp - fn) / n::DOUBLE AS aligned FROM t)", t=TOTAL))
def composite_rank(spark, sf_dir):
    t = totals(spark, sf_dir).select("tag", ((F.col("tp") + F.col("fp") + F.col("fn")) / F.col("n")).alias("literal"), ((F.col("tp") - F.col("fp") - F.col("fn")) / F.col("n")).alias("aligned"))
    r = lambda c: F.rank().over(W.orderBy(F.desc(F.round(c, 9))))
    return rounded(t.withColumn("agree", r("literal") == r("aligned")))


@query(rsql("SELECT round(avg(d),6) AS mean_diff, round(stddev_samp(d),6) AS sd, count(*) FILTER (d > 0) AS wins, count(*) AS seeds FROM (SELECT seed, avg(value) FILTER (tag='click') - avg(value) FILTER (tag='error') AS d FROM runs GROUP BY 1)"))
def paired_by_seed(spark, sf_dir):
    mean = lambda t: F.avg(F.when(F.col("tag") == t, F.col("value")))
    d = runs(spark, sf_dir).groupBy("seed").agg((mean("click") - mean("error")).alias("d"))
    return rounded(d.agg(F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"), F.count_if(F.col("d") > 0).alias("wins"), F.count("*").alias("seeds")))


@query(rsql("SELECT wins, losses, round((SELECT sum(exp(lgamma(wins+losses+1) - lgamma(k+1) - lgamma(wins+losses-k+1) - (wins+losses)*ln(2))) FROM range(0, 100000) r(k) WHERE k >= wins AND k <= wins+losses), 6) AS p_value FROM (SELECT count(*) FILTER (s > 0) AS wins, count(*) FILTER (s < 0) AS losses FROM (SELECT case_id, cls, sign(coalesce(c.h,0) - coalesce(b.h,0)) AS s FROM (SELECT case_id, cls, sum(tp) AS h FROM runs WHERE tag='click' GROUP BY 1,2) b FULL JOIN (SELECT case_id, cls, sum(tp) AS h FROM runs WHERE tag='error' GROUP BY 1,2) c USING (case_id, cls)))"))
def sign_test(spark, sf_dir):
    hits = lambda t: runs(spark, sf_dir).where(F.col("tag") == t).groupBy("case_id", "cls").agg(F.sum("tp").alias("hits"))
    return rounded(E.paired_counts(hits("click"), hits("error"), ["case_id", "cls"]))


NO = "SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT case_id FROM runs)"
WEIGHT = "SELECT d.b, x.case_id, count(*) AS w FROM (SELECT b, (b*7919 + no*104729 + b*no*31 + 17) % n AS pick FROM no, range(0,40) t(b)) d JOIN no x ON x.no = d.pick GROUP BY 1,2"


@query(rsql("SELECT tag, round(quantile_cont(m,0.025),6) AS low, round(quantile_cont(m,0.975),6) AS high, round(stddev_pop(m),6) AS sd FROM (SELECT tag, b, sum(tp*w)::DOUBLE / sum((tp+fp)*w) AS m FROM runs JOIN weight USING (case_id) GROUP BY 1,2) GROUP BY 1", no=NO, weight=WEIGHT))
def bootstrap_ci(spark, sf_dir):
    r = runs(spark, sf_dir)
    per = r.groupBy("tag", "case_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    m = per.join(E.bootstrap_weights(r, "case_id", 40), "case_id").groupBy("tag", "b").agg((F.sum(F.col("tp") * F.col("w")) / F.sum((F.col("tp") + F.col("fp")) * F.col("w"))).alias("m"))
    return rounded(m.groupBy("tag").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.stddev_pop("m").alias("sd")))


@query(rsql("SELECT round(avg(d),6) AS mean_diff, round(quantile_cont(d,0.025),6) AS low, round(quantile_cont(d,0.975),6) AS high, round(avg((d>0)::INT),6) AS win FROM (SELECT b, sum(tp*w) FILTER (tag='click')::DOUBLE / sum((tp+fp)*w) FILTER (tag='click') - sum(tp*w) FILTER (tag='error')::DOUBLE / sum((tp+fp)*w) FILTER (tag='error') AS d FROM runs JOIN weight USING (case_id) GROUP BY 1)", no=NO, weight=WEIGHT))
def paired_bootstrap(spark, sf_dir):
    r = runs(spark, sf_dir).where("tag in ('click', 'error')")
    per = r.groupBy("tag", "case_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    x = per.join(E.bootstrap_weights(runs(spark, sf_dir), "case_id", 40), "case_id")
    rate = lambda t: F.sum(F.when(F.col("tag") == t, F.col("tp") * F.col("w"))) / F.sum(F.when(F.col("tag") == t, (F.col("tp") + F.col("fp")) * F.col("w")))
    d = x.groupBy("b").agg((rate("click") - rate("error")).alias("d"))
    return rounded(d.agg(F.avg("d").alias("mean_diff"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.avg((F.col("d") > 0).cast("int")).alias("win")))


@query(rsql("SELECT n, round(avg(d),6) AS mean_diff, round(stddev_pop(d),6) AS sd FROM (SELECT n, b, avg(value) FILTER (tag='click') - avg(value) FILTER (tag='error') AS d FROM runs JOIN (SELECT b, case_id, row_number() OVER (PARTITION BY b ORDER BY (case_id*7919 + b*104729) % 10007, case_id) AS r FROM (SELECT DISTINCT case_id FROM runs), range(0,20) t(b)) USING (case_id), (VALUES (10),(40),(100)) v(n) WHERE r <= n GROUP BY 1,2) GROUP BY 1"))
def size_effect(spark, sf_dir):
    r = runs(spark, sf_dir)
    per = r.groupBy("tag", "case_id").agg(F.sum("value").alias("v"), F.count("*").alias("m"))
    cases = r.select("case_id").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(19))))
    order = (F.col("case_id") * 7919 + F.col("b") * 104729) % 10007
    top = cases.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(order, "case_id"))).where("r <= 100")
    x = per.join(top, "case_id").withColumn("n", F.explode(F.array(*[F.lit(v) for v in (10, 40, 100)]))).where("r <= n")
    mean = lambda t: F.sum(F.when(F.col("tag") == t, F.col("v"))) / F.sum(F.when(F.col("tag") == t, F.col("m")))
    d = x.groupBy("n", "b").agg((mean("click") - mean("error")).alias("d"))
    return rounded(d.groupBy("n").agg(F.avg("d").alias("mean_diff"), F.stddev_pop("d").alias("sd")))


@query(rsql("SELECT seed, CASE WHEN cls IN (1,3) THEN 'weak' ELSE 'strong' END AS grp, sum(tp)::BIGINT AS tp, sum(tp+fn)::BIGINT AS gt, sum(fp)::BIGINT AS fp FROM runs GROUP BY 1,2"))
def weak_report(spark, sf_dir):
    grp = F.when(F.col("cls").isin(1, 3), "weak").otherwise("strong")
    return runs(spark, sf_dir).groupBy("seed", grp.alias("grp")).agg(F.sum("tp").alias("tp"), F.sum(F.col("tp") + F.col("fn")).alias("gt"), F.sum("fp").alias("fp"))


@query(rsql("SELECT seed, cls, round(avg(value),6) AS value, sum(tp)::BIGINT AS tp, count(DISTINCT cls) FILTER (tp > 0) AS alive FROM runs GROUP BY GROUPING SETS ((cls), (seed), ())"))
def fold_summary(spark, sf_dir):
    return rounded(spark.sql("SELECT seed, cls, avg(value) AS value, sum(tp) AS tp, count(DISTINCT CASE WHEN tp > 0 THEN cls END) AS alive FROM {rows} GROUP BY GROUPING SETS ((cls), (seed), ())", rows=runs(spark, sf_dir)))


@query(rsql("SELECT better, ok_mcc, better >= 2 AND ok_mcc AS adopt FROM (SELECT count(*) FILTER (d * dir > 0) AS better, bool_and(d * dir >= 0) FILTER (m = 'tp') AS ok_mcc FROM (SELECT m, dir, avg(v) FILTER (tag='click') - avg(v) FILTER (tag='error') AS d FROM (SELECT tag, m, CASE WHEN m IN ('fp','fn') THEN -1 ELSE 1 END AS dir, v FROM (SELECT tag, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, value FROM runs) UNPIVOT (v FOR m IN (tp, fp, fn, value))) GROUP BY 1,2))"))
def adoption_verdict(spark, sf_dir):
    r = runs(spark, sf_dir).select("tag", *[F.col(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "value")])
    long = r.unpivot("tag", ["tp", "fp", "fn", "value"], "m", "v").withColumn("dir", F.when(F.col("m").isin("fp", "fn"), -1).otherwise(1))
    mean = lambda t: F.avg(F.when(F.col("tag") == t, F.col("v")))
    d = long.groupBy("m", "dir").agg((mean("click") - mean("error")).alias("d"))
    out = d.agg(F.count_if(F.col("d") * F.col("dir") > 0).alias("better"), F.bool_and(F.when(F.col("m") == "tp", F.col("d") * F.col("dir") >= 0)).alias("ok_mcc"))
    return out.withColumn("adopt", (F.col("better") >= 2) & F.col("ok_mcc"))


@query(rsql("SELECT cls, sum(tp) FILTER (tag='click')::BIGINT AS base, sum(tp) FILTER (tag='error')::BIGINT AS cand, (sum(tp) FILTER (tag='error') - sum(tp) FILTER (tag='click'))::BIGINT AS gain FROM runs GROUP BY 1"))
def hit_tally(spark, sf_dir):
    p = runs(spark, sf_dir).groupBy("cls").pivot("tag", ["click", "error"]).agg(F.sum("tp"))
    return p.select("cls", F.col("click").alias("base"), F.col("error").alias("cand"), (F.col("error") - F.col("click")).alias("gain"))


@query(with_tables("SELECT case_id, f.patient_id, CAST((r - 1) % 5 AS INT) AS fold FROM folds f JOIN (SELECT patient_id, row_number() OVER (ORDER BY count(*) DESC, patient_id) AS r FROM folds GROUP BY 1) USING (patient_id)", "folds"))
def group_kfold(spark, sf_dir):
    return E.group_kfold(folds(spark, sf_dir), 5).select("case_id", "patient_id", "fold")


@query(with_tables("SELECT 5::BIGINT AS folds, 0::BIGINT AS leaks, count(*) AS cases FROM folds", "folds"))
def leak_check(spark, sf_dir):
    f = E.group_kfold(folds(spark, sf_dir), 5)
    return f.agg(F.countDistinct("fold").alias("folds"), F.count("*").alias("cases")).crossJoin(E.leaks(f).agg(F.count("*").alias("leaks")))


@query(with_tables("SELECT modality, round((sum(r) FILTER (pos) - (count(*) FILTER (pos))*(count(*) FILTER (pos)+1)/2.0) / ((count(*) FILTER (pos))*(count(*) FILTER (NOT pos))), 6) AS auc FROM (SELECT modality, mask='aneurysm' AS pos, rank() OVER (PARTITION BY modality ORDER BY value) + (count(*) OVER (PARTITION BY modality, value) - 1)/2.0 AS r FROM inten WHERE mask <> 'brain') GROUP BY 1", "inten"))
def auc(spark, sf_dir):
    x = intensity(spark, sf_dir).where("mask <> 'brain'")
    return rounded(E.rank_sum_auc(x, "modality", F.col("mask") == "aneurysm"))


@query(with_tables("SELECT modality, round(greatest(0, least(a1, v1) - greatest(a0, v0)) / (greatest(a1, v1) - least(a0, v0)), 6) AS share FROM (SELECT modality, min(value) FILTER (mask='aneurysm') AS a0, max(value) FILTER (mask='aneurysm') AS a1, min(value) FILTER (mask='vessel') AS v0, max(value) FILTER (mask='vessel') AS v1 FROM inten GROUP BY 1)", "inten"))
def interval_overlap(spark, sf_dir):
    of = lambda f, m: f(F.when(F.col("mask") == m, F.col("value")))
    x = intensity(spark, sf_dir).groupBy("modality").agg(of(F.min, "aneurysm").alias("a0"), of(F.max, "aneurysm").alias("a1"), of(F.min, "vessel").alias("v0"), of(F.max, "vessel").alias("v1"))
    inside = F.greatest(F.lit(0.0), F.least("a1", "v1") - F.greatest("a0", "v0"))
    return rounded(x.select("modality", (inside / (F.greatest("a1", "v1") - F.least("a0", "v0"))).alias("share")))


@query(with_tables("SELECT count(*) FILTER (b AND NOT a) AS fixed, count(*) FILTER (a AND NOT b) AS broken, count(*) AS n FROM (SELECT lesion, bool_or(cls=truth) FILTER (seed=0) AS a, bool_or(cls=truth) FILTER (seed=1) AS b FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY round(p,9) DESC, cls) AS r FROM probs) WHERE r=1 GROUP BY 1)", "probs"))
def fix_break(spark, sf_dir):
    best = P.argmax(probs(spark, sf_dir), ("lesion", "seed")).withColumn("ok", F.col("cls") == F.col("truth"))
    of = lambda s: F.bool_or(F.when(F.col("seed") == s, F.col("ok")))
    x = best.groupBy("lesion").agg(of(0).alias("a"), of(1).alias("b"))
    return x.agg(F.count_if(F.col("b") & ~F.col("a")).alias("fixed"), F.count_if(F.col("a") & ~F.col("b")).alias("broken"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'R-' ELSE 'L-' END AS side, regexp_extract(p_brand, '([0-9]+)$', 1) AS code, CAST(left(regexp_extract(p_brand, '([0-9]+)$', 1), 1) AS INT) AS grp, split_part(p_name, ' ', 2) AS family, (CASE WHEN p_partkey % 2 = 0 THEN 'R-' ELSE 'L-' END) || split_part(p_name, ' ', 2) AS restored FROM part")
def class_name_parts(spark, sf_dir):
    side = F.when(F.col("p_partkey") % 2 == 0, "R-").otherwise("L-")
    code = F.regexp_extract("p_brand", "([0-9]+)$", 1)
    family = F.split_part("p_name", F.lit(" "), F.lit(2))
    return table(spark, sf_dir, "part").select("p_partkey", side.alias("side"), code.alias("code"), F.left(code, F.lit(1)).cast("int").alias("grp"), family.alias("family"), F.concat(side, family).alias("restored"))


CODES = "SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS code FROM part"


def codes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("code")).distinct()


@query(f"WITH c AS ({CODES}) SELECT a.code AS a, b.code AS b FROM c a JOIN c b ON a.code // 10 = b.code // 10 AND abs(a.code - b.code) = 1")
def adjacent_classes(spark, sf_dir):
    c = codes(spark, sf_dir)
    near = c.select(F.col("code").alias("a"), F.explode(F.array(F.col("code") - 1, F.col("code") + 1)).alias("b"))
    return near.join(c.select(F.col("code").alias("b")), "b").where(F.floor(F.col("a") / 10) == F.floor(F.col("b") / 10)).select("a", "b")


@query(f"WITH RECURSIVE c AS ({CODES}), e AS (SELECT a.code AS a, b.code AS b FROM c a JOIN c b ON abs(a.code - b.code) IN (1, 5)), h(a, b, n) AS (SELECT code, code, 0 FROM c UNION SELECT h.a, e.b, h.n + 1 FROM h JOIN e ON h.b = e.a WHERE h.n < 3) SELECT a, b, min(n) AS hops FROM h GROUP BY 1, 2")
def class_hops(spark, sf_dir):
    c = codes(spark, sf_dir)
    edges = c.select(F.col("code").alias("b"), F.explode(F.array(*[F.col("code") + d for d in (-5, -1, 1, 5)])).alias("to")).join(c.select(F.col("code").alias("to")), "to")
    reach = c.select(F.col("code").alias("a"), F.col("code").alias("b"), F.lit(0).alias("n"))
    step = reach
    for _ in range(3):  # the class graph is as small as the taxonomy
        step = step.join(F.broadcast(edges), "b").select("a", F.col("to").alias("b"), (F.col("n") + 1).alias("n")).distinct()
        reach = reach.unionByName(step)
    return reach.groupBy("a", "b").agg(F.min("n").alias("hops"))


HALVES = "SELECT m::INT AS half, bit_count(m::INT)::INT AS k FROM range(1, 32) t(m) WHERE bit_count(m::INT) IN (2, 3)"
SIDES = "SELECT tag, half, sign(coalesce(sum(tp) FILTER ((half >> seed) & 1 = 1), 0) * (5 - k) - coalesce(sum(tp) FILTER ((half >> seed) & 1 = 0), 0) * k) AS s FROM runs, halves GROUP BY tag, half, k, case_id, cls"
SPLITS = "SELECT tag, half, count(*) FILTER (s > 0) AS wins, count(*) FILTER (s < 0) AS losses FROM sides GROUP BY 1, 2"


@query(rsql("SELECT tag, half, wins, losses, CASE WHEN wins + losses > 0 THEN round((wins - (wins + losses) / 2.0 - 0.5) / (sqrt(wins + losses) / 2), 6) END AS z FROM splits", halves=HALVES, sides=SIDES, splits=SPLITS))
def sign_test_null(spark, sf_dir):
    hits = runs(spark, sf_dir).withColumnRenamed("tp", "hits")
    return rounded(E.null_splits(hits, "tag", ["case_id", "cls"], 5))
