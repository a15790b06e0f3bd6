"""Queries of class means, feature blocks, recovery curves and the streaming leaderboard, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtab.operators import learning as L
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import decisions, nodes, probs, table, vox, with_tables
from voxtab.streaming.leaderboard import stream_leaderboard as board_of_stream

#: Components of a vector; all are read.
DIMS = 64
#: DuckDB: embeddings with their fold, the components as doubles, and one row per component.
E = "SELECT vec_id, CAST(label AS INT) AS label, (vec_id // 3) % 5 AS fold, [v::DOUBLE FOR v IN embedding] AS x FROM embeddings"
LONG = "SELECT {by} vec_id, label, fold, d, x[d] AS v FROM {src}, range(1, {top}) t(d)"
MEANS = "SELECT f.fold, {by} m.label, m.d, sum(m.v) FILTER (m.fold <> f.fold) / count(*) FILTER (m.fold <> f.fold) AS mean FROM long m, (SELECT DISTINCT fold FROM e) f GROUP BY ALL"
NEAR = "SELECT {by} l.vec_id, l.label, m.label AS pred, row_number() OVER (PARTITION BY {by} l.vec_id ORDER BY round(sum((l.v - m.mean) * (l.v - m.mean)), 9), m.label) AS r FROM long l JOIN means m ON l.fold = m.fold AND l.d = m.d {on} GROUP BY {group} l.vec_id, l.label, m.label"


def esql(body: str, by: str = "", on: str = "", e: str = E, src: str = "e", top: int = DIMS + 1, **more: str) -> str:
    names = by.rstrip(", ")
    own = f"l.{names}, " if names else ""
    return with_tables(body, e=e, **more, long=LONG.format(by=by, src=src, top=top), means=MEANS.format(by=f"m.{names}, " if names else ""), near=NEAR.format(by=own, on=on, group=own))


def embedded(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("int").alias("label"), (F.floor(F.col("vec_id") / 3) % 5).alias("fold"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query(esql("SELECT vec_id, label, pred FROM near WHERE r = 1"))
def oof_class_mean(spark, sf_dir):
    """EXP2: each row is predicted by class means of the other folds."""
    e = embedded(spark, sf_dir)
    return L.nearest_mean(e, L.means_without_fold(e, [], DIMS), []).select("vec_id", "label", "pred")


BLOCKS = {"first": (0, 32), "second": (32, 64), "both": (0, 64)}


@query(
    esql(
        "SELECT block, count(*) AS n, sum((pred = label)::INT)::BIGINT AS hits FROM near WHERE r = 1 GROUP BY 1", by="block, ", on="AND l.block = m.block", src="b",
        b="SELECT e.vec_id, e.label, e.fold, k.block, list_concat(e.x[k.lo:k.hi], [0.0::DOUBLE FOR i IN range(64 - (k.hi - k.lo + 1))]) AS x FROM e, (VALUES ('first', 1, 32), ('second', 33, 64), ('both', 1, 64)) k(block, lo, hi)",
    )
)
def ablation_grid(spark, sf_dir):
    """EXP3: out-of-fold hits with each block of components alone and with both."""
    b = L.blocks_of(embedded(spark, sf_dir), BLOCKS)
    pred = L.nearest_mean(b, L.means_without_fold(b, ["block"], DIMS), ["block"])
    return pred.groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("hits"))


@query(
    esql(
        "SELECT draw, count(*) AS n, sum((pred = label)::INT)::BIGINT AS hits FROM near WHERE r = 1 GROUP BY 1", by="draw, ", on="AND l.draw = m.draw", src="b",
        b="SELECT e.*, t.draw FROM e, range(0, 10) t(draw) WHERE (e.vec_id * 7919 + t.draw * 104729 + e.vec_id * t.draw * 31) % 100 >= 5",
    )
)
def noise_floor(spark, sf_dir):
    """EXP12: out-of-fold hits in draws that leave about one row in twenty out."""
    turn = (F.col("vec_id") * 7919 + F.col("draw") * 104729 + F.col("vec_id") * F.col("draw") * 31) % 100
    e = embedded(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")))).where(turn >= 5)
    pred = L.nearest_mean(e, L.means_without_fold(e, ["draw"], DIMS), ["draw"])
    return pred.groupBy("draw").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("hits"))


@query(
    "WITH e AS (SELECT vec_id, CAST(label AS INT) AS label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), m AS (SELECT label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, sum(a*a) - count(*)*avg(a)*avg(a) AS aa, sum(b*b) - count(*)*avg(b)*avg(b) AS bb, sum(a*b) - count(*)*avg(a)*avg(b) AS ab FROM e GROUP BY 1),"
    " c AS (SELECT sum(aa)/(sum(n)-count(*)) AS aa, sum(bb)/(sum(n)-count(*)) AS bb, sum(ab)/(sum(n)-count(*)) AS ab FROM m), d AS (SELECT vec_id, e.label, m.label AS cls, ((a-ma)*(a-ma)*c.bb - 2*(a-ma)*(b-mb)*c.ab + (b-mb)*(b-mb)*c.aa) / (c.aa*c.bb - c.ab*c.ab) AS d FROM e, m, c),"
    " w AS (SELECT *, exp(-(d - min(d) OVER (PARTITION BY vec_id)) / 2) AS w FROM d) SELECT vec_id, label, cls, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS p FROM w"
)
def mahalanobis_proba(spark, sf_dir):
    """CLF7 on the two leading components."""
    return rounded(L.mahalanobis(embedded(spark, sf_dir), 2))


@query(
    "WITH b AS (SELECT vec_id, [1/(1+abs(v::DOUBLE)*10) FOR v IN embedding[1:24]] AS a, [abs(v::DOUBLE) FOR v IN embedding[25:44]] AS o, [abs(v::DOUBLE)*20 FOR v IN embedding[45:64]] AS n FROM embeddings),"
    " c AS (SELECT vec_id, a, [CASE WHEN list_sum(o) > 0 THEN v/list_sum(o) ELSE 0.0 END FOR v IN o] AS o, [CASE WHEN v <= 2 THEN exp(-v) ELSE 0.0 END FOR v IN n] AS n FROM b),"
    " u AS (SELECT vec_id, sqrt(list_sum([v*v FOR v IN a])) AS ua, sqrt(list_sum([v*v FOR v IN o])) AS uo, sqrt(list_sum([v*v FOR v IN n])) AS un, a, o, n FROM c)"
    " SELECT vec_id, list_concat([round(CASE WHEN ua > 0 THEN v/ua ELSE v END, 5) FOR v IN a], [round(CASE WHEN uo > 0 THEN v/uo ELSE v END * 0.5, 5) FOR v IN o], [round(CASE WHEN un > 0 THEN v/un ELSE v END * 0.25, 5) FOR v IN n]) AS vec FROM u"
)
def vectorise_blocks(spark, sf_dir):
    """FEA2, mode sharp: the first 24 components stand for distances, 20 for overlaps and 20 for distances from junctions."""
    part = lambda lo, n, times: F.transform(F.slice("x", lo, n), lambda v: F.abs(v) * times)
    vec = L.vectorise(part(1, 24, 10.0), part(25, 20, 1.0), part(45, 20, 20.0), "sharp", 2.0, (1.0, 0.5, 0.25))
    return embedded(spark, sf_dir).select("vec_id", F.transform(vec, lambda v: F.round(v, 5)).alias("vec"))


@query("WITH e AS (SELECT vec_id, CAST(label AS INT) AS label, [v::DOUBLE FOR v IN embedding] AS x FROM embeddings), r AS (SELECT label FROM e GROUP BY 1 HAVING count(*) * 10 < (SELECT count(*) FROM e)), n AS (SELECT *, lead(x) OVER w AS nx FROM e JOIN r USING (label) WINDOW w AS (PARTITION BY label, vec_id IS NULL ORDER BY vec_id)) SELECT vec_id, label, [round(x[d] + (nx[d] - x[d]) * 0.3, 6) FOR d IN range(1, 65)] AS x FROM n WHERE nx IS NOT NULL")
def minority_interpolation(spark, sf_dir):
    """FEA16: between rows of labels that hold less than a tenth of all rows."""
    e = embedded(spark, sf_dir)
    sizes = e.groupBy("label").agg(F.count("*").alias("n"))
    rare = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).where("n * 10 < all").select("label")
    signed = lambda v: F.when(v < 0, -F.round(-v, 6)).otherwise(F.round(v, 6))  # noqa: E731  # DuckDB rounds to -0.0, too
    return L.interpolated_rows(e, rare, 0.3).select("vec_id", "label", F.transform("x", signed).alias("x"))


PRESENCE = "SELECT k.share, k.draw, k.case_id, c.cls, max(coalesce(k.truth = c.cls, false)::INT) AS t, max(coalesce(k.q = c.cls, false)::INT) AS p FROM k, unnest([x FOR x IN list_distinct([k.truth, k.q]) IF x IS NOT NULL AND x >= 0]) c(cls) GROUP BY 1, 2, 3, 4"


@query(
    with_tables(
        "SELECT share, draw, round(avg(CASE WHEN (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 THEN (tp*tn-fp*fn)/sqrt((tp+fp)*(tp+fn)*(tn+fp)*(tn+fn)) ELSE 0 END), 6) AS macro_mcc, count(*) AS classes FROM (SELECT *, (SELECT count(DISTINCT case_id) FROM dec)::DOUBLE - tp - fp - fn AS tn FROM (SELECT share, draw, cls, sum(t*p)::DOUBLE AS tp, sum((1-t)*p)::DOUBLE AS fp, sum(t*(1-p))::DOUBLE AS fn FROM here GROUP BY 1,2,3) WHERE tp + fn > 0) GROUP BY 1, 2",
        "dec",
        k="SELECT s.share::DOUBLE AS share, CAST(t.draw AS INT) AS draw, case_id, truth, CASE WHEN pred IS NULL AND truth >= 0 AND (lesion*7919 + t.draw*104729 + lesion*t.draw*31) % 1000 < s.share * 1000 THEN truth ELSE pred END AS q FROM dec, (VALUES (0.0), (0.25), (0.5), (1.0)) s(share), range(0, 5) t(draw) WHERE seed = 0",
        here=PRESENCE,
    )
)
def recovery_curve(spark, sf_dir):
    """SCO16: macro-MCC when a share of the missed units is found, in five draws."""
    d = decisions(spark, sf_dir).where("seed = 0")
    return rounded(L.macro_mcc(L.recovered(d, [0.0, 0.25, 0.5, 1.0], 5), ["share", "draw"]))


@query(with_tables("SELECT truth, step, count(*) AS n, sum(found)::BIGINT AS found, round(1 - sum(found) * 1.0 / count(*), 6) AS miss_rate FROM (SELECT a.lesion, a.truth, s.step, max((b.pred = b.truth)::INT) AS found FROM (SELECT DISTINCT lesion, truth FROM dec WHERE truth >= 0) a, (VALUES (0), (1), (2)) s(step) JOIN dec b ON b.seed <= s.step WHERE b.lesion = a.lesion GROUP BY 1, 2, 3) GROUP BY 1, 2".replace("(b.pred = b.truth)::INT", "coalesce(b.pred = b.truth, false)::INT"), "dec"))
def ladder_recovery(spark, sf_dir):
    """SCO17: units found by a variant or any before it on the ladder, by class."""
    d = decisions(spark, sf_dir).where("truth >= 0")
    hits = d.groupBy("lesion", "truth").agg(*[F.max(F.when(F.col("seed") <= s, F.coalesce(F.col("pred") == F.col("truth"), F.lit(False)).cast("int"))).alias(f"_{s}") for s in range(3)])
    steps = hits.select("truth", F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"_{s}").alias("found")) for s in range(3)])).alias("x")).select("truth", "x.*")
    return rounded(steps.groupBy("truth", "step").agg(F.count("*").alias("n"), F.sum("found").cast("bigint").alias("found"), (1 - F.sum("found") / F.count("*")).alias("miss_rate")))


@query(with_tables("SELECT t.t::DOUBLE AS t, count(DISTINCT CASE WHEN lesion % 11 <> 0 AND cls = truth AND p >= t.t THEN lesion END) AS hit, round(count(DISTINCT CASE WHEN lesion % 11 <> 0 AND cls = truth AND p >= t.t THEN lesion END) * 1.0 / count(DISTINCT CASE WHEN lesion % 11 <> 0 THEN lesion END), 6) AS sensitivity, round(count(DISTINCT CASE WHEN lesion % 11 = 0 AND p >= t.t THEN lesion END) * 1.0 / count(DISTINCT case_id), 6) AS fp_per_case FROM probs, (VALUES (0.0), (0.1), (0.15), (0.2), (0.3)) t(t) WHERE seed = 0 GROUP BY 1", "probs"))
def prob_threshold_sweep(spark, sf_dir):
    """SCO8 over thresholds of probability; cases without a detection count as cases."""
    p = probs(spark, sf_dir).where("seed = 0").withColumn("t", F.explode(F.array(*[F.lit(t) for t in (0.0, 0.1, 0.15, 0.2, 0.3)])))
    real, kept = F.col("lesion") % 11 != 0, F.col("p") >= F.col("t")
    units = p.groupBy("t", "case_id", "lesion").agg(F.max(real).alias("real"), F.max(real & (F.col("cls") == F.col("truth")) & kept).alias("hit"), F.max(~real & kept).alias("fp"))
    out = units.groupBy("t").agg(F.count_if("hit").alias("hit"), F.count_if("real").alias("real"), F.count_if("fp").alias("fp"), F.countDistinct("case_id").alias("cases"))
    return rounded(out.select("t", "hit", (F.col("hit") / F.col("real")).alias("sensitivity"), (F.col("fp") / F.col("cases")).alias("fp_per_case")))


@query(with_tables("SELECT p.lesion, p.cls, round(avg(p), 6) AS p, a.tables FROM probs p JOIN (SELECT lesion, count(DISTINCT seed) AS tables FROM (SELECT lesion, seed, list_sort(list(cls)) AS axis FROM probs GROUP BY 1, 2) GROUP BY 1 HAVING count(DISTINCT axis) = 1) a USING (lesion) GROUP BY 1, 2, 4", "probs"))
def multi_table_ensemble(spark, sf_dir):
    """CLF13: the average over tables, for units whose tables have one class axis."""
    p = probs(spark, sf_dir)
    axis = p.groupBy("lesion", "seed").agg(F.sort_array(F.collect_set("cls")).alias("axis"))
    same = axis.groupBy("lesion").agg(F.countDistinct("seed").alias("tables"), F.min("axis").alias("a"), F.max("axis").alias("b")).where("a = b").select("lesion", "tables")
    return rounded(p.join(same, "lesion").groupBy("lesion", "cls", "tables").agg(F.avg("p").alias("p")))


@query(with_tables("SELECT case_id, plane, u, w, max(cls) AS v, count(*) AS n FROM (SELECT case_id, cls, unnest([{'plane': 'ij', 'u': i // 4, 'w': j // 4}, {'plane': 'ik', 'u': i // 4, 'w': k // 4}, {'plane': 'jk', 'u': j // 4, 'w': k // 4}], recursive := true) FROM vox WHERE layer = 'R') GROUP BY 1, 2, 3, 4", "vox"))
def mip_features(spark, sf_dir):
    """CRP2: the largest value along each axis, on a grid of cells of four steps."""
    cell = lambda a: F.floor(F.col(a) / 4).cast("int")
    planes = F.array(*[F.struct(F.lit(a + b).alias("plane"), cell(a).alias("u"), cell(b).alias("w")) for a, b in ("ij", "ik", "jk")])
    x = vox(spark, sf_dir, "R").select("case_id", "cls", F.explode(planes).alias("x")).select("case_id", "cls", "x.*")
    return x.groupBy("case_id", "plane", "u", "w").agg(F.max("cls").alias("v"), F.count("*").alias("n"))


@query(with_tables("SELECT case_id, axis, q, v FROM (SELECT c.case_id, t.q::DOUBLE AS q, unnest([{'axis': 'i', 'v': arg_min(v.i, abs(v.i - c.qi) * 1000 + v.i * 0.001)}], recursive := true) FROM (SELECT case_id, t.q, quantile_cont(i, t.q) AS qi FROM vox, (VALUES (0.25), (0.5), (0.75)) t(q) WHERE layer = 'R' GROUP BY 1, 2) c JOIN vox v ON v.case_id = c.case_id AND v.layer = 'R', (SELECT 1) z, (VALUES (0.25), (0.5), (0.75)) t(q) WHERE t.q = c.q GROUP BY 1, 2)".replace("quantile_cont(i, t.q)", "quantile_cont(i, [0.25, 0.5, 0.75])[CAST(t.q * 4 AS INT)]"), "vox"))
def axis_quantile_pick(spark, sf_dir):
    """PRB14 along the first axis: the plane with a voxel nearest to each quantile, ties to the smaller."""
    v = vox(spark, sf_dir, "R").select("case_id", "i")
    qs = [0.25, 0.5, 0.75]
    targets = v.groupBy("case_id").agg(F.percentile("i", F.array(*[F.lit(q) for q in qs])).alias("t"))
    each = targets.select("case_id", F.posexplode("t").alias("no", "target")).withColumn("q", F.get(F.array(*[F.lit(q) for q in qs]), F.col("no")))
    near = each.join(v.distinct(), "case_id").groupBy("case_id", "q").agg(F.min_by("i", F.struct(F.round(F.abs(F.col("i") - F.col("target")), 9), "i")).alias("v"))
    return near.select("case_id", F.lit("i").alias("axis"), "q", "v")


@query(with_tables("SELECT n.case_id, n.node_id, round(m.mid, 6) AS mid, CASE WHEN n.x < m.mid THEN 'R' ELSE 'L' END AS side, abs(n.x - m.mid) >= 3 AS hard FROM nodes n JOIN (SELECT case_id, median(x) AS mid FROM nodes WHERE list_contains(class_ids, 4) GROUP BY 1) m USING (case_id)", "nodes"))
def side_constraint(spark, sf_dir):
    """GRA17: the mid-line is the median x of nodes with the mid-line class; a node is on a side, surely so from 3 mm on."""
    n = nodes(spark, sf_dir)
    mid = n.where(F.array_contains("class_ids", 4)).groupBy("case_id").agg(F.percentile("x", F.lit(0.5)).alias("mid"))
    y = n.join(mid, "case_id")
    return rounded(y.select("case_id", "node_id", "mid", F.when(F.col("x") < F.col("mid"), "R").otherwise("L").alias("side"), (F.abs(F.col("x") - F.col("mid")) >= 3).alias("hard")))


@query(with_tables("SELECT case_id, n, round(slope, 6) AS slope, round(fit_error, 6) AS fit_error, round(flat_error, 6) AS flat_error, flat_error - fit_error >= 0.01 AS accepted FROM (SELECT p.case_id, count(*) AS n, max(s.slope) AS slope, sqrt(avg(pow((p.y - s.my - s.slope * (p.x - s.mx)) / (1 - 1.0/s.n - (p.x - s.mx)*(p.x - s.mx)/s.sxx), 2))) AS fit_error, sqrt(avg(pow((p.y - s.my) / (1 - 1.0/s.n), 2))) AS flat_error FROM nodes p JOIN s USING (case_id) WHERE s.n >= 5 AND s.sxx > 0 GROUP BY 1)", "nodes", s="SELECT case_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) / nullif(var_pop(x), 0) AS slope FROM nodes GROUP BY 1"))
def cut_regression(spark, sf_dir):
    """GRA18: a line through a case's node positions against their mean, by leave-one-out errors in closed form."""
    n = nodes(spark, sf_dir)
    s = n.groupBy("case_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.var_pop("x") * F.count("*")).alias("sxx"), (F.covar_pop("x", "y") / F.nullif(F.var_pop("x"), F.lit(0.0))).alias("slope"))
    y = n.join(s.where("n >= 5 and sxx > 0"), "case_id")
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    fit, flat = (dy - F.col("slope") * dx) / (1 - 1 / F.col("n") - dx * dx / F.col("sxx")), dy / (1 - 1 / F.col("n"))
    out = y.groupBy("case_id").agg(F.count("*").alias("n"), F.max("slope").alias("slope"), F.sqrt(F.avg(fit * fit)).alias("fit_error"), F.sqrt(F.avg(flat * flat)).alias("flat_error"))
    return rounded(out.withColumn("accepted", F.col("flat_error") - F.col("fit_error") >= 0.01))


@query(with_tables("SELECT d.case_id, count(*) AS lesions, count(n.case_id) AS matched, count(*) - count(n.case_id) AS missed, sum(n.n_transition_vox)::BIGINT AS vox FROM dec d LEFT JOIN nodes n ON n.case_id = d.case_id AND n.node_id = d.lesion % 100 WHERE d.seed = 0 GROUP BY 1", "dec", "nodes"))
def join_features(spark, sf_dir):
    """FEA14: rows matched with features by two keys, and how many found none."""
    d = decisions(spark, sf_dir).where("seed = 0").select("case_id", "lesion", (F.col("lesion") % 100).alias("node_id"))
    f = nodes(spark, sf_dir).select("case_id", "node_id", "n_transition_vox", F.lit(1).alias("there"))
    y = d.join(f, ["case_id", "node_id"], "left")
    return y.groupBy("case_id").agg(F.count("*").alias("lesions"), F.count("there").alias("matched"), (F.count("*") - F.count("there")).alias("missed"), F.sum("n_transition_vox").alias("vox"))


@query("SELECT event_type AS tag, count(*) AS n, round(sum(value), 3) AS total, max(value) AS top FROM events GROUP BY 1")
def stream_leaderboard(spark, sf_dir):
    """STR1: the board that a stream of the events leaves."""
    return board_of_stream(spark, f"{sf_dir}/events.parquet").withColumn("total", F.round("total", 3))
