"""Queries of presence priors, farthest-point picks and rare-class boosts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtab.operators import logistic as R
from voxtab.operators import picks as K
from voxtab.plans.queries_learning import embedded
from voxtab.plans.queries_voxels import ID, comp_sql, comps
from voxtab.plans.registry import query, rounded
from voxtab.sources.fixtures import probs, vox, with_tables

CLASSES = list(range(1, 8))
#: Truth voxels of a class from which on it is present; the ridge; Newton steps that the SQL takes.
LEAST_VOX, RIDGE, STEPS = 28, 1 / 0.3, 7


def _presence_sql() -> str:
    n = len(CLASSES) + 1
    z = ["1.0::DOUBLE", *[f"x[{c}]" for c in CLASSES]]
    parts = {
        "x": "SELECT case_id, [" + ", ".join(f"ln(1 + count(*) FILTER (layer = 'A' AND cls = {c}) * 0.096::DOUBLE)" for c in CLASSES) + "] AS x FROM vox GROUP BY 1 HAVING bool_or(layer = 'A')",
        "t": f"SELECT case_id, cls FROM vox WHERE layer = 'N' GROUP BY 1, 2 HAVING count(*) >= {LEAST_VOX}",
        "k": "SELECT CAST(c AS INT) AS cls FROM range(1, 8) r(c)",
        "y": "SELECT x.case_id, x.x, k.cls, (t.cls IS NOT NULL)::INT AS y FROM x CROSS JOIN k LEFT JOIN t ON t.case_id = x.case_id AND t.cls = k.cls",
        "r": "SELECT cls, avg(y) AS rate, sum(y) >= 3 AND count(*) - sum(y) >= 3 AS able FROM y GROUP BY 1",
        "b0": "SELECT cls, " + ", ".join(f"0::DOUBLE AS b{i}" for i in range(n)) + " FROM r WHERE able",
    }
    for s in range(STEPS):
        score = " + ".join(f"b{i} * {z[i]}" for i in range(n))
        parts[f"p{s}"] = f"SELECT y.cls, x, y, 1 / (1 + exp(-({score}))) AS p, " + ", ".join(f"b{i}" for i in range(n)) + f" FROM y JOIN b{s} USING (cls)"
        pull = lambda i: RIDGE if i else 0
        cells = [f"sum(p * (1 - p) * {z[i]} * {z[j]}) + {pull(i) if i == j else 0} AS m{i}_{j}" for i in range(n) for j in range(n)]
        cells += [f"sum((p - y) * {z[i]}) + {pull(i)} * any_value(b{i}) AS m{i}_{n}" for i in range(n)]
        parts[f"e{s}_0"] = f"SELECT cls, {', '.join(cells)} FROM p{s} GROUP BY 1"
        for q in range(n):
            row = lambda j: f"m{q}_{j} / m{q}_{q}"  # noqa: E731, B023
            cells = [(row(j) if i == q else f"m{i}_{j} - m{i}_{q} * ({row(j)})") + f" AS m{i}_{j}" for i in range(n) for j in range(q + 1, n + 1)]
            parts[f"e{s}_{q + 1}"] = f"SELECT cls, {', '.join(cells)} FROM e{s}_{q}"
        parts[f"b{s + 1}"] = "SELECT b.cls, " + ", ".join(f"b.b{i} - e.m{i}_{n} AS b{i}" for i in range(n)) + f" FROM b{s} b JOIN e{s}_{n} e USING (cls)"
    score = " + ".join(f"b{i} * {z[i]}" for i in range(n))
    body = f"SELECT case_id, cls, round(CASE WHEN r.able THEN 1 / (1 + exp(-({score}))) ELSE r.rate END, 6) AS p FROM x CROSS JOIN r LEFT JOIN b{STEPS} USING (cls)"
    return with_tables(body, "vox", **parts).replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query(_presence_sql())
def presence_prior(spark, sf_dir):
    """CLF5: per case and class the chance that the class is present, by a logistic regression on the case's vessel volumes."""
    v = vox(spark, sf_dir, "A").groupBy("case_id").pivot("cls", CLASSES).agg(F.count("cls"))
    x = v.select("case_id", F.array(*[F.log1p(F.coalesce(F.col(str(c)), F.lit(0)) * 0.096) for c in CLASSES]).alias("x"))
    there = vox(spark, sf_dir, "N").groupBy("case_id", "cls").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_VOX).groupBy("case_id").agg(F.collect_set("cls").alias("present"))
    rows = x.join(there, "case_id", "left").withColumn("present", F.coalesce("present", F.array().cast("array<int>")))
    return rounded(R.presence(rows, R.fit_presence(rows, len(CLASSES), CLASSES, RIDGE)))


BUDGET = 4


def _farthest_sql() -> str:
    parts = {
        "m": "SELECT case_id, comp_id, count(*) AS n, avg(i) AS ci, avg(j) AS cj, avg(k) AS ck FROM comp GROUP BY 1, 2",
        "x": f"SELECT c.case_id, c.comp_id, c.i, c.j, c.k, {ID.replace('i*', 'c.i*').replace('j*', 'c.j*').replace('+ k', '+ c.k')} AS id, n, round((c.i-ci)*(c.i-ci) + (c.j-cj)*(c.j-cj) + (c.k-ck)*(c.k-ck), 9) AS d FROM comp c JOIN m USING (case_id, comp_id)",
        "s1": f"SELECT case_id, comp_id, i, j, k, id, -d AS far FROM x WHERE n > {BUDGET}",
    }
    for r in range(1, BUDGET + 1):
        parts[f"q{r}"] = f"SELECT * FROM s{r} WHERE {'far > 0' if r > 1 else 'true'} QUALIFY row_number() OVER (PARTITION BY case_id, comp_id ORDER BY far DESC, id) = 1"
        now = "(s.i-q.i)*(s.i-q.i) + (s.j-q.j)*(s.j-q.j) + (s.k-q.k)*(s.k-q.k)"
        parts[f"s{r + 1}"] = f"SELECT s.case_id, s.comp_id, s.i, s.j, s.k, s.id, {now if r == 1 else f'least(s.far, {now})'}::DOUBLE AS far FROM s{r} s JOIN q{r} q USING (case_id, comp_id)"
    picks = " UNION ALL ".join(f"SELECT case_id, comp_id, i, j, k, {r} AS nth FROM q{r}" for r in range(1, BUDGET + 1))
    return comp_sql(f"SELECT case_id, comp_id, i, j, k, CAST(nth AS INT) AS nth FROM ({picks} UNION ALL SELECT case_id, comp_id, i, j, k, row_number() OVER (PARTITION BY case_id, comp_id ORDER BY d, id) FROM x WHERE n <= {BUDGET})", extra=parts)


@query(_farthest_sql())
def farthest_picks(spark, sf_dir):
    """PRB14: the voxels of each lesion that are spread the widest."""
    return K.farthest_points(comps(spark, sf_dir), BUDGET)


RARE = {
    "e": "SELECT vec_id, CAST(label AS INT) AS label, (vec_id // 3) % 5 AS fold, [v::DOUBLE FOR v IN embedding] AS x FROM embeddings",
    "rare": "SELECT label AS cls FROM e GROUP BY 1 HAVING count(*) * 10 < (SELECT count(*) FROM e)",
    "pr": "SELECT lesion AS vec_id, cls, p FROM probs WHERE seed = 0",
}


def rare_tables(spark, sf_dir):
    e = embedded(spark, sf_dir)
    n = e.groupBy(F.col("label").alias("cls")).agg(F.count("*").alias("n"))
    return e, n.crossJoin(F.broadcast(e.agg(F.count("*").alias("all")))).where("n * 10 < all").select("cls")


@query(
    with_tables(
        "SELECT vec_id, cls, round(CASE WHEN sum(q) OVER w > 0 THEN q / sum(q) OVER w ELSE p END, 6) AS p FROM (SELECT pr.*, CASE WHEN sim IS NOT NULL THEN p * pow(greatest(sim, 1e-6), 0.5) ELSE p END AS q FROM pr LEFT JOIN sims USING (vec_id, cls)) WINDOW w AS (PARTITION BY vec_id)",
        "probs", **RARE,
        sims="SELECT a.vec_id, b.label AS cls, max(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x)))) AS sim FROM e a JOIN e b ON a.fold <> b.fold AND b.label IN (SELECT cls FROM rare) GROUP BY 1, 2",
    )
)
def rare_boost(spark, sf_dir):
    """PRB11: rare classes by their likeness to the few rows known of them."""
    e, rare = rare_tables(spark, sf_dir)
    p = probs(spark, sf_dir).where("seed = 0").select(F.col("lesion").alias("vec_id"), "cls", "p")
    return rounded(K.rare_boost(p, K.rare_similarity(e, rare), 0.5))


@query(
    with_tables(
        "SELECT vec_id, cls, round(m / sum(m) OVER (PARTITION BY vec_id), 6) AS p FROM (SELECT *, CASE WHEN rare AND sub > 0 THEN 0.6 * p + 0.4 * keep * q / sub ELSE p END AS m FROM (SELECT pr.vec_id, pr.cls, pr.p, o.p AS q, pr.cls IN (SELECT cls FROM rare) AS rare, sum(pr.p) FILTER (pr.cls IN (SELECT cls FROM rare)) OVER w AS keep, sum(o.p) FILTER (pr.cls IN (SELECT cls FROM rare)) OVER w AS sub FROM pr JOIN (SELECT lesion AS vec_id, cls, p FROM probs WHERE seed = 1) o USING (vec_id, cls) WINDOW w AS (PARTITION BY vec_id)))",
        "probs", **RARE,
    )
)
def rare_blend(spark, sf_dir):
    """PRB11: the mass of rare classes, two fifths of it dealt as a second source deals it."""
    _, rare = rare_tables(spark, sf_dir)
    p = probs(spark, sf_dir)
    of = lambda seed, name: p.where(F.col("seed") == seed).select(F.col("lesion").alias("vec_id"), "cls", F.col("p").alias(name))
    return rounded(K.rare_blend(of(0, "p"), of(1, "q"), rare, 0.4))
