"""Statistics over runs: folds, resampling, paired tests and rankings."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.plans.lineage import materialize
from voxtab.plans.totals import running_total


def group_kfold(cases: DataFrame, k: int) -> DataFrame:
    """(case_id, patient_id, fold): a patient's cases share a fold; patients take turns by size, then id.

    A patient's number is a running total over ranges of (size, id), so no task ranks
    all patients.
    """
    size = cases.groupBy("patient_id").agg((-F.count("*")).alias("_less")).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    numbered = running_total(size, "_all", ["_less", "patient_id"], "_one", "_no")
    return cases.join(numbered.select("patient_id", (F.col("_no") % k).cast("int").alias("fold")), "patient_id")


def leaks(folded: DataFrame) -> DataFrame:
    """(patient_id, folds) of patients in more than one fold: must be empty."""
    return folded.groupBy("patient_id").agg(F.countDistinct("fold").alias("folds")).where("folds > 1")


def draw_index(b: Column, d: Column, n: Column) -> Column:
    """The d-th draw of resample b among n items, by a congruence that any engine repeats."""
    return (b * 7919 + d * 104729 + b * d * 31 + 17) % n


def bootstrap_weights(items: DataFrame, key: str, resamples: int) -> DataFrame:
    """(b, key, w): how often each item is drawn in each resample, as often as there are items.

    Items are numbered by running totals over ranges of ids, draws are made where the
    items are, and only counts are shuffled.
    """
    ids = items.where(F.col(key).isNotNull()).select(key).distinct().withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    numbered = materialize(running_total(ids, "_all", [key], "_one", "no").select(key, F.col("no").cast("bigint").alias("no")))
    n = numbered.count()
    draws = numbered.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    hit = draws.select("b", draw_index(F.col("b").cast("bigint"), F.col("no"), F.lit(n)).alias("no")).groupBy("b", "no").agg(F.count("*").alias("w"))
    return hit.join(numbered, "no").select("b", key, "w")


def paired_counts(base: DataFrame, cand: DataFrame, unit: list[str]) -> DataFrame:
    """One row: units better and worse under cand (by hits), and the one-sided sign-test probability."""
    both = base.withColumnRenamed("hits", "_b").join(cand.withColumnRenamed("hits", "_c"), unit, "full_outer").fillna(0, ["_b", "_c"])
    s = F.signum(F.col("_c") - F.col("_b"))
    wins, losses = both.agg(F.count_if(s > 0), F.count_if(s < 0)).first()
    return base.sparkSession.createDataFrame([(wins, losses, sign_tail(wins, wins + losses))], "wins bigint, losses bigint, p_value double")


def sign_tail(wins: int, n: int) -> float:
    """P(X >= wins) of a fair binomial of n: the shorter tail, term by term from its largest, until terms no longer count."""
    lower = 2 * wins <= n
    k = wins - 1 if lower else wins
    if k < 0:
        return 1.0
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2))
    total = 0.0
    while 0 <= k <= n and term > total * 1e-18:
        total += term
        term, k = (term * k / (n - k + 1), k - 1) if lower else (term * (n - k) / (k + 1), k + 1)
    return 1 - total if lower else total


def rank_sum_auc(x: DataFrame, by: str, positive: Column) -> DataFrame:
    """(by, auc): Mann-Whitney share from average ranks of equal values."""
    g = x.groupBy(by, "value").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = F.sum("neg").over(W.partitionBy(by).orderBy("value")) - F.col("neg")
    g = g.withColumn("below", below)
    out = g.groupBy(by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return out.select(by, (F.col("u") / (F.col("p") * F.col("n"))).alias("auc"))


def null_splits(hits: DataFrame, by: str, unit: list[str], seeds: int) -> DataFrame:
    """(by, half, wins, losses, z): the sign test between halves of one run's own seeds, for every split both ways.

    hits: by, unit columns, seed (0 .. seeds - 1), hits. `half` has the bit of each
    seed on the candidate's side; both sides have seeds // 2 seeds at least, and
    units compare by mean hits per seed. z is the sign test's normal score with
    continuity correction, null without any unequal unit. Units are gathered once,
    and splits are counted on the map side.
    """
    halves = [m for m in range(1 << seeds) if seeds // 2 <= m.bit_count() <= seeds - seeds // 2]
    total = hits.groupBy(by, *unit).agg(*[F.sum(F.when(F.col("seed") == s, F.col("hits")).otherwise(0)).alias(f"_{s}") for s in range(seeds)])
    side = lambda m: sum((F.col(f"_{s}") for s in range(seeds) if m >> s & 1), F.lit(0))
    # Means compare as sums times the other side's seeds, in whole numbers.
    lead = [F.struct(F.lit(m).alias("half"), F.signum(side(m) * (seeds - m.bit_count()) - side(~m & (1 << seeds) - 1) * m.bit_count()).alias("s")) for m in halves]
    each = total.select(by, F.explode(F.array(*lead)).alias("x")).select(by, "x.half", "x.s")
    c = each.groupBy(by, "half").agg(F.count_if(F.col("s") > 0).alias("wins"), F.count_if(F.col("s") < 0).alias("losses"))
    n = F.col("wins") + F.col("losses")
    return c.withColumn("z", F.when(n > 0, (F.col("wins") - n / 2 - 0.5) / (F.sqrt(n) / 2)))
