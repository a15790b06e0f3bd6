"""Intensity normalisation and statistics per case; exact percentiles throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.plans.totals import quantiles


def case_percentiles(x: DataFrame) -> DataFrame:
    """Percentiles 0.5, 1, 5, 95, 99, 99.5 and the count per case and mask, in one pass."""
    shares = {"p0_5": 0.005, "p1": 0.01, "p5": 0.05, "p95": 0.95, "p99": 0.99, "p99_5": 0.995}
    p = x.groupBy("case_id", "mask").agg(F.count("*").alias("n"), F.percentile("value", F.array(*[F.lit(s) for s in shares.values()])).alias("p"))
    return p.select("case_id", "mask", "n", *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(shares)])


def foreground(x: DataFrame, least: int = 100) -> DataFrame:
    """Rows above the modality's background limit; all rows of a case with fewer than `least` such rows."""
    low = F.when(F.col("modality") == "CT", -300.0).otherwise(F.greatest(F.lit(1.0), 0.02 * F.col("p")))
    lim = x.groupBy("case_id", "modality").agg(F.percentile("value", F.lit(0.995)).alias("p")).select("case_id", low.alias("_low"))
    y = x.join(lim, "case_id")
    n = F.count_if(F.col("value") > F.col("_low")).over(W.partitionBy("case_id"))
    return y.withColumn("_n", n).where((F.col("value") > F.col("_low")) | (F.col("_n") < least)).drop("_n", "_low")


def robust_z(x: DataFrame) -> DataFrame:
    """Adds z = (value - median) / IQR of the foreground; a flat case uses the population deviation, or 1."""
    q = foreground(x).groupBy("case_id").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.stddev_pop("value").alias("sd"))
    iqr = F.col("q")[2] - F.col("q")[0]
    scale = F.when(iqr >= 1e-6, iqr).otherwise(F.when(F.col("sd") != 0, F.col("sd")).otherwise(1.0))
    return x.join(q, "case_id").withColumn("z", (F.col("value") - F.col("q")[1]) / scale).drop("q", "sd")


def zscore_in_mask(x: DataFrame, mask: str) -> DataFrame:
    """Adds z by the mean and deviation of a mask's rows, or of all rows where a case has none."""
    v = F.when(F.col("mask") == mask, F.col("value"))
    s = x.groupBy("case_id").agg(F.coalesce(F.avg(v), F.avg("value")).alias("m"), F.coalesce(F.stddev_pop(v), F.stddev_pop("value")).alias("s"))
    return x.join(s, "case_id").withColumn("z", (F.col("value") - F.col("m")) / F.when(F.col("s") != 0, F.col("s")).otherwise(1.0)).drop("m", "s")


def clip_scale(v: Column, low: float, high: float) -> Column:
    """v clipped to [low, high] and scaled to [0, 1]."""
    return F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def density_histogram(x: DataFrame, by: tuple[str, ...], low: float, high: float, bins: int) -> DataFrame:
    """Counts and densities of equal bins per group."""
    b = F.least(F.greatest(F.floor((F.col("value") - low) / (high - low) * bins).cast("int"), F.lit(0)), F.lit(bins - 1))
    n = x.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / F.sum("n").over(W.partitionBy(*by)) / ((high - low) / bins))


def bounded_sample(x: DataFrame, n: int) -> DataFrame:
    """At most n rows of each case, in the order of a congruence of the position."""
    order = (F.col("i") * 7919 + F.col("j") * 104729 + F.col("k") * 31337) % 1009
    return x.withColumn("_r", F.row_number().over(W.partitionBy("case_id").orderBy(order, "i", "j", "k", "value"))).where(F.col("_r") <= n).drop("_r")


def recommend_window(x: DataFrame) -> DataFrame:
    """Per modality: pooled p0.5, the larger p99.5 of all and of vessels, and the variation of p99.5 over cases."""
    whole = quantiles(x, "modality", "value", {"low": 0.005, "_p": 0.995})
    vessel = quantiles(x.where(F.col("mask") == "vessel"), "modality", "value", {"_v": 0.995})
    pooled = whole.join(vessel, "modality", "left").select("modality", "low", F.greatest("_p", "_v").alias("high"))
    per = x.groupBy("modality", "case_id").agg(F.percentile("value", F.lit(0.995)).alias("p")).groupBy("modality").agg((F.stddev_pop("p") / F.avg("p")).alias("cv"))
    return pooled.join(per, "modality")


def adaptive_norm(x: DataFrame) -> DataFrame:
    """Adds z: cases with over 1 % of values below -300 are clipped to [-200, 800] and scaled by values over -100; others are clipped to p0.5..p99.9 of the positive values, with 0 left 0."""
    v = F.col("value")
    s = x.groupBy("case_id").agg(
        (F.avg((v < -300).cast("int")) > 0.01).alias("ct"),
        F.percentile(F.when(v > 0, v), F.array(F.lit(0.005), F.lit(0.999))).alias("q"),
        *[f(F.when(v > -100, F.least(F.greatest(v, F.lit(-200.0)), F.lit(800.0)))).alias(n) for f, n in ((F.avg, "m1"), (F.stddev_pop, "s1"))],
    )
    y = x.join(s, "case_id")
    mr = F.least(F.greatest(v, F.col("q")[0]), F.col("q")[1])
    t = y.where(v > 0).groupBy("case_id").agg(F.avg(mr).alias("m2"), F.stddev_pop(mr).alias("s2"))
    y = y.join(t, "case_id", "left")
    ct = F.when(F.col("s1") > 0, (F.least(F.greatest(v, F.lit(-200.0)), F.lit(800.0)) - F.col("m1")) / F.col("s1")).otherwise(0.0)
    other = F.when(v <= 0, 0.0).when(F.col("s2") > 0, (mr - F.col("m2")) / F.col("s2")).otherwise(0.0)
    return y.withColumn("z", F.when(F.col("ct"), ct).otherwise(other)).drop("ct", "q", "m1", "s1", "m2", "s2")


def otsu(x: DataFrame, low: float, width: float) -> DataFrame:
    """(case_id, otsu_bin): the bin after which the variance between both sides is largest, the first of equals."""
    h = x.groupBy("case_id", F.floor((F.col("value") - low) / width).cast("int").alias("bin")).agg(F.count("*").cast("double").alias("n"))
    w, whole = W.partitionBy("case_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("case_id")
    m = F.col("n") * F.col("bin")
    h = h.select("case_id", "bin", F.sum("n").over(w).alias("w0"), F.sum(m).over(w).alias("s0"), F.sum("n").over(whole).alias("wt"), F.sum(m).over(whole).alias("st"))
    w1 = F.col("wt") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("st") - F.col("s0")) / F.when(w1 > 0, w1)
    score = F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0))
    return h.groupBy("case_id").agg(F.max_by("bin", F.struct(F.round(score, 6), -F.col("bin"))).alias("otsu_bin"))


def coarsen(x: DataFrame, factors: tuple[int, int, int]) -> DataFrame:
    """Mean and count of thinned rows (every factor-th i) per coarse block."""
    f = dict(zip("ijk", factors))
    y = x.where(F.col("i") % f["i"] == 0)
    return y.groupBy("case_id", *[F.floor(F.col(a) / n).cast("int").alias("b" + a) for a, n in f.items()]).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
