"""Algebra of class probabilities in long form: key columns, cls, p. Ties go to the smaller class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.plans.lineage import materialize


def normalise(x: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """p divided by its sum over the key."""
    return x.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy(*key)))


def ranked(x: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Adds rk, the rank of p within the key."""
    return x.withColumn("rk", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.round("p", 9)), "cls")))


def argmax(x: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return ranked(x, key).where("rk = 1").drop("rk")


def prior_correct(x: DataFrame, prior: DataFrame, beta: float, key: tuple[str, ...]) -> DataFrame:
    """p / n**beta, normalised; prior (cls, n) has a row per class and is broadcast."""
    y = x.join(F.broadcast(prior), "cls").withColumn("p", F.col("p") / F.pow("n", F.lit(beta))).drop("n")
    return normalise(y, key)


def gated_prior(x: DataFrame, prior: DataFrame, below: float, beta: float, key: tuple[str, ...]) -> DataFrame:
    """prior_correct only where the largest p of the key is below a limit."""
    top = F.max("p").over(W.partitionBy(*key))
    y = x.join(F.broadcast(prior), "cls").withColumn("_top", top)
    y = y.withColumn("p", F.when(F.col("_top") < below, F.col("p") / F.pow("n", F.lit(beta))).otherwise(F.col("p"))).drop("n", "_top")
    return normalise(y, key)


def ensemble(x: DataFrame, n_models: int, key: tuple[str, ...]) -> DataFrame:
    """Mean over models; a class that a model lacks counts 0 there."""
    return x.groupBy(*key, "cls").agg((F.sum("p") / n_models).alias("p"))


def mirror_class(c: Column) -> Column:
    """The class on the other side: 0-7 pair up, others are on the mid-line."""
    return F.when(c < 8, c.bitwiseXOR(F.lit(1))).otherwise(c)


def mirror_average(x: DataFrame, key: tuple[str, ...], mirrored: Column) -> DataFrame:
    """Mean of p and of the mirrored prediction's p for the mirrored class (0 if it lacks it)."""
    other = x.select(*key, mirrored.alias("cls"), F.col("p").alias("_q"))
    return x.join(other, [*key, "cls"], "left").withColumn("p", (F.col("p") + F.coalesce("_q", F.lit(0.0))) / 2).drop("_q")


def blend(a: DataFrame, b: DataFrame, weight: float, key: tuple[str, ...]) -> DataFrame:
    """weight * a + (1 - weight) * b, each normalised first; a class that one lacks counts 0 there."""
    x, y = normalise(a, key).select(*key, "cls", F.col("p").alias("_a")), normalise(b, key).select(*key, "cls", F.col("p").alias("_b"))
    both = x.join(y, [*key, "cls"], "full_outer")
    return both.select(*key, "cls", (weight * F.coalesce("_a", F.lit(0.0)) + (1 - weight) * F.coalesce("_b", F.lit(0.0))).alias("p"))


def case_prior(x: DataFrame, prior: DataFrame, power: float, floor: float, key: tuple[str, ...]) -> DataFrame:
    """p times the case's prior (case_id, cls, c; at least floor) to a power, normalised."""
    y = x.join(prior, ["case_id", "cls"]).withColumn("p", F.col("p") * F.pow(F.greatest("c", F.lit(floor)), F.lit(power))).drop("c")
    return normalise(y, key)


def hierarchical_argmax(x: DataFrame, family: Column, key: tuple[str, ...]) -> DataFrame:
    """The best class of the family with the largest sum."""
    y = x.withColumn("_f", family)
    y = y.withColumn("_s", F.sum("p").over(W.partitionBy(*key, "_f")))
    r = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.round("_s", 9)), "_f", F.desc(F.round("p", 9)), "cls"))
    return y.withColumn("_r", r).where("_r = 1").drop("_f", "_s", "_r")


def sinkhorn(x: DataFrame, goal: DataFrame, rounds: int, alpha: float) -> DataFrame:
    """Class factors v that bring the mean of row-normalised p v to the goal; returns p v**alpha, normalised.

    v has one row per class and is broadcast; every ten rounds it is written, so
    the plan stays short.
    """
    v = goal.select("cls", F.lit(1.0).alias("v"))
    for t in range(rounds):
        scaled = normalise(x.join(F.broadcast(v), "cls").withColumn("p", F.col("p") * F.col("v")), ("lesion",))
        mean = scaled.groupBy("cls").agg(F.avg("p").alias("m"))
        v = v.join(mean, "cls").join(goal, "cls").select("cls", (F.col("v") * F.col("goal") / F.col("m")).alias("v"))
        if t % 10 == 4:
            v = materialize(v)
    out = x.join(F.broadcast(v), "cls").withColumn("p", F.col("p") * F.pow("v", F.lit(alpha)))
    return normalise(out, ("lesion",)).select("lesion", "cls", "p")


def assign_unique(x: DataFrame, n: int, case: tuple[str, ...]) -> DataFrame:
    """Different classes for the n lesions of every case, of the largest product of p: picks, an array of (lesion, cls).

    Each lesion needs its n best classes only, so n joins list at most n**n
    combinations a case; more than 5 lesions are refused. Cases must have exactly n lesions.
    """
    if n > 5:
        raise ValueError("over 5 lesions in a case: too many combinations")
    top = ranked(x, (*case, "lesion")).where(F.col("rk") <= n)
    top = top.withColumn("_nth", F.dense_rank().over(W.partitionBy(*case).orderBy("lesion")))
    one = top.select(*case, "_nth", F.struct("lesion", "cls").alias("pick"), F.log("p").alias("s"))
    acc = one.where("_nth = 1").select(*case, F.array("pick").alias("picks"), "s")
    for k in range(2, n + 1):
        nxt = one.where(F.col("_nth") == k).select(*case, F.col("pick").alias("_p"), F.col("s").alias("_s"))
        acc = acc.join(nxt, list(case)).where(~F.exists("picks", lambda q: q["cls"] == F.col("_p.cls")))
        acc = acc.select(*case, F.concat("picks", F.array("_p")).alias("picks"), (F.col("s") + F.col("_s")).alias("s"))
    best = F.min_by("picks", F.struct(-F.round("s", 9), F.transform("picks", lambda q: q["cls"])))
    return acc.groupBy(*case).agg(best.alias("picks"))


def redistribute(x: DataFrame, inside: Column, expert: Column, key: tuple[str, ...]) -> DataFrame:
    """Within a group of classes its mass is dealt by an expert's shares; others keep theirs."""
    mass = F.sum(F.when(inside, F.col("p"))).over(W.partitionBy(*key))
    return x.withColumn("_g", mass).withColumn("p", F.when(inside, F.col("_g") * expert).otherwise(F.col("p"))).drop("_g")


def top_two(x: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, c1, c2, p1, p2): the two best classes."""
    r = ranked(x, key).where("rk <= 2")
    pick = lambda c, k: F.max(F.when(F.col("rk") == k, F.col(c)))
    return r.groupBy(*key).agg(pick("cls", 1).alias("c1"), pick("cls", 2).alias("c2"), pick("p", 1).alias("p1"), pick("p", 2).alias("p2"))


def second_class_gate(x: DataFrame, prior: DataFrame, key: tuple[str, ...], ratio: float, floor: float, most: int) -> DataFrame:
    """(key, c1, c2, emit): whether the second class is given too: one family, near enough, probable enough, rare enough."""
    t = top_two(x, key).join(F.broadcast(prior.withColumnRenamed("cls", "c2")), "c2")
    family = (F.col("c1") < 8) & (F.col("c2") < 8) & (F.floor(F.col("c1") / 2) == F.floor(F.col("c2") / 2))
    gate = family & (F.col("p2") / F.col("p1") > ratio) & (F.col("p2") > floor) & (F.col("n") <= most)
    return t.select(*key, "c1", "c2", gate.alias("emit"))


def veto(x: DataFrame, forbidden: Column, key: tuple[str, ...]) -> DataFrame:
    """The best class after forbidden ones are set to 0."""
    return argmax(x.withColumn("p", F.when(forbidden, 0.0).otherwise(F.col("p"))), key)


def suspect_labels(x: DataFrame, below: float, above: float, agree: int) -> DataFrame:
    """Lesions whose seeds agree on a class other than the label, with a low mean p of the label and a high one of the class."""
    votes = argmax(x, ("lesion", "seed")).groupBy("lesion", "truth", "cls").agg(F.count("*").alias("c"))
    r = F.row_number().over(W.partitionBy("lesion").orderBy(F.desc("c"), "cls"))
    mode = votes.withColumn("r", r).where((F.col("r") == 1) & (F.col("c") >= agree) & (F.col("cls") != F.col("truth"))).select("lesion", "truth", F.col("cls").alias("pred"))
    mean = x.groupBy("lesion", "cls").agg(F.avg("p").alias("m"))
    a, b = mean.select("lesion", F.col("cls").alias("truth"), F.col("m").alias("p_truth")), mean.select("lesion", F.col("cls").alias("pred"), F.col("m").alias("p_pred"))
    return mode.join(a, ["lesion", "truth"]).join(b, ["lesion", "pred"]).where((F.col("p_truth") < below) & (F.col("p_pred") > above)).select("lesion", "truth", "pred", "p_truth", "p_pred")


def gate_bands(x: DataFrame, bands: list[float]) -> DataFrame:
    """Per limit: rows that seed 1 fixes and breaks when it replaces seed 0 below that confidence."""
    best = argmax(x, ("lesion", "seed"))
    a = best.where("seed = 0").select("lesion", "truth", F.col("cls").alias("c0"), F.col("p").alias("p0"))
    b = best.where("seed = 1").select("lesion", F.col("cls").alias("c1"))
    y = a.join(b, "lesion").withColumn("band", F.explode(F.array(*[F.lit(t) for t in bands])))
    old, new = F.col("c0") == F.col("truth"), F.when(F.col("p0") < F.col("band"), F.col("c1")).otherwise(F.col("c0")) == F.col("truth")
    return y.groupBy("band").agg(F.count_if(new & ~old).alias("fixed"), F.count_if(old & ~new).alias("broken"), F.count("*").alias("n"))


def two_stage(groups: DataFrame, members: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Group probability times the member's share within the group."""
    whole = F.sum("p").over(W.partitionBy(*key, "grp"))
    return members.withColumn("_s", whole).join(groups, [*key, "grp"]).withColumn("p", F.col("pg") * F.col("p") / F.col("_s")).drop("_s", "pg")


def canonical_restore(x: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """(key, name): the best side-free class, with the more probable side put back; mid-line classes have none."""
    fam = F.floor(F.col("cls") / 2).cast("int")
    f = x.groupBy(*key, fam.alias("fam")).agg(F.sum("p").alias("p"))
    best = f.groupBy(*key).agg(F.min_by("fam", F.struct(-F.round("p", 9), "fam")).alias("fam"))
    side = lambda r: F.round(F.sum(F.when((F.col("cls") < 8) & (F.col("cls") % 2 == r), F.col("p"))), 9)
    s = x.groupBy(*key).agg(side(0).alias("r"), side(1).alias("l"))
    name = F.when(F.col("fam") >= 4, "mid").otherwise(F.concat(F.when(F.col("r") >= F.col("l"), "R-").otherwise("L-"), F.col("fam").cast("string")))
    return best.join(s, list(key)).select(*key, name.alias("name"))


def threshold_curve(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per threshold t: hits with p >= t, and misses removed below t."""
    y = scored.withColumn("t", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return y.groupBy("t").agg(F.count_if(F.col("hit") & (F.col("p") >= F.col("t"))).alias("tp_kept"), F.count_if(~F.col("hit") & (F.col("p") < F.col("t"))).alias("fp_removed"))


def class_weight_step(x: DataFrame, grid: list[float], key: tuple[str, ...]) -> DataFrame:
    """Accuracy of the argmax when one class's p is multiplied by each weight of a grid: one sweep of a coordinate ascent.

    A key's probabilities lie in one row, so each choice of (class, weight) is an
    array expression and no row is joined with another.
    """
    rows = x.groupBy(*key, "truth").agg(F.sort_array(F.collect_list(F.struct("cls", "p"))).alias("ps"))
    trial = rows.withColumn("cls", F.explode(F.transform("ps", lambda q: q["cls"]))).withColumn("w", F.explode(F.array(*[F.lit(w) for w in grid])))
    scored = F.transform("ps", lambda q: F.struct(F.round(q["p"] * F.when(q["cls"] == F.col("cls"), F.col("w")).otherwise(1.0), 9).alias("s"), (-q["cls"]).alias("c")))
    pred = -F.array_max(scored)["c"]
    return trial.groupBy("cls", "w").agg(F.avg((pred == F.col("truth")).cast("int")).alias("top1"))
