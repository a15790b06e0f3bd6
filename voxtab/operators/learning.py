"""Class means and what is judged with them: out-of-fold predictions, ablation, noise floors; feature blocks and synthetic rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.plans.leaders import tasks
from voxtab.plans.lineage import materialize


def class_sums(rows: DataFrame, by: list[str], dims: int) -> DataFrame:
    """(by, label, n, s): rows and sums of the first dims components of x, one row per class and `by`."""
    sums = [F.sum(F.get("x", F.lit(d))) for d in range(dims)]
    return rows.groupBy(*by, "label").agg(F.count("*").alias("n"), F.array(*sums).alias("s"))


def means_without_fold(rows: DataFrame, by: list[str], dims: int) -> DataFrame:
    """(by, fold, means): the class means of all rows outside each fold, as an array of (label, mean); as many as classes and folds."""
    own = class_sums(rows, [*by, "fold"], dims)
    total = class_sums(rows, by, dims).withColumnRenamed("n", "n_all").withColumnRenamed("s", "s_all")
    rest = own.select(*by, "fold").distinct().join(total, by) if by else own.select("fold").distinct().crossJoin(total)
    rest = rest.join(own, [*by, "fold", "label"], "left")
    left = F.col("n_all") - F.coalesce("n", F.lit(0))
    s = F.when(F.col("s").isNull(), F.col("s_all")).otherwise(F.zip_with("s_all", "s", lambda a, b: a - b))
    rest = rest.where(left > 0).select(*by, "fold", "label", F.transform(s, lambda v: v / left).alias("mean"))
    return rest.groupBy(*by, "fold").agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("means"))


def squared(a: Column, b: Column) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def nearest_mean(rows: DataFrame, means: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """rows with pred: the label of the nearest class mean of the rows outside their fold, ties to the smaller label."""
    best = F.array_min(F.transform("means", lambda m: F.struct(F.round(squared(F.col("x"), m["mean"]), digits).alias("d"), m["label"].alias("label"))))
    return rows.join(F.broadcast(means), [*by, "fold"]).withColumn("pred", best["label"]).drop("means")


def blocks_of(rows: DataFrame, blocks: dict[str, tuple[int, int]]) -> DataFrame:
    """Every row once per block of components (name, from, to): x holds that block alone, padded with 0 to the widest."""
    widest = max(b - a for a, b in blocks.values())
    part = lambda a, b: F.concat(F.slice("x", a + 1, b - a), F.array_repeat(F.lit(0.0), widest - b + a))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("block"), part(a, b).alias("x")) for n, (a, b) in blocks.items()]))
    return rows.withColumn("_b", each).select(*[c for c in rows.columns if c != "x"], "_b.block", "_b.x")


def mahalanobis(rows: DataFrame, dims: int) -> DataFrame:
    """(vec_id, label, cls, p): exp(-(d2 - least d2) / 2) over classes, normalised, by class means and the pooled covariance.

    Means and second moments come from one aggregate; the matrix that is inverted on
    the driver has dims rows.
    """
    x = [F.get("x", F.lit(d)) for d in range(dims)]
    stats = rows.groupBy("label").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{d}") for d, c in enumerate(x)], *[F.sum(x[a] * x[b]).alias(f"q{a}_{b}") for a in range(dims) for b in range(a, dims)]).collect()
    if not stats:
        return rows.select("vec_id", "label", F.col("label").alias("cls"), F.lit(1.0).alias("p"))
    scatter, n = np.zeros((dims, dims)), sum(r["n"] for r in stats)
    means = {r["label"]: np.array([r[f"s{d}"] / r["n"] for d in range(dims)]) for r in stats}
    for r in stats:
        for a in range(dims):
            for b in range(dims):
                scatter[a, b] += r[f"q{min(a, b)}_{max(a, b)}"] - r["n"] * means[r["label"]][a] * means[r["label"]][b]
    inverse = np.linalg.pinv(scatter / max(1, n - len(stats)))

    def d2(mean: np.ndarray) -> Column:
        diff = [c - float(m) for c, m in zip(x, mean)]
        return sum((diff[a] * diff[b] * float(inverse[a, b]) for a in range(dims) for b in range(dims)), F.lit(0.0))

    table = F.array(*[F.struct(F.lit(c).alias("cls"), d2(m).alias("d")) for c, m in sorted(means.items())])
    near = rows.select("vec_id", "label", table.alias("t"))
    weight = F.transform("t", lambda q: F.struct(q["cls"].alias("cls"), F.exp(-(q["d"] - F.array_min(F.transform("t", lambda z: z["d"]))) / 2).alias("w")))
    total = F.aggregate("w", F.lit(0.0), lambda s, q: s + q["w"])
    each = near.withColumn("w", weight).select("vec_id", "label", total.alias("total"), F.explode("w").alias("q"))
    return each.select("vec_id", "label", "q.cls", (F.col("q.w") / F.col("total")).alias("p"))


def unit(v: Column) -> Column:
    """An array scaled to length 1; one of zeros stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def proximity(d: Column, mode: str, gate: float) -> Column:
    """Distances as nearness: 1 / (1 + d) (raw), nothing beyond the gate (gated), exp(-d) within it (sharp), or none at all (off)."""
    modes = {"raw": lambda x: 1 / (1 + x), "gated": lambda x: F.when(x <= gate, 1 / (1 + x)).otherwise(0.0), "sharp": lambda x: F.when(x <= gate, F.exp(-x)).otherwise(0.0), "off": lambda x: x * 0}
    return F.transform(d, modes[mode])


def vectorise(distances: Column, overlap: Column, nodes: Column, mode: str, gate: float, weights: tuple[float, float, float]) -> Column:
    """One vector of three blocks, each of length 1 times its weight: nearness of classes, overlap shares, nearness of junctions."""
    total = F.aggregate(overlap, F.lit(0.0), lambda s, x: s + x)
    share = F.transform(overlap, lambda x: F.when(total > 0, x / total).otherwise(0.0))
    parts = (proximity(distances, "raw", gate), share, proximity(nodes, mode, gate))
    return F.concat(*[_scaled(unit(b), w) for b, w in zip(parts, weights)])


def _scaled(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x * w)


def interpolated_rows(rows: DataFrame, rare: DataFrame, share: float) -> DataFrame:
    """(vec_id, label, x): for rows of rare labels, the point `share` of the way to the next row of its label.

    Next by vec_id, those without one apart. Rows are dealt by ranges, so no task ranks a
    whole label; the last of a range goes on with the first of its label's next range.
    """
    few = rows.join(F.broadcast(rare), "label", "left_semi").select("vec_id", "label", "x", F.col("vec_id").isNull().alias("_no"))
    group, part = ["label", "_no"], F.spark_partition_id()
    dealt = materialize(few.repartitionByRange(max(2, tasks(few)), *group, "vec_id").withColumn("_part", part))
    mine = W.partitionBy("_part", *group).orderBy("vec_id")
    firsts = dealt.withColumn("_r", F.row_number().over(mine)).where("_r = 1").select("_part", *group, F.struct("x").alias("_x"))
    firsts = firsts.withColumn("_after", F.lead("_x").over(W.partitionBy(*group).orderBy("_part"))).drop("_x")  # a row for each label and range
    nxt = dealt.withColumn("_n", F.lead(F.struct("x")).over(mine)).join(firsts, ["_part", *group])
    nxt = nxt.withColumn("_n", F.coalesce("_n", "_after")["x"]).where("_n is not null")
    return nxt.select("vec_id", "label", F.zip_with("x", "_n", lambda a, b: a + (b - a) * share).alias("x"))


def macro_mcc(decisions: DataFrame, by: list[str]) -> DataFrame:
    """(by, macro_mcc, classes): the mean over true classes of the MCC of presence per case, for each `by`."""
    here = decisions.select(*by, "case_id", F.explode(F.array_distinct(F.array_compact(F.array("truth", "pred")))).alias("cls"), "truth", "pred").where("cls >= 0")
    is_cls = lambda c: F.max(F.coalesce(F.col(c) == F.col("cls"), F.lit(False)))
    here = here.groupBy(*by, "case_id", "cls").agg(is_cls("truth").alias("t"), is_cls("pred").alias("p"))
    cases = decisions.select("case_id").distinct().agg(F.count("*").cast("double").alias("all"))
    one = lambda c: F.count_if(c).cast("double")
    n = here.groupBy(*by, "cls").agg(one(F.col("t") & F.col("p")).alias("tp"), one(~F.col("t") & F.col("p")).alias("fp"), one(F.col("t") & ~F.col("p")).alias("fn"))
    n = n.where("tp + fn > 0").crossJoin(cases).withColumn("tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return n.groupBy(*by).agg(F.avg(F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0)).alias("macro_mcc"), F.count("*").alias("classes"))


def recovered(decisions: DataFrame, shares: list[float], draws: int) -> DataFrame:
    """The decisions once per share and draw, with that share of the missed units found and named rightly.

    A unit's turn in a draw is a congruence of its id, so any engine draws alike and no task ranks all units.
    """
    each = decisions.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares]))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    turn = (F.col("lesion") * 7919 + F.col("draw") * 104729 + F.col("lesion") * F.col("draw") * 31) % 1000
    missed = F.col("pred").isNull() & (F.col("truth") >= 0)
    return each.withColumn("pred", F.when(missed & (turn < F.col("share") * 1000), F.col("truth")).otherwise(F.col("pred")))
