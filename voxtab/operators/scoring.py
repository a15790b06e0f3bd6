"""Scores of predicted against true label volumes, lesions and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.operators.space import AXES

EPS = 1e-6


def overlap_counts(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(case_id, cls, n_gt, n_pred, n_both) of every class that either volume has in a case."""
    both = gt.select("case_id", *AXES, F.col("cls").alias("g")).join(pred.select("case_id", *AXES, F.col("cls").alias("p")), ["case_id", *AXES], "full_outer")
    long = both.select("case_id", F.explode(F.array_distinct(F.array_compact(F.array("g", "p")))).alias("cls"), "g", "p")
    is_g, is_p = F.coalesce(F.col("g") == F.col("cls"), F.lit(False)), F.coalesce(F.col("p") == F.col("cls"), F.lit(False))
    return long.groupBy("case_id", "cls").agg(F.count_if(is_g).alias("n_gt"), F.count_if(is_p).alias("n_pred"), F.count_if(is_g & is_p).alias("n_both"))


def overlap_metrics(counts: DataFrame) -> DataFrame:
    """Dice, IoU and volume similarity; two empty sides score 1, one empty side 0."""
    g, p, b = F.col("n_gt"), F.col("n_pred"), F.col("n_both")
    one = (g == 0) | (p == 0)
    none = (g == 0) & (p == 0)
    pick = lambda x: F.when(none, 1.0).when(one, 0.0).otherwise(x)
    return counts.withColumns({
        "dice": pick(2 * b / (g + p + EPS)),
        "iou": pick(b / (g + p - b) + EPS),
        "volsim": pick(1 - F.abs(g - p) / (g + p + EPS)),
    })


def check_tp(metrics: DataFrame, method: str, threshold: float) -> DataFrame:
    """Adds tp by one of three criteria; any other name is an error at plan time."""
    rule = {"intersection": F.col("n_both") > threshold, "dice": F.col("dice") > threshold, "iou": F.col("iou") > threshold}
    if method not in rule:
        raise ValueError(f"unknown criterion {method!r}; one of {sorted(rule)}")
    return metrics.withColumn("tp", rule[method].cast("int"))


def case_class_grid(cases: DataFrame, n_classes: int) -> DataFrame:
    """Every case with every class 1..n: the classes are exploded beside each case, nothing is joined."""
    return cases.select("case_id", F.explode(F.sequence(F.lit(1), F.lit(n_classes))).alias("cls"))


def presence_v1(cases: DataFrame, counts: DataFrame, n_classes: int) -> DataFrame:
    """First edition, per case and class: tp if a voxel is shared, fp if predicted and not tp, fn if true and not tp, tn = classes of the case's truth - (tp + fn)."""
    grid = case_class_grid(cases, n_classes).join(counts, ["case_id", "cls"], "left").fillna(0, ["n_gt", "n_pred", "n_both"])
    one = lambda c: c.cast("int")
    x = grid.withColumn("tp", one(F.col("n_both") > 0))
    x = x.withColumn("fp", one((F.col("n_pred") > 0) & (F.col("tp") == 0))).withColumn("fn", one((F.col("n_gt") > 0) & (F.col("tp") == 0)))
    in_gt = counts.where("n_gt > 0").groupBy("case_id").agg(F.count("*").alias("gt_classes"))
    x = x.join(in_gt, "case_id", "left").fillna(0, ["gt_classes"])
    return x.withColumn("tn", F.col("gt_classes") - F.col("tp") - F.col("fn")).select("case_id", "cls", "tp", "fp", "fn", "tn")


def presence_v2(cases: DataFrame, counts: DataFrame, n_classes: int) -> DataFrame:
    """Revised edition, per case and class: presence in both, one or no label set; overlap measures are null where neither has the class."""
    grid = case_class_grid(cases, n_classes).join(overlap_metrics(counts), ["case_id", "cls"], "left").fillna(0, ["n_gt", "n_pred", "n_both"])
    g, p = F.col("n_gt") > 0, F.col("n_pred") > 0
    flag = lambda c: c.cast("int")
    return grid.select("case_id", "cls", flag(g & p).alias("tp"), flag(~g & p).alias("fp"), flag(g & ~p).alias("fn"), flag(~g & ~p).alias("tn"), "dice", "volsim")


def _mcc(tp, fp, fn, tn) -> tuple[Column, Column]:
    top = tp * tn - fp * fn
    return top, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))


def aggregate_v1(rows: DataFrame, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Sums over cases; precision and recall with epsilon below, MCC with epsilon beside the root."""
    s = rows.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    top, root = _mcc(tp, fp, fn, tn)
    return s.withColumns({"precision": tp / (tp + fp + EPS), "recall": tp / (tp + fn + EPS), "mcc": top / (root + EPS)})


def aggregate_v2(rows: DataFrame, by: tuple[str, ...] = ("cls",)) -> DataFrame:
    """Sums over cases; measures with a zero denominator are null."""
    s = rows.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in ("tp", "fp", "fn", "tn")], F.avg("dice").alias("dice"), F.avg("volsim").alias("volsim"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    top, root = _mcc(tp, fp, fn, tn)
    ratio = lambda a, b: F.when(b != 0, a / b)
    return s.withColumns({
        "support": tp + fn, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": ratio(top, root),
    })


def macro(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Means over classes that skip nulls (null if all are), and how many classes each mean has."""
    return rows.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"macro_{m}") for m in measures], *[F.count(m).alias(f"valid_{m}") for m in measures])


def multiclass_mcc(decisions: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Gorodkin's R_K from the confusion counts of (truth, pred), per group."""
    n = decisions.groupBy(*by, "truth", "pred").agg(F.count("*").cast("double").alias("n"))
    t = n.groupBy(*by, F.col("truth").alias("c")).agg(F.sum("n").alias("t"))
    p = n.groupBy(*by, F.col("pred").alias("c")).agg(F.sum("n").alias("p"))
    both = t.join(p, [*by, "c"], "full_outer").fillna(0.0, ["t", "p"])
    sums = both.groupBy(*by).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum("t").alias("s"))
    hit = n.groupBy(*by).agg(F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0.0)).alias("c"))
    x = sums.join(hit, list(by))
    root = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return x.select(*by, F.when(root != 0, (F.col("c") * F.col("s") - F.col("tp")) / root).otherwise(0.0).alias("mcc"))


def instance_counts(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(cls, tp, fp, fn, tn) from found (cls, tp, fp), over predicted components, and truth (cls, n), over true ones.

    fn = n - tp, below 0 where several predictions hit one component; tn = all - (tp + fn) over the components of all classes.
    """
    both = found.join(truth, "cls", "full_outer").crossJoin(truth.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))).fillna(0, ["tp", "fp", "n"])
    return both.select("cls", "tp", "fp", (F.col("n") - F.col("tp")).alias("fn"), (F.col("_all") - F.col("n")).alias("tn"))
