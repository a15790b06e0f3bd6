"""Detector operating points over a grid of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.operators.components import mask_distance
from voxtab.operators.space import AXES
from voxtab.plans.lineage import by_shuffle, stored


def detection_sweep(pred: DataFrame, truth: DataFrame, vessels: DataFrame, grid: DataFrame, radius: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Per grid row (min_vox, max_dist): true components hit, and kept components that hit none.

    Component sizes, distances and hits are computed once; the grid, a handful of
    rows, is broadcast over components.
    """
    size = pred.groupBy("case_id", "comp_id").agg(F.count("*").alias("n"))
    table = stored(size.join(mask_distance(pred, vessels, radius, spacing), ["case_id", "comp_id"]))
    key = ["case_id", *AXES]
    hits = pred.select(*key, "comp_id").join(truth.select(*key, F.col("comp_id").alias("gt")), key).select("case_id", "comp_id", "gt").distinct()
    kept = table.join(F.broadcast(grid), (F.col("n") >= F.col("min_vox")) & (F.col("dist") <= F.col("max_dist") + 1e-9))
    met = kept.join(by_shuffle(hits), ["case_id", "comp_id"], "left")
    found = met.groupBy("min_vox", "max_dist").agg(F.countDistinct(F.when(F.col("gt").isNotNull(), F.struct("case_id", "gt"))).alias("hits"), F.count_if(F.col("gt").isNull()).alias("false_comps"))
    return grid.join(found, ["min_vox", "max_dist"], "left").fillna(0, ["hits", "false_comps"])
