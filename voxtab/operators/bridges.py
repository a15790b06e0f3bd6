"""Bridging gaps between pieces of a centreline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.operators.space import AXES, range_join
from voxtab.plans.graph import connected_components
from voxtab.plans.lineage import stored


def bridge_components(points: DataFrame, gap: float, spacing: tuple[float, float, float]) -> DataFrame:
    """(case_id, a, b, w, bridged): the gaps that joining in ascending length accepts, and the least comp_id of what they unite.

    points: (case_id, comp_id, i, j, k), the ends of the pieces. Pieces a < b are
    as far apart as their nearest ends, within `gap` mm; equal lengths go by (a, b).
    Every round takes the shortest gap out of each united piece, which gives the
    same gaps as one ascending pass and at least halves the pieces in play.
    """
    ends = points.select("case_id", "comp_id", *AXES).distinct()
    pairs = range_join(ends, ends, gap, spacing).where("l_comp_id < r_comp_id")
    least = pairs.groupBy("case_id", F.col("l_comp_id").alias("a"), F.col("r_comp_id").alias("b")).agg(F.round(F.min("d"), 9).alias("w"))
    live = stored(least.select("case_id", "a", "b", "w", F.col("a").alias("la"), F.col("b").alias("lb")))
    taken = live.select("case_id", "a", "b", "w").limit(0)
    label = None
    while not live.isEmpty():
        sides = live.select("case_id", F.explode(F.array("la", "lb")).alias("l"), F.struct("w", "a", "b").alias("e"))
        best = sides.groupBy("case_id", "l").agg(F.min("e").alias("e")).select("case_id", "e.a", "e.b", "e.w")
        taken = stored(taken.unionByName(best.distinct()))
        roots = connected_components(taken, "a", "b", within=("case_id",))
        label = stored(roots.select("case_id", F.col("node").alias("comp"), F.col("component").alias("root")))
        of = lambda c, name: label.select("case_id", F.col("comp").alias(c), F.col("root").alias(name))
        moved = live.drop("la", "lb").join(of("a", "la"), ["case_id", "a"]).join(of("b", "lb"), ["case_id", "b"])
        live = stored(moved.where("la <> lb").select("case_id", "a", "b", "w", "la", "lb"))
    if label is None:
        return taken.withColumn("bridged", F.col("a"))
    return taken.join(label.select("case_id", F.col("comp").alias("a"), F.col("root").alias("bridged")), ["case_id", "a"]).select("case_id", "a", "b", "w", "bridged")
