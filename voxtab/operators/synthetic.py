"""Synthetic rows of rare classes: balls at junctions, of radii drawn from those of real lesions."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.operators.components import components
from voxtab.operators.lesions import lesion_features
from voxtab.operators.space import AXES, ball_offsets
from voxtab.plans.totals import running_total


def radius_table(comps: DataFrame, spacing: tuple[float, float, float], low: float, high: float) -> DataFrame:
    """(place, radius): the equivalent radii of all components between low and high, in ascending order from place 0."""
    volume = F.count("*") * (spacing[0] * spacing[1] * spacing[2])
    radius = F.round(F.least(F.greatest(F.pow(volume * (3 / (4 * pi)), F.lit(1 / 3)), F.lit(low)), F.lit(high)), 9)
    r = comps.groupBy("case_id", "comp_id").agg(radius.alias("radius")).withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1))
    return running_total(r, "_all", ["radius", "case_id", "comp_id"], "_one", "place").select(F.col("place").cast("bigint").alias("place"), "radius")


def targets(nodes: DataFrame, kinds: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """(case_id, kind, cls, x, y, z): for each kind (class, classes of its node), in order, the case's first node that holds them."""
    rows = F.array(*[F.when(F.size(F.array_intersect("class_ids", F.array(*[F.lit(c) for c in need]))) == len(need), F.struct(F.lit(n).alias("kind"), F.lit(cls).alias("cls"))) for n, (cls, need) in enumerate(kinds)])
    each = nodes.select("case_id", F.explode(F.array_compact(rows)).alias("k"), F.struct("node_id", "x", "y", "z").alias("node"))
    return each.groupBy("case_id", "k").agg(F.min("node").alias("node")).select("case_id", "k.*", "node.x", "node.y", "node.z")


def balls(marks: DataFrame, radii: DataFrame, shape: tuple[int, int, int], high: float, spacing: tuple[float, float, float], least: int = 3) -> DataFrame:
    """(case_id, kind, i, j, k): a ball of a drawn radius around the voxel of each target; a voxel in several balls is the first kind's.

    The draw is a congruence of case and kind over the places of the radius table, so
    any order of tasks draws alike. Balls left with fewer than `least` voxels go, with
    the voxels that they took from later ones.
    """
    n = radii.agg(F.count("*").alias("_n"))
    place = F.pmod(F.col("case_id") * 7919 + F.col("kind") * 104729, F.col("_n"))
    drawn = marks.crossJoin(F.broadcast(n)).where("_n > 0").withColumn("place", place).join(radii, "place")
    offsets = F.array(*[F.struct(*[F.lit(x).alias(a) for x, a in zip(o, AXES)]) for o in ball_offsets(high, spacing)])
    d2 = sum((F.col(f"_o.{a}") * s) * (F.col(f"_o.{a}") * s) for a, s in zip(AXES, spacing))
    cells = drawn.withColumn("_o", F.explode(offsets)).where(F.round(d2, 9) <= F.round(F.col("radius") * F.col("radius"), 9))
    cells = cells.select("case_id", "kind", *[(F.round(F.round(F.col(c) / s, 6)).cast("int") + F.col(f"_o.{a}")).alias(a) for c, a, s in zip("xyz", AXES, spacing)])
    for a, size in zip(AXES, shape):
        cells = cells.where(F.col(a).between(0, size - 1))
    own = cells.groupBy("case_id", *AXES).agg(F.min("kind").alias("kind"))
    kept = own.groupBy("case_id", "kind").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return own.join(kept, ["case_id", "kind"], "left_semi").select("case_id", "kind", *AXES)


def synthetic_rows(drawn: DataFrame, marks: DataFrame, labels: DataFrame, reach: float, radius: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Lesion feature rows of the components that the balls form, with cls: that of the nearest drawn target within reach mm of the centre, ties to the first kind; those of no target go."""
    parts = components(drawn.select("case_id", *AXES), 26)
    centre = parts.groupBy("case_id", "comp_id").agg(*[(F.avg(a) * s).alias("c" + a) for a, s in zip(AXES, spacing)])
    there = marks.join(drawn.select("case_id", "kind").distinct(), ["case_id", "kind"], "left_semi")
    off = [F.col(c) - F.col("c" + a) for c, a in zip("xyz", AXES)]
    d = F.round(F.sqrt(off[0] * off[0] + off[1] * off[1] + off[2] * off[2]), 9)
    named = centre.join(there, "case_id").withColumn("_d", d).where(F.col("_d") < reach)
    named = named.groupBy("case_id", "comp_id").agg(F.min_by("cls", F.struct("_d", "kind")).alias("cls"))
    return lesion_features(parts, labels, radius, spacing).join(named, ["case_id", "comp_id"])
