"""Where lesions sit on vessels: necks, protrusions, vessel thickness, and blobs that no truth explains.

Lesions and vessels are voxel tables (case_id, i, j, k, ...), lesions with a
comp_id. Repeated voxels of a vessel count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.operators.components import components, largest_component
from voxtab.operators.space import AXES, ball_offsets, least_distances, nearest, range_join, shifted
from voxtab.plans.lineage import by_shuffle, stored

COMP = ("case_id", "comp_id")
PLACE = ("case_id", *AXES)


def neck_set(lesions: DataFrame, vessel: DataFrame) -> DataFrame:
    """(case_id, comp_id, i, j, k, whole): the largest 26-connected piece of lesion and vessel, ties to the least id; the whole lesion where they do not meet."""
    own = lesions.select(*COMP, *AXES)
    met = own.join(vessel.select(*PLACE), list(PLACE), "left_semi")
    pieces = components(met.withColumnRenamed("comp_id", "lesion"), 26, ("case_id", "lesion"))
    top = largest_component(pieces, ("case_id", "lesion"))
    neck = pieces.join(top, ["case_id", "lesion", "comp_id"], "left_semi").select("case_id", F.col("lesion").alias("comp_id"), *AXES)
    rest = own.join(top.select("case_id", F.col("lesion").alias("comp_id")), list(COMP), "left_anti")
    return neck.withColumn("whole", F.lit(False)).unionByName(rest.withColumn("whole", F.lit(True)))


def side_flips(whole: DataFrame, neck: DataFrame) -> DataFrame:
    """(case_id, comp_id, cls, whole_mm, neck_mm, flip) from two distance tables (case_id, comp_id, cls, dist).

    flip: the class nearest to the neck is of another side (parity of its number)
    than the one nearest to the whole lesion, ties to the smaller class; false
    where the neck has no class in reach.
    """
    side = lambda t, name: t.groupBy(*COMP).agg((F.min_by("cls", F.struct(F.round("dist", 9), "cls")) % 2).alias(name))
    near = neck.select(*COMP, "cls", F.col("dist").alias("neck_mm"))
    both = whole.select(*COMP, "cls", F.col("dist").alias("whole_mm")).join(near, [*COMP, "cls"], "left")
    sides = side(whole, "a").join(side(neck, "b"), list(COMP), "left")
    return both.join(sides, list(COMP)).select(*COMP, "cls", "whole_mm", "neck_mm", F.coalesce(F.col("a") != F.col("b"), F.lit(False)).alias("flip"))


def protrusion(lesions: DataFrame, vessel: DataFrame, radius: float, spacing: tuple[float, float, float], rim: float = 0.6, tip: float = 0.8) -> DataFrame:
    """(case_id, comp_id, parent, length, ui, uj, uk): from the neck's centre to the tip's, in millimetres, and its unit vector.

    The neck is all voxels within `rim` mm of the least vessel distance, the tip
    those at `tip` or more of the largest; the parent is the class nearest to most
    voxels of the neck, ties to the smaller. Voxels without a vessel within radius
    are left out, lesions without any too; a length of 0 has no direction (null).
    """
    near = nearest(lesions.select(*COMP, *AXES), vessel, radius, spacing).where("d is not null")
    ends = near.groupBy(*COMP).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    x = near.join(ends, list(COMP))
    is_neck = F.round("d", 9) <= F.round(F.col("lo") + rim, 9)
    is_tip = F.round("d", 9) >= F.round(F.col("hi") * tip, 9)
    centre = lambda a, s, which: F.avg(F.when(which, F.col(a) * s))
    move = x.groupBy(*COMP).agg(*[(centre(a, s, is_tip) - centre(a, s, is_neck)).alias("m" + a) for a, s in zip(AXES, spacing)])
    votes = x.where(is_neck).groupBy(*COMP, "nearest_cls").agg(F.count("*").alias("n"))
    parent = votes.groupBy(*COMP).agg(F.min_by("nearest_cls", F.struct(-F.col("n"), "nearest_cls")).alias("parent"))
    length = F.sqrt(F.col("mi") * F.col("mi") + F.col("mj") * F.col("mj") + F.col("mk") * F.col("mk"))
    out = move.join(parent, list(COMP)).withColumn("length", length)
    return out.select(*COMP, "parent", "length", *[F.when(F.col("length") > 1e-9, F.col("m" + a) / F.col("length")).alias("u" + a) for a in AXES])


def inner_distance(voxels: DataFrame, spacing: tuple[float, float, float]) -> DataFrame:
    """(case_id, i, j, k, inner): distance of each voxel to the nearest position of its case that is none.

    Shells of growing radius are looked up by an equi-join on position, and only
    voxels whose inner shells are full go on, so the work follows the thickness.
    """
    full = stored(voxels.select(*PLACE).distinct())
    open_, done, inside, reach = full, None, {(0, 0, 0)}, max(spacing)
    while True:
        ball = ball_offsets(reach, spacing)
        shell = [o for o in ball if o not in inside]
        own = open_.select(*PLACE, *[F.col(a).alias("o" + a) for a in AXES])
        free = shifted(own, shell).join(full, list(PLACE), "left_anti")
        gap = F.sqrt(sum(((F.col(a) - F.col("o" + a)) * F.lit(s)) * ((F.col(a) - F.col("o" + a)) * F.lit(s)) for a, s in zip(AXES, spacing)))
        hit = stored(free.groupBy("case_id", *[F.col("o" + a).alias(a) for a in AXES]).agg(F.min(gap).alias("inner")))
        done = hit if done is None else done.unionByName(hit)
        open_ = stored(open_.join(hit, list(PLACE), "left_anti"))
        if open_.isEmpty():
            return done
        inside, reach = set(ball), reach + max(spacing)


def parent_thickness(lesions: DataFrame, thickness: DataFrame, radius: float, spacing: tuple[float, float, float]) -> DataFrame:
    """(case_id, comp_id, parent_mm, ratio): largest inner distance of the vessel within radius of a lesion, and its ratio to the 95th percentile of the case."""
    pairs = range_join(lesions.select(*COMP, *AXES), thickness, radius, spacing)
    own = pairs.groupBy("case_id", F.col("l_comp_id").alias("comp_id")).agg(F.max("r_inner").alias("parent_mm"))
    case = thickness.groupBy("case_id").agg(F.percentile("inner", F.lit(0.95)).alias("p95"))
    return own.join(case, "case_id").select(*COMP, "parent_mm", (F.col("parent_mm") / F.col("p95")).alias("ratio"))


def false_blobs(found: DataFrame, truth: DataFrame, radius: float | None, spacing: tuple[float, float, float]) -> DataFrame:
    """(case_id, comp_id, rank, cls, n, n_vox, gt_mm): the first and second class of every component that meets no truth.

    Classes rank by their voxels, ties to the smaller; gt_mm is the distance to
    the truth, where that is within radius if one is given; null in cases without truth.
    """
    met = found.join(truth.select(*PLACE), list(PLACE), "left_semi").select(*COMP).distinct()
    false = found.join(by_shuffle(met), list(COMP), "left_anti")
    n = false.groupBy(*COMP, "cls").agg(F.count("*").alias("n"))
    w = W.partitionBy(*COMP)
    n = n.withColumn("n_vox", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "cls"))).where("rank <= 2")
    if radius is None:
        gap = least_distances(false.select(*COMP, *AXES), truth.select(*PLACE), list(COMP), 1.2, spacing, "gt_mm")
    else:
        gap = range_join(false.select(*COMP, *AXES), truth.select(*PLACE), radius, spacing).groupBy("case_id", F.col("l_comp_id").alias("comp_id")).agg(F.min("d").alias("gt_mm"))
    return n.join(by_shuffle(gap), list(COMP), "left").select(*COMP, "rank", "cls", "n", "n_vox", "gt_mm")
