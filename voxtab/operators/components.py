"""Connected components of voxels, their statistics and filters."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxtab.operators.pieces import EDGE, labelled
from voxtab.operators.space import AXES, half_neighbours, range_join, shifted, voxel_key
from voxtab.plans.graph import connected_components
from voxtab.plans.lineage import by_shuffle, stored


def components(voxels: DataFrame, connectivity: int = 26, within: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """voxels with comp_id: the least voxel key of the 6- or 26-connected component inside the same `within` columns.

    Voxels are dealt to blocks of space, whose pieces are found inside a task; pieces
    of different blocks that touch are joined by star contraction, in a number of
    rounds that grows with the logarithm of their number. Rows without a place, or
    with a null in `within`, are components of their own.
    """
    on, offsets = list(within), half_neighbours(connectivity)
    known = F.lit(True)
    for c in (*within, *AXES):
        known = known & F.col(c).isNotNull()
    block = lambda a: F.floor(F.col(a) / EDGE).alias("b" + a)
    v = voxels.withColumn("_key", voxel_key()).withColumn("_ok", known)
    v = v.select("*", *[block(a) for a in AXES]).withColumn("_block", voxel_key("b")).drop(*["b" + a for a in AXES])
    schema = StructType([*v.schema, StructField("_root", LongType())])
    v = v.repartition(*within, "_block").sortWithinPartitions(*within, "_block")
    v = stored(v.mapInArrow(lambda rows: labelled(rows, on, offsets), schema))  # read by every user
    most = v.where("_ok").groupBy(*within).agg((F.max("_block") > F.min("_block")).alias("_many")).where("_many").select(*within)
    if most.isEmpty():
        return v.select(*voxels.columns, F.col("_root").alias("comp_id"))
    rim = F.lit(False)
    for a in AXES:
        rim = rim | F.pmod(F.col(a), F.lit(EDGE)).isin(0, EDGE - 1)
    faces = stored(v.where(F.col("_ok") & rim).join(by_shuffle(most), on, "left_semi").select(*within, *AXES, "_block", "_root"))
    met = range_join(faces, faces, 3**0.5 if connectivity == 26 else 1.0, (1.0, 1.0, 1.0), on=within).where("l__block <> r__block and l__root > r__root")
    found = connected_components(met.select(*within, F.col("l__root").alias("u"), F.col("r__root").alias("v")), "u", "v", within=within)
    found = found.select(*within, F.col("node").alias("_root"), F.col("component").alias("comp_id"))
    out = v.join(by_shuffle(found), [*within, "_root"], "left").withColumn("comp_id", F.coalesce("comp_id", "_root"))
    return stored(out.select(*voxels.columns, "comp_id"))


def component_stats(comps: DataFrame, spacing: tuple[float, float, float], by: tuple[str, ...] = ("case_id", "comp_id")) -> DataFrame:
    """Per component: n_vox, centroid, bounding box, volume in mm3, equivalent diameter, log10 of the volume."""
    volume = F.count("*") * (spacing[0] * spacing[1] * spacing[2])
    return comps.groupBy(*by).agg(
        F.count("*").alias("n_vox"),
        *[F.avg(a).alias(f"c{a}") for a in AXES],
        *[F.min(a).alias(f"min_{a}") for a in AXES],
        *[F.max(a).alias(f"max_{a}") for a in AXES],
        volume.alias("vol_mm3"),
        (2 * F.pow(volume * (3 / (4 * pi)), F.lit(1 / 3))).alias("diameter_mm"),
        F.log10(volume).alias("log_vol"),
    )


def mask_distance(comps: DataFrame, mask: DataFrame, radius: float, spacing: tuple[float, float, float]) -> DataFrame:
    """(case_id, comp_id, dist): least distance of each component to the mask within radius."""
    pairs = range_join(comps.select("case_id", "comp_id", *AXES), mask.select("case_id", *AXES), radius, spacing)
    return pairs.groupBy("case_id", F.col("l_comp_id").alias("comp_id")).agg(F.min("d").alias("dist"))


def filter_components(comps: DataFrame, mask: DataFrame, min_vox: int, max_dist: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Components of at least min_vox voxels within max_dist of the mask; size is judged before any distance."""
    large = comps.groupBy("case_id", "comp_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_vox)
    kept = comps.join(large, ["case_id", "comp_id"], "left_semi")
    return kept.join(mask_distance(kept, mask, max_dist, spacing), ["case_id", "comp_id"], "left_semi")


def largest_component(comps: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, comp_id, n_vox) of the largest component of each group, ties to the lowest id."""
    n = comps.groupBy(*by, "comp_id").agg(F.count("*").alias("n_vox"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n_vox"), "comp_id"))
    return n.withColumn("_r", rank).where("_r = 1").drop("_r")


def prune_small(comps: DataFrame, learned: DataFrame, floor_vox: int = 5, share: float = 0.05) -> DataFrame:
    """(case_id, cls, comp_id, n_vox) kept: n_vox >= max(floor, min(learned minimum, share of the largest)); the largest if none is."""
    n = comps.groupBy("case_id", "cls", "comp_id").agg(F.count("*").alias("n_vox")).join(F.broadcast(learned), "cls", "left")
    w = W.partitionBy("case_id", "cls")
    top = F.max("n_vox").over(w)
    n = n.withColumn("_ok", F.col("n_vox") >= F.greatest(F.lit(floor_vox), F.least("min_cc_vox", top * share)))
    n = n.withColumn("_any", F.max("_ok").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n_vox"), "comp_id")))
    return n.where("_ok or (not _any and _r = 1)").select("case_id", "cls", "comp_id", "n_vox")


def touching(comps: DataFrame, connectivity: int = 26) -> DataFrame:
    """(case_id, comp_id, cls, other_comp, other_cls, contacts): neighbouring voxels of different class, both ways."""
    from voxtab.operators.space import box_offsets, cross_offsets

    offs = [o for o in (box_offsets(1) if connectivity == 26 else cross_offsets(1)) if o != (0, 0, 0)]
    near = shifted(comps.select("case_id", *AXES, "comp_id", "cls"), offs)
    other = comps.select("case_id", *AXES, F.col("comp_id").alias("other_comp"), F.col("cls").alias("other_cls"))
    met = near.join(other, ["case_id", *AXES]).where("cls <> other_cls")
    return met.groupBy("case_id", "comp_id", "cls", "other_comp", "other_cls").agg(F.count("*").alias("contacts"))


def drop_orphans(comps: DataFrame, allowed: DataFrame) -> DataFrame:
    """(case_id, cls, comp_id) kept: all but components that are not the largest of their class, touch something, and touch no allowed class (cls, other_cls)."""
    top = largest_component(comps, ("case_id", "cls")).select("case_id", "cls", "comp_id")
    met = touching(comps)
    good = met.join(F.broadcast(allowed), ["cls", "other_cls"], "left_semi").select("case_id", "cls", "comp_id").distinct()
    bad = met.select("case_id", "cls", "comp_id").distinct().join(by_shuffle(good), ["case_id", "cls", "comp_id"], "left_anti").join(by_shuffle(top), ["case_id", "cls", "comp_id"], "left_anti")
    return comps.select("case_id", "cls", "comp_id").distinct().join(by_shuffle(bad), ["case_id", "cls", "comp_id"], "left_anti")
