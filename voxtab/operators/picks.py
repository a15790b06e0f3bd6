"""Which voxels of a component to give away, and what rare classes get."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from voxtab.operators.space import AXES, voxel_key
from voxtab.plans.lineage import stored

COMP = ("case_id", "comp_id")


def farthest_points(comps: DataFrame, budget: int) -> DataFrame:
    """(case_id, comp_id, i, j, k, nth) of the first `budget` voxels of each component: the one nearest to its centre, then again and again the one farthest from all picked.

    Distances are in steps; ties go to the smaller key. One round per pick serves all
    components: every voxel holds its distance to the picked ones. Components of
    `budget` voxels or fewer are given in order of their distance from the centre.
    """
    x = comps.select(*COMP, *AXES).distinct()
    centre = x.groupBy(*COMP).agg(F.count("*").alias("n"), *[F.avg(a).alias("c" + a) for a in AXES])
    square = lambda p: sum((F.col(a) - F.col(p + a)) * (F.col(a) - F.col(p + a)) for a in AXES)
    x = x.join(centre, list(COMP)).select(*COMP, *AXES, "n", F.round(square("c"), 9).alias("d"))
    few = x.where(F.col("n") <= budget).withColumn("nth", F.row_number().over(W.partitionBy(*COMP).orderBy("d", voxel_key())))
    out = few.select(*COMP, *AXES, "nth")
    state = stored(x.where(F.col("n") > budget).select(*COMP, *AXES, (-F.col("d")).alias("far")))
    for nth in range(1, budget + 1):
        best = F.min_by(F.struct(*[F.col(a).alias("p" + a) for a in AXES], "far"), F.struct(-F.col("far"), voxel_key())).alias("b")
        pick = stored(state.groupBy(*COMP).agg(best).select(*COMP, "b.*"))
        if nth > 1:  # none left that is not picked
            pick = pick.where("far > 0")
        out = out.unionByName(pick.select(*COMP, *[F.col("p" + a).alias(a) for a in AXES], F.lit(nth).alias("nth")))
        if nth < budget:
            now = square("p").cast("double")
            near = now if nth == 1 else F.least("far_", now)
            moved = state.withColumnRenamed("far", "far_").join(pick.drop("far"), list(COMP)).select(*COMP, *AXES, near.alias("far"))
            state = stored(moved)
    return out


def rare_similarity(rows: DataFrame, rare: DataFrame, block: int = 8192) -> DataFrame:
    """(vec_id, cls, sim): the largest cosine of each row (vec_id, fold, label, x) with a row of another fold that has the rare label cls.

    All rows against all rows of rare labels, however many: both are dealt to blocks
    of bounded size, and every block of rows meets every block of rare ones in a task
    of its own, as products of matrices, some rows at a time. Arrays that are null,
    zero, hold a null or have another length are like none, and folds that are null meet none.
    """
    dot = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    usable = rows.withColumn("_n", F.sqrt(dot)).where("_n > 0 and fold is not null")
    plain = [F.col("fold").cast("bigint").alias("fold"), F.col("x").cast("array<double>").alias("x"), F.col("_n").alias("_n")]
    q = usable.select("vec_id", *plain).distinct()
    t = usable.join(F.broadcast(rare.select(F.col("cls").alias("label"))), "label", "left_semi").select(F.col("label").alias("cls"), *plain).distinct()
    sets, blocks = (max(df.count() // block, 3) + 1 for df in (q, t))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    q = q.withColumn("dims", F.size("x")).withColumn("set", F.pmod(F.xxhash64("vec_id", "x"), F.lit(sets))).withColumn("block", F.explode(upto(blocks)))
    t = t.withColumn("dims", F.size("x")).withColumn("block", F.pmod(F.xxhash64("cls", "fold", "x"), F.lit(blocks))).withColumn("set", F.explode(upto(sets)))
    ids = StructType([q.schema["vec_id"], t.schema["cls"]])
    kinds = to_arrow_schema(ids)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [pa.table([pa.array([], f.type) for f in kinds] + [pa.array([], pa.float64())], names=["vec_id", "cls", "sim"])]
        if left.num_rows and right.num_rows:
            right = right.sort_by([("cls", "ascending"), ("fold", "ascending")])
            unit = lambda x: np.stack(x.column("x").to_numpy()) / x.column("_n").to_numpy()[:, None]
            a, b = unit(left), unit(right).T
            own, fold, cls = left.column("fold").to_numpy(), right.column("fold").to_numpy(), right.column("cls").to_numpy()
            first = lambda *keys: np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            runs = first(cls, fold)  # rows of one label and fold stand together
            tops = first(cls[runs])
            for lo in range(0, len(a), 512):
                top = np.maximum.reduceat(a[lo : lo + 512] @ b, runs, axis=1)
                top = np.maximum.reduceat(np.where(own[lo : lo + 512, None] != fold[runs], top, -np.inf), tops, axis=1)
                r, c = np.nonzero(~np.isneginf(top))
                found.append(pa.table([left.column("vec_id").take(pa.array(lo + r)), right.column("cls").take(pa.array(runs[tops[c]])), pa.array(top[r, c])], names=["vec_id", "cls", "sim"]))
        return pa.concat_tables(found).cast(kinds.append(pa.field("sim", pa.float64())))

    meeting = ["set", "block", "dims"]
    best = q.groupBy(*meeting).cogroup(t.groupBy(*meeting)).applyInArrow(meet, StructType([*ids, StructField("sim", DoubleType())]))
    return best.groupBy("vec_id", "cls").agg(F.max("sim").alias("sim"))


def rare_boost(probs: DataFrame, similarity: DataFrame, power: float) -> DataFrame:
    """probs (vec_id, cls, p) times sim ** power (at least 1e-6) for the classes in similarity, normalised again; a row whose total is 0 stays."""
    x = probs.join(similarity, ["vec_id", "cls"], "left").withColumn("q", F.when(F.col("sim").isNotNull(), F.col("p") * F.pow(F.greatest("sim", F.lit(1e-6)), F.lit(power))).otherwise(F.col("p")))
    total = F.sum("q").over(W.partitionBy("vec_id"))
    return x.withColumn("p", F.when(total > 0, F.col("q") / total).otherwise(F.col("p"))).select("vec_id", "cls", "p")


def rare_blend(probs: DataFrame, other: DataFrame, rare: DataFrame, share: float) -> DataFrame:
    """probs (vec_id, cls, p) whose rare classes keep their mass, `share` of which is dealt as `other` (vec_id, cls, q) deals it among them; a row without such mass in other stays."""
    x = probs.join(other, ["vec_id", "cls"], "left").join(F.broadcast(rare.select("cls").withColumn("_rare", F.lit(True))), "cls", "left")
    w = W.partitionBy("vec_id")
    rare_ = F.coalesce("_rare", F.lit(False))
    x = x.withColumn("_keep", F.sum(F.when(rare_, F.col("p"))).over(w)).withColumn("_sub", F.sum(F.when(rare_, F.col("q"))).over(w))
    mixed = (1 - share) * F.col("p") + share * F.col("_keep") * F.coalesce("q", F.lit(0.0)) / F.col("_sub")
    x = x.withColumn("m", F.when(rare_ & (F.col("_sub") > 0), mixed).otherwise(F.col("p")))
    total = F.sum("m").over(w)
    # Sums come in any order; twelve decimals hide that, so that halves of a later digit round alike.
    return x.select("vec_id", "cls", F.round(F.when(total > 0, F.col("m") / total).otherwise(F.col("p")), 12).alias("p"))
