"""Branches of centreline graphs: chains of degree-2 vertices contracted by pointer doubling, and the pruning of spurs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.operators.graph import skeleton_edges
from voxtab.operators.space import voxel_key
from voxtab.plans.lineage import few_or_shuffled, stored


def contract(edges: DataFrame, limit: float | None = None, most: int | None = None) -> DataFrame:
    """(case_id, u, v, own, at, len, steps, degree, done): for every arc u -> v, where following it through vertices of degree 2 leads.

    edges: (case_id, u, v, w) both ways. own is the degree of u; at is the first
    vertex on the way whose degree is not 2, degree that vertex's, len the length and
    steps the edges up to it. Every round each arc takes over what the arc at its end knows, so rounds
    grow with the logarithm of the longest chain. With a limit, arcs are followed no
    further once they are that long. done is false where a limit or a ring without
    any other vertex ended the way; at is then a vertex on it.
    With `most` (2 at least), only arcs whose u has a degree up to it are returned.
    Ways lead through arcs of vertices of degree 2 alone, so all other arcs are
    set aside at once, and the rounds read and write the rest.
    """
    around = edges.groupBy("case_id", "u").agg(F.count("*").alias("n"), F.sum("v").alias("both"))
    here = around.select("case_id", F.col("u").alias("v"), F.col("n").alias("degree"), F.col("both"))
    own = around.select("case_id", "u", F.col("n").alias("own"))
    arcs = edges.join(own if most is None else own.where(F.col("own") <= most), ["case_id", "u"]).join(here, ["case_id", "v"])
    nxt = F.when(F.col("degree") == 2, F.col("both") - F.col("u"))
    state = stored(arcs.select("case_id", "u", "v", "own", F.col("v").alias("at"), nxt.alias("nxt"), F.col("w").alias("len"), F.lit(1).alias("steps"), "degree"))
    rounds = max(1, state.count()).bit_length() + 1
    short = F.lit(True) if limit is None else F.round("len", 9) < limit
    open_ = F.col("nxt").isNotNull() & short
    aside, state = state.where(~open_ & (F.col("own") != 2)), state.where(open_ | (F.col("own") == 2))
    for _ in range(rounds):
        if state.where(open_).isEmpty():
            break
        ahead = state.where("own = 2").select(F.col("case_id").alias("_case"), *[F.col(c).alias("_" + c) for c in ("u", "v", "at", "nxt", "len", "steps", "degree")])
        moved = state.where(open_).join(ahead, (F.col("case_id") == F.col("_case")) & (F.col("at") == F.col("_u")) & (F.col("nxt") == F.col("_v")), "left")
        took = F.col("_u").isNotNull()
        of = lambda c: F.when(took, F.col("_" + c)).otherwise(F.col(c)).alias(c)
        sum_of = lambda c: F.when(took, F.col(c) + F.col("_" + c)).otherwise(F.col(c)).alias(c)
        moved = moved.select("case_id", "u", "v", "own", of("at"), of("nxt"), sum_of("len"), sum_of("steps"), of("degree"))
        state = stored(moved.unionByName(state.where(~open_)))
    return aside.unionByName(state).select("case_id", "u", "v", "own", "at", "len", "steps", "degree", F.col("nxt").isNull().alias("done"))


def branches(edges: DataFrame) -> DataFrame:
    """(case_id, a, b, len, n, degree_a, degree_b) of every chain between two vertices whose degree is not 2, once (a <= b): n counts the vertices between them.

    Rings without such a vertex are no branches. Of a ring at one junction, a = b.
    """
    ends = contract(edges).where("done and own <> 2")
    chain = ends.select("case_id", F.col("u").alias("a"), F.col("at").alias("b"), "len", (F.col("steps") - 1).alias("n"), F.col("own").alias("degree_a"), F.col("degree").alias("degree_b"))
    # A ring at one junction is met from both of its ends.
    ring = chain.where("a = b").withColumn("_len", F.round("len", 9)).groupBy("case_id", "a", "b", "n", "degree_a", "degree_b", "_len").agg(F.count("*").alias("k"), F.min("len").alias("len"))
    ring = ring.withColumn("_i", F.explode(F.sequence(F.lit(1), (F.col("k") / 2).cast("int"))))
    return chain.where("a < b").unionByName(ring.select(*chain.columns))


def prune_spurs(voxels: DataFrame, spur_mm: float, spacing: tuple[float, float, float], max_rounds: int = 20) -> DataFrame:
    """voxels without the branches shorter than spur_mm that start at an endpoint, again and again as new endpoints come up.

    A branch holds its endpoint, the vertices of degree 2 behind it, and the vertex
    where that ends: a junction voxel of the twig, or the other end of a short piece.
    Isolated voxels stay. All branches of a round go at once; after max_rounds
    rounds what is left is returned.
    """
    edges, gone = stored(skeleton_edges(voxels.select("case_id", "i", "j", "k"), spacing)), None
    for _ in range(max_rounds):
        arcs = contract(edges, spur_mm, most=2)
        short = arcs.where("done").withColumn("len", F.round("len", 9))
        ends = short.where((F.col("own") == 1) & (F.col("len") < spur_mm)).select("case_id", F.explode(F.array("u", "at")).alias("u"))
        both = short.where("own = 2").groupBy("case_id", "u").agg(F.count("*").alias("n"), F.sum("len").alias("len"), F.min("degree").alias("least"))
        inner = both.where((F.col("n") == 2) & (F.col("least") == 1) & (F.round("len", 9) < spur_mm)).select("case_id", "u")
        drop = stored(ends.unionByName(inner).distinct())
        n = drop.count()
        if n == 0:
            break
        gone = drop if gone is None else gone.unionByName(drop)
        drop = few_or_shuffled(drop, n)
        left = edges.join(drop, ["case_id", "u"], "left_anti").join(drop.withColumnRenamed("u", "v"), ["case_id", "v"], "left_anti")
        edges = stored(left.select("case_id", "u", "v", "w"))
    if gone is None:
        return voxels
    return voxels.withColumn("u", voxel_key()).join(gone, ["case_id", "u"], "left_anti").select(*voxels.columns)
