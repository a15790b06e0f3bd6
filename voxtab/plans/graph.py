"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.plans.lineage import FEW, by_shuffle, materialize


def _both_ways(edges: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return edges.unionByName(edges.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, wide: bool, by: tuple[str, ...]) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest node around u."""
    around = _both_ways(edges, by)
    low = around.groupBy(*by, "u").agg(F.min("v").alias("low"))
    tied = around.join(by_shuffle(low) if wide else low, [*by, "u"]).where("v > u")
    return tied.select(*by, F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(edges: DataFrame, wide: bool, by: tuple[str, ...]) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is tied to the smallest of them. Edges have u > v."""
    low = edges.groupBy(*by, "u").agg(F.min("v").alias("low"))
    tied = edges.join(by_shuffle(low) if wide else low, [*by, "u"]).where("v <> low").select(*by, F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.unionByName(low.select(*by, "u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, node, component) for every node that has an edge; component is the smallest node id reachable.

    edges: any two columns of one orderable type; nulls and self-loops are left
    out, repeated edges count once. Ids of different `within` columns are different
    nodes. Rounds grow with the logarithm of the number of nodes; each round's edges
    are written to the shared folder, so a lost executor costs one round at most. An
    empty table gives an empty result.
    """
    e = edges.select(*within, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = e.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).distinct()
    state = materialize(e)
    before, wide = None, state.count() > FEW
    for _ in range(max_rounds):
        state = materialize(_small_star(_large_star(state, wide, within), wide, within))
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64(*within, "u", "v")), F.bit_xor(F.xxhash64(*within, "v", "u"))).first())
        if now == before:
            break
        before, wide = now, now[0] > FEW
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(*within, F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(*within, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
