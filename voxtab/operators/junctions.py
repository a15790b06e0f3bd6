"""Junction nodes: case_id, node_id, class_ids, x, y, z in millimetres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.plans.lineage import by_shuffle


def _gap() -> object:
    return F.sqrt(sum((F.col("a." + c) - F.col("b." + c)) * (F.col("a." + c) - F.col("b." + c)) for c in "xyz"))


def anchor_rates(nodes: DataFrame) -> DataFrame:
    """(a, b, cases, rate): cases with a node of both classes, and their share. A node's classes are a handful."""
    pairs = nodes.select("case_id", F.explode("class_ids").alias("a"), "class_ids").select("case_id", "a", F.explode("class_ids").alias("b")).where("a < b")
    n = pairs.groupBy("a", "b").agg(F.countDistinct("case_id").alias("cases"))
    return n.crossJoin(nodes.agg(F.countDistinct("case_id").alias("all"))).select("a", "b", "cases", (F.col("cases") / F.col("all")).alias("rate"))


def match_nodes(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """(case_id, node_id, kind): nodes of a with (true) or without (false) a node of b of the same classes within radius."""
    met = a.alias("a").join(by_shuffle(b).alias("b"), ["case_id", "class_ids"]).where(_gap() <= radius).select("case_id", F.col("a.node_id").alias("node_id")).distinct()
    hit = met.withColumn("_h", F.lit(True))
    return a.join(by_shuffle(hit), ["case_id", "node_id"], "left").select("case_id", "node_id", F.when(F.col("_h"), "true").otherwise("false").alias("kind"))


def atlas(nodes: DataFrame, least: int) -> DataFrame:
    """(sig, n, x, y, z): median position of node types seen at least `least` times."""
    sig = F.array_join(F.transform("class_ids", lambda c: c.cast("string")), ",")
    return nodes.groupBy(sig.alias("sig")).agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in "xyz"]).where(F.col("n") >= least)


def node_neighbourhood(nodes: DataFrame, radius: float) -> DataFrame:
    """(case_id, node_id, near, near3, nearest): other nodes of the case within radius, those of 3 classes or more, and the least gap."""
    pairs = nodes.alias("a").join(nodes.alias("b"), "case_id").where((F.col("a.node_id") != F.col("b.node_id")) & (_gap() <= radius))
    n = pairs.groupBy("case_id", F.col("a.node_id").alias("node_id")).agg(F.count("*").alias("near"), F.count_if(F.size("b.class_ids") >= 3).alias("near3"), F.min(_gap()).alias("nearest"))
    return nodes.select("case_id", "node_id").join(n, ["case_id", "node_id"], "left").fillna(0, ["near", "near3"])


def landmark_frame(nodes: DataFrame) -> DataFrame:
    """(case_id, node_id, px, py, pz): positions relative to the case's centre, in units of its spread."""
    spread = F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))
    o = nodes.groupBy("case_id").agg(*[F.avg(c).alias("o" + c) for c in "xyz"], F.when(spread > 0, spread).otherwise(1.0).alias("s"))
    y = nodes.join(o, "case_id")
    return y.select("case_id", "node_id", *[((F.col(c) - F.col("o" + c)) / F.col("s")).alias("p" + c) for c in "xyz"])
