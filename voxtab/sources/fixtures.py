"""Voxel, intensity, probability, node, run and fold tables derived from the general test tables.

Each builder takes (spark, sf_dir) and returns a DataFrame whose size follows the
input; SQL holds the same definitions for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Millimetres per step on (i, j, k).
SPACING = (0.4, 0.4, 0.6)
LAYERS = {"R": "prediction", "A": "vessel", "N": "truth"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(x: DataFrame) -> dict:
    return {
        "i": F.col("l_quantity").cast("int"),
        "j": F.round(F.col("l_discount") * 100).cast("int"),
        "k": F.round(F.col("l_tax") * 100).cast("int"),
    }


def vox(spark: SparkSession, sf_dir: str, layer: str | None = None) -> DataFrame:
    """case_id, layer, i, j, k, cls: sparse label voxels in three layers."""
    x = table(spark, sf_dir, "lineitem")
    if layer:
        x = x.where(F.col("l_returnflag") == layer)
    g = _grid(x)
    keys = [F.col("l_suppkey").alias("case_id"), F.col("l_returnflag").alias("layer"), *[c.alias(n) for n, c in g.items()]]
    return x.groupBy(*keys).agg(F.min("l_linenumber").cast("int").alias("cls"))


def intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, modality, mask, value, i, j, k: one row per measured voxel."""
    x = table(spark, sf_dir, "lineitem")
    g = _grid(x)
    flag = F.col("l_returnflag")
    return x.select(
        F.col("l_suppkey").alias("case_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "CT").otherwise("MR").alias("modality"),
        F.when(flag == "R", "aneurysm").when(flag == "A", "vessel").otherwise("brain").alias("mask"),
        (F.col("l_extendedprice") / 100 - 500).alias("value"),
        *[c.alias(n) for n, c in g.items()],
    )


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lesion, case_id, truth, seed, cls, p: class probabilities of 3 seeds over 10 classes."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    e = e.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(9))))
    w = 1 + (F.col("vec_id") * 7919 + F.col("cls") * 104729 + F.col("seed") * 31337) % 97 + F.when(F.col("cls") == F.col("label"), 60).otherwise(0)
    from pyspark.sql import Window as W

    e = e.withColumn("w", w.cast("double"))
    p = F.col("w") / F.sum("w").over(W.partitionBy("vec_id", "seed"))
    return e.select(F.col("vec_id").alias("lesion"), F.floor(F.col("vec_id") / 3).alias("case_id"), F.col("label").alias("truth"), "seed", "cls", p.alias("p"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lesion, case_id, seed, truth, pred: argmax of probs; -1 as truth is a false detection, a null pred a miss."""
    p = probs(spark, sf_dir).groupBy("lesion", "case_id", "truth", "seed").agg(F.min_by("cls", F.struct(-F.col("p"), "cls")).alias("pred"))
    return p.select(
        "lesion", "case_id", "seed",
        F.when(F.col("lesion") % 11 == 0, -1).otherwise(F.col("truth")).alias("truth"),
        F.when(F.col("lesion") % 13 != 0, F.col("pred")).alias("pred"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, node_id, class_ids, x, y, z, n_transition_vox: junction nodes."""
    x = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")
    return x.groupBy(F.col("l_suppkey").alias("case_id"), (F.col("l_partkey") % 100).alias("node_id")).agg(
        F.sort_array(F.collect_set(F.col("l_linenumber").cast("int"))).alias("class_ids"),
        (F.avg("l_quantity") * 0.4).alias("x"), (F.avg("l_discount") * 40).alias("y"), (F.avg("l_tax") * 60).alias("z"),
        F.count("*").alias("n_transition_vox"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag, seed, case_id, cls, tp, fp, fn, value, props: metric rows of runs."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tag"), (F.dayofmonth("ts") % 5).alias("seed"), F.col("user_id").alias("case_id"), (F.col("event_id") % 7).alias("cls"),
        (v >= 15).cast("int").alias("tp"), (v < 5).cast("int").alias("fp"), ((v >= 5) & (v < 10)).cast("int").alias("fn"), "value", "props",
    )


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, patient_id: cases of patients."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("patient_id"))


#: The same tables for DuckDB.
SQL = {
    "vox": "SELECT l_suppkey AS case_id, l_returnflag AS layer, CAST(l_quantity AS INT) AS i, CAST(round(l_discount*100) AS INT) AS j, CAST(round(l_tax*100) AS INT) AS k, CAST(min(l_linenumber) AS INT) AS cls FROM lineitem GROUP BY 1,2,3,4,5",
    "inten": "SELECT l_suppkey AS case_id, CASE WHEN l_suppkey % 2 = 0 THEN 'CT' ELSE 'MR' END AS modality, CASE l_returnflag WHEN 'R' THEN 'aneurysm' WHEN 'A' THEN 'vessel' ELSE 'brain' END AS mask, l_extendedprice/100 - 500 AS value, CAST(l_quantity AS INT) AS i, CAST(round(l_discount*100) AS INT) AS j, CAST(round(l_tax*100) AS INT) AS k FROM lineitem",
    "probs": "SELECT vec_id AS lesion, vec_id // 3 AS case_id, label AS truth, CAST(seed AS INT) AS seed, CAST(c AS INT) AS cls, w * 1.0 / sum(w) OVER (PARTITION BY vec_id, seed) AS p FROM (SELECT e.vec_id, e.label, s.seed, k.c, 1 + (e.vec_id*7919 + k.c*104729 + s.seed*31337) % 97 + CASE WHEN k.c = e.label THEN 60 ELSE 0 END AS w FROM embeddings e, range(0,10) k(c), range(0,3) s(seed))",
    "dec": "SELECT lesion, case_id, seed, CASE WHEN lesion % 11 = 0 THEN -1 ELSE truth END AS truth, CASE WHEN lesion % 13 <> 0 THEN cls END AS pred FROM (SELECT *, row_number() OVER (PARTITION BY lesion, seed ORDER BY p DESC, cls) AS rn FROM probs) WHERE rn = 1",
    "nodes": "SELECT l_suppkey AS case_id, l_partkey % 100 AS node_id, list_sort(list_distinct(list(CAST(l_linenumber AS INT)))) AS class_ids, avg(l_quantity)*0.4 AS x, avg(l_discount)*40 AS y, avg(l_tax)*60 AS z, count(*) AS n_transition_vox FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1,2",
    "runs": "SELECT event_type AS tag, CAST(dayofmonth(ts) % 5 AS INT) AS seed, user_id AS case_id, event_id % 7 AS cls, CAST(value >= 15 AS INT) AS tp, CAST(value < 5 AS INT) AS fp, CAST(value >= 5 AND value < 10 AS INT) AS fn, value, props FROM events",
    "folds": "SELECT o_orderkey AS case_id, o_custkey AS patient_id FROM orders",
}


def with_tables(body: str, /, *names: str, recursive: bool = False, **more: str) -> str:
    """DuckDB SQL: the named tables, further ones, then the body."""
    if "dec" in names and "probs" not in names:
        names = ("probs", *names)
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}"
