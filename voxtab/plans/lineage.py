"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where tables go when the session names no folder (tests, a laptop).
LOCAL_DIR = "file:///tmp/checkpoints"

#: No table of more rows, of a few numbers each, is broadcast.
FEW = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or our own where it is unset and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder, and executors do not share this machine's")
    return (named or LOCAL_DIR).rstrip("/")


def materialize(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result has a one-step lineage, survives lost executors, and is computed
    once however often it is used. Row order is not kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for joins with tables that grow with the input as it does: it is shuffled, never broadcast.

    Spark takes the size of a table's files for that of its rows, which are ten times
    as large or more, so it would broadcast tables that the driver cannot hold.
    """
    return df.hint("merge")


def stored(df: DataFrame) -> DataFrame:
    """materialize, for tables of voxels, vertices or edges: joins shuffle them."""
    return by_shuffle(materialize(df))


def few_or_shuffled(df: DataFrame, n: int) -> DataFrame:
    """df of n rows for a join with a larger table, which is shuffled only if df is too large to broadcast."""
    return F.broadcast(df) if n <= FEW else by_shuffle(df)
