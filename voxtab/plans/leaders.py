"""Joins of many rows with the leaders of their groups, where a few groups may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot if it holds one in so many of all grouped rows; no table has more hot groups than this.
HOT = 1024


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions, for Python stages whose rows are few and slow."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_leaders(rows: DataFrame, leaders: DataFrame, key: str, size: str = "n") -> DataFrame:
    """Inner join of rows with leaders: one row per key, with the number of rows of its group in `size`; the key is dropped.

    Leaders of hot groups (one in HOT of all grouped rows or more, so HOT groups at
    most, whatever the input) are broadcast, and the rows that have found them are
    dealt by a hash of the whole row in the shuffle of the others, so no task gets
    a hot group. rows is read once, leaders three times: it should be a written table.
    """
    total, top = leaders.agg(F.sum(size), F.max(size)).first()
    rows, names = rows.where(F.col(key).isNotNull()), [c for c in leaders.columns if c not in (key, size)]
    if total is None or top * HOT < total:
        return rows.join(leaders.drop(size), key).drop(key)
    hot, values = F.col(size) * HOT >= total, F.struct(*names)
    marked = rows.join(F.broadcast(leaders.where(hot).select(key, values.alias("_hot"))), key, "left")
    spread = F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)
    marked = marked.withColumn("_found", F.col("_hot").isNotNull()).withColumn("_key", F.when(F.col("_found"), spread).otherwise(F.col(key))).drop(key)
    cold = leaders.where(~hot).select(F.col(key).alias("_key"), F.lit(False).alias("_found"), values.alias("_cold"))
    both = marked.join(cold, ["_key", "_found"], "left").withColumn("_one", F.coalesce("_hot", "_cold")).where("_one is not null")
    return both.select(*[c for c in rows.columns if c != key], *[F.col(f"_one.{c}") for c in names])
