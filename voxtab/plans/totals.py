"""Running totals over tables of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.plans.leaders import tasks
from voxtab.plans.lineage import materialize


def running_total(rows: DataFrame, group: str, order: list[str], value: str, name: str = "before") -> DataFrame:
    """rows with `name`: the sum of value over the rows of the same group (not null) that come earlier in `order`.

    Rows are dealt by ranges of (group, order), nulls first; each range is summed on
    its own, and a range's sums of the ranges before it, one row per group and range,
    are added. Rows that agree in group and order are in one range, in any order.
    """
    part, mine = F.spark_partition_id(), [group, *order]
    dealt = materialize(rows.repartitionByRange(max(2, tasks(rows)), *mine).withColumn("_part", part))
    inside = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranges = dealt.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    ranges = ranges.withColumn("_base", F.coalesce(F.sum("_sum").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    summed = dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(ranges, ["_part", group]).withColumn(name, F.col("_base") + F.col("_own")).select(*rows.columns, name)


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], times: str | None = None) -> DataFrame:
    """(group, one column per share): exact percentiles, interpolated between neighbours, of values that are not null, each counted `times` (a column) times if given.

    Values are counted, the counts summed over ranges, and the two values at each
    place read off, so no task holds all values of a group. Groups without values
    (and a null group) are left out.
    """
    n = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    n = running_total(n, group, ["_v"], "_n", "_at")
    n = materialize(n)  # read again for the totals
    y = n.join(n.groupBy(group).agg(F.sum("_n").alias("_all")), group)
    held = lambda place: F.max(F.when((F.col("_at") <= place) & (place < F.col("_at") + F.col("_n")), F.col("_v")))
    place = {c: F.lit(s) * (F.col("_all") - 1) for c, s in shares.items()}
    ends = [held(f(p)).alias(f"_{side}_{c}") for c, p in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))]
    y = y.groupBy(group, "_all").agg(*ends)
    between = lambda c: F.col(f"_lo_{c}") + (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) * (place[c] - F.floor(place[c]))
    return y.select(group, *[between(c).alias(c) for c in shares])
