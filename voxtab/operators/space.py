"""Offsets, voxel keys and distance joins on sparse voxel tables (case_id, i, j, k, ...)."""

from __future__ import annotations

from itertools import product
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.plans.lineage import by_shuffle, stored

AXES = ("i", "j", "k")
STEP_I, STEP_J = 1 << 42, 1 << 21


def voxel_key(prefix: str = "") -> Column:
    """One bigint per position (21 bits an axis), ordered as (i, j, k)."""
    i, j, k = (F.col(prefix + a).cast("bigint") for a in AXES)
    return i * STEP_I + j * STEP_J + k


def box_offsets(n: int = 1) -> list[tuple[int, int, int]]:
    """All offsets of a (2n+1)-cube."""
    return list(product(range(-n, n + 1), repeat=3))


def cross_offsets(n: int = 1) -> list[tuple[int, int, int]]:
    """Offsets that n steps along the axes reach."""
    return [o for o in box_offsets(n) if sum(map(abs, o)) <= n]


def ball_offsets(radius: float, spacing: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Offsets within radius millimetres."""
    reach = [range(-floor(radius / s), floor(radius / s) + 1) for s in spacing]
    return [o for o in product(*reach) if sum((x * s) ** 2 for x, s in zip(o, spacing)) <= radius * radius + 1e-9]


def half_neighbours(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each pair of opposite neighbour offsets, for 6- or 26-connectivity."""
    if connectivity not in (6, 26):
        raise ValueError(f"connectivity is 6 or 26, not {connectivity}")
    return [o for o in (cross_offsets(1) if connectivity == 6 else box_offsets(1)) if o > (0, 0, 0)]


def shifted(voxels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Every voxel at each offset: i, j, k move, all other columns stay."""
    table = F.array(*[F.struct(*[F.lit(x).alias(a) for x, a in zip(o, AXES)]) for o in offsets])
    out = voxels.withColumn("_o", F.explode(table))
    return out.select(*[(F.col(c) + F.col(f"_o.{c}")).alias(c) if c in AXES else F.col(c) for c in voxels.columns])


def squared_distance(a: str, b: str, spacing: tuple[float, float, float]) -> Column:
    """Squared distance between columns a_i.. and b_i.. in millimetres."""
    parts = [((F.col(a + x) - F.col(b + x)) * F.lit(s)) for x, s in zip(AXES, spacing)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def range_join(left: DataFrame, right: DataFrame, radius: float, spacing: tuple[float, float, float], on: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """Pairs within radius millimetres in the same `on` columns: those, l_* and r_* of the others, and d.

    Space is cut into blocks somewhat wider than two radii; the right side is given
    to the blocks that its radius meets (two an axis at most), the join is an
    equi-join on blocks, and the exact distance is checked last.
    """
    take = lambda df, p: [F.col(c).alias(p + c) for c in df.columns if c not in on]
    reach = {a: radius / s + 1e-6 for a, s in zip(AXES, spacing)}
    if all(t in ("tinyint", "smallint", "int", "bigint") for df in (left, right) for c, t in df.dtypes if c in AXES):
        reach = {a: floor(n) for a, n in reach.items()}
    block = lambda a, n=0: F.floor((F.col(a) + F.lit(n)) / block_edge(reach[a]))
    lb = left.select(*on, *take(left, "l_"), *[block(a).alias("b" + a) for a in AXES])
    rb = right.select(*on, *take(right, "r_"), *[F.sequence(block(a, -reach[a]), block(a, reach[a])).alias("b" + a) for a in AXES])
    for a in AXES:
        rb = rb.withColumn("b" + a, F.explode("b" + a))
    named = lambda df: df.withColumn("_block", voxel_key("b")).drop("bi", "bj", "bk")
    joined = named(lb).join(by_shuffle(named(rb)), [*on, "_block"]).drop("_block")
    d = F.sqrt(squared_distance("l_", "r_", spacing))
    return joined.withColumn("d", d).where(F.col("d") <= radius + 1e-9)


def block_edge(reach: float) -> int:
    """The width, in steps, of blocks of which a reach to both sides of a place meets two at most."""
    return max(1, ceil(2 * reach + 1))


def nearest(left: DataFrame, right: DataFrame, radius: float, spacing: tuple[float, float, float], value: str = "cls") -> DataFrame:
    """left with d and nearest_<value>: distance and value of the nearest right voxel within radius, ties to the smaller key; null if none."""
    pairs = range_join(left, right.select("case_id", *AXES, value), radius, spacing)
    best = F.min(F.struct(F.round("d", 9), voxel_key("r_"), F.col(f"r_{value}").alias("value"), "d"))
    hit = pairs.groupBy("case_id", *[F.col("l_" + a).alias(a) for a in AXES]).agg(best.alias("_n"))
    return left.join(hit.select("case_id", *AXES, F.col("_n.d").alias("d"), F.col("_n.value").alias(f"nearest_{value}")), ["case_id", *AXES], "left")


def _placed() -> Column:
    """Whether a row has a case and a place."""
    known = F.col("case_id").isNotNull()
    for a in AXES:
        known = known & F.col(a).isNotNull()
    return known


def nearest_always(left: DataFrame, right: DataFrame, start: float, spacing: tuple[float, float, float], value: str = "cls") -> DataFrame:
    """nearest without a radius: rows that have met none look four times as far in each round, from `start` on; null only in cases without right voxels."""
    right = stored(right.where(_placed()).select("case_id", *AXES, value))
    there = left.where(_placed()).join(right.select("case_id").distinct(), "case_id", "left_semi")
    out = left.join(right.select("case_id").distinct().withColumn("_there", F.lit(True)), "case_id", "left").where(F.col("_there").isNull() | ~_placed()).drop("_there")
    out = out.withColumns({"d": F.lit(None).cast("double"), f"nearest_{value}": F.lit(None).cast(right.schema[value].dataType)})
    todo, reach = stored(there.select(*left.columns)), start
    while not todo.isEmpty():
        seen = stored(nearest(todo, right, reach, spacing, value))
        out = out.select(*left.columns, "d", f"nearest_{value}").unionByName(seen.where("d is not null").select(*left.columns, "d", f"nearest_{value}"))
        todo, reach = seen.where("d is null").select(*left.columns), 4 * reach
    return out


def least_distances(points: DataFrame, targets: DataFrame, group: list[str], start: float, spacing: tuple[float, float, float], name: str) -> DataFrame:
    """(group, name): the least distance of each group's points (group, i, j, k) to the targets (case_id, i, j, k) of its case, however far; groups that have met none look four times as far in each round."""
    targets = stored(targets.where(_placed()).select("case_id", *AXES))
    named = _placed()
    for c in group:
        named = named & F.col(c).isNotNull()
    todo = stored(points.where(named).select(*group, *AXES).join(targets.select("case_id").distinct(), "case_id", "left_semi"))
    out, reach = None, start
    while True:
        pairs = range_join(todo, targets, reach, spacing)
        met = stored(pairs.groupBy(*[F.col(c if c == "case_id" else "l_" + c).alias(c) for c in group]).agg(F.min("d").alias(name)))
        out = met if out is None else out.unionByName(met)
        todo = stored(todo.join(met, group, "left_anti"))
        reach *= 4
        if todo.isEmpty():
            return out
