"""Landmark frames of cases, node positions in them, an atlas that stands in for missing nodes, mirrored nodes, and conventions of naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.operators.space import AXES, range_join, shifted, voxel_key
from voxtab.plans.lineage import by_shuffle

#: A landmark or a node type is known by classes that its node has; any of the listed sets will do.
Patterns = list[tuple[int, ...]]


def _has(classes: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains("class_ids", c) for c in classes])


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _three(name: str) -> list[Column]:
    return [F.col(name + c) for c in "xyz"]


def frames(nodes: DataFrame, right: Patterns, left: Patterns, base: Patterns) -> DataFrame:
    """One row per case that has all three landmarks: origin o*, orthonormal axes u* (right to left), v* (towards the base), w*, scale s, and the landmarks r*, l*, b*.

    A landmark is the node of the smallest id that holds one of its patterns. Cases
    whose landmarks coincide or lie on one line have no frame.
    """
    found = {}
    for name, patterns in (("r", right), ("l", left), ("b", base)):
        hit = reduce(lambda a, b: a | b, [_has(p) for p in patterns])
        found[name] = F.min(F.when(hit, F.struct("node_id", "x", "y", "z")))
    lm = nodes.groupBy("case_id").agg(*[c.alias("_" + n) for n, c in found.items()]).where("_r is not null and _l is not null and _b is not null")
    f = lm.select("case_id", *[F.col(f"_{n}.{c}").alias(n + c) for n in found for c in "xyz"])
    f = f.select("*", *[((F.col("r" + c) + F.col("l" + c) + F.col("b" + c)) / 3).alias("o" + c) for c in "xyz"])
    across = [F.col("l" + c) - F.col("r" + c) for c in "xyz"]
    f = f.withColumn("s", F.sqrt(_dot(across, across))).where("s >= 1e-6")
    f = f.select("*", *[(d / F.col("s")).alias("u" + c) for d, c in zip(across, "xyz")])
    up = [F.col("b" + c) - F.col("o" + c) for c in "xyz"]
    f = f.withColumn("_along", _dot(up, _three("u")))
    f = f.select("*", *[(d - F.col("_along") * F.col("u" + c)).alias("_" + c) for d, c in zip(up, "xyz")])
    f = f.withColumn("_n", F.sqrt(_dot(_three("_"), _three("_")))).where("_n >= 1e-6")
    f = f.select("*", *[(F.col("_" + c) / F.col("_n")).alias("v" + c) for c in "xyz"])
    cross = {"x": "uy * vz - uz * vy", "y": "uz * vx - ux * vz", "z": "ux * vy - uy * vx"}
    f = f.select("*", *[F.expr(e).alias("w" + c) for c, e in cross.items()])
    return f.select("case_id", "s", *[n + c for n in "ouvwrlb" for c in "xyz"])


def positions(points: DataFrame, frame: DataFrame) -> DataFrame:
    """points (case_id, x, y, z, ...) of cases with a frame, with p* (in its axes) and dr, dl, db (from its landmarks), all in units of its scale."""
    y = points.join(by_shuffle(frame), "case_id")
    off = [F.col(c) - F.col("o" + c) for c in "xyz"]
    axes = [(_dot(off, _three(a)) / F.col("s")).alias("p" + c) for a, c in zip("uvw", "xyz")]
    far = [[F.col(c) - F.col(n + c) for c in "xyz"] for n in "rlb"]
    return y.select(*points.columns, *axes, *[(F.sqrt(_dot(d, d)) / F.col("s")).alias("d" + n) for d, n in zip(far, "rlb")])


def node_type(nodes: DataFrame) -> DataFrame:
    """nodes with sig: their classes, joined."""
    return nodes.withColumn("sig", F.array_join(F.transform("class_ids", lambda c: c.cast("string")), ","))


def atlas(nodes: DataFrame, frame: DataFrame, least: int = 5) -> DataFrame:
    """(sig, n, px, py, pz): the median position in the frames of each node type seen `least` times or more."""
    p = positions(node_type(nodes).select("case_id", "sig", "x", "y", "z"), frame)
    return p.groupBy("sig").agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(0.5)).alias(c) for c in ("px", "py", "pz")]).where(F.col("n") >= least)


def filled_nodes(nodes: DataFrame, frame: DataFrame, types: DataFrame) -> DataFrame:
    """(case_id, sig, x, y, z, missing) for each case with a frame and each type of the atlas: its own nodes, or the atlas's place for it.

    The types are sets of classes, so as many as there are such sets, however many cases.
    """
    own = node_type(nodes).join(F.broadcast(types.select("sig")), "sig", "left_semi").select("case_id", "sig", "x", "y", "z")
    wanted = frame.crossJoin(F.broadcast(types)).join(by_shuffle(own.select("case_id", "sig").distinct()), ["case_id", "sig"], "left_anti")
    place = lambda c: F.col("o" + c) + F.col("s") * (F.col("px") * F.col("u" + c) + F.col("py") * F.col("v" + c) + F.col("pz") * F.col("w" + c))
    stand_in = wanted.select("case_id", "sig", *[place(c).alias(c) for c in "xyz"], F.lit(True).alias("missing"))
    return own.join(by_shuffle(frame.select("case_id")), "case_id", "left_semi").withColumn("missing", F.lit(False)).unionByName(stand_in)


def node_distances(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(case_id, comp_id, sig, dist, missing): from every point (case_id, comp_id, x, y, z) to the nearest target of each type."""
    y = points.select("case_id", "comp_id", *[F.col(c).alias("a" + c) for c in "xyz"]).join(by_shuffle(targets), "case_id")
    off = [F.col(c) - F.col("a" + c) for c in "xyz"]
    return y.groupBy("case_id", "comp_id", "sig").agg(F.min(F.sqrt(_dot(off, off))).alias("dist"), F.max("missing").alias("missing"))


def mirror_nodes(nodes: DataFrame, frame: DataFrame, labels: DataFrame, pairs: list[tuple[int, int]], mirror: dict[int, int], radius: float, spacing: tuple[float, float, float]) -> DataFrame:
    """(case_id, trunk, branch, node_id, i, j, k, snap_mm): nodes that a case has on one side only, for its other side.

    pairs lists (trunk, branch) classes of both sides. The first node of the other
    side is reflected in the plane through the frame's origin across its first axis,
    and snapped to the nearest voxel of the missing side's trunk within radius, ties
    to the smaller key; where there is none, no node is added.
    """
    kinds = F.array(*[F.when(_has(p), F.struct(F.lit(p[0]).alias("trunk"), F.lit(p[1]).alias("branch"))) for p in pairs])
    each = nodes.select("case_id", F.explode(F.array_compact(kinds)).alias("kind"), F.struct("node_id", "x", "y", "z").alias("node"))
    have = each.groupBy("case_id", F.col("kind.trunk").alias("trunk"), F.col("kind.branch").alias("branch")).agg(F.min("node").alias("node"))
    other = F.create_map(*[F.lit(v) for item in mirror.items() for v in item])
    swap = lambda c: F.coalesce(other[F.col(c)], F.col(c)).alias(c)
    lost = have.select("case_id", swap("trunk"), swap("branch"), "node.*").join(have, ["case_id", "trunk", "branch"], "left_anti").join(frame, "case_id")
    across = _dot([F.col(c) - F.col("o" + c) for c in "xyz"], _three("u"))
    reflected = [((F.col(c) - 2 * across * F.col("u" + c)) / s).alias(a) for c, a, s in zip("xyz", AXES, spacing)]
    points = lost.select("case_id", F.col("trunk").alias("cls"), "branch", "node_id", *reflected)
    near = range_join(points, labels.select("case_id", "cls", *AXES), radius, spacing, on=("case_id", "cls"))
    best = F.min(F.struct(F.round("d", 9).alias("d"), voxel_key("r_").alias("key"), *[F.col("r_" + a).alias(a) for a in AXES]))
    found = near.groupBy("case_id", F.col("cls").alias("trunk"), F.col("l_branch").alias("branch"), F.col("l_node_id").alias("node_id")).agg(best.alias("at"))
    return found.select("case_id", "trunk", "branch", "node_id", *[F.col("at." + a).alias(a) for a in AXES], F.col("at.d").alias("snap_mm"))


def conventions(shares: DataFrame, order: list[int], trunk: dict[int, int], junction: dict[tuple[int, int], int], least: float = 0.15) -> DataFrame:
    """(case_id, comp_id, major, proximal, joint) of components with two or more classes of share `least` or more.

    shares: case_id, comp_id, cls, share. major and proximal are the trunk names of the
    class of the largest share and of the class that comes first in `order` (classes
    not in it come last); joint is the junction's name of the two largest. Ties go to
    the smaller class; a name that the tables lack is null.
    """
    at = F.create_map(*[F.lit(v) for k, c in enumerate(order) for v in (c, k)])
    name = F.create_map(*[F.lit(v) for item in trunk.items() for v in item])
    meet = F.create_map(*[x for (a, b), v in junction.items() for x in (F.lit(f"{min(a, b)},{max(a, b)}"), F.lit(v))])
    rank = F.struct((-F.round("share", 9)).alias("s"), F.col("cls").alias("cls"))
    first = F.struct(F.coalesce(at[F.col("cls")], F.lit(len(order))).alias("o"), *[(-F.round("share", 9)).alias("s"), F.col("cls").alias("cls")])
    y = shares.where(F.round("share", 9) >= least).groupBy("case_id", "comp_id").agg(F.sort_array(F.collect_list(rank)).alias("span"), F.min(first).alias("first")).where(F.size("span") >= 2)
    a, b = F.col("span")[0]["cls"], F.col("span")[1]["cls"]
    key = F.concat_ws(",", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    return y.select("case_id", "comp_id", name[a].alias("major"), name[F.col("first.cls")].alias("proximal"), meet[key].alias("joint"))


def convention_accuracy(named: DataFrame, truth: DataFrame, by: str, least: int = 10, rate: float = 0.8) -> DataFrame:
    """Per value of `by`: spanning components with a true class, how many each convention names rightly, how many none does, the best and whether it is a rule.

    truth: case_id, comp_id, cls, by. The best is that of most hits, ties in the order
    major, proximal, joint; a rule explains `rate` of `least` components or more.
    """
    y = named.join(truth, ["case_id", "comp_id"])
    rules = ("major", "proximal", "joint")
    right = {r: F.coalesce(F.col(r) == F.col("cls"), F.lit(False)) for r in rules}
    none = ~(right["major"] | right["proximal"] | right["joint"])
    out = y.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(r) for r, c in right.items()], F.count_if(none).alias("neither"))
    most = F.greatest(*rules)
    best = F.when(F.col("major") == most, "major").when(F.col("proximal") == most, "proximal").otherwise("joint")
    return out.select("*", best.alias("best"), ((F.col("n") >= least) & (most >= F.col("n") * rate)).alias("is_rule"))


def class_shares(comps: DataFrame, labels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """(case_id, comp_id, cls, share): the labels (case_id, i, j, k, cls) in a component and its shell, as shares of the labelled voxels there."""
    region = shifted(comps.select("case_id", "comp_id", *AXES), offsets).distinct()
    n = region.join(labels.select("case_id", *AXES, "cls"), ["case_id", *AXES]).groupBy("case_id", "comp_id", "cls").agg(F.count("*").alias("n"))
    return n.select("case_id", "comp_id", "cls", (F.col("n") / F.sum("n").over(W.partitionBy("case_id", "comp_id"))).alias("share"))
