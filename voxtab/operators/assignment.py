"""Different classes for the lesions of a case, at the least cost."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Costs are whole numbers of this part of a nat, so ties are exact.
UNIT = 1_000_000


def shortest_paths(cost: list[list[int]]) -> list[int]:
    """The column of every row of a matrix with as many columns as rows, or more, at the least total: one shortest augmenting path per row."""
    rows, columns = len(cost), len(cost[0]) if cost else 0
    u, v, row_of, back = [0] * (rows + 1), [0] * (columns + 1), [0] * (columns + 1), [0] * (columns + 1)
    for r in range(1, rows + 1):
        row_of[0], at = r, 0
        least: list[int | None] = [None] * (columns + 1)
        done = [False] * (columns + 1)
        while row_of[at]:
            done[at] = True
            i, step, to = row_of[at], None, 0
            for c in range(1, columns + 1):
                if done[c]:
                    continue
                slack = cost[i - 1][c - 1] - u[i] - v[c]
                if least[c] is None or slack < least[c]:
                    least[c], back[c] = slack, at
                if step is None or least[c] < step:
                    step, to = least[c], c
            for c in range(columns + 1):
                if done[c]:
                    u[row_of[c]] += step
                    v[c] -= step
                elif least[c] is not None:
                    least[c] -= step
            at = to
        while at:
            row_of[at] = row_of[back[at]]
            at = back[at]
    out = [0] * rows
    for c in range(1, columns + 1):
        if row_of[c]:
            out[row_of[c] - 1] = c - 1
    return out


def best_classes(cost: dict[tuple[int, int], int], lesions: list[int], classes: list[int]) -> dict[int, int]:
    """A class for min(lesions, classes) lesions, none twice, at the least total cost; ties to the least classes in order of lesions, where none counts most."""
    base, none = len(classes) + 1, len(classes)
    scale = base ** len(lesions)
    worst = (max(cost.values()) + 1) * (len(lesions) + 1)
    full = [[cost.get((x, c), worst) * scale + (k - none) * base ** (len(lesions) - 1 - i) for k, c in enumerate(classes)] for i, x in enumerate(lesions)]
    if len(lesions) <= len(classes):
        return {lesions[i]: classes[k] for i, k in enumerate(shortest_paths(full))}
    turned = [list(r) for r in zip(*full)]
    return {lesions[i]: classes[k] for k, i in enumerate(shortest_paths(turned))}


def unique_classes(probs: DataFrame, case: tuple[str, ...]) -> DataFrame:
    """(case, lesion, cls, p): different classes within each case at the largest product of p, for as many lesions as there are classes.

    probs: (case, lesion, cls, p), p above 1e-9 counting; ties go to the least classes
    in order of lesions. Of k classes in a case, a class goes to one of its k best
    lesions, and of n lesions, a lesion gets one of its n best classes: all others
    can be swapped for one of these. So a case comes down to k rows for each of its k
    classes before it meets in one task, however many lesions it has.
    """
    x = probs.where("lesion is not null and cls is not null and p is not null")
    x = x.withColumn("_cost", F.round(-F.log(F.greatest("p", F.lit(1e-9))) * UNIT).cast("bigint"))
    axis = x.groupBy(*case, "cls").agg(F.lit(1).alias("_one")).groupBy(*case).agg(F.count("*").alias("_k"))
    order = W.partitionBy(*case, "cls").orderBy("_cost", "lesion")
    # A bound above any taxonomy lets Spark cut each task's rows before the shuffle; the case's own follows.
    few = x.withColumn("_rk", F.row_number().over(order)).where("_rk <= 1024").join(axis, list(case)).where("_rk <= _k")
    wide = few.join(axis.where("_k > 1024").select(*case), list(case), "left_semi")
    if not wide.isEmpty():
        raise ValueError("over 1024 classes in a case")
    schema = ", ".join(f"{c} {t}" for c, t in probs.dtypes if c in (*case, "lesion", "cls", "p"))
    names = [c for c in probs.columns if c in (*case, "lesion", "cls", "p")]

    def solve(t: pa.Table) -> pa.Table:
        lesion, cls, cost = (t.column(c).to_pylist() for c in ("lesion", "cls", "_cost"))
        found = best_classes(dict(zip(zip(lesion, cls), cost)), sorted(set(lesion)), sorted(set(cls)))
        keep = [i for i, (x, c) in enumerate(zip(lesion, cls)) if found.get(x) == c]
        return t.select(names).take(pa.array(keep, pa.int64()))

    return few.select(*names, "_cost").groupBy(*case).applyInArrow(solve, schema)
