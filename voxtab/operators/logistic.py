"""Logistic regressions of presence, one per class, fitted together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.plans.lineage import materialize


def fit_presence(rows: DataFrame, dims: int, classes: list[int], ridge: float, least: int = 3, balanced: bool = False, steps: int = 25, enough: float = 1e-9) -> dict[int, float | list[float]]:
    """Per class its mean rate, or an intercept and dims weights, from rows (x: array of dims numbers, present: array of classes).

    Newton steps on the logistic loss plus ridge / 2 times the squared weights (the
    intercept is free). All classes take a step in one pass over the rows: tasks add
    up gradients and Hessians, and matrices of dims + 1 rows are solved on the driver.
    Steps are at most 5 long in any weight and end when all are below `enough`.
    Classes with fewer than `least` rows present, or absent, get their mean rate.
    balanced weighs present and absent rows so that both count the same. Rows with a
    null in x or present are left out; without rows every rate is 0.
    """
    rows = materialize(rows.where("x is not null and present is not null and not exists(x, v -> v is null)").select("x", "present"))  # every step reads it
    here = [F.count_if(F.array_contains("present", c)).alias(f"n{c}") for c in classes]
    total = rows.agg(F.count("*").alias("n"), *here).first()
    n = {c: total[f"n{c}"] for c in classes}
    rates: dict[int, float | list[float]] = {c: n[c] / total["n"] if total["n"] else 0.0 for c in classes}
    todo = [c for c in classes if least <= n[c] <= total["n"] - least]
    weights = {c: (total["n"] / 2 / (total["n"] - n[c]), total["n"] / 2 / n[c]) if balanced else (1.0, 1.0) for c in todo}
    beta = {c: np.zeros(dims + 1) for c in todo}
    size = dims + 1
    kinds = pa.schema([("cls", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches, beta=beta):
        sums = {c: np.zeros(size + size * size) for c in beta}
        for b in batches:
            if not b.num_rows:
                continue
            z = np.hstack([np.ones((b.num_rows, 1)), np.stack(b.column(0).to_numpy(zero_copy_only=False))])
            inside = b.column(1).to_pylist()
            for c in beta:
                y = np.array([c in p for p in inside], float)
                p = 1 / (1 + np.exp(-np.clip(z @ beta[c], -700, 700)))
                w = np.where(y > 0, weights[c][1], weights[c][0])
                sums[c][:size] += z.T @ (w * (p - y))
                sums[c][size:] += ((z.T * (w * p * (1 - p))) @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), kinds[1].type)], schema=kinds)

    for _ in range(steps if todo else 0):
        parts = rows.mapInArrow(lambda batches, now={c: b.copy() for c, b in beta.items()}: run(batches, now), "cls int, sums array<double>")
        merged = parts.groupBy("cls").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(size + size * size)]).alias("sums")).collect()
        longest = 0.0
        for r in merged:
            s, b = np.array(r["sums"]), beta[r["cls"]]
            pull = np.concatenate([[0.0], np.full(dims, ridge)])
            step = np.linalg.solve(s[size:].reshape(size, size) + np.diag(pull), s[:size] + pull * b)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-300))
            beta[r["cls"]] = b - step
            longest = max(longest, float(np.abs(step).max()))
        if longest < enough:
            break
    return rates | {c: b.tolist() for c, b in beta.items()}


def presence(rows: DataFrame, models: dict[int, float | list[float]], unknown: float = 0.5) -> DataFrame:
    """rows (x, ...) with one row per class of the models: cls and p, or `unknown` where x is null or holds one."""

    def chance(m):
        if isinstance(m, float):
            return F.lit(m)
        score = F.lit(m[0])
        for d, w in enumerate(m[1:]):
            score = score + F.get("x", F.lit(d)) * w
        return 1 / (1 + F.exp(-score))

    known = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())
    each = [F.struct(F.lit(c).alias("cls"), F.when(known, chance(m)).otherwise(unknown).alias("p")) for c, m in sorted(models.items())]
    return rows.withColumn("_c", F.explode(F.array(*each))).select(*[c for c in rows.columns if c not in ("x", "present")], "_c.cls", "_c.p")
