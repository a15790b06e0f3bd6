"""Rules, lookups and nearest-neighbour decisions, and their accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from voxtab.plans.leaders import tasks


def _majority(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, best): the commonest truth, ties to the smaller."""
    n = rows.groupBy(*by, "truth").agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.min_by("truth", F.struct(-F.col("n"), "truth")).alias("best"))


def lookup_backoff(rows: DataFrame, train: DataFrame, signature: str, usable: Column) -> DataFrame:
    """Adds pred_rule: the majority truth of the row's signature, or of all training rows where the signature is unknown or not usable."""
    by_sig = _majority(train, [signature]).withColumnRenamed("best", "_s")
    overall = _majority(train.withColumn("_one", F.lit(1)), ["_one"]).select(F.col("best").alias("_g"))
    y = rows.join(by_sig, signature, "left").crossJoin(F.broadcast(overall))
    return y.withColumn("pred_rule", F.coalesce(F.when(usable, F.col("_s")), F.col("_g"))).drop("_s", "_g")


def lookup_levels(rows: DataFrame, train: DataFrame, levels: list[list[str]]) -> DataFrame:
    """Adds pred_rule and level: the majority truth of the first of the levels (lists of columns) whose values the training rows know, at last of all training rows.

    Null values match nothing; without training rows pred_rule is null.
    """
    y = rows
    for n, keys in enumerate(levels):
        y = y.join(_majority(train, keys).withColumnRenamed("best", f"_l{n}"), keys, "left")
    overall = _majority(train.withColumn("_one", F.lit(1)), ["_one"]).select(F.lit(1).alias("_one"), F.col("best").alias("_g"))
    y = y.withColumn("_one", F.lit(1)).join(F.broadcast(overall), "_one", "left")
    at = F.coalesce(*[F.when(F.col(f"_l{n}").isNotNull(), n) for n in range(len(levels))], F.lit(len(levels)))
    return y.select(*rows.columns, F.coalesce(*[F.col(f"_l{n}") for n in range(len(levels))], F.col("_g")).alias("pred_rule"), at.alias("level"))


def leave_one_out(rows: DataFrame, signature: str) -> DataFrame:
    """(signature, acc, n): accuracy of the majority rule with each row left out, from counts less one."""
    n = rows.groupBy(signature, "truth").agg(F.count("*").alias("n"))
    # The classes of a signature are as few as the taxonomy; each row meets its signature's counts.
    table = n.groupBy(signature).agg(F.sort_array(F.collect_list(F.struct("truth", "n"))).alias("t"))
    scored = F.transform("t", lambda q: F.struct((q["n"] - (q["truth"] == F.col("truth")).cast("int")).alias("m"), (-q["truth"]).alias("c")))
    y = rows.join(table, signature).withColumn("_b", F.array_max(F.filter(scored, lambda q: q["m"] > 0)))
    ok = F.when(F.col("_b").isNotNull(), (-F.col("_b.c") == F.col("truth")).cast("int"))
    return y.groupBy(signature).agg(F.avg(ok).alias("acc"), F.count("*").alias("n"))


def oracle_split(decisions: DataFrame) -> DataFrame:
    """tp, fp, fn per seed as it is (cur), with all found lesions relabelled (fix), without false detections (noh), and with both."""
    s = F.explode(F.array(*[F.lit(x) for x in ("cur", "fix", "noh", "both")]))
    d = decisions.withColumn("scenario", s)
    real = F.col("truth") >= 0
    pred = F.when(F.col("scenario").isin("fix", "both") & F.col("pred").isNotNull() & real, F.col("truth")).when(F.col("scenario").isin("noh", "both") & ~real, None).otherwise(F.col("pred"))
    d = d.withColumn("q", pred)
    same = F.col("q") == F.col("truth")
    return d.groupBy("scenario", "seed").agg(F.count_if(same & real).alias("tp"), F.count_if(~same).alias("fp"), F.count_if(real & (F.col("q").isNull() | ~same)).alias("fn"))


def macro_mcc_sets(decisions: DataFrame) -> DataFrame:
    """Mean over true classes of the MCC of presence per case; plain denominators, 0 where they vanish."""
    long = decisions.select("case_id", F.explode(F.array_distinct(F.array_compact(F.array("truth", "pred")))).alias("cls"), "truth", "pred").where("cls >= 0")
    here = long.groupBy("case_id", "cls").agg(F.max(F.coalesce(F.col("truth") == F.col("cls"), F.lit(False))).alias("t"), F.max(F.coalesce(F.col("pred") == F.col("cls"), F.lit(False))).alias("p"))
    cases = decisions.select("case_id").distinct().agg(F.count("*").cast("double").alias("all"))
    one = lambda c: F.count_if(c).cast("double")
    n = here.groupBy("cls").agg(one(F.col("t") & F.col("p")).alias("tp"), one(~F.col("t") & F.col("p")).alias("fp"), one(F.col("t") & ~F.col("p")).alias("fn"))
    n = n.where("tp + fn > 0").crossJoin(cases).withColumn("tn", F.col("all") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return n.select(F.when(root > 0, (tp * tn - fp * fn) / root).otherwise(0.0).alias("m")).agg(F.avg("m").alias("macro_mcc"), F.count("*").alias("classes"))


def energy(v: Column) -> Column:
    """Sum of squares of an array."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def relative_encoding(ds: str, tau: float) -> Column:
    """Softmax of -(d - min) / tau over an array of distances."""
    e = F.transform(ds, lambda d: F.exp(-(d - F.array_min(ds)) / tau))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def mirror_rows(x: DataFrame) -> DataFrame:
    """The rows and their mirror images: components 2m and 2m+1 swap, and so do the labels of a pair."""
    swap = F.transform("embedding", lambda v, i: F.get("embedding", i.bitwiseXOR(F.lit(1))))
    label = F.when(F.col("label") < 8, F.col("label").bitwiseXOR(F.lit(1))).otherwise(F.col("label"))
    return x.withColumn("mirrored", F.lit(False)).unionByName(x.withColumn("embedding", swap).withColumn("label", label).withColumn("mirrored", F.lit(True)))


def knn_cosine(train: DataFrame, queries: DataFrame, k: int, power: int, block: int = 16_384) -> DataFrame:
    """(vec_id, truth, pred, w): votes sim**power of the k most similar training rows of other folds with positive similarity.

    A stated set of queries against all rows: both are dealt to blocks of bounded
    size, every block of queries meets every block of rows in a task of its own (as
    products of matrices, some queries at a time), and sends k rows of each on.
    Vectors that are null, zero or hold a null are near to none.
    """
    usable = lambda df: df.withColumn("_n", F.sqrt(energy(F.col("embedding")))).where("_n > 0 and fold is not null")
    size = train.count()
    blocks = max(size // block, min(tasks(train), size // 1024)) + 1
    sets = queries.count() // block + 1
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    q = usable(queries).select("vec_id", F.col("label").alias("truth"), F.col("fold").cast("bigint").alias("own"), F.col("embedding").cast("array<double>").alias("a"), F.col("_n").alias("na"))
    q = q.withColumn("dims", F.size("a")).withColumn("set", F.pmod(F.xxhash64("vec_id"), F.lit(sets))).withColumn("block", F.explode(upto(blocks)))
    t = usable(train).select(F.col("vec_id").alias("nb"), "label", F.col("fold").cast("bigint").alias("fold"), F.col("embedding").cast("array<double>").alias("b"), F.col("_n").alias("nbn"))
    t = t.withColumn("dims", F.size("b")).withColumn("block", F.pmod(F.xxhash64("nb"), F.lit(blocks))).withColumn("set", F.explode(upto(sets)))
    ids = StructType([df.schema[c] for df, c in ((q, "vec_id"), (q, "truth"), (t, "nb"), (t, "label"))])
    kinds = to_arrow_schema(ids)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, at, sims = [], [], []
        if left.num_rows and right.num_rows:
            unit = lambda x, v, n: np.stack(x.column(v).to_numpy()) / x.column(n).to_numpy()[:, None]
            a, b = unit(left, "a", "na"), unit(right, "b", "nbn").T
            own, fold, nb = left.column("own").to_numpy(), right.column("fold").to_numpy(), right.column("nb").to_numpy()
            for lo in range(0, len(a), 512):
                sim = np.where(own[lo : lo + 512, None] != fold, a[lo : lo + 512] @ b, 0.0)
                least = np.partition(sim, -k, axis=1)[:, -k] - 2e-9 if sim.shape[1] > k else np.zeros(len(sim))
                for r, s in enumerate(sim):
                    near = np.flatnonzero((s >= least[r]) & (s > 0))
                    near = near[np.lexsort((nb[near], -np.floor(s[near] * 1e9 + 0.5)))[:k]]
                    rows.append(np.full(len(near), lo + r))
                    at.append(near)
                    sims.append(s[near])
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, int)
        l, r = left.select(["vec_id", "truth"]).take(flat(rows)), right.select(["nb", "label"]).take(flat(at))
        out = pa.table([*l.columns, *r.columns], names=["vec_id", "truth", "nb", "label"]).cast(kinds)
        return out.append_column("sim", pa.array(flat(sims), pa.float64()))

    meeting = ["set", "block", "dims"]
    in_block = q.groupBy(*meeting).cogroup(t.groupBy(*meeting)).applyInArrow(meet, StructType([*ids, StructField("sim", DoubleType())]))
    order = (F.desc(F.round("sim", 9)), "nb")
    near = in_block.withColumn("r", F.row_number().over(W.partitionBy("vec_id").orderBy(*order))).where(F.col("r") <= k)
    votes = near.groupBy("vec_id", "truth", "label").agg(F.sum(F.pow("sim", F.lit(power))).alias("w"))
    best = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc(F.round("w", 9)), "label"))
    return votes.withColumn("r", best).where("r = 1").select("vec_id", "truth", F.col("label").alias("pred"), "w")


def soft_label_copies(rows: DataFrame, neighbours: DataFrame, label: str, weight: float) -> DataFrame:
    """rows with a column weight 1, and a copy of weight `weight` under each neighbour of its label.

    neighbours: (a, b) pairs of classes, a row per direction, as many as the
    taxonomy has; a label without neighbours, null included, has no copies.
    """
    copies = rows.join(neighbours, rows[label] == neighbours["a"]).withColumn(label, F.col("b")).drop("a", "b")
    return rows.withColumn("weight", F.lit(1.0)).unionByName(copies.withColumn("weight", F.lit(weight)))
