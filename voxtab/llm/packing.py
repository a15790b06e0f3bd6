"""Packing documents into fixed windows by non-negative least squares over a length histogram.

1. Every document becomes token ids and an end id, cut into full windows and one
   remainder; lengths are counted in steps of `step` tokens (window/step bins).
2. All combinations of up to `depth` bins that fill a window exactly are listed;
   non-negative least squares finds how often each is used so that the histogram
   is met; counts are rounded down to what is there.
3. What is left is packed greedily, longest first, bin counts at a time.
4. Each piece finds its window from its rank within its bin, by joins.

Only the histogram (window/step rows) and the plan (a few hundred patterns) pass
through the driver, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.llm.streams import slices
from voxtab.llm.wordbpe import word_bpe
from voxtab.plans.lineage import materialize

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
#: Pieces that one task ranks at most, about.
RANK_ROWS = 5_000


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = 4096, eos: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document's ids: full windows, then the remainder.

    Columns: those of PIECES, and ids (array<int>) if asked for. A null or empty
    text is the end id alone. Repeated rows give repeated pieces; further columns
    of docs are not read.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    end = np.array([eos], "<u4").tobytes()

    def cut(batches):
        bpe = word_bpe(tokenizer)
        for b in slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            for doc, data in zip(b.column(0).to_pylist(), bpe.encode_bytes(b.column(1).to_pylist())):
                data += end
                n = len(data) // 4
                for s in range(0, n, window):
                    piece = data[4 * s : 4 * (s + window)]
                    for c, v in zip(rows, (doc, s, len(piece) // 4, zlib.crc32(piece), n)):
                        c.append(v)
                    if with_ids:
                        rows[5].append(np.frombuffer(piece, "<i4"))
            cols = [pa.array(c, pa.int64()) for c in rows[:5]] + [pa.array(rows[5], pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([(f.split()[0], c.type) for f, c in zip(schema.split(", "), cols)]))

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """Every multiset of at most depth bins (1..units) that sums to units, longest part first."""

    def parts(total: int, most: int, left: int):
        if total <= most:
            yield (total,)
        if left > 1:
            for x in range(min(most, total - 1), 0, -1):
                if x * left < total:
                    break
                for rest in parts(total - x, x, left - 1):
                    yield (x, *rest)

    return sorted(set(parts(units, units, depth)), reverse=True)


def nnls(a: np.ndarray, b: np.ndarray, most_steps: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * a.shape[0]
    for _ in range(most_steps):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tol:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min(initial=1) > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            xa = x[at]
            alpha = (xa[low] / np.maximum(xa[low] - s[low], 1e-300)).min()
            x[at] = xa + alpha * (s - xa)
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_windows(histogram: dict[int, int], units: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a window, how many such windows): uses every piece of the histogram exactly once."""
    left = np.zeros(units + 1, np.int64)
    for k, v in histogram.items():
        left[k] = v
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(combo: tuple[int, ...], times: int) -> None:
        if times > 0:
            np.subtract.at(left, list(combo), times)
            plan.append((combo, times))

    def available(combo: tuple[int, ...]) -> int:
        return min(int(left[k]) // combo.count(k) for k in set(combo))

    combos = combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for j, c in enumerate(combos):
        for k in c:
            a[k - 1, j] += 1
    # Long pieces are hard to place later, so their counts weigh more.
    weight = np.sqrt(np.arange(1, units + 1))
    x = nnls(a * weight[:, None], left[1:] * weight)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        use(combos[j], min(int(round(x[j])), available(combos[j])))
    while left.any():
        combo, space, spare = [], units, left.copy()
        while space and (fit := np.flatnonzero(spare[: space + 1])).size:
            k = int(fit[-1])
            many = min(space // k, int(spare[k]))
            combo += [k] * many
            spare[k] -= many
            space -= k * many
        use(tuple(combo), available(tuple(combo)))
    return plan


def pack(pieces: DataFrame, window: int = 4096, step: int = 32, depth: int = 3) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of PIECES, lengths 1..window).

    Pieces of one sequence follow each other without gaps from offset 0 and never
    exceed the window. An empty table stays empty. Work past the histogram is two
    shuffles of the small piece rows; a hot bin is ranked in parts.
    """
    spark, units = pieces.sparkSession, window // step
    p = pieces.withColumn("bin", F.ceil(F.col("length") / step).cast("int"))
    counts = {r["bin"]: r["n"] for r in p.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    salts = 1 + sum(counts.values()) // RANK_ROWS
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)).cast("int"))
    sizes = p.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("bin", "salt", (F.sum("n").over(W.partitionBy("bin").orderBy("salt")) - F.col("n")).alias("before"))
    in_part = W.partitionBy("bin", "salt").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")
    ranked = p.withColumn("row", F.row_number().over(in_part)).join(before, ["bin", "salt"]).withColumn("rank", F.col("before") + F.col("row") - 1)

    segments, used, sequence = [], dict.fromkeys(counts, 0), 0
    for combo, times in plan_windows(counts, units, depth):
        for k in set(combo):
            each = combo.count(k)
            segments.append((k, used[k], used[k] + times * each, each, sequence, combo.index(k)))
            used[k] += times * each
        sequence += times
    seg = spark.createDataFrame(segments, "bin int, low bigint, high bigint, each bigint, sequence bigint, slot bigint")
    # The plan has at most a few rows per bin and pattern, so it is broadcast.
    placed = ranked.join(F.broadcast(seg), (ranked.bin == seg.bin) & (F.col("rank") >= seg.low) & (F.col("rank") < seg.high)).drop(seg.bin)
    placed = placed.withColumn("nth", F.col("rank") - F.col("low"))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.expr("nth div each")).withColumn("slot", F.col("slot") + F.expr("nth % each"))
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.withColumn("offset", offset).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = 4096, eos: int = 2) -> DataFrame:
    """token_pieces and pack over a table of documents (doc_id, text); pieces are written once between the two."""
    return pack(materialize(token_pieces(docs, tokenizer, window, eos)), window)
