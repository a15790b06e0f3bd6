"""Toxicity: bags of hashed character n-grams, averaged embeddings, one linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its n-grams and of itself, so an
unseen misspelling shares most of its vector with the word. A text is read in
windows of `span` words (half overlapping, all of the text); the window of the
largest logit speaks for the text, through a logistic scale fitted on further
labelled rows. The training set is bounded: at most 2 * `per_class` labelled rows
of either class, chosen by a hash of the id; a third of them are kept for the scale.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtab.llm.chars import CharBlock, char_blocks
from voxtab.llm.streams import slices

SIZES = (3, 4, 5)
BUCKETS = 1 << 17
#: Words of a window. A word that came within so many words before adds nothing again.
SPAN = 64
#: Texts of fewer words are averaged as if they had so many.
FEWEST = 16
#: Weight decay of the embeddings of a step.
DECAY = 1e-3
#: Steps of training at least, where the rows are few.
STEPS = 300
#: Averages are small; the softmax sees them so many times larger.
GAIN = 30.0


class Model(NamedTuple):
    """value: logit share of each n-gram bucket; bias, and the scale of the largest window logit."""

    value: np.ndarray
    bias: float
    slope: float
    shift: float


def _features(b: CharBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, weight): the weights of a word sum to 1, or to 0 if it is repeated within SPAN words."""
    n_words, whole = len(b.start), b.word_hashes()
    order = np.lexsort((np.arange(n_words), whole, b.doc))
    again = (np.diff(order) < SPAN) & (np.diff(whole[order].view(np.int64)) == 0) & (np.diff(b.doc[order]) == 0)
    share = np.ones(n_words)
    share[order[1:][again]] = 0
    words, hashes = [np.arange(n_words)], [whole]
    for n in SIZES:
        w, h = b.ngrams(n)
        words.append(w)
        hashes.append(h)
    word = np.concatenate(words)
    bucket = (np.concatenate(hashes) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    return word, bucket, (share / np.bincount(word, minlength=n_words))[word]


def fit_embeddings(texts: list[str], labels: np.ndarray, dim: int = 8, epochs: int = 12, rate: float = 0.2, seed: int = 7) -> tuple[np.ndarray, float]:
    """Bucket values and bias of a softmax over averaged embeddings (Adagrad, batches of 64 texts)."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    docs, buckets, weights, sizes = [], [], [], np.zeros(len(texts))
    shuffled = [texts[i] for i in order]
    for b in char_blocks(shuffled, digits=True, block_chars=1 << 17):
        if not len(b.start):
            continue
        word, bucket, weight = _features(b)
        key, at = np.unique(b.doc[word] * BUCKETS + bucket, return_inverse=True)
        docs.append((key // BUCKETS + b.lo).astype(np.int32))
        buckets.append((key % BUCKETS).astype(np.int32))
        weights.append(np.bincount(at, weight).astype(np.float32))
        sizes[b.lo : b.hi] = np.diff(b.first)
    if not docs:
        return np.zeros(BUCKETS, np.float32), 0.0
    doc, bucket, weight = np.concatenate(docs), np.concatenate(buckets), np.concatenate(weights)
    docs, buckets, weights = [], [], []
    weight *= (GAIN / np.maximum(sizes, FEWEST)).astype(np.float32)[doc]
    seen = np.bincount(bucket, minlength=BUCKETS)
    clean = np.bincount(bucket[labels[order][doc] == 0], minlength=BUCKETS)
    keep = (seen[bucket] >= 4) & (clean[bucket] <= 0.3 * (labels == 0).sum())  # neither chance nor what all texts hold
    doc, bucket, weight = doc[keep], bucket[keep], weight[keep]
    used = np.unique(bucket)
    column = np.searchsorted(used, bucket).astype(np.int32)
    y = labels[order].astype(int)
    emb = rng.normal(0, 1 / dim, (len(used), dim))
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    ge, go, gb = np.full(emb.shape, 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    for _ in range(max(epochs, STEPS * 64 // max(len(texts), 1))):
        for lo in range(0, len(texts), 64):
            hi = min(lo + 64, len(texts))
            s = slice(first[lo], first[hi])
            c, w, d = column[s], weight[s], doc[s] - lo
            x = np.stack([np.bincount(d, w * emb[c, k], minlength=hi - lo) for k in range(dim)], 1)
            z = x @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(hi - lo), y[lo:hi]] -= 1
            p /= hi - lo
            g_out, g_x, g_bias = x.T @ p, p @ out.T, p.sum(0)
            here, at = np.unique(c, return_inverse=True)
            g_emb = np.stack([np.bincount(at, w * g_x[d, k], minlength=len(here)) for k in range(dim)], 1) + DECAY * emb[here]
            for value, grown, g, rows in ((emb, ge, g_emb, here), (out, go, g_out, slice(None)), (bias, gb, g_bias, slice(None))):
                grown[rows] += g * g
                value[rows] -= rate * g / np.sqrt(grown[rows])
    value = np.zeros(BUCKETS, np.float32)
    value[used] = GAIN * (emb @ (out[:, 1] - out[:, 0]))
    return value, float(bias[1] - bias[0])


def window_logits(texts: list[str | None], value: np.ndarray, bias: float, span: int = SPAN) -> np.ndarray:
    """The largest window logit of each text; the bias for a text without words."""
    out = np.full(len(texts), bias)
    for b in char_blocks(texts, digits=True, block_chars=1 << 16):
        n = len(b.start)
        if not n:
            continue
        word, bucket, weight = _features(b)
        score = np.bincount(word, weight * value[bucket], minlength=n)
        sums = np.concatenate([[0.0], np.cumsum(score)])
        count = np.diff(b.first)
        windows = np.maximum(-(-(count - span) // (span // 2)), 0) + (count > 0)
        doc = np.repeat(np.arange(len(count)), windows)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        stop = np.minimum(b.first[doc] + nth * (span // 2) + span, b.first[doc + 1])
        start = np.maximum(stop - span, b.first[doc])
        logit = bias + (sums[stop] - sums[start]) / np.maximum(stop - start, FEWEST)
        best = np.full(len(count), -np.inf)
        np.maximum.at(best, doc, logit)
        out[b.lo : b.hi] = np.where(count > 0, best, bias)
    return out


def _logistic(z: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of P(y) = sigmoid(slope z + shift), by damped Newton steps on standardised z."""
    if len(z) == 0 or y.min() == y.max():
        return 1.0, 0.0
    mid, sd = z.mean(), z.std() or 1.0
    x, ab = np.stack([(z - mid) / sd, np.ones(len(z))], 1), np.zeros(2)
    target = np.where(y == 1, 0.99, 0.01)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        ab += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(ab[0] / sd), float(ab[1] - ab[0] * mid / sd)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 600, seed: int = 7) -> Model:
    """Trains on two thirds of at most 2 * per_class labelled rows of either class; the others set the scale.

    docs: doc_id, text; labels: doc_id, toxic (0 or 1; other rows are left out).
    Only the chosen ids (at most 4 * per_class) are broadcast against the
    documents. Without rows of both classes the model scores 0.5 shifted by the
    one class that there is, or 0 without any.
    """
    chosen, there = None, {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    for c in (0, 1):
        ids = labels.where(F.col("toxic") == c).select("doc_id", F.lit(c).alias("toxic")).where("doc_id is not null").distinct()
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        chosen = ids if chosen is None else chosen.unionByName(ids)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").toPandas()
    rows = rows.sort_values("doc_id", kind="stable").reset_index(drop=True)
    if rows.empty or rows.toxic.nunique() < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, 0.0 if rows.empty else (9.0 if rows.toxic[0] == 1 else -9.0))
    turn = np.random.default_rng(seed).permutation(len(rows)) % 3 != 0
    train, scale = rows[turn], rows[~turn]
    value, bias = fit_embeddings(train.text.tolist(), train.toxic.to_numpy())
    z = window_logits(scale.text.tolist(), value, bias)
    y = scale.toxic.to_numpy()
    slope, shift = _logistic(z, y)
    # The chosen rows hold more of the rarer class than all rows do.
    odds = np.log(there[1] / there[0]) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return Model(value, bias, slope, shift + float(odds))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts get the score of no words.

    Repeated rows are scored each; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 numbers, whatever the input

    def run(batches):
        m = shared.value
        for b in slices(batches):
            z = window_logits(b.column(1).to_pylist(), m.value, m.bias)
            p = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """docs with all its columns and toxicity_score; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("toxicity_score")
    at = base.columns.index("text")

    def run(batches):
        m = shared.value
        for b in slices(batches):
            z = window_logits(b.column(at).to_pylist(), m.value, m.bias)
            p = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, "toxicity_score"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("toxicity_score", T.DoubleType())]))
