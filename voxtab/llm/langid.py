"""Language identification, word first with backoff to shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. Any
other word falls back to its longest known character n-grams: those of 5
characters, if any of them is known, else of 4, and so on to 1. A text takes the
language of the largest mean score over all its words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.llm.chars import CharBlock, char_blocks
from voxtab.llm.streams import slices

LONGEST = 5


class Model(NamedTuple):
    """languages; for orders 0 (words) and 1..LONGEST: sorted hashes, and log frequencies per language."""

    languages: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]


def _merged(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums the rows of counts by hash."""
    keys, at = np.unique(hashes, return_inverse=True)
    return keys, np.stack([np.bincount(at, counts[:, k], minlength=len(keys)) for k in range(counts.shape[1])], 1)


def _order_table(texts: list[str], number: np.ndarray, n_lang: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log frequencies of the commonest words (n = 0) or n-grams; one missing in a language counts half."""
    keys, counts = np.zeros(0, np.uint64), np.zeros((0, n_lang))
    for b in char_blocks(texts):
        if not len(b.start):
            continue
        word, h = (np.arange(len(b.start)), b.word_hashes()) if n == 0 else b.ngrams(n)
        u, at = np.unique(h, return_inverse=True)
        c = np.bincount(at * n_lang + number[b.lo + b.doc[word]], minlength=len(u) * n_lang).reshape(-1, n_lang)
        keys, counts = _merged(np.concatenate([keys, u]), np.concatenate([counts, c]))
    total, seen = np.maximum(counts.sum(0), 1), counts.sum(1)
    keep = np.flatnonzero(seen >= (3 if n == 0 else 5))
    keep = np.sort(keep[np.argsort(-seen[keep], kind="stable")[:most]])
    return keys[keep], np.log(np.maximum(counts[keep], 0.5) / total).astype(np.float32)


def fit_texts(texts: list[str], langs: list[str], most: int = 60_000) -> Model:
    """A model from texts and their languages; at most `most` entries of each order."""
    names = sorted(set(langs))
    number = np.array([names.index(x) for x in langs], np.int64)
    tables = [_order_table(texts, number, len(names), n, most) for n in range(LONGEST + 1)] if texts else []
    return Model(names, [t[0] for t in tables], [t[1] for t in tables])


def fit(docs: DataFrame, per_language: int = 400) -> Model:
    """Trains on about per_language rows of each value of lang, chosen by a hash of the id (all, if fewer).

    docs: doc_id, text, lang; rows with a null in text or lang are left out.
    """
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / n))) for k, n in sorted(counts.items())]) if counts else F.lit(0.0)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003).toPandas().sort_values("doc_id", kind="stable")
    return fit_texts(drawn.text.tolist(), drawn.lang.tolist())


def _look_up(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Row of each hash among sorted keys, -1 if it is not there."""
    if not len(keys):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, at, -1)


def word_scores(b: CharBlock, m: Model) -> np.ndarray:
    """Per distinct word of the block, its score in each language; and each word's distinct number."""
    hashes, sample, number = np.unique(b.word_hashes(), return_index=True, return_inverse=True)
    scores = np.full((len(hashes), len(m.languages)), np.nan, np.float32)
    row = _look_up(m.hashes[0], hashes)
    scores[row >= 0] = m.logs[0][row[row >= 0]]
    open_ = np.flatnonzero(row < 0)
    for n in range(LONGEST, 0, -1):
        if not len(open_):
            break
        word, h = b.ngrams(n, sample[open_])
        back = np.zeros(len(b.start), np.int64)
        back[sample[open_]] = open_
        row = _look_up(m.hashes[n], h)
        own, row = back[word[row >= 0]], row[row >= 0]
        count = np.bincount(own, minlength=len(hashes))
        for k in range(len(m.languages)):
            total = np.bincount(own, m.logs[n][row, k], minlength=len(hashes))
            hit = count > 0
            scores[hit, k] = total[hit] / count[hit]
        open_ = open_[count[open_] == 0]
    return np.nan_to_num(scores, nan=0.0), number


def predict_texts(texts: list[str | None], m: Model) -> tuple[list[str], np.ndarray]:
    """Language and score (softmax of the mean log frequency times the root of the number of words) of each text."""
    names, conf = ["und"] * len(texts), np.zeros(len(texts))
    if not m.languages:
        return names, conf
    for b in char_blocks(texts):
        if not len(b.start):
            continue
        scores, number = word_scores(b, m)
        count = np.diff(b.first)
        z = np.stack([np.bincount(b.doc, scores[number, k], minlength=len(count)) for k in range(len(m.languages))], 1)
        z /= np.sqrt(np.maximum(count, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i in np.flatnonzero(count):
            k = int(z[i].argmax())
            names[b.lo + i], conf[b.lo + i] = m.languages[k], p[i, k]
    return names, conf


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row; `und` with score 0 for null texts and texts without letters.

    Repeated rows are predicted each; further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 6 * 60,000 entries per language

    def run(batches):
        for b in slices(batches):
            names, conf = predict_texts(b.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(conf)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
