"""The Merkle manifest against a plain tree, and its parts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtab.llm import merkle
from voxtab.llm.merkle import manifest, pack_bits, ranks, unpack_bits

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, skey string, high int, pos double"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars, cut=False):
    text = text.replace("\n", "") if cut and text is not None else text
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def brute(rows):
    """The rows of the manifest, from lists."""
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        trees[s] = levels_of([leaf_of(*r) for r in sources[s]])
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            sides, at = [], i
            for tree, start in ((trees[s], i), (top, k)):
                at = start
                for level in tree[:-1]:
                    lo = at // 3 * 3
                    sides.append(("".join(level[lo:at]), "".join(level[at + 1 : lo + 3])))
                    at //= 3
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf_of(*r, cut=tampered)
            for a, b in sides:
                node = h(a + node + b)
            root = top[-1][0]
            out.append((r[0], leaf_of(*r), trees[s][-1][0], root, h("".join(a + b for a, b in sides)), node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, levels=8):
    docs = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA)
    return sorted(map(tuple, manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 2 == 0, levels).collect()), key=repr)


ODD = [
    (1, None, "en", "a", 3), (2, "", None, "a", None), (3, "one\ntwo", "fr", None, 7), (None, "no id\n", "de", "a", 1), (None, "no id\n", "de", "a", 1), (None, "other", "de", "a", 1),
    (4, "x\n", "en", "", 1), (4, "x\n", "en", "", 1), (4, "y", "en", "", 1), (-5, "ü😀\n", "en", "é", 2), (1 << 40, "far\n", "en", "a", 2), (70000, "b\n", "en", "a", 2),
]


def test_nulls_copies_and_shared_ids(spark):
    assert run(spark, ODD) == brute(ODD)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, ODD[:1]) == brute(ODD[:1])


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_several_rounds(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle.leaf_nodes, "__defaults__", (4,))
    r = random.Random(levels)
    rows = [(r.choice([i, i, i * 70000]), f"t\n{i}", "en", f"s{r.choice([0, 0, 0, r.randrange(8)])}", i) for i in range(200)] + [(7, "copy\n", "en", "s0", 1)] * 11
    assert run(spark, rows, levels) == brute(rows)


def test_ranks_of_both_packings():
    r = np.random.default_rng(0)
    for n in (0, 1, 100, merkle.FEW - 1, merkle.FEW, 50_000, merkle.BITS):
        low = np.sort(r.choice(merkle.BITS, n, replace=False))
        raw = pack_bits(low)
        ask = np.array([0, 1, 63, 64, 65_535, *low[:50]], np.int64)
        assert (unpack_bits(raw) == low).all() and (ranks(raw, ask) == np.searchsorted(low, ask)).all() and len(raw) <= merkle.BITS // 8
