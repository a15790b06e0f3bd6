"""Repeated passages against a search of all windows of fifty words."""

import random

from tests.llm.test_joins import text_of, words
from voxtab.llm.substring import repeated_passages, with_version, without_passages

LEAST = 50


def brute_cover(rows):
    """Per (doc_id, version), the words that lie in a window of LEAST words that came before, without overlap."""
    seen, out = {}, {}
    for i, v, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[:2]):
        w = words(t)
        cut = set()
        for x in range(len(w) - LEAST + 1):
            before = seen.setdefault(tuple(w[x : x + LEAST]), (i, v, x))
            if before[:2] != (i, v) or before[2] + LEAST <= x:
                cut |= set(range(x, x + LEAST))
        out[i, v] = cut
    return out


def covered(found):
    out = {}
    for p in found:
        out.setdefault((p.doc_id, p.version), set()).update(range(p.start_word, p.end_word))
    return out


def held_against_brute(docs, rows):
    """Shares of words found of those that came before, and of those that are not of them among the found."""
    d = docs(rows)
    keyed = [(r.doc_id, r.version, r.text) for r in with_version(d).collect()]
    want, got = brute_cover(keyed), covered(repeated_passages(d).collect())
    total = sum(map(len, want.values()))
    hit = sum(len(c & got.get(k, set())) for k, c in want.items())
    extra = sum(len(c - want.get(k, set())) for k, c in got.items())
    return hit / max(total, 1), extra / max(total, 1)


def test_periodic_texts(docs):
    r = random.Random(1)
    for period in (1, 2, 3, 7, 10, 16, 17, 40):
        sentence = text_of(r, period)
        rows = [(k, f"{text_of(r, 20 + k)} {' '.join([sentence] * (1000 // period))} {text_of(r, 20)}") for k in (1, 2)]
        got = covered(repeated_passages(docs(rows)).collect())
        want = {i: c for (i, _), c in brute_cover([(i, 0, t) for i, t in rows]).items()}
        got = {i: c for (i, _), c in got.items()}
        assert want[2] <= got[2], period  # of the other document, all
        assert len(want[1] - got[1]) < 40 and sum(len(got[i] - want[i]) for i in (1, 2)) < 40, period  # of its own, but for the beginning


def test_periodic_texts_of_every_period(docs):
    r = random.Random(5)
    rows = []
    for period in range(1, 61):
        sentence = text_of(r, period).split()
        for k, n in enumerate((300, 300, 1200)):  # a copy, and one that goes on far longer
            rows.append((3 * period + k, f"{text_of(r, 20 + k)} {' '.join((sentence * n)[:n])} {text_of(r, 20)}"))
    got = covered(repeated_passages(docs(rows)).collect())
    want = brute_cover([(i, 0, t) for i, t in rows])
    lost = {i: len(c - got.get((i, 0), set())) for (i, _), c in want.items() if i % 3}
    assert not any(lost.values()), {i: n for i, n in lost.items() if n}


def test_tandem_passages_in_many_documents(docs):
    r = random.Random(2)
    p = text_of(r, 60)
    rows = [(k, f"{text_of(r, 30)} {p} {p} {p} {text_of(r, 30)}") for k in range(40)]
    d = docs(rows)
    got = covered(repeated_passages(d).collect())
    sizes = {k: len(c) for (k, _), c in got.items()}
    assert 120 <= sizes[0] <= 122 and all(180 <= sizes[k] <= 182 for k in range(1, 40))  # a word beside a passage may agree by chance
    recall, extra = held_against_brute(docs, rows)
    assert recall > 0.999 and extra < 0.001


def test_exact_passages_of_random_places(docs):
    r = random.Random(3)
    pool = [text_of(r, r.randint(40, 140)) for _ in range(12)]
    rows = []
    for k in range(80):
        parts = [r.choice(pool) if r.random() < 0.4 else text_of(r, r.randint(10, 60)) for _ in range(6)]
        if r.random() < 0.3:  # the middle of a passage alone
            w = r.choice(pool).split()
            parts.append(" ".join(w[5 : r.randint(35, len(w))]))
        rows.append((k, " ".join(parts)))
    recall, extra = held_against_brute(docs, rows)
    assert recall > 0.999 and extra < 0.05


def test_rows_of_one_id(docs):
    r = random.Random(4)
    p = text_of(r, 80)
    rows = [(1, f"{text_of(r, 30)} {p}"), (2, f"one {p} {text_of(r, 30)}"), (2, f"{text_of(r, 5)} other"), (2, ""), (2, None), (None, p), (3, p), (3, p)]
    assert held_against_brute(docs, rows)[0] == 1.0
    d = docs(rows)
    left = [(x.doc_id, x.text) for x in without_passages(d, repeated_passages(d)).collect()]
    assert len(left) == len(rows)
    assert sorted(x for x in left if x[0] == 3) == [(3, ""), (3, "")] and (None, p) in left
    assert sum(1 for i, t in left if i == 2 and t in (rows[2][1], "", None)) == 3 and ("one " + rows[1][1][4 + len(p) + 1 :]) in [t for i, t in left if i == 2]
