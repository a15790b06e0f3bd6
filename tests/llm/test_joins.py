"""Similarity join, passages and line runs against brute force."""

import itertools
import random
import re

from voxtab.llm import jaccard
from voxtab.llm.jaccard import jaccard_components
from voxtab.llm.linededup import without_repeated_lines
from voxtab.llm.substring import chain, repeated_passages, without_passages
from voxtab.plans import leaders

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(seed, groups=6, members=12):
    r, rows = random.Random(seed), []
    vocab = [f"w{k}" for k in range(400)]
    for _ in range(groups):
        base = r.choices(vocab, k=r.randint(20, 120))
        for _ in range(members):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((len(rows), " ".join(w).title() if r.random() < 0.3 else " ".join(w)))
    return rows + [(1000 + k, " ".join(r.choices(vocab, k=3))) for k in range(6)]


def test_components_match_brute_force(docs):
    for n, percent in ((4, 85), (5, 80)):
        rows = near_copies(n)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows), n, percent).collect()}
        assert got == brute_components(rows, n, percent)


def test_components_of_split_groups(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT", 2)
    monkeypatch.setattr(leaders, "HOT", 8)
    rows = near_copies(9, groups=4, members=20)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows), 4, 85).collect()}
    assert got == brute_components(rows, 4, 85)


def test_components_of_rows_of_one_id(docs):
    text = "one two three four five six seven"
    rows = [(1, text), (2, text + " eight"), (2, text.upper()), (2, "nothing in common with it at all here"), (None, text)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.leads) for r in jaccard_components(docs(rows), 4, 80).collect())
    assert got == [(0, 4, 0, True), (1, 4, 1, True), (2, 4, 1, False), (2, 5, 1, False), (2, 5, 2, True)]


def test_components_of_odd_rows(docs, odd):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs(odd)).collect() if r.doc_id is not None)
    assert [x for x in got if x[0] != 6] == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5)]
    assert jaccard_components(docs([])).count() == 0
    assert jaccard_components(docs([(1, None)])).first().component_id == 1


def text_of(r, n):
    return " ".join(r.choices([f"v{k}" for k in range(3000)], k=n))


def test_exact_passages_are_covered_and_cut(docs):
    r = random.Random(3)
    passage = text_of(r, 60)
    rows = [(k, text_of(r, 80) + (" " + passage + " " if k % 2 else " ") + text_of(r, 80)) for k in range(10)]
    d = docs(rows)
    found = repeated_passages(d)
    spans = {x.doc_id: (x.start_word, x.end_word, x.src_doc_id) for x in found.collect()}
    assert spans == {k: (80, 140, 1) for k in (3, 5, 7, 9)}
    left = {x.doc_id: x.text for x in without_passages(d, found).collect()}
    assert passage in left[1] and all(passage not in left[k] for k in (3, 5, 7, 9)) and left[0] == rows[0][1]
    assert without_passages(d, found).columns == d.columns


def test_fuzzy_passage_is_one_chain(docs):
    r = random.Random(4)
    w = text_of(r, 120).split()
    edited = w[:40] + ["new"] + w[41:80] + w[82:]
    rows = [(1, text_of(r, 30) + " " + " ".join(w)), (2, " ".join(edited) + " " + text_of(r, 30))]
    got = repeated_passages(docs(rows)).collect()
    assert len(got) == 1 and got[0].doc_id == 2 and (got[0].start_word, got[0].end_word) == (0, 118) and got[0].similarity > 0.95


def test_passages_of_odd_rows(docs, odd):
    assert {x.doc_id for x in repeated_passages(docs(odd)).collect()} <= {6}
    assert repeated_passages(docs([])).count() == 0
    d = docs(odd)
    assert without_passages(d, repeated_passages(d)).count() == len(odd)


def test_chain_follows_both_orders():
    import numpy as np

    x, y = np.array([0, 10, 20, 30, 35]), np.array([100, 110, 50, 130, 135])
    best = chain(x, y, 8)[0]
    assert best.tolist() == [0, 1, 3, 4]


def brute_lines(rows, min_chars=40):
    """Per row, the text without repeated lines, the number of lines and of those that went."""
    out, seen, done = {}, set(), {}
    for i, text in sorted((r for r in rows if None not in r), key=lambda r: r[0]):
        if (i, text) in out:
            continue
        lines = text.split("\n")
        seq = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(lines)]
        seq = [x for x in seq if x[1]]
        cut = set()
        for at, (k, a) in enumerate(seq):
            if len(a) >= min_chars:
                cut |= {k} if a in seen else set()
                seen.add(a)
            if at + 2 < len(seq):
                run = tuple(x for _, x in seq[at : at + 3])
                cut |= set(range(k, seq[at + 2][0] + 1)) if run in seen else set()
                seen.add(run)
        out[i, text] = ("\n".join(x for k, x in enumerate(lines) if k not in cut), len(lines), len(cut))
    return out


def test_line_runs_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(leaders, "HOT", 16)
    r, rows = random.Random(5), []
    pool = [f"line {k} of the pool" for k in range(40)] + ["menu", "home", "a long line of more than forty characters, told again"]
    for i in range(80):
        lines = [r.choice(pool) if r.random() < 0.7 else f"own {i} {k}" for k in range(r.randint(0, 9))]
        if r.random() < 0.5:
            lines[2:2] = pool[:4]
        rows.append((i, "\n".join(x + r.choice(["", " ", "\n"]) for x in lines)))
    want = brute_lines(rows)
    for x in without_repeated_lines(docs(rows)).collect():
        assert (x.text, x.n_lines, x.n_removed) == want[x.doc_id, rows[x.doc_id][1]]
        assert sum(g["last"] - g["first"] + 1 for g in x.removed or []) == x.n_removed


def test_lines_of_rows_of_one_id(docs):
    rows = [(1, "keep1\nkeep2\nkeep3"), (2, "x1\nx2\nx3"), (2, "keep1\nkeep2\nkeep3"), (2, "keep1\nkeep2\nkeep3"), (None, "keep1\nkeep2\nkeep3")]
    got = sorted((x.doc_id or 0, x.text, x.n_removed) for x in without_repeated_lines(docs(rows)).collect())
    assert got == [(0, rows[0][1], 0), (1, rows[0][1], 0), (2, "", 3), (2, "", 3), (2, "x1\nx2\nx3", 0)]


def test_many_equal_lines(docs):
    import time

    for line in ("equal", "a line of forty characters or more, repeated"):
        rows = [(1, "\n".join([line] * 100_000))]
        began = time.time()
        got = without_repeated_lines(docs(rows)).first()
        assert got.n_removed == 99_999
        assert time.time() - began < 60


def test_lines_of_odd_rows(docs, odd):
    out = without_repeated_lines(docs(odd))
    got = {(x.doc_id, x.text): (x.n_lines, x.n_removed) for x in out.collect()}
    assert got[(1, None)] == (0, 0) and got[(2, "")] == (1, 0) and out.count() == len(odd)
    assert without_repeated_lines(docs([])).count() == 0


def test_passages_around_unrelated_words(docs):
    r = random.Random(11)
    for gap in (50, 150, 300):
        p, q = text_of(r, 60), text_of(r, 60)
        rows = [(1, f"{text_of(r, 40)} {p} {text_of(r, gap)} {q} {text_of(r, 40)}"), (2, f"{text_of(r, 30)} {p} {text_of(r, gap)} {q} {text_of(r, 30)}")]
        got = sorted((x.start_word, x.end_word, x.src_start_word, x.src_end_word) for x in repeated_passages(docs(rows)).collect())
        assert got == [(30, 90, 40, 100), (90 + gap, 150 + gap, 100 + gap, 160 + gap)]


def test_stray_phrase_beside_a_passage(docs):
    r = random.Random(12)
    p, stray = text_of(r, 60), text_of(r, 30)
    rows = [(1, f"{p} {text_of(r, 80)} {stray}"), (2, f"{p} {text_of(r, 80)} {stray}")]
    assert [(x.start_word, x.end_word) for x in repeated_passages(docs(rows)).collect()] == [(0, 60)]


def test_passages_twice_in_one_document(docs):
    r = random.Random(13)
    p, q = text_of(r, 60), text_of(r, 60)
    got = sorted((x.start_word, x.end_word, x.src_start_word) for x in repeated_passages(docs([(1, f"{p} {p} {q} {q}"), (2, f"{p} {text_of(r, 20)} {p}")])).collect() if x.doc_id == x.src_doc_id == 1)
    assert got == [(60, 120, 0), (180, 240, 120)]


def test_parts_of_a_passage_agree_in_all(docs):
    r = random.Random(14)
    p, q = text_of(r, 40), text_of(r, 40)
    rows = [(k, f"{text_of(r, 30)} {p} {text_of(r, 15)} {q} {text_of(r, 30)}") for k in (1, 2)]
    assert [(x.start_word, x.end_word) for x in repeated_passages(docs(rows)).collect()] == [(30, 125)]


def test_whole_passage_whose_halves_came_before(docs):
    r = random.Random(15)
    p, q = text_of(r, 40), text_of(r, 40)
    parts = {1: p, 2: q, 3: f"{p} {q}", 9: f"{p} {q}"}
    got = repeated_passages(docs([(k, f"{text_of(r, 30)} {t} {text_of(r, 30)}") for k, t in parts.items()])).collect()
    assert [(x.doc_id, x.src_doc_id, x.start_word, x.end_word) for x in got] == [(9, 3, 30, 110)]


def test_recall_of_evenly_edited_passages(docs):
    r, rows, want = random.Random(16), [], []
    for every, n in ((7, 50), (8, 50), (8, 100), (10, 50), (10, 100), (20, 50), (20, 100)):  # 86 to 95 % agreement
        for _ in range(6):
            w = text_of(r, n).split()
            edited = [f"new{k}" if k % every == every // 2 else x for k, x in enumerate(w)]
            k = len(rows)
            rows += [(k, f"{text_of(r, 30)} {' '.join(w)} {text_of(r, 30)}"), (k + 1, f"{text_of(r, 30)} {' '.join(edited)} {text_of(r, 30)}")]
            want.append(k + 1)
    found = {x.doc_id: x for x in repeated_passages(docs(rows)).collect() if x.src_doc_id == x.doc_id - 1}
    assert sorted(found) == want
