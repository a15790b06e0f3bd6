"""License scan against plain words and re, rule by rule."""

import re

from voxtab.llm.licenses import BASE, WEIGHTS, keywords, license_labels, rules, scan


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc_id, text):
    w = words_of(text)
    at = sorted(i for phrase in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    base = {label for phrase, label in BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()}
    t = f" {'  '.join(w)} " if w else ""
    found = []
    for no, kind, label, p, keyword, pattern in rules():
        if any(k in t for k in keywords(keyword)):
            found += [(t[: m.start()].count(" ") // 2, t[: m.end()].count(" ") // 2, p, no, label, kind) for m in re.finditer(pattern, t)]
    best = {}
    for a, b, p, no, label, kind in found:
        inside = any(c <= a and d >= b and q <= p and (c < a or d > b or q < p or o < no) for c, d, q, o, _, _ in found)
        if not inside or kind == "base":
            best[label] = max(best.get(label, 0), WEIGHTS[p])
    rest = 1.0
    for x in best.values():
        rest *= 1 - x
    return (doc_id, len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(best)), round(1 - rest, 6))


TEXTS = [
    None, "", " \n\t", "word", "MIT License", "the MIT License, the mit  license.\nMit-license", "GNU General Public License version 3 or later", "GNU Lesser General Public License v2 1",
    "Licensed under the Apache License, Version 2.0 (the \"License\")", "SPDX-License-Identifier: BSD-3-Clause", "cc by cc by cc by-nc-sa 4.0 International", "ccby license", "the mité license and mit license ",
    "released under the terms of the Creative Commons Attribution ShareAlike 4.0 and, see the MPL 2 for more details", "this is in the Public Domain. All rights reserved", "emit license", "MİT license ÀPACHE LICENSE",
    "dual MIT and GPLv3; noncommercial cc by non commercial", "mit license " * 3000, "plain words " * 20000 + "apache license", "cc\x00by\x7fcc_by", "gnu affero general public license",
]


def test_texts_against_words(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "mit license"), (3, "cc by"), (3, "cc by")]
    got = sorted(map(tuple, license_labels(docs(rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()), key=repr)
    assert got == sorted((brute(i, t) for i, t in rows), key=repr)


def test_titles_hide_what_they_hold(docs):
    rows = [(1, "Licensed under the GNU Lesser General Public License version 2.1"), (2, "GNU Affero General Public License")]
    kept = {(r.doc_id, r.label, r.rule) for r in scan(docs(rows)).where("kept").collect()}
    assert kept == {(1, "lgpl", "grant"), (2, "agpl", "mention")}


def test_empty_table(spark):
    assert license_labels(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_rules_are_many_and_ordered():
    table = rules()
    assert len(table) > 200 and [r[0] for r in table] == list(range(len(table))) and all(re.compile(r[5]) for r in table)


def test_no_python_in_the_plan(docs):
    plan = license_labels(docs([(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
