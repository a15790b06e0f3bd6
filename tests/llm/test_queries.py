"""The registered queries of this subpackage on the smallest tables, against SQL, brute force and their contracts."""

import hashlib
import zlib

import pytest

import corpus_pipeline as cp
from tests.llm.test_joins import brute_components
from tests.llm.test_texts import brute_counts
from tests.oracle import connect, differences
from voxtab.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(Q.QUERIES[name](spark, SF), connect(SF), Q.ORACLE_SQL[name]) == ""


def test_packing_and_pieces(spark, texts):
    rows = Q.op2_packing(spark, SF).collect()
    for i in texts:
        own = sorted((r.start, r.length, r.doc_tokens) for r in rows if r.doc_id == i)
        assert own[0][0] == 0 and sum(n for _, n, _ in own) == own[0][2] and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))
    best = [r for r in Q.op3_sentencepiece(spark, SF).collect() if r["rank"] == 1]
    assert {r.doc_id: r.decoded_md5 for r in best} == {i: hashlib.md5((t.text or "").replace("▁", " ").encode()).hexdigest() for i, t in texts.items()}


def test_language_and_toxicity_columns(spark, texts):
    langs = {r.lang for r in texts.values()} | {"und"}
    got = Q.op4_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and r.lang_pred in langs and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id].text or ""))
    got = Q.op10_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)


def test_quality_columns(spark, texts):
    for r in Q.op7_quality_rules(spark, SF).collect():
        want = brute_counts(texts[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.kept and r.base_failed)


def test_components_of_the_table(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op8_ngram_jaccard(spark, SF).collect()}
    assert got == brute_components([(i, r.text) for i, r in texts.items()], 4, 85)


def test_pipeline_keeps_rows_of_null_and_repeated_ids(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = "A short text of its own number {} that no other row has in whole or in part, {} times over."
    odd = [(None, own.format(1, 2)), (None, own.format(3, 4)), (77, own.format(50, 60)), (77, "Quite different words stand in this second row, which has the first one's id."), (78, None), (79, "")]
    rows = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in odd], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    rows = rows.select(*docs.columns)
    for _, stage in cp.STAGES[:4]:
        rows = stage(spark, rows, SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in rows.collect()) == sorted((i or 0, t or "") for i, t in odd)
    assert cp.STAGES[4][1](spark, rows, SF).count() == len(odd)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
