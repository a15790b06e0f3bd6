"""Packing, pieces, archives, quality, language, toxicity and neighbours."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtab.llm import langid, quality, toxicity
from voxtab.llm.neighbours import nearest
from voxtab.llm.packing import combinations, nnls, pack_documents, plan_windows, token_pieces
from voxtab.llm.pieces import MARK, decode_ids, encode_nbest, lattice
from voxtab.llm.warc import archive_round_trip, read_chunks, record_types, write_archives
from voxtab.llm.wordbpe import word_bpe
from voxtab.plans.lineage import materialize, shared_dir

SF = "/root/testdata/sf0.001"


def test_word_ids_are_those_of_tokenizers(spark):
    w = word_bpe("word_bpe_49k.json")
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    vocab = [k.replace("</w>", "") for k in w.slow.get_vocab()]
    r = random.Random(1)
    glued = ["".join(r.choices([v for v in vocab if v.isascii()], k=r.randint(1, 4))) for _ in range(5000)]
    odd = ["", " \n", "İstanbul ΣΑΣ", "<|endoftext|>a <|startoftext|>", "it's DON'T ½ x\0y \x85q \x1ca 日本 😀!!", "ǅ ß ſ 'LL"]
    for batch in (texts, glued, odd):
        want = w.slow.encode_batch(batch, add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in w.encode_bytes(batch)] == [e.ids for e in want]


def test_packing_uses_each_id_once(spark, docs, odd):
    d = docs(odd + [(k, f"some words {k} " * (k % 300)) for k in range(10, 400)])
    pieces = materialize(token_pieces(d, with_ids=True))
    rows = pack_documents(d).collect()
    assert len(rows) == pieces.count()
    for s in pieces.collect():
        assert len(s.ids) == s.length and zlib.crc32(np.array(s.ids, "<u4").tobytes()) == s.ids_crc32
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(x.length for x in rows)
    assert total / (4096 * len(by)) > 0.9
    empty = [x for x in rows if x.doc_id in (1, 2, 3)]
    assert [x.length for x in empty] == [1, 1, 1] and {x.ids_crc32 for x in empty} == {zlib.crc32(np.array([2], "<u4").tobytes())}
    assert pack_documents(docs([])).count() == 0


def test_plan_uses_every_piece():
    r = random.Random(2)
    for _ in range(20):
        h = {k: r.randint(1, 200) for k in r.sample(range(1, 33), r.randint(1, 30))}
        used = Counter()
        for combo, times in plan_windows(h, 32):
            assert sum(combo) <= 32
            for k in combo:
                used[k] += times
        assert used == h
    assert all(sum(c) == 16 and len(c) <= 3 for c in combinations(16, 3)) and len(combinations(16, 3)) == len(set(combinations(16, 3)))


def test_nnls_finds_known_solutions():
    rng = np.random.default_rng(0)
    a = rng.random((30, 12))
    x = np.maximum(rng.normal(size=12), 0)
    assert np.allclose(nnls(a, a @ x), x, atol=1e-8)


def brute_paths(lat, text):
    whole, out = MARK + text.replace(" ", MARK), []

    def go(i, s, ids):
        if i == len(whole):
            out.append((s, ids))
            return
        one = False
        for j in range(i + 1, len(whole) + 1):
            e = lat.edges.get(whole[i:j])
            if e:
                one |= j == i + 1
                go(j, s + e[0], ids + e[1])
        if not one:
            go(i + 1, s + lat.rest, ids + np.array([lat.byte_ids[b] for b in whole[i].encode()], "<u4").tobytes())

    go(0, 0.0, b"")
    return sorted(out, key=lambda p: -p[0])


@pytest.mark.parametrize("text", ["the cat", "a a", "hello", "  x", "é日 b", "ababab", "aaaa", "on it, no", "x"])
def test_n_best_pieces_match_all_paths(text):
    lat = lattice("piece_bpe_32k.model", 3)
    want, got = brute_paths(lat, text), lat.encode(text)
    assert [g[0] for g in got] == [s for s, _ in want[:3]]
    assert len({g[1] for g in got}) == len(got) and all((g[0], g[1]) in want and g[2] for g in got)
    assert [s for s, _ in lat.search(MARK + text.replace(" ", MARK))] == [s for s, _ in want[:3]]


def test_pieces_round_trip(spark, docs, odd):
    d = docs(odd).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("").alias("removed"), F.lit(0).alias("key"), F.lit(0.0).alias("score")))
    out = encode_nbest(d)
    assert out.where("not round_trip").count() == 0
    back = decode_ids(out.where("rank = 1")).select("doc_id", "text")
    want = d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assert back.exceptAll(want).count() == 0 and want.exceptAll(back).count() == 0
    assert encode_nbest(docs([])).count() == 0


def test_archives_round_trip(spark):
    big = "x<é>\r\n\r\nWARC/1.1\r\n" * 3000
    rows = [(1, "http://a/", big), (2, "u\r\nBad: 1", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", "z")]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in archive_round_trip(p, chunk_bytes=1000).collect()}
    assert set(got) == {None, *range(1, 10)} and got[None].record_type == "response"
    import hashlib

    for i, _, html in rows[:-1]:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest()) == (len(data), got[i].declared_digest)
    assert {i for i in got if got[i].record_type == "revisit"} == {1, 2} and got[1].refers_to == got[2].refers_to == 3
    folder = f"{shared_dir(spark)}/warc-test-{random.random()}"
    m = materialize(write_archives(record_types(p), folder))
    chunks = read_chunks(m, folder, chunk_bytes=1000).where("page_id = 3").orderBy("chunk").collect()
    assert b"".join(c.data for c in chunks) == big.encode() and [c.chunk for c in chunks] == list(range(len(chunks))) and max(len(c.data) for c in chunks) <= 1000
    assert archive_round_trip(p.where("false")).count() == 0


def test_archives_of_odd_pages(spark):
    import hashlib

    long = "z" * 2_500_000  # over two chunks of the default size
    rows = [(None, "u", "a" * 1500), (None, "u", "b" * 1500), (7, "u", "b" * 1500), (8, None, "c" * 1500), (8, "v", "c" * 1500), (8, "w", "other"), (9, "u", long), (10, "u", long)]
    p = spark.createDataFrame([(*r, "x", 1, None) for r in rows], "page_id bigint, url string, html string, payload_digest string, chunks int, target bigint")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.chunks, r.payload_digest) for r in archive_round_trip(p).collect()), key=repr)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(None, 1500, "response", None, 1, sha("a" * 1500)), (None, 1500, "revisit", 7, 1, sha("b" * 1500)), (7, 1500, "response", None, 1, sha("b" * 1500)), (8, 1500, "response", None, 1, sha("c" * 1500)),
            (8, 1500, "response", None, 1, sha("c" * 1500)), (8, 5, "response", None, 1, sha("other")), (9, 2_500_000, "revisit", 10, 1, sha(long)), (10, 2_500_000, "response", None, 3, sha(long))]
    assert got == sorted(want, key=repr)


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    c = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
    cover = {k for j in range(len(w) - 7) if c[tuple(w[j : j + 8])] > 1 for k in range(j, j + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_quality_counts_match_brute_force(spark, docs, odd):
    more = [(50, "a\na\n\n b\n b\na "), (51, "#a|b <c>\n*"), (52, "x y z " * 9 + "é" * 5), (53, "\n\n\n"), (54, "one two three four five six seven eight nine " * 2)]
    d = docs(odd + more)
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.text_counts(d).collect())
    assert got == sorted((i or 0, *brute_counts(t)) for i, t in odd + more)
    assert quality.text_counts(docs([])).count() == 0


def test_binomial_bound_is_exact():
    from math import comb

    for k, n, delta in ((0, 50, 0.05), (3, 40, 0.01), (10, 200, 1e-4)):
        p = quality.upper_bound(k, n, delta)
        tail = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail - delta) < 1e-6
    assert quality.upper_bound(5, 5, 0.05) == 1.0


def labelled_rows(spark, n, seed):
    """Good rows whose symbol counts grow with chance, and bad ones with many; other statistics are equal."""
    x = F.rand(seed)
    rows = spark.range(n).withColumn("good", F.col("id") % 10 != 0).withColumn("n_symbols", F.when(F.col("good"), (x * x * x * x * 60).cast("bigint")).otherwise((40 + x * 60).cast("bigint")))
    return rows.selectExpr("id AS doc_id", "'en' AS stratum", "good", "100 AS n_words", "500 AS word_chars", "n_symbols", "0 AS n_dup_lines", "0 AS n_repeat_words", "1 AS n_lines", "0 AS n_upper", "1 AS n_letters", "0 AS n_marks")


def test_cutoffs_hold_their_risk_on_unseen_rows(spark):
    unseen = labelled_rows(spark, 20000, 99)
    rejected = []
    for seed in range(5):
        cuts = quality.choose_cutoffs(labelled_rows(spark, 3000, seed), risk=0.05)
        assert [(s, r) for s, r, _ in cuts] == [("en", "symbols")]
        judged = quality.judge(unseen, cuts).groupBy("good").agg(F.avg((F.size("failed_rules") > 0).cast("int")).alias("share"))
        rejected.append({r.good: r.share for r in judged.collect()})
    assert all(r[True] <= 0.05 for r in rejected) and all(r[False] > 0.5 for r in rejected)
    few = quality.choose_cutoffs(labelled_rows(spark, 60, 1))
    assert few == [] and quality.judge(unseen, few).where("size(failed_rules) > 0").count() == 0


def test_rules_reject_junk_of_the_labelled_table(spark):
    from voxtab.llm.queries import op7_quality_rules

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    langs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    judged = op7_quality_rules(spark, sf).where("not base_failed").join(labels, "doc_id").join(langs, "doc_id").groupBy("lang", "quality").agg(F.avg((~F.col("kept")).cast("int")).alias("lost"))
    lost = {(r.lang, r.quality): r.lost for r in judged.collect()}
    assert {lang for lang, _ in lost} == {"de", "en", "es", "fr"}
    for (lang, quality), share in lost.items():  # every language has the labels for cutoffs
        assert share <= 0.03 if quality else share > 0.75, (lang, quality, share)


def test_strata_of_one_class_and_contradictory_labels(spark):
    rows = labelled_rows(spark, 3000, 5)
    for good in (True, False):  # without the other class nothing tells rules apart
        assert quality.choose_cutoffs(rows.where(F.col("good") == good)) == []
    both = rows.unionByName(rows.withColumn("stratum", F.lit("other")).where("good"))
    assert {s for s, _, _ in quality.choose_cutoffs(both, risk=0.05)} == {r.stratum for r in rows.select("stratum").distinct().collect()}
    assert quality.choose_cutoffs(rows.unionByName(rows.withColumn("good", ~F.col("good")))) == []


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.where("doc_id % 3 <> 0"))
    out = langid.identify(d.where("doc_id % 3 = 0"), model).join(d.select("doc_id", "lang"), "doc_id")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(spark, docs, odd):
    model = langid.fit_texts(["the cat and the dog " * 20, "der hund und die katze " * 20], ["en", "de"])
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(odd + [(9, "12 345 !!"), (10, "die katze")]), model).collect()}
    assert got[1] == got[2] == got[3] == got[9] == "und" and got[10] == "de"
    none = langid.fit(spark.createDataFrame([], "doc_id int, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs(odd), none).collect()} == {"und"}


def test_toxicity_learns_stems(spark, docs, odd):
    r = random.Random(6)
    clean = ["".join(r.choices("aeioustrn", k=r.randint(3, 8))) for _ in range(400)]
    rows, marks = [], []
    for i in range(800):
        w, bad = r.choices(clean, k=r.randint(20, 90)), i % 4 == 0
        for _ in range(len(w) // 20 + 1 if bad else 0):
            w[r.randrange(len(w))] = "grumpf" + r.choice(["", "a", "ig", "en", "us", "ox"])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    d, labels = docs(rows), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.fit(d, labels.where("doc_id % 5 <> 0"))
    out = toxicity.score(d, model).join(labels, "doc_id").where("doc_id % 5 = 0")
    assert out.where("(score >= 0.5) <> (toxic = 1)").count() <= 3
    unseen = toxicity.score(docs([(1, " ".join(clean[:30]) + " grumpfyz"), (2, " ".join(clean[:30]))]), model).collect()
    assert unseen[0].score > unseen[1].score
    odd_scores = toxicity.score(docs(odd), model).collect()
    assert len(odd_scores) == len(odd) and all(0 <= x.score <= 1 for x in odd_scores)
    assert toxicity.fit(d, labels.where("false")).value.max() == 0


def test_neighbours_recall_and_odd_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    odd = spark.createDataFrame([(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] * 64, 0), (9100, [None] + [1.0] * 63, 0)], v.schema)
    got = nearest(v.unionByName(odd), F.col("vec_id") % 100 == 0).toPandas()
    rows = v.toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hit = total = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        hit += len(set(ids[np.lexsort((ids, d))[:10]]) & set(g.vec_id))
        total += 10
        assert g.sort_values("rank").score.is_monotonic_increasing and list(g.sort_values("rank")["rank"]) == list(range(1, 11))
        assert np.allclose(g.score, [d[ids == i][0] for i in g.vec_id], rtol=0, atol=1e-12)
    assert total == 10 * (ids % 100 == 0).sum() and hit / total >= 0.9
    assert got.verified.mean() < 0.5  # of 2,000 rows
    assert nearest(odd, F.col("vec_id") % 100 == 0).count() == 0
    short = spark.createDataFrame([(9300, [1.0, 2.0], 0), (100, [0.25] * 64, 0)], v.schema)
    assert nearest(v.unionByName(short), F.col("vec_id") % 100 == 0).where("query_id = 9300 or vec_id = 9300").count() == 0
    assert nearest(v.unionByName(short), F.col("vec_id") % 100 == 0).where("query_id = 100").count() == 10
    few = nearest(v.limit(4).withColumn("vec_id", F.monotonically_increasing_id() % 4 * 50 + 100), F.col("vec_id") % 100 == 0)
    assert few.count() > 0


def test_letters_of_every_plane(spark, docs):
    model = langid.fit_texts(["the cat and the dog " * 20, "\U00010330\U00010331 \U00010332\U00010333 " * 20], ["en", "got"])
    got = {r.doc_id: r for r in langid.identify(docs([(1, "\U00010330\U00010331"), (2, "\U00020000 \U00020001"), (3, "1 \U0001F600")]), model).collect()}
    assert got[1].lang_pred == "got" and got[2].lang_pred != "und" and got[3].lang_pred == "und"


def test_whole_texts_match_one_search_of_their_lattice(spark):
    lat = lattice("piece_bpe_32k.model", 3)
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").select("text").limit(60).collect()
    for (text,) in rows:
        if text:
            want = [s for s, _ in lat.search(MARK + text.replace(" ", MARK))]
            assert [g[0] for g in lat.encode(text)] == pytest.approx(want)


def test_neighbours_of_ties_and_clashing_columns(spark):
    near = [(100, [5.0, 5.0, 5.0]), *((n, [5.0, 5.0, 5.0 + (1 if n % 2 else -1) * (n // 2 + 1)]) for n in (9, 8, 7, 6, 5, 4, 3, 2))]
    far = [(n, [5.0, 40.0, 5.0]) for n in (50, 40, 30, 20)]
    rows = [(i, v, 7, "r", 0.5, 3, False, "b") for i, v in near + far]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, query_id int, rank string, score double, dim int, verified boolean, block string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(v, F.col("vec_id") % 100 == 0).collect())
    want = [(100, n + 1, n + 2, float((n + 2) // 2 + 1)) for n in range(8)] + [(100, 9, 20, 35.0), (100, 10, 30, 35.0)]
    assert got == want  # of equal distances the smaller ids come first, and 40 and 50 find no place


def test_toxicity_of_held_out_rows(spark):
    from voxtab.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic in (0, 1)").select("doc_id", "toxic")
    got = queries.op10_toxicity(spark, sf).where("held_out").join(labels, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.avg("predicted").alias("called")).collect()
    by = {r.toxic: r for r in got}
    assert by[0].n > 500 and by[0].called <= 0.02
    assert by[1].n > 50 and by[1].called >= 0.6
