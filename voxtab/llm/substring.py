"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Every document gives word k-mers as seeds: those whose hash lies in the least
   1/`one_in` of all hashes, which depends on the k-mer alone, so both copies of an
   edited passage choose the same ones; and the least of every `window` consecutive
   k-mers, so any exact run of k + window - 1 words holds a seed. In text with a
   period of fewer words than a window a seed is taken once a window.
2. A seed's occurrences are joined to its first one in (doc_id, version, position)
   order, and to the first one where min_words - window + 1 words from there on
   agree: two matches per occurrence at most, so copies never give all their pairs.
   Any exact run of min_words words has a seed with so many words behind it, so
   parts that came before elsewhere seldom hide where a whole passage came before.
3. Matches of a document with an earlier one are chained in order of both
   positions: a Fenwick tree keeps the best chain that ends before a position,
   with a cost for the words skipped on either side.
4. Chains are aligned on the words themselves: gaps by longest common
   subsequence, seeds extended into gaps and beyond both ends while words agree.
   A chain may bridge unrelated text, so every longest stretch of it with at
   least `min_words` words and `percent` agreement is a passage. Only the words
   beside a chain are fetched at first; where it still agrees near the edge of
   them, it is aligned again with FURTHER times as many, until it ends. Of chains
   of one pair that hold a passage already and end (begin) at the same place of the
   source, the last (first) one in the document goes on: what the others would
   still find, it finds too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxtab.llm.bitmap import bit_of, has_bits, id_bitmap
from voxtab.llm.streams import slices, sorted_groups
from voxtab.llm.words import _P, mix, same_bits, shingles, word_blocks
from voxtab.plans.leaders import tasks, with_leaders
from voxtab.plans.lineage import materialize

#: Words beside a chain that are fetched first, beside one that spans under 16 words, and how many times more are fetched for one that goes on.
MARGIN, NARROW, FURTHER = 256, 48, 4
#: An alignment that ends fewer words than this before the edge of what was fetched goes on.
EDGE = 8
#: Chains whose words a task holds as Python objects at a time.
ALIGNED = 1000
#: Cost of a skipped word, in words.
SKIP = 0.05


def _slide(x: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over every window of `width` values, by doubling."""
    done = 1
    while done < width:
        more = min(done, width - done)
        x = op(x[:-more], x[more:])
        done += more
    return x


def _once_a_window(doc: np.ndarray, h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The k-mers `at` without those whose hash came before in the same window of a run of equal ones."""
    order = at[np.lexsort((at, h[at], doc[at]))]
    if not len(order):
        return order
    begins = np.ones(len(order), bool)
    begins[1:] = (h[order[1:]] != h[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]]) | (order[1:] - order[:-1] >= window)
    run = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    cell = (order - order[run]) // window
    keep = begins.copy()
    keep[1:] |= cell[1:] != cell[:-1]
    return np.sort(order[keep])


def seeds(docs: DataFrame, k: int = 5, window: int = 16, one_in: int = 5, long: int = 35) -> DataFrame:
    """(seed, long, doc_id, version, pos): word k-mers of docs (doc_id, version, text), as the module says.

    The second column is a hash of the `long` words from pos on, null near the end of a text.
    """
    few = np.uint64((1 << 64) // one_in)

    def run(batches):
        for b in slices(batches, 4096):
            ids, versions = b.column(0).to_numpy(), b.column(1).to_numpy()
            for w in word_blocks(b.column(2)):
                at, h = shingles(w, k)
                if not len(at):
                    continue
                doc = w.doc[at]
                picked = h < few
                if len(at) >= window:
                    low = _slide(h, window, np.minimum)
                    whole = doc[: len(low)] == doc[window - 1 :]
                    top = np.zeros(len(at) + window - 1, np.uint64)  # the largest of the minima of the windows around a k-mer
                    top[window - 1 : window - 1 + len(low)] = np.where(whole, low, 0)
                    picked |= (_slide(top, window, np.maximum) == h) & (h > 0)
                count = np.bincount(doc, minlength=w.hi - w.lo)
                first = np.searchsorted(doc, np.arange(w.hi - w.lo))
                for d in np.flatnonzero((count > 0) & (count < window)):  # too short for a window: its least k-mer
                    picked[first[d] + int(h[first[d] : first[d] + count[d]].argmin())] = True
                s = _once_a_window(doc, h, np.flatnonzero(picked), window)
                pos = at[s] - w.first[doc[s]]
                fits = at[s] + long <= w.first[doc[s] + 1]
                more = np.zeros(len(s), np.uint64)
                for j in range(long):
                    more[fits] = mix(more[fits] * _P + w.hash[at[s[fits]] + j])
                row = w.lo + doc[s]
                cols = [pa.array(same_bits(h[s])), pa.array(same_bits(more), mask=~fits), pa.array(ids[row]), pa.array(versions[row]), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["seed", "long", "doc_id", "version", "pos"])

    return docs.select("doc_id", "version", "text").mapInArrow(run, "seed bigint, long bigint, doc_id bigint, version int, pos int")


def chain(x: np.ndarray, y: np.ndarray, k: int) -> list[np.ndarray]:
    """Disjoint chains of matches (x ascending), best first: each an array of match numbers in order.

    f(i) = k + max(0, max over x_j < x_i, y_j < y_i of f(j) - gap cost), where a
    chained match counts its new words at most and a gap costs SKIP per word
    skipped on either side. The maximum over j is a prefix maximum in a Fenwick
    tree over ranks of y.
    """
    n = len(x)
    rank = (np.unique(y, return_inverse=True)[1] + 1).tolist()
    size = max(rank)
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    xs, ys = x.tolist(), y.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # equal x: none follows another
            r, best = rank[j] - 1, (-np.inf, -1)
            while r > 0:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            got = best[0] - SKIP * (xs[j] + ys[j] - 2 * k)
            p = best[1]
            new = float(k) if p < 0 else float(min(k, xs[j] - xs[p], ys[j] - ys[p]))
            score[j], before[j] = (new + got, p) if got > 0 else (float(k), -1)
            j += 1
        for m in range(i, j):
            key, r = (score[m] + SKIP * (xs[m] + ys[m]), m), rank[m]
            while r <= size:
                if key > tree[r]:
                    tree[r] = key
                r += r & -r
        i = j
    used, out = [False] * n, []
    for m in np.argsort(-np.array(score), kind="stable").tolist():
        path = []
        while m >= 0 and not used[m]:
            used[m] = True
            path.append(m)
            m = before[m]
        if path:
            out.append(np.array(path[::-1]))
    return out


PAIR = ["doc_id", "version", "src", "src_version"]


def chains(matches: DataFrame, k: int) -> DataFrame:
    """Chains of matches (PAIR, pos, src_pos): PAIR, both ends and the matches.

    A pair's matches are bounded by the length of its document, two for each seed.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("version", pa.int32()), ("src", pa.int64()), ("src_version", pa.int32()), *[(c, pa.int32()) for c in ("x0", "x1", "y0", "y1")], ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32()))])
    schema = "doc_id bigint, version int, src bigint, src_version int, x0 int, x1 int, y0 int, y1 int, xs array<int>, ys array<int>"

    def run(batches):
        rows: list[tuple] = []
        held = 0
        for g in sorted_groups(batches, 4):
            x, y = g.column(4).to_numpy(), g.column(5).to_numpy()
            pair = tuple(g.column(c)[0].as_py() for c in range(4))
            for c in chain(x, y, k) if len(x) > 1 else [np.zeros(1, np.int64)]:
                cx, cy = x[c], y[c]
                rows.append((*pair, cx[0], cx[-1] + k, cy[0], cy[-1] + k, cx, cy))
                held += 8 + len(cx)
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), kinds)], schema=kinds)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), kinds)], schema=kinds)

    dealt = matches.select(*PAIR, "pos", "src_pos").repartition(tasks(matches), *PAIR).sortWithinPartitions(*PAIR, "pos", "src_pos")
    return dealt.mapInArrow(run, schema)


def word_arrays(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, version, words): 16 bits of each word's hash, of the documents (doc_id, version, text) whose doc_id is in wanted.

    Two different words are taken for the same once in 65,536.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, "doc_id"))

    def run(batches):
        for b in slices(batches, 4096):
            b = b.filter(pa.array(has_bits(shared.value, b.column(3).to_numpy())))
            for w in word_blocks(b.column(2)):
                low = w.hash.astype("<u2")
                cut = [low[w.first[d] : w.first[d + 1]].tobytes() for d in range(w.hi - w.lo)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.lo, w.hi - w.lo), b.column(1).slice(w.lo, w.hi - w.lo), pa.array(cut, pa.binary())], names=["doc_id", "version", "words"])

    return docs.select("doc_id", "version", "text", bit_of("doc_id").alias("bit")).mapInArrow(run, "doc_id bigint, version int, words binary")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short arrays."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        step = row[:-1] + (b == v)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], step))
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words agree, over the longest run from the start of both that ends where at least half agree best."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    total = np.cumsum(np.where(same, 1, -1))
    best = n - 1 - int(total[::-1].argmax()) if n else 0
    return same[: best + 1] if n and total[best] >= 0 else same[:0]


def _diagonal(a: np.ndarray, b: np.ndarray, x: int, y: int) -> int:
    """Equal words on the diagonal through (x, y), the most that a passage around a single seed can hold."""
    back = min(x, y)
    a, b = a[x - back :], b[y - back :]
    n = min(len(a), len(b))
    return int((a[:n] == b[:n]).sum())


def blocks(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int) -> tuple[np.ndarray, int, int]:
    """Rows (start, stop, start in b, agreeing words before): runs of equal words along a chain, its gaps and both its sides.

    The last column also counts words that agree in gaps, in order, outside any run.
    The words that the sides before and behind the chain extend over follow.
    """
    rows: list[list[int]] = []
    total = 0

    def add(x: int, y: int, n: int) -> None:
        nonlocal total
        if rows and rows[-1][1] == x and rows[-1][2] + x - rows[-1][0] == y:
            rows[-1][1] = x + n
        else:
            rows.append([x, x + n, y, total])
        total += n

    def runs(x: int, y: int, same: np.ndarray) -> None:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for lo, hi in edge.reshape(-1, 2).tolist():
            add(x + lo, y + lo, hi - lo)

    x, y = int(xs[0]), int(ys[0])
    left = _extend(a[:x][::-1], b[:y][::-1])[::-1]
    runs(x - len(left), y - len(left), left)
    for sx, sy in zip(xs.tolist(), ys.tolist()):
        if sx > x or sy > y:
            if sx >= x and sy >= y:
                p, q = a[x:sx], b[y:sy]
                after = _extend(p, q)
                p, q = p[len(after) :], q[len(after) :]
                ahead = _extend(p[::-1], q[::-1])[::-1]
                runs(x, y, after)
                total += _common(p[: len(p) - len(ahead)], q[: len(q) - len(ahead)])
                runs(sx - len(ahead), sy - len(ahead), ahead)
        over = max(0, x - sx, y - sy)
        if over < k:
            add(sx + over, sy + over, k - over)
        x, y = max(x, sx + k), max(y, sy + k)
    right = _extend(a[x:], b[y:])
    runs(x, y, right)
    return np.array(rows, np.int64), len(left), len(right)


def passages(rows: np.ndarray, min_words: int, percent: int, shift: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, start in b, stop in b, agreeing words) of each longest passage in the rows of `blocks`.

    Passages begin and end with runs of equal words, hold min_words words and agree
    in percent of the longer side, and lie in no longer such passage. With a shift
    (of b's words against a's, in one document) none reaches into its own source.
    """
    lo, hi, slo, before = rows.T
    if shift is not None:  # a run longer than its distance from its source is cut into parts of that length, the last two of which may overlap
        parts = [(x, min(x + far, h), s + x - l, n + x - l) for l, h, s, n in rows.tolist() if (far := l - s + shift) > 0 for x in (*range(l, h - far, far), max(l, h - far))]
        lo, hi, slo, before = np.array(parts, np.int64).reshape(-1, 4).T
    shi, after = slo + hi - lo, before + hi - lo
    first, last = 100 * before - percent * np.stack([lo, slo]), 100 * after - percent * np.stack([hi, shi])
    out, done = [], 0
    for i in range(len(lo)):
        if done == len(lo):
            break
        j0 = max(i, done)
        fits = (last[0, j0:] >= first[0, i]) & (last[1, j0:] >= first[1, i])
        if shift is not None:
            fits &= shi[j0:] <= lo[i] + shift
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        j = j0 + int(at[-1])
        done = j + 1
        if hi[j] - lo[i] >= min_words:
            out.append((int(lo[i]), int(hi[j]), int(slo[i]), int(shi[j]), int(after[j] - before[i])))
    return out


def with_version(docs: DataFrame) -> DataFrame:
    """docs with one more column: 0, or a hash of the text if some doc_id stands twice and this is one of its rows.

    The rows are told by a bitmap of fixed size, which may give others a hash too.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    bits = id_bitmap(ids, "doc_id")
    if not bits.any():
        return docs.withColumn("version", F.lit(0))
    words = bits.view(np.int64)
    spark = docs.sparkSession
    at = np.flatnonzero(words)
    table = spark.createDataFrame(pa.table({"_word": pa.array(at.astype(np.int32)), "_bits": pa.array(words[at])}))
    bit = bit_of("doc_id")
    marked = docs.withColumn("_word", F.shiftright(bit, 6)).join(F.broadcast(table), "_word", "left")
    told = F.coalesce(F.expr("(shiftright(_bits, int(pmod(xxhash64(doc_id), 64))) & 1) = 1"), F.lit(False))
    return marked.withColumn("version", F.when(told, F.hash("text")).otherwise(F.lit(0))).select(*docs.columns, "version")


def repeated_passages(docs: DataFrame, k: int = 5, window: int = 16, one_in: int = 5, min_words: int = 50, percent: int = 80) -> DataFrame:
    """Passages of docs (doc_id, text) that came before in a document of smaller doc_id, or earlier in their own.

    One row per passage and source, which may overlap another's: doc_id, version,
    start_word, end_word, src_doc_id, src_version, src_start_word, src_end_word,
    same_words, similarity (version: of with_version). Words are maximal runs outside ASCII white space, A-Z
    lower-cased, counted from 0; end_word is not included. Null, empty and short
    texts have none. Rows of one doc_id with different texts are documents of their
    own, in the order of version, a hash of the text; rows that agree in both are
    one document. Rows with a null doc_id are not compared; other columns are not
    read. An empty table gives an empty result.
    """
    docs = with_version(docs.where("doc_id is not null").select("doc_id", "text"))
    found = seeds(docs, k, window, one_in, max(k, min_words - window + 1))
    place = F.struct("doc_id", "version", "pos")
    first = materialize(found.groupBy("seed").agg(F.min(place).alias("lead"), F.count("*").alias("n")).where("n > 1"))
    again = materialize(with_leaders(found, first, "seed").select("doc_id", "version", "pos", "long", "lead"))
    whole = materialize(again.where("long is not null").groupBy("long").agg(F.min(place).alias("lead"), F.count("*").alias("n")).where("n > 1"))
    further = with_leaders(again.withColumnRenamed("lead", "near"), whole, "long").where("lead <> near").select("doc_id", "version", "pos", "lead")
    matches = again.select("doc_id", "version", "pos", "lead").unionByName(further).where(place != F.col("lead"))
    matches = matches.select("doc_id", "version", F.col("lead.doc_id").alias("src"), F.col("lead.version").alias("src_version"), "pos", F.col("lead.pos").alias("src_pos"))
    linked = materialize(chains(matches, k))

    wanted = linked.select("doc_id").unionByName(linked.select(F.col("src").alias("doc_id")))
    words = materialize(word_arrays(docs, wanted).dropDuplicates(["doc_id", "version"]))
    todo, out = linked.withColumn("beside", F.when(F.col("x1") - F.col("x0") < 16, NARROW).otherwise(MARGIN)), None
    while True:
        aligned = materialize(aligned_chains(todo, words, k, min_words, percent))
        last, first = W.partitionBy(*PAIR, "y1"), W.partitionBy(*PAIR, "y0")
        holds = F.size("passages") > 0
        edge = aligned.where("ahead or behind").withColumn("_last", F.max(F.when(F.col("ahead") & holds, F.col("x1"))).over(last)).withColumn("_first", F.min(F.when(F.col("behind") & holds, F.col("x0"))).over(first))
        more = ~holds | (F.col("ahead") & (F.col("x1") == F.col("_last"))) | (F.col("behind") & (F.col("x0") == F.col("_first")))
        edge = materialize(edge.withColumn("_more", more))
        done = aligned.where("not (ahead or behind)").unionByName(edge.where("not _more").select(*aligned.columns))
        out = done if out is None else out.unionByName(done)
        todo = edge.where("_more").withColumn("beside", F.col("beside") * FURTHER).select(*todo.columns)
        if todo.isEmpty():
            break
    return out.select(*PAIR, F.explode("passages").alias("p")).select(
        "doc_id", "version", "p.start_word", "p.end_word", F.col("src").alias("src_doc_id"), "src_version",
        F.col("p.src_start").alias("src_start_word"), F.col("p.src_end").alias("src_end_word"), "p.same_words",
        (F.col("p.same_words") / F.greatest(F.col("p.end_word") - F.col("p.start_word"), F.col("p.src_end") - F.col("p.src_start"))).alias("similarity"),
    )


def aligned_chains(chained: DataFrame, words: DataFrame, k: int, min_words: int, percent: int) -> DataFrame:
    """Chains (of `chains`, with beside) aligned on `beside` words on either side: their passages, and whether the words agree up to the edge.

    ahead and behind tell that the words behind and before the chain still agree
    where what was fetched ends, though both texts go on. Chains without passages
    that touch no edge are left out.
    """
    part = lambda lo, hi: F.expr(f"substring(words, int(greatest({lo} - beside, 0) * 2 + 1), int(({hi} + beside - greatest({lo} - beside, 0)) * 2))")
    own = chained.join(words, ["doc_id", "version"]).withColumn("a", part("x0", "x1")).drop("words")
    sources = words.select(F.col("doc_id").alias("src"), F.col("version").alias("src_version"), "words")
    both = own.join(sources, ["src", "src_version"]).withColumn("b", part("y0", "y1")).drop("words")
    spans = ("start_word", "end_word", "src_start", "src_end", "same_words")
    names = [*PAIR, "x0", "x1", "y0", "y1", "beside", "xs", "ys"]
    schema = ", ".join(f"{c} {chained.schema[c].dataType.simpleString()}" for c in names) + f", ahead boolean, behind boolean, passages array<struct<{', '.join(f'{c}: int' for c in spans)}>>"
    kinds = pa.list_(pa.struct([(c, pa.int32()) for c in spans]))

    def run(batches):
        for t in slices(batches, ALIGNED):
            at, ahead, behind, found = [], [], [], []
            for i, (doc, version, src, src_version, x0, x1, y0, y1, beside, xs, ys, a, b) in enumerate(zip(*[t.column(c).to_pylist() for c in range(13)])):
                ax, by = max(x0 - beside, 0), max(y0 - beside, 0)
                a, b = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
                if len(xs) == 1 and _diagonal(a, b, x0 - ax, y0 - by) * 100 < percent * min_words:
                    continue
                own = doc == src and version == src_version
                xs, ys = np.array(xs) - ax, np.array(ys) - by
                rows, before, after = blocks(a, b, xs, ys, k)
                back = min(x0 - ax, y0 - by) == beside and before + EDGE > beside
                on = min(len(a) - x1 + ax, len(b) - y1 + by) == beside and after + EDGE > beside
                got = passages(rows, min_words, percent, ax - by if own else None)
                if got or back or on:
                    at.append(i)
                    ahead.append(on)
                    behind.append(back)
                    found.append([dict(zip(spans, (lo + ax, hi + ax, slo + by, shi + by, same))) for lo, hi, slo, shi, same in got])
            kept = t.select(names).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(ahead, pa.bool_()), pa.array(behind, pa.bool_()), pa.array(found, kinds)], names=[*names, "ahead", "behind", "passages"])

    return both.select(*names, "a", "b").mapInArrow(run, schema)


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs with the passages' words (and the white space behind them) cut from text; all columns stay.

    Passages are gathered per document, which its length bounds, and cut from the
    rows of their doc_id and text. Rows without passages, null texts and null
    doc_ids included, stay as they are.
    """
    spans = passages.groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).agg(F.sort_array(F.collect_set(F.struct("start_word", "end_word"))).alias("_spans"))
    able = docs["doc_id"].isNotNull() & docs["text"].isNotNull()
    of_text = (spans["_version"] == 0) | (F.hash(docs["text"]) == spans["_version"])
    joined = docs.where(able).join(spans, (docs["doc_id"] == spans["_doc"]) & of_text, "left").drop("_doc", "_version")
    joined = joined.unionByName(docs.where(~able).withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType)))
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            spans = b.column(b.num_columns - 1).to_pylist()
            hit = [i for i, s in enumerate(spans) if s and texts[i]]
            for i in hit:
                w = next(word_blocks(pa.array([texts[i]])))
                raw, keep = texts[i].encode(), np.ones(len(w.data), bool)
                for s in spans[i]:
                    stop = len(raw) if s["end_word"] >= len(w.start) else w.start[s["end_word"]]
                    keep[w.start[s["start_word"]] : stop] = False
                texts[i] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode()
            cols = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(run, docs.schema)
