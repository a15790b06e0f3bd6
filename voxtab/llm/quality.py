"""Quality rules with risk-controlled cutoffs.

Every text gets statistics; each rule rejects texts whose statistic exceeds a
cutoff. Per stratum, half of the labelled rows propose a ladder of joint cutoffs,
from loose to tight. Its first levels let in one rule at a time, in the order of the
bad rows that they reject, with cutoffs MARGIN candidates above the lowest one that
rejects no good row; then the margins shrink, and at last one rule after another may
reject a few good rows, up to the risk. Rules that do not reject bad rows ten times as
readily as good ones stay out. The other half, the holdout, tests the levels in that
fixed order, so they need no correction among themselves: the exact (Clopper-Pearson)
upper bound on the share of good texts that a level's rules reject together must
stay within `risk`, at a confidence divided by the number of strata (Bonferroni). The
last level before the first failure is taken; a stratum with too few good labels
gets no cutoffs. So with probability 1 - `delta`, no stratum loses more than `risk`
of its good texts to the rules.
"""

from __future__ import annotations

from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.llm.streams import slices
from voxtab.llm.words import shingles, word_blocks

#: Fixed: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A rule is used where it rejects bad rows so many times as readily as good ones.
ODDS = 10
#: Candidate cutoffs between a rule's first cutoff and the lowest one that rejects no good row.
MARGIN = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks")

_SYMBOL, _UPPER, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True


def text_counts(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id and COUNTS of every row of docs (doc_id, text), over whole texts.

    n_lines and n_dup_lines count lines with a word; n_repeat_words the words of
    `window`-word windows that occur twice or more. A null text is empty, with
    zeros. Rows with a null doc_id are counted too; other columns are not read.
    """
    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)

    def run(batches):
        for b in slices(batches, 4096):
            for w in word_blocks(b.column(1), lower=False):
                m = w.hi - w.lo
                of = lambda at: np.bincount(np.searchsorted(w.byte_first, at, "right") - 1, minlength=m)[:m]
                head = (w.data & 0xC0) != 0x80
                chars = np.concatenate([[0], np.cumsum(head)])
                word_chars = np.bincount(w.doc, chars[w.end] - chars[w.start], minlength=m).astype(np.int64)
                edges = np.unique(np.concatenate([w.byte_first, np.flatnonzero(w.data == 10) + 1]))
                lo = edges[:-1]
                hi = edges[1:] - (w.data[edges[1:] - 1] == 10) if len(lo) else edges[1:]
                has_word = np.searchsorted(w.start, hi) > np.searchsorted(w.start, lo)
                lo, hi = lo[has_word], hi[has_word]
                line_doc, line = np.searchsorted(w.byte_first, lo, "right") - 1, w.spans(lo, hi)
                order = np.lexsort((line, line_doc))
                dup = (np.diff(line_doc[order]) == 0) & (np.diff(line[order].view(np.int64)) == 0)
                dups = np.bincount(line_doc[order][1:][dup], minlength=m)
                at, h = shingles(w, window)
                order = np.lexsort((h, w.doc[at]))
                same = (np.diff(w.doc[at][order]) == 0) & (np.diff(h[order].view(np.int64)) == 0)
                twice = np.zeros(len(at), bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                cover = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(cover, at[twice], 1)
                np.add.at(cover, at[twice] + window, -1)
                repeat = np.bincount(w.doc[np.cumsum(cover)[:-1] > 0], minlength=m)
                cols = [np.diff(w.first), word_chars, of(np.flatnonzero(_SYMBOL[w.data])), dups, repeat, np.bincount(line_doc, minlength=m)]
                cols += [of(np.flatnonzero(t[w.data])) for t in (_UPPER, _LETTER, _MARK)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.lo, m), *[pa.array(c.astype(np.int64)) for c in cols]], names=["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))



def rules() -> dict[str, tuple[Column, list[float]]]:
    """The statistics and their candidate cutoffs: 40 shares, or word lengths from 4 to 23.5."""
    shares = [i / 40 for i in range(1, 41)]
    return {
        "symbols": (_share("n_symbols", "n_words"), shares),
        "dup_lines": (_share("n_dup_lines", "n_lines"), shares),
        "repeats": (_share("n_repeat_words", "n_words"), shares),
        "upper": (_share("n_upper", "n_letters"), shares),
        "marks": (_share("n_marks", "word_chars"), shares),
        "long_words": (_share("word_chars", "n_words"), [4 + i / 2 for i in range(40)]),
    }


def _log_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) for X binomial of n and p."""
    i = np.arange(k + 1)
    terms = lgamma(n + 1) - np.array([lgamma(x + 1) + lgamma(n - x + 1) for x in i]) + i * log(p) + (n - i) * np.log1p(-p)
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum()))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest share p for which k or fewer of n are not too unlikely (probability delta)."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if mid in (0.0, 1.0) or mid <= lo:
            break
        lo, hi = (mid, hi) if _log_tail(k, n, mid) > log(delta) else (lo, mid)
    return hi


def _count(cuts: list[float], holds) -> Column:
    """The number of cutoffs for which a comparison holds."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: holds(c)))


def ladder(over: dict[str, tuple[np.ndarray, np.ndarray]], risk: float, margin: int = MARGIN) -> dict[str, list[float]]:
    """Per rule its cutoffs at every level, from loose to tight (infinite where it rejects nothing).

    over: per rule the good and the bad rows with so many cutoffs below their
    statistic. Every level lowers the cutoff of one rule. Without bad rows, or where
    no rule tells them from good ones, there are no levels.
    """
    cuts = {r: c for r, (_, c) in rules().items()}
    beyond = {r: [x.sum() - np.cumsum(x)[:-1] for x in pair] for r, pair in over.items()}  # good and bad rows above cutoff i
    good = max((int(pair[0].sum()) for pair in over.values()), default=0)
    able = {r: b[1] / max(1, over[r][1].sum()) >= ODDS * (b[0] + 1) / (good + 1) for r, b in beyond.items()}
    now, out, at = {r: np.inf for r in over}, {r: [] for r in over}, {r: len(cuts[r]) for r in over}

    def lower(r: str, i: int) -> None:
        now[r], at[r] = float(cuts[r][i]), i
        for k, held in out.items():
            held.append(now[k])

    def lowest(r: str, allowed: int) -> int | None:
        fits = np.flatnonzero(able[r] & (beyond[r][0] <= allowed))
        return int(fits[0]) if len(fits) else None

    gained = lambda r, i: int(beyond[r][1][i]) - (int(beyond[r][1][at[r]]) if at[r] < len(cuts[r]) else 0)
    clean = {r: i for r in over if (i := lowest(r, 0)) is not None}
    for step in range(margin, -1, -1):
        for r in sorted((r for r, i in clean.items() if i + step < len(cuts[r]) and able[r][i + step]), key=lambda r: (-beyond[r][1][clean[r] + step], r)):
            if clean[r] + step < at[r]:
                lower(r, clean[r] + step)
    allowed, left = {r: 0 for r in over}, int(risk * good)
    while left > 0:
        found = [(-gained(r, i) / more, more, r, i) for r in over for more in range(1, left + 1) if (i := lowest(r, allowed[r] + more)) is not None and i < at[r] and gained(r, i) > 0]
        if not found:
            break
        _, more, r, i = min(found)
        allowed[r] += more
        left -= more
        lower(r, i)
    return out


def choose_cutoffs(labelled: DataFrame, risk: float = 0.03, delta: float = 0.05) -> list[tuple[str, str, float]]:
    """(stratum, rule, cutoff) from labelled rows with doc_id, COUNTS, stratum and good (boolean).

    Rows are dealt to the two halves by a hash of doc_id. Only counts per stratum,
    rule and candidate, and per stratum and level, reach the driver. Rows with a
    null in good or doc_id are left out. Without rows there are no cutoffs.
    """
    table = rules()
    labelled = labelled.where("good is not null and doc_id is not null").withColumn("_holdout", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 1)
    bins = [F.struct(F.lit(r).alias("rule"), _count(cuts, stat.__gt__).alias("bin")) for r, (stat, cuts) in table.items()]
    exploded = labelled.where("not _holdout").select("stratum", "good", F.explode(F.array(*bins)).alias("x"))
    counts: dict[str, dict] = {}
    for r in exploded.groupBy("stratum", "good", "x.rule", "x.bin").agg(F.count("*").alias("n")).collect():
        over = counts.setdefault(r["stratum"], {k: (np.zeros(len(c) + 1, np.int64), np.zeros(len(c) + 1, np.int64)) for k, (_, c) in table.items()})
        over[r["rule"]][0 if r["good"] else 1][r["bin"]] += r["n"]
    if not counts:
        return []
    ladders = {s: ladder(over, risk) for s, over in sorted(counts.items())}
    levels = max(len(next(iter(steps.values()))) for steps in ladders.values())
    ladders = {s: {r: held + held[-1:] * (levels - len(held)) for r, held in steps.items()} for s, steps in ladders.items()}
    ladders = {s: steps for s, steps in ladders.items() if steps and len(next(iter(steps.values()))) == levels > 0}
    if not ladders:
        return []
    # The first level that rejects a row: levels whose cutoff its statistic does not exceed come before it.
    first = []
    for rule, (stat, _) in table.items():
        first.append(F.coalesce(*[F.when(F.col("stratum") == s, _count(steps[rule], stat.__le__)) for s, steps in ladders.items()], F.lit(levels)))
    tested = labelled.where("_holdout and good").select("stratum", F.least(*first).alias("level")).groupBy("stratum", "level").agg(F.count("*").alias("n")).collect()
    out = []
    for s, steps in ladders.items():
        at = np.zeros(levels + 1, np.int64)
        for r in tested:
            if r["stratum"] == s:
                at[r["level"]] += r["n"]
        n, passed = int(at.sum()), -1
        for level, k in enumerate(np.cumsum(at)[:levels].tolist()):
            if k > n * risk or upper_bound(k, n, delta / len(ladders)) > risk:
                break
            passed = level
        if passed >= 0:
            out += [(s, rule, cuts[passed]) for rule, cuts in steps.items() if cuts[passed] < np.inf]
    return out


def base_failed() -> Column:
    """The fixed rule before all others: under 20 words, or over 30 percent of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(counted: DataFrame, cutoffs: list[tuple[str, str, float]]) -> DataFrame:
    """Adds base_failed, failed_rules (array) and kept to rows with COUNTS and stratum."""
    by = {}
    for s, rule, cut in cutoffs:
        by.setdefault(rule, []).append((s, cut))
    failed = []
    for rule, (stat, _) in rules().items():
        cut = F.coalesce(*[F.when(F.col("stratum") == s, F.lit(c)) for s, c in by.get(rule, [])], F.lit(None).cast("double"))
        failed.append(F.when(stat > cut, F.lit(rule)))
    out = counted.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.array_compact(F.array(*failed)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
