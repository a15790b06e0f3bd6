"""Repeated lines and runs of lines, by winnowing over line hashes. DataFrame functions only.

1. Lines without blanks around them are hashed; empty ones are left out of a
   document's sequence. Hashes of every two consecutive lines are its grams. The
   lesser of every two consecutive grams is a fingerprint, so any three lines that
   two documents share give the same fingerprint in both. A line of `min_chars`
   characters or more is a window, and a fingerprint, of its own.
2. Fingerprints are joined by position to the first place where they stand; those
   that stand once only go no further, and their lines are looked at no more.
3. A fingerprint of two lines that came elsewhere is extended both ways, to the
   windows of three lines that chose it. Their hashes are joined to their first
   places in turn, so a run is found although its lines came before it one by one.
4. Long lines and windows that came before are deleted, with the empty lines inside
   a window; their first occurrence stays. So a line goes if and only if it is long
   and stands further up or in an earlier document, or lies in three lines that do.
   Runs of any length are the unions of their windows, at a cost that grows with
   the number of lines alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.plans.leaders import with_leaders
from voxtab.plans.lineage import materialize

#: White space that does not count at the ends of a line.
BLANKS = " \t\r\x0b\x0c"


def line_sequences(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, version, at, hashes, long): numbers, hashes and greater lengths of the non-empty lines of each document.

    version is a hash of the text; rows that agree in doc_id and version are one document.
    """
    stripped = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    line = lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n"), F.xxhash64(x).alias("h"))
    lines = docs.where("text is not null and doc_id is not null").select("doc_id", F.hash("text").alias("version"), F.filter(F.transform(stripped, line), lambda x: x["n"] > 0).alias("l"))
    long = F.transform("l.n", lambda n: n >= min_chars)
    return lines.select("doc_id", "version", F.col("l.i").alias("at"), F.col("l.h").alias("hashes"), long.alias("long")).dropDuplicates(["doc_id", "version"])


def fingerprints(sequences: DataFrame) -> DataFrame:
    """(doc_id, version, first, last, print, windows): fingerprints with their lines, and the windows (first, last, whole) that chose each.

    A long line has no windows: it is one itself.
    """
    h, at = (lambda i: F.get("hashes", i)), (lambda i: F.get("at", i))
    gram = lambda i: F.xxhash64(h(i), h(i + 1))
    # Window i holds the lines i to i+2 and the grams i and i+1; the first of equal grams is its least.
    has = lambda i: (i >= 0) & (i + 2 < F.size("hashes"))
    window = lambda i, chosen: F.when(has(i) & chosen, F.struct(at(i).alias("first"), at(i + 2).alias("last"), F.xxhash64(h(i), h(i + 1), h(i + 2)).alias("whole")))
    chose = lambda i: F.array_compact(F.array(window(i - 1, gram(i) < gram(i - 1)), window(i, gram(i) <= gram(i + 1))))
    none = F.array().cast("array<struct<first:int,last:int,whole:bigint>>")
    runs = F.transform(F.sequence(F.lit(0), F.size("hashes") - 2), lambda i: F.struct(at(i).alias("first"), at(i + 1).alias("last"), gram(i).alias("print"), chose(i).alias("windows")))
    runs = F.when(F.size("hashes") >= 3, F.filter(runs, lambda x: F.size(x["windows"]) > 0))
    alone = F.transform("hashes", lambda x, i: F.when(F.get("long", i), F.struct(at(i).alias("first"), at(i).alias("last"), F.xxhash64(x, F.lit(1)).alias("print"), none.alias("windows"))))
    out = sequences.select("doc_id", "version", F.explode(F.concat(F.array_compact(alone), F.coalesce(runs, F.array().cast("array<struct<first:int,last:int,print:bigint,windows:array<struct<first:int,last:int,whole:bigint>>>>")))).alias("x"))
    return out.select("doc_id", "version", "x.*")


def _later(rows: DataFrame, key: str) -> DataFrame:
    """The rows (doc_id, version, first, key) that are not the first with their key, in that order."""
    place = F.struct("doc_id", "version", "first")
    leaders = materialize(rows.groupBy(key).agg(F.min(place).alias("lead"), F.count("*").alias("n")).where("n > 1"))
    return with_leaders(rows, leaders, key).withColumn("again", place != F.col("lead")).drop("lead")


def repeated_ranges(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """(doc_id, version, first, last): line ranges that repeat an earlier occurrence, single long lines and windows of three lines.

    Earlier means a smaller (doc_id, version), or the same document further up.
    Null texts, null doc_ids and texts without lines have none. Other columns are
    not read.
    """
    found = materialize(_later(materialize(fingerprints(line_sequences(docs, min_chars))), "print"))
    lines = found.where("again and size(windows) = 0").select("doc_id", "version", "first", "last")
    windows = found.select("doc_id", "version", F.explode("windows").alias("w")).select("doc_id", "version", "w.*")
    return lines.unionByName(_later(materialize(windows), "whole").where("again").select("doc_id", "version", "first", "last"))


def _ranges(lines: Column) -> Column:
    """Ascending distinct numbers as maximal ranges (first, last)."""
    ends = lambda step: F.array_except(lines, F.transform(lines, lambda i: i + step))
    return F.arrays_zip(ends(1).alias("first"), ends(-1).alias("last"))


def without_repeated_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """docs with repeated lines deleted from text, and three more columns: n_lines, n_removed, removed (line ranges).

    All rows and columns stay. A null text stays null with 0 lines; a row with a
    null doc_id loses nothing. Rows of one doc_id with different texts are documents
    of their own; rows that agree in both lose the same lines. Columns of docs that
    are named like the new ones are replaced. An empty table stays empty.
    """
    spans = repeated_ranges(docs, min_chars).groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
    spans = spans.agg(F.array_sort(F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("first", "last")), lambda r: F.sequence(r["first"], r["last"]))))).alias("_cut"))
    old = docs.drop("n_lines", "n_removed", "removed")
    able = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    joined = old.where(able).join(spans, (F.col("doc_id") == F.col("_doc")) & (F.hash("text") == F.col("_version")), "left").drop("_doc", "_version")
    joined = joined.unionByName(old.where(~able).withColumn("_cut", F.lit(None).cast("array<int>")))
    lines, cut = F.split("text", "\n"), F.col("_cut")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut), lambda i: F.get("_lines", i))
    out = joined.withColumn("_lines", F.when(cut.isNotNull(), lines)).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
    out = out.withColumn("n_removed", F.coalesce(F.size(F.when(cut.isNotNull(), cut)), F.lit(0))).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))
    text = F.when(cut.isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
    return out.withColumn("removed", F.when(cut.isNotNull(), _ranges(cut))).withColumn("text", text).select(*old.columns, "n_lines", "n_removed", "removed")
