"""Similarity join of documents on their sets of word shingles, by rare-first prefix filtering.

1. Documents of equal sets become one class; shingle counts over all documents go
   into a table of hashed counters of fixed size, which orders shingles rare first.
2. Each class gives the rarest n - ceil(t n) + 1 shingles of its set; two linked
   classes share one of them. Length and position of a shared shingle bound the
   overlap, parities of the set's parts (a suffix filter) bound its difference,
   and what is left is verified on the whole sets, once per pair.
3. Groups of copies would give all their pairs, so links are found in rounds: every
   class is held against the leader that it shares most tokens with, then against
   all leaders of its prefix groups, then against the class before it in each, and
   only pairs that are still in different components are compared in the last
   round, large groups in pairs of blocks. Pairs within a component cannot change
   the components, so no link that matters is lost, and no cap is needed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.llm.bitmap import bit_of, has_bits, id_bitmap
from voxtab.llm.streams import slices
from voxtab.llm.words import U, same_bits, set_keys, shingle_sets, word_blocks
from voxtab.plans.graph import connected_components
from voxtab.plans.leaders import with_leaders
from voxtab.plans.lineage import materialize

COUNTERS = 1 << 20
PART = 1 << 12
PARITY_WORDS = 8
#: Rows of a block of a group whose pairs are compared.
SPLIT = 2048


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> U(44)).astype(np.int64)


def _parities(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """PARITY_WORDS words per set: bit b says whether an odd number of its shingles fall into part b.

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    m, bits = len(first) - 1, 64 * PARITY_WORDS
    part = np.repeat(np.arange(m), np.diff(first)) * bits + (h & U(bits - 1)).astype(np.int64)
    odd = (np.bincount(part, minlength=m * bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: one row per row of docs (doc_id, version, size, key, parity); kind 1: blocks of shingle counters of a task."""
    schema = "kind int, doc_id bigint, version int, size int, key bigint, parity array<bigint>, block int, counts binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        counters = np.zeros(COUNTERS, np.uint32)
        for b in slices(batches, 4096):
            ids, versions, col = b.columns
            for w in word_blocks(col):
                first, h = shingle_sets(w, n)
                counters += np.bincount(_bucket(h), minlength=COUNTERS).astype(np.uint32)
                m = w.hi - w.lo
                lists = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * PARITY_WORDS), pa.array(_parities(first, h)))
                cols = [pa.array(np.zeros(m, np.int32)), ids.slice(w.lo, m), versions.slice(w.lo, m), pa.array(np.diff(first).astype(np.int32)), pa.array(same_bits(set_keys(first, h))), lists, pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        used = [k for k in range(COUNTERS // PART) if counters[k * PART : (k + 1) * PART].any()]
        blocks = [zlib.compress(counters[k * PART : (k + 1) * PART].tobytes(), 1) for k in used]
        m = len(used)
        cols = [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.int64())), pa.array(used, pa.int32()), pa.array(blocks, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "version", "text").mapInArrow(run, schema)


def shingle_counters(signs: DataFrame) -> np.ndarray:
    """The hashed shingle counts of all documents: COUNTERS numbers, summed in tasks that hold one block at a time."""

    def add(batches):
        held, total = None, None
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block != held:
                    if held is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([held], pa.int32()), "counts": [total.tobytes()]})
                    held, total = block, np.zeros(PART, np.int64)
                total += np.frombuffer(zlib.decompress(data), np.uint32)
        if held is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([held], pa.int32()), "counts": [total.tobytes()]})

    blocks = signs.where("kind = 1").select("block", "counts").repartition("block").sortWithinPartitions("block")
    out = np.zeros(COUNTERS, np.int64)
    for r in blocks.mapInArrow(add, "block int, counts binary").collect():
        out[r["block"] * PART : (r["block"] + 1) * PART] = np.frombuffer(r["counts"], np.int64)
    return out


def prefixes(docs: DataFrame, n: int, percent: int, counters: np.ndarray) -> DataFrame:
    """(token, key, size, pos): the prefix of each set in rare-first order, once per task however many copies it has."""
    # COUNTERS numbers, whatever the input; counts beyond 31 bits are as common as common gets.
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counters, (1 << 31) - 1).astype(np.int32))

    def run(batches):
        given: set[int] = set()
        for b in slices(batches, 4096):
            for w in word_blocks(b.column(0)):
                first, h = shingle_sets(w, n)
                keys, size = set_keys(first, h), np.diff(first)
                new = np.zeros(len(size), bool)
                new[np.unique(keys, return_index=True)[1]] = True
                new &= ~np.array([k in given for k in keys.tolist()], bool)
                given.update(keys[new].tolist())
                doc = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((h, shared.value[_bucket(h)], doc))
                pos = np.arange(len(h)) - np.repeat(first[:-1], size)
                length = size - -(-percent * size // 100) + 1
                keep = (pos < length[doc]) & new[doc]
                doc = doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(same_bits(h[order][keep])), pa.array(same_bits(keys)[doc]), pa.array(size[doc].astype(np.int32)), pa.array(pos[keep].astype(np.int32))],
                    names=["token", "key", "size", "pos"],
                )

    return docs.select("text").mapInArrow(run, "token bigint, key bigint, size int, pos int")


GROUPS = "token bigint, key bigint, size int, pos int, lo_key bigint, lo_size int, lo_pos int, hi_key bigint, hi_size int, hi_pos int"


def prefix_groups(prefix: DataFrame) -> DataFrame:
    """Rows of GROUPS: tokens of two classes or more, each row with the group's first class (lo) and the one before it (hi).

    Within a group rows go by position: the first class is the one with the
    fewest rarer shingles, so the nearest to all others. It has itself as lo and
    no hi. Rows come sorted, so a task holds one batch, whatever the size of a group.
    """
    names = [f.split()[0] for f in GROUPS.split(", ")]

    def run(batches):
        last = lead = None  # the row before, and the first row of its group
        pending = False  # whether that row is such a first row, not yet given
        for b in batches:
            if not b.num_rows:
                continue
            cols = np.stack([b.column(c).to_numpy().astype(np.int64) for c in range(4)])
            if last is None:
                last = lead = np.array([~cols[0, 0], 0, 0, 0])  # another token than the first
            cols = np.concatenate([last[:, None], cols], 1)
            fresh = np.ones(cols.shape[1], bool)
            fresh[1:] = (cols[0, 1:] != cols[0, :-1]) | (cols[1, 1:] != cols[1, :-1])
            cols = cols[:, fresh]
            n = cols.shape[1]
            begins = np.ones(n, bool)
            begins[1:] = cols[0, 1:] != cols[0, :-1]
            begins[0] = pending
            start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            heads = cols[:, start].copy()
            heads[:, start == 0] = lead[:, None]
            member = np.arange(n) > 0
            member[1:] &= cols[0, 1:] == cols[0, :-1]
            first = begins.copy()
            first[:-1] &= member[1:]
            first[-1] = False
            out = []
            for pick, low, high in ((first, cols, None), (member, heads, np.roll(cols, 1, 1))):
                m = int(pick.sum())
                part = [*cols[:, pick], *low[1:, pick]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                arrays = [pa.array(x).cast(k) for x, k in zip(part, kinds)]
                arrays += [pa.nulls(m, k) for k in kinds[4:]] if high is None else [pa.array(x).cast(k) for x, k in zip(high[1:, pick], kinds[4:])]
                out.append(pa.RecordBatch.from_arrays(arrays, names=names))
            yield from out
            last, lead, pending = cols[:, -1].copy(), heads[:, -1].copy(), bool(begins[-1])

    dealt = prefix.repartition("token").sortWithinPartitions("token", "pos", "key")
    return dealt.select("token", "key", "size", "pos").mapInArrow(run, GROUPS)


def whole_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(key, shingles) of the classes of wanted (doc_id, key), and perhaps of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(id_bitmap(wanted, "doc_id"))

    def run(batches):
        for b in slices(batches, 4096):
            b = b.filter(pa.array(has_bits(shared.value, b.column(2).to_numpy())))
            for w in word_blocks(b.column(1)):
                first, h = shingle_sets(w, n)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(same_bits(h)))
                yield pa.RecordBatch.from_arrays([pa.array(same_bits(set_keys(first, h))), lists], names=["key", "shingles"])

    return docs.select("doc_id", "text", bit_of("doc_id").alias("bit")).mapInArrow(run, "key bigint, shingles array<bigint>").dropDuplicates(["key"])


def _bounded(a: str, b: str, percent: int):
    """Length and positional filters between two sides of a prefix group, and the least overlap of a link."""
    na, nb = F.col(f"{a}size"), F.col(f"{b}size")
    rest = 1 + F.least(na - F.col(f"{a}pos"), nb - F.col(f"{b}pos")) - 1
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (rest * (100 + percent) >= (na + nb) * percent)


def _split_groups(rows: DataFrame) -> DataFrame:
    """rows (token, key, ...) with `part`: the pairs of blocks of their group that a row belongs to, one pair if the group is small.

    The blocks of a group are dealt by key and hold SPLIT rows or so each. A row of
    block i goes to the pairs {i, j} of all blocks j, so any two rows of a group
    meet in one pair of blocks (if their blocks differ) or in the pair {i, i}.
    """
    size = rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)
    size = materialize(size.withColumn("many", (F.col("n") / SPLIT).cast("int") + 1))
    large = with_leaders(rows.withColumn("_token", F.col("token")), size.withColumnRenamed("token", "_token"), "_token").withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.col("many")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumn("inner", F.col("own") == F.col("other"))
    large = large.withColumn("part", F.least("own", "other") * F.col("many") + F.greatest("own", "other"))
    small = rows.join(size, "token", "left_anti").select("*", F.lit(0).alias("own"), F.lit(True).alias("inner"), F.lit(0).alias("part"))
    return small.unionByName(large.drop("many", "other"))


def _united(comp: DataFrame | None, found: DataFrame) -> DataFrame:
    """(key, comp) of all keys with links, after the links (a, b, a_comp, b_comp) that were found between components."""
    joined = connected_components(found, "a_comp", "b_comp")
    if comp is None:
        return joined.select(F.col("node").alias("key"), F.col("component").alias("comp"))
    moved = comp.join(joined, comp["comp"] == joined["node"], "left").select("key", F.coalesce("component", "comp").alias("comp"))
    fresh = joined.join(comp.select(F.col("key").alias("node")), "node", "left_anti").select(F.col("node").alias("key"), F.col("component").alias("comp"))
    return moved.unionByName(fresh)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, version, n_shingles, component_id, leads) of every row of docs (doc_id, text).

    Two documents link when 100 * intersection >= percent * union of their
    sets of n-word shingles (lower-cased A-Z; a text of fewer words is one
    shingle). component_id is the smallest doc_id reachable by links; leads says
    that the row has the least (doc_id, version) of its component, version being a
    hash of its text. Null texts and texts without words have empty sets and link
    with nothing. Repeated rows are kept; rows of one doc_id with different texts
    are documents of their own; rows with a null doc_id are not compared and have a
    null component_id. Other columns are not read. Shingles are compared by 64-bit
    hashes.
    """
    docs = docs.select("doc_id", F.hash("text").alias("version"), "text")
    signs = materialize(signatures(docs, n))
    docs = docs.where("doc_id is not null")
    sig = signs.where("kind = 0").select("doc_id", "version", "size", "key", "parity")
    # Every row of a class has the same set; the first stands for it.
    able = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    alike = sig.where(able).groupBy("key").agg(F.min(F.struct("doc_id", "version", "size", "parity")).alias("r"), F.count("*").alias("n"))
    about = materialize(alike.select("key", "r.*", "n"))

    prefix = prefixes(docs, n, percent, shingle_counters(signs))
    groups = materialize(prefix_groups(prefix))

    tried = comp = None
    for leader in ("best", "lo", "hi", None):
        rows = groups
        if comp is not None:
            rows = rows.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
            spread = rows.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token")
            rows = rows.join(spread, "token", "left_semi")
        else:
            rows = rows.withColumn("comp", F.col("key"))
        if leader:
            end = "lo" if leader == "best" else leader
            pairs = rows.where(F.col("key") != F.col(f"{end}_key")).where(_bounded("", f"{end}_", percent))
            if comp is not None:
                heads = comp.select(F.col("key").alias(f"{end}_key"), F.col("comp").alias("head"))
                pairs = pairs.join(heads, f"{end}_key", "left").where(F.col("comp") != F.coalesce("head", f"{end}_key"))
            if leader == "best":
                counted = pairs.groupBy("key", "lo_key").agg(F.count("*").alias("n"))
                pairs = counted.groupBy("key").agg(F.max(F.struct("n", "lo_key"))["lo_key"].alias("lo_key"))
            pairs = pairs.select(F.least("key", f"{end}_key").alias("a"), F.greatest("key", f"{end}_key").alias("b"))
        else:
            rows = rows.select("token", "key", "size", "pos", "comp").join(about.select("key", "parity"), "key")
            rows = materialize(_split_groups(materialize(rows)))
            left, right = (rows.select("token", "part", *[F.col(c).alias(f"{x}_{c}") for c in ("own", "inner", "key", "size", "pos", "comp", "parity")]) for x in "ab")
            meet = (left["token"] == right["token"]) & (left["part"] == right["part"]) & (F.col("a_comp") != F.col("b_comp"))
            # Rows of one block meet in the pair of their block with itself only.
            meet &= (F.col("a_own") < F.col("b_own")) | ((F.col("a_own") == F.col("b_own")) & F.col("a_inner") & (F.col("a_key") < F.col("b_key")))
            meet &= _bounded("a_", "b_", percent) & _near("a_parity", "b_parity", "a_size", "b_size", percent)
            pairs = left.join(right, meet).select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"))
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialize(_suffix_filter(pairs, about, percent) if leader else pairs)
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = _verified(pairs, docs, about, n, percent)
        for x in "ab":
            found = found.withColumn(f"{x}_comp", F.col(x)) if comp is None else found.join(comp.select(F.col("key").alias(x), F.col("comp").alias("c")), x, "left").withColumn(f"{x}_comp", F.coalesce("c", x)).drop("c")
        comp = materialize(_united(comp, found))

    whole = about.select("key", "doc_id", "version", "n")
    whole = whole.withColumn("comp", F.col("key")) if comp is None else whole.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = whole.groupBy("comp").agg(F.min(F.struct("doc_id", "version")).alias("least"))
    component = materialize(whole.join(least, "comp").select("key", "least", "n"))
    out = with_leaders(sig.where(able).select("doc_id", "version", "size", "key"), component, "key")
    rest = sig.where(~able | F.col("doc_id").isNull()).select("doc_id", "version", "size", F.struct("doc_id", "version").alias("least"))
    out, leads = out.unionByName(rest), F.col("doc_id").isNull() | (F.col("least") == F.struct("doc_id", "version"))
    return out.select("doc_id", "version", F.col("size").cast("bigint").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), leads.alias("leads"))


def _near(pa_: str, pb: str, na: str, nb: str, percent: int):
    """Whether two sets may differ little enough for a link, by the parities of their parts."""
    bits = sum((F.bit_count(F.get(pa_, F.lit(i)).bitwiseXOR(F.get(pb, F.lit(i)))) for i in range(1, PARITY_WORDS)), F.bit_count(F.get(pa_, F.lit(0)).bitwiseXOR(F.get(pb, F.lit(0)))))
    return bits * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def _suffix_filter(pairs: DataFrame, about: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets may be near enough, by their parities."""
    side = lambda x: about.select(F.col("key").alias(x), F.col("size").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_near("pa", "pb", "na", "nb", percent)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, about: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs that link, by the intersection of their whole sets."""
    keys = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = whole_sets(docs, n, about.join(keys, "key", "left_semi").select("doc_id"))
    side = lambda x: sets.select(F.col("key").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.col("common") * (100 + percent) >= (F.size("sa") + F.size("sb")) * percent).select("a", "b")
