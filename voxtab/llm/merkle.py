"""A Merkle manifest of documents: a root over all sources, and a proof for every row.

1. Rows with the same source and doc_id become one id with a count; the ids of a
   source are merged into compressed bitmaps of 2^16 ids each (sorted 16-bit numbers
   while those are smaller), beside the counts of ids that stand more than once.
2. A directory holds, per bitmap, the rows of its source before it. A row's place
   among the leaves is a rank query: the directory's entry, and the population
   count of the bits below its own, by a directory of the bitmap's words. Nothing is
   sorted by doc_id but the directory's entries, one per bitmap.
3. Nodes are put by key into slot arrays of ARITY^LEVELS places, one task reducing
   LEVELS levels of one array, so that two or three rounds reach the root of any table.
4. Back down the same arrays every node gets the siblings on its way to the root;
   at the leaves these become proofs, and the root is folded from them again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtab.llm.streams import give_back
from voxtab.plans.leaders import with_leaders
from voxtab.plans.lineage import materialize
from voxtab.plans.totals import running_total

ARITY, LEVELS = 3, 7
#: Ids of one bitmap, and the most of them that are kept as numbers.
BITS, FEW = 1 << 16, 1 << 12
#: The high part that stands for a null doc_id, which comes before all others.
NO_ID = -(1 << 62)
#: Rows of one text and id are spread in groups of so many.
COPIES = 4096


def field(c: Column) -> Column:
    """A value's part of a leaf: `-` for a null, else its number of UTF-8 bytes, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(skey, doc_id, leaf, other): the leaf of each row of docs (doc_id, source, lang, n_chars, text), and what it is without the line feeds of tampered rows' text.

    skey is the source behind an `s`, empty for a null one, so it is never null and
    sorts as sources do.
    """
    digest = lambda text: F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)
    changed = F.coalesce(tampered & F.contains("text", F.lit("\n")), F.lit(False))
    leaf = digest(F.col("text"))
    other = F.when(changed, digest(F.replace("text", F.lit("\n"), F.lit(""))))
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select(skey.alias("skey"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf.alias("leaf"), other.alias("other"))


def _high(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.shiftright(doc_id, 16), F.lit(NO_ID))


def pack_bits(low: np.ndarray) -> bytes:
    """Distinct numbers below BITS, ascending, as 16-bit numbers or as a bitmap, whichever is smaller."""
    if len(low) < FEW:
        return low.astype("<u2").tobytes()
    bits = np.zeros(BITS, bool)
    bits[low] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(raw: bytes) -> np.ndarray:
    """The numbers of pack_bits."""
    if len(raw) < BITS // 8:
        return np.frombuffer(raw, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little"))


def ranks(raw: bytes, low: np.ndarray) -> np.ndarray:
    """How many numbers of a packed bitmap are below each of `low`."""
    if len(raw) < BITS // 8:
        return np.searchsorted(np.frombuffer(raw, "<u2"), low)
    words = np.frombuffer(raw, "<u8")
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    below = words[low >> 6] & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
    return directory[low >> 6] + np.bitwise_count(below)


def bitmaps(ids: DataFrame) -> DataFrame:
    """(skey, high, bits, repeated, extra, total) of ids (skey, doc_id, n): a bitmap per source and high part of its ids.

    repeated and extra are the low parts of ids with more rows than one and what
    they have more; total is the bitmap's rows. Every task packs what it has of a
    bitmap, and the parts are merged.
    """
    schema = "skey string, high bigint, bits binary, repeated array<int>, extra array<bigint>, total bigint"
    kinds = pa.schema([("skey", pa.string()), ("high", pa.int64()), ("bits", pa.binary()), ("repeated", pa.list_(pa.int32())), ("extra", pa.list_(pa.int64())), ("total", pa.int64())])

    def part(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]).sort_by([("skey", "ascending"), ("high", "ascending"), ("low", "ascending")])
            source = t.column("skey").combine_chunks().dictionary_encode().indices.to_numpy()
            high, low, n = (t.column(c).to_numpy() for c in ("high", "low", "n"))
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(source) != 0) | (np.diff(high) != 0)]))
            rows = []
            for lo, hi in zip(starts, [*starts[1:], len(low)]):
                more = np.flatnonzero(n[lo:hi] > 1) + lo
                rows.append((pack_bits(low[lo:hi]), low[more].astype(np.int32), n[more] - 1, int(n[lo:hi].sum())))
            cols = [t.column("skey").take(pa.array(starts)), pa.array(high[starts]), *[pa.array(v, f.type) for v, f in zip(zip(*rows), list(kinds)[2:])]]
            yield from pa.Table.from_arrays([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in cols], schema=kinds).to_batches()

    def merge(t: pa.Table) -> pa.Table:
        if t.num_rows == 1:
            return t
        low = np.unique(np.concatenate([unpack_bits(raw) for raw in t.column("bits").to_pylist()]))
        extra = dict(zip(np.concatenate([np.array(x, np.int64) for x in t.column("repeated").to_pylist()]).tolist(), np.concatenate([np.array(x, np.int64) for x in t.column("extra").to_pylist()]).tolist()))
        keys = sorted(extra)
        row = [t.column("skey")[0].as_py(), t.column("high")[0].as_py(), pack_bits(low), keys, [extra[x] for x in keys], sum(t.column("total").to_pylist())]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, kinds)], schema=kinds)

    low = F.coalesce(F.col("doc_id").bitwiseAND(BITS - 1), F.lit(0)).cast("int")
    packed = ids.select("skey", _high().alias("high"), low.alias("low"), "n").mapInArrow(part, schema)
    return packed.groupBy("skey", "high").applyInArrow(merge, schema)


def placed(ids: DataFrame) -> DataFrame:
    """ids (skey, doc_id, n, ...; one row per source and id) with pos, the rows of the source before them, and size, all its rows."""
    maps = materialize(bitmaps(ids))
    sizes = maps.groupBy("skey").agg(F.sum("total").alias("size"))
    directory = materialize(running_total(maps, "skey", ["high"], "total").join(sizes, "skey"))
    rows = ids.withColumn("high", _high())

    def query(own: pa.Table, entry: pa.Table) -> pa.Table:
        e = entry.to_pylist()[0]
        low = own.column("doc_id").to_numpy() & (BITS - 1) if e["high"] != NO_ID else np.zeros(own.num_rows, np.int64)
        more = np.concatenate([[0], np.cumsum(np.array(e["extra"], np.int64))])
        pos = e["before"] + ranks(e["bits"], low) + more[np.searchsorted(np.array(e["repeated"], np.int64), low)]
        own = own.drop_columns(["high"])
        give_back()
        return own.append_column("pos", pa.array(pos.astype(np.int64))).append_column("size", pa.array(np.full(len(pos), e["size"], np.int64)))

    schema = ", ".join(f"{c} {t}" for c, t in [*ids.dtypes, ("pos", "bigint"), ("size", "bigint")])
    return rows.groupBy("skey", "high").cogroup(directory.groupBy("skey", "high")).applyInArrow(query, schema)


def leaf_nodes(docs: DataFrame, tampered: Column, copies: int = COPIES) -> DataFrame:
    """(skey, pos, size, doc_id, digest, other) of every row: its place among its source's leaves, ascending by doc_id, nulls first, then by leaf."""
    each = leaves(docs, tampered)
    ids = materialize(each.groupBy("skey", "doc_id").agg(F.count("*").alias("n"), F.min("leaf").alias("digest"), F.max("leaf").alias("_last"), F.min("other").alias("other")))
    at = materialize(placed(ids))
    rows = at.where("digest = _last").select("skey", "pos", "size", "doc_id", "digest", "other", "n")
    mixed = at.where("digest <> _last").withColumn("_group", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "skey"), 256))
    if not mixed.isEmpty():  # ids of several texts: their leaves in order
        of = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "skey"), 256)
        met = with_leaders(each.withColumn("_group", of).withColumn("_of", F.col("_group")), materialize(mixed.select("_group", "n", "pos", "size")), "_group")
        texts = met.groupBy(F.col("_of").alias("_group"), "leaf").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("skey", "doc_id", "other", "pos", "size")])
        ordered = running_total(texts, "_group", ["leaf"], "n")
        rows = rows.unionByName(ordered.select("skey", (F.col("pos") + F.col("before")).alias("pos"), "size", "doc_id", F.col("leaf").alias("digest"), "other", "n"))
    # Copies take the places behind each other; groups of many are spread over tasks first.
    single, many = rows.where("n = 1").drop("n"), materialize(rows.where("n > 1"))
    if many.isEmpty():
        return single
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(copies).cast("bigint")))
    spread = many.withColumn("_from", starts).repartition("skey", "pos", "_from")
    copy = F.explode(F.sequence(F.col("_from"), F.least(F.col("n"), F.col("_from") + copies) - 1))
    return single.unionByName(spread.withColumn("_copy", copy).withColumn("pos", F.col("pos") + F.col("_copy")).select(*single.columns))


def reduce_slots(slots: list[str], levels: int) -> list[list[str]]:
    """Every level above the slots: each ARITY consecutive nodes become the SHA-256 of their digests' text."""
    out = [slots]
    for _ in range(levels):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(low), ARITY)])
    return out


def _levels(size: int, most: int) -> int:
    """Levels of an array of a group with `size` nodes: until one node is left, `most` at most."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def _array(t: pa.Table, levels: int) -> tuple[list[int], list[list[str]]]:
    """The slot of each node of one array, and the array's nodes by slot with all levels above them."""
    place = (t.column("pos").to_numpy() % ARITY**levels).tolist()
    slots = [""] * t.num_rows
    for p, d in zip(place, t.column("digest").to_pylist()):
        slots[p] = d
    return place, reduce_slots(slots, _levels(t.column("size")[0].as_py(), levels))


def _block(nodes: DataFrame, levels: int):
    """Nodes grouped by the array that they are in."""
    return nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels)).groupBy("skey", "block")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables (skey, pos, size, digest) of nodes, round by round, each a written table; the last holds one node per skey."""
    rounds = [nodes]
    schema = "skey string, pos bigint, size bigint, digest string"
    out = pa.schema([("skey", pa.string()), ("pos", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])

    def up(t: pa.Table) -> pa.Table:
        span = ARITY**levels
        row = [t.column("skey")[0].as_py(), t.column("pos")[0].as_py() // span, -(-t.column("size")[0].as_py() // span), _array(t, levels)[1][-1][0]]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, out)], schema=out)

    while True:
        largest = rounds[-1].agg(F.max("size")).first()[0] or 0
        if largest <= 1 and len(rounds) > 1:
            return rounds
        rounds.append(materialize(_block(rounds[-1].select("skey", "pos", "size", "digest"), levels).applyInArrow(up, schema)))


#: The siblings on the way from a node to the root, and the subroot passed: lists of what stands left and right of it, level by level.
PATH = "subroot string, lefts array<string>, rights array<string>"


def _way(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """For slot i of the lowest level, the siblings to its left and right at each level."""
    lefts, rights = [], []
    for level in levels[:-1]:
        lo = i // ARITY * ARITY
        lefts.append("".join(level[lo:i]))
        rights.append("".join(level[i + 1 : lo + ARITY]))
        i //= ARITY
    return lefts, rights


def descend(rounds: list[DataFrame], ways: DataFrame, levels: int) -> DataFrame:
    """(skey, pos, PATH) of the nodes of the second round from ways of the last one's (skey, pos, PATH); see prove for the first round's."""
    out = pa.schema([("skey", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))])

    def down(own: pa.Table, way: pa.Table) -> pa.Table:
        w = way.to_pylist()[0]
        place, tree = _array(own, levels)
        inner = [_way(tree, p) for p in place]
        cols = [[w["skey"]] * len(place), own.column("pos").to_pylist(), [w["subroot"]] * len(place), [a + w["lefts"] for a, _ in inner], [b + w["rights"] for _, b in inner]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(cols, out)], schema=out)

    for nodes in reversed(rounds[1:-1]):
        ways = materialize(_block(nodes, levels).cogroup(ways.withColumn("block", F.col("pos")).groupBy("skey", "block")).applyInArrow(down, f"skey string, pos bigint, {PATH}"))
    return ways


def prove(nodes: DataFrame, ways: DataFrame, root: str, levels: int) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf node."""
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    kinds = pa.schema([(n, pa.int64() if n == "doc_id" else pa.bool_() if n == "verified" else pa.string()) for n in names])

    def leaf(own: pa.Table, way: pa.Table) -> pa.Table:
        w = way.to_pylist()[0]
        place, tree = _array(own, levels)
        digests, others = own.column("digest").to_pylist(), own.column("other").to_pylist()
        proofs, folded = [], []
        for p, digest, other in zip(place, digests, others):
            lefts, rights = _way(tree, p)
            lefts, rights = lefts + w["lefts"], rights + w["rights"]
            proofs.append(hashlib.sha256("".join(a + b for a, b in zip(lefts, rights)).encode()).hexdigest())
            node = other or digest
            for a, b in zip(lefts, rights):
                node = hashlib.sha256((a + node + b).encode()).hexdigest()
            folded.append(node)
        n = len(place)
        give_back()
        cols = [own.column("doc_id").to_pylist(), digests, [w["subroot"]] * n, [root] * n, proofs, folded, [f == root for f in folded]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(cols, kinds)], schema=kinds)

    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _block(nodes, levels).cogroup(ways.withColumn("block", F.col("pos")).groupBy("skey", "block")).applyInArrow(leaf, schema)


def manifest(docs: DataFrame, tampered: Column, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs (doc_id, source, lang, n_chars, text), as `prove` returns: its leaf, its source's subroot, the root, and what its proof gives.

    Nulls are values of their own: a null source is the first one, null doc_ids come
    first in theirs. Rows of one source and doc_id go by their leaves; equal rows
    take places behind each other. A lone leaf is its source's subroot, a lone
    subroot the root. tampered rows (a null is false) are folded from the leaf they
    would have without their text's line feeds. A task reduces `levels` levels. Other columns are not read. An empty
    table gives an empty result.
    """
    nodes = materialize(leaf_nodes(docs, tampered))
    rounds = climb(nodes, levels)
    tops = rounds[-1].select("skey", F.lit("").alias("all"), F.col("digest").alias("subroot"), F.lit(1).cast("bigint").alias("n"))
    ordered = running_total(tops, "all", ["skey"], "n")
    count = ordered.count()
    roots = materialize(ordered.select(F.col("all").alias("skey"), F.col("before").alias("pos"), F.lit(count).cast("bigint").alias("size"), F.col("subroot").alias("digest"), F.col("skey").alias("source")))
    above = climb(roots, levels)
    root = next((r["digest"] for r in above[-1].collect()), "")  # one node
    none = F.array().cast("array<string>")
    top = above[-1].select("skey", "pos", F.lit("").alias("subroot"), none.alias("lefts"), none.alias("rights"))
    return prove(nodes, descend(rounds, _ways_of_sources(roots, descend(above, top, levels), levels), levels), root, levels)


def _ways_of_sources(roots: DataFrame, ways: DataFrame, levels: int) -> DataFrame:
    """(skey, pos, PATH) of every source's only top node, pos 0: the ways of the subroots among all sources."""
    out = pa.schema([("skey", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))])

    def down(own: pa.Table, way: pa.Table) -> pa.Table:
        w = way.to_pylist()[0]
        place, tree = _array(own, levels)
        inner = [_way(tree, p) for p in place]
        cols = [own.column("source").to_pylist(), [0] * len(place), own.column("digest").to_pylist(), [a + w["lefts"] for a, _ in inner], [b + w["rights"] for _, b in inner]]
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(cols, out)], schema=out)

    return materialize(_block(roots, levels).cogroup(ways.withColumn("block", F.col("pos")).groupBy("skey", "block")).applyInArrow(down, f"skey string, pos bigint, {PATH}"))
