"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

The lattice of a text has an edge for every piece that matches. A forward Viterbi
pass gives each position the best score up to it; a backward A* search from the
end uses these scores as its exact heuristic, so the first n paths that reach the
start are the n best. No piece of the model holds a word mark after another
character, so the lattice parts into chunks at the marks. Each chunk's best path
and the loss of its second best are remembered; only the n - 1 chunks of least loss of a text can differ in its n best
paths, and these alone are searched.
Scores are the model's own (of a BPE vocabulary: minus the rank of a merge).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from voxtab.llm.streams import slices
from voxtab.llm.wordbpe import vocabulary_path

MARK = "▁"
#: A chunk: marks, then other characters; or marks at the end.
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
#: The same, parted between a Latin letter and a full stop or comma too, where no piece of the model holds these two in a row.
FINE = re.compile(f"{MARK}*[^{MARK}]*?[A-Za-zÀ-ÖØ-öø-ɏ](?=[.,])|{MARK}*[^{MARK}]+|{MARK}+$")
INSIDE = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ][.,]")
#: Chunks that a generation of a worker's memory holds, and the longest that it keeps.
CACHE_CHUNKS, CACHE_LENGTH = 500_000, 48


class PieceLattice:
    def __init__(self, path: str, n_best: int):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_best = n_best
        size = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.edges: dict[str, tuple[float, bytes] | None] = {}
        byte_ids, scores = {}, []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                score = sp.get_score(i)
                scores.append(score)
                self.edges[piece] = (score, np.array([i], "<u4").tobytes())
                self.bytes_of.append(piece.encode())
                if MARK in piece.lstrip(MARK):
                    raise ValueError(f"the piece {piece!r} crosses a word mark")
        # A character without a piece is spelled in bytes, at less than any piece but the forbidden ones.
        self.rest = min(s for s in scores if s > -1e8) - 10
        self.byte_ids = [byte_ids[b] for b in range(256)]
        for piece in list(self.edges):
            for j in range(1, len(piece)):
                self.edges.setdefault(piece[:j], None)
        self.split = (CHUNK if any(INSIDE.search(p) for p in self.edges) else FINE).findall
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.beside: dict[str, list] = {}

    def search(self, text: str) -> list[tuple[float, bytes]]:
        """The n best (score, ids) of one chunk, best first; ties go to the path whose last pieces are shorter."""
        n, get = len(text), self.edges.get
        best = [0.0] + [-1e300] * n
        ends: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            b, j, single = best[i], i + 1, False
            while j <= n:
                e = get(text[i:j], 0)
                if e == 0:
                    break
                if e:
                    single |= j == i + 1
                    ends[j].append((i, e[0], e[1]))
                    if b + e[0] > best[j]:
                        best[j] = b + e[0]
                j += 1
            if not single:
                ids = np.array([self.byte_ids[x] for x in text[i].encode("utf-8", "replace")], "<u4").tobytes()
                ends[i + 1].append((i, self.rest, ids))
                if b + self.rest > best[i + 1]:
                    best[i + 1] = b + self.rest
        heap, count, out = [(-best[n], n, 0, 0.0, None)], 0, []
        while heap:
            _, pos, _, g, path = heappop(heap)
            if pos == 0:
                ids = []
                while path:
                    ids.append(path[0])
                    path = path[1]
                out.append((g, b"".join(ids)))
                if len(out) == self.n_best:
                    break
                continue
            for i, score, ids in ends[pos]:
                count += 1
                heappush(heap, (-(g + score + best[i]), i, count, g + score, (ids, path)))
        return out

    def best(self, text: str) -> tuple[float, bytes, float]:
        """(score, ids) of the best path of one chunk, and what the second best scores less (the two best scores of each position)."""
        n, get = len(text), self.edges.get
        one, two = [0.0] + [-1e300] * n, [-1e300] * (n + 1)
        into: list = [None] * (n + 1)
        for i in range(n):
            b, j, single = one[i], i, False
            c = two[i]
            while j < n:
                j += 1
                e = get(text[i:j], 0)
                if not e:
                    if e == 0:
                        break
                    continue
                if j == i + 1:
                    single = True
                s = e[0]
                v, old = b + s, one[j]
                if v > old:
                    one[j] = v
                    into[j] = (i, e[1])
                    u = c + s
                    two[j] = u if u > old else old
                elif v > two[j]:
                    two[j] = v
            if not single:
                j, v = i + 1, b + self.rest
                if v > one[j]:
                    two[j], one[j] = max(one[j], c + self.rest), v
                    into[j] = (i, np.array([self.byte_ids[x] for x in text[i].encode("utf-8", "replace")], "<u4").tobytes())
                elif v > two[j]:
                    two[j] = v
        path, pos = [], n
        while pos:
            pos, ids = into[pos]
            path.append(ids)
        path.reverse()
        return one[n], b"".join(path), one[n] - two[n] if two[n] > -1e299 else np.inf

    def chunk(self, text: str) -> tuple[float, bytes, float]:
        """best() of a chunk, remembered for two generations."""
        e = self.young.get(text)
        if e is None:
            e = self.old.get(text) or self.best(text)
            if len(text) <= CACHE_LENGTH:
                if len(self.young) >= CACHE_CHUNKS:
                    self.old, self.young = self.young, {}
                self.young[text] = e
        return e

    def others(self, text: str, ids: bytes) -> list[tuple[float, bytes]]:
        """The n - 1 best paths of a chunk besides the one of ids."""
        found = self.beside.get(text)
        if found is None:
            found = [f for f in self.search(text) if f[1] != ids][: self.n_best - 1]
            if len(self.beside) >= 50_000:
                self.beside.clear()
            if len(text) <= CACHE_LENGTH:
                self.beside[text] = found
        return found

    def encode(self, text: str | None) -> list[tuple[float, bytes, bool, str | None]]:
        """The n best (score, ids as little-endian 32-bit numbers, whether they decode to the text, of the first the decoded text).

        The first is decoded whole; of the others, the chunks in which they differ.
        One empty path for null and empty texts.
        """
        if not text:
            return [(0.0, b"", True, "")]
        whole = MARK + text.replace(" ", MARK)
        chunks = self.split(whole)
        get, chunk = self.young.get, self.chunk
        scores, ids, losses = zip(*[get(c) or chunk(c) for c in chunks])
        base, joined = sum(scores), b"".join(ids)
        decoded = self.decode(joined)
        same = decoded == text.encode("utf-8", "replace").decode().replace(MARK, " ")
        out = [(base, joined, same, decoded)]
        if self.n_best == 1:
            return out
        # A path that changes a chunk outside the n - 1 of least loss is beaten by n others.
        loss = np.array(losses)
        near = range(len(loss)) if len(loss) < self.n_best else np.argpartition(loss, self.n_best - 2)[: self.n_best - 1].tolist()
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for i in sorted(near):
            if loss[i] < np.inf:
                more = [(0.0, None), *((scores[i] - s, x) for s, x in self.others(chunks[i], ids[i]))]
                combos = sorted((lost + d, change + ((i, x),) if x is not None else change) for lost, change in combos for d, x in more)[: self.n_best]
        for lost, change in combos[1:]:
            parts = list(ids)
            for i, x in change:
                parts[i] = x
            out.append((base - lost, b"".join(parts), same and all(self.spell(x) == chunks[i].encode("utf-8", "replace") for i, x in change), None))
        return out

    def spell(self, ids: bytes) -> bytes:
        """The bytes of the pieces of ids, with word marks."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, marks as spaces, the leading mark left out; broken UTF-8 is replaced."""
        text = self.spell(ids).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[tuple[str, int], PieceLattice] = {}


def lattice(model: str, n_best: int) -> PieceLattice:
    """The lattice of a model file; a worker loads it once."""
    if (model, n_best) not in _LOADED:
        _LOADED[model, n_best] = PieceLattice(vocabulary_path(model), n_best)
    return _LOADED[model, n_best]


def encode_nbest(docs: DataFrame, model: str = "piece_bpe_32k.model", n_best: int = 3, with_ids: bool = True) -> DataFrame:
    """(doc_id, rank, score, n_pieces, ids_crc32, round_trip, decoded_md5, ids): up to n_best segmentations of each text, rank from 1.

    ids_crc32 is over little-endian 32-bit ids; round_trip says that the ids
    decode to the text (with marks read as spaces); decoded_md5 is of the text that
    the ids of rank 1 decode to; ids is null unless asked for.
    Null and empty texts have one path without pieces. Repeated rows and null
    doc_ids are kept; other columns are not read.
    """
    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "decoded_md5", "ids"]

    def run(batches):
        lat = lattice(model, n_best)
        for b in slices(batches):
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(docs_), 512):
                rows: list[list] = [[] for _ in names]
                for doc, text in zip(docs_[lo : lo + 512], texts[lo : lo + 512]):
                    for rank, (score, ids, same, decoded) in enumerate(lat.encode(text), 1):
                        digest = None if decoded is None else hashlib.md5(decoded.encode()).hexdigest()
                        for c, v in zip(rows, (doc, rank, score, len(ids) // 4, zlib.crc32(ids), same, digest, np.frombuffer(ids, "<i4") if with_ids else None)):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    schema = "doc_id bigint, rank int, score double, n_pieces bigint, ids_crc32 bigint, round_trip boolean, decoded_md5 string, ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """encoded (with an ids column of array<int>) with one more column, text; null ids give null."""

    def run(batches):
        lat = lattice(model, 1)
        for b in batches:
            at = b.schema.get_field_index("ids")
            texts = [None if i is None else lat.decode(np.array(i, "<u4").tobytes()) for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    base = encoded.drop("text")
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("text", T.StringType())]))
