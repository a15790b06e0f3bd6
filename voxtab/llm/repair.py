"""Repair of broken conversations as lightest derivations (Knuth's agenda).

An item (i, q) says that the first i rows of a conversation are edited so that the
roles kept so far lead to state q of the grammar `(s?(ua)+)?`. Every edit is a
deduction of a further item: its weight is a pair (cost, audit), where the cost
grows by the edit's and the audit by its initial. These functions are superior
(a result is never less than what it is made of) and monotone: at equal cost, no
audit of an item begins another of the same item, because the same edits cost the
same. So an agenda popped by (cost, audit) finalises each item at its least weight.

A conversation is read as a stream of sorted rows, in blocks of BLOCK. The items at
a block's end, four at most, begin the next one; what their audits have in common
is set apart, and each carries the running digest of its repaired text. So a long
conversation takes memory for one block, four short audits, one byte of audit a row
and one digest a row of those seen.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.llm.streams import slices

#: ASCII white space: what a text without other characters is blank by.
SPACE = " \t\n\x0b\x0c\r"
STOPS = ".!?"
#: Grammar: the next state by the present one and a role's initial, and the role that a state wants next.
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WANTS = {"": "user", "s": "user", "u": "assistant", "a": "user"}
GOALS = ("", "a")
LEGAL = {"su", "ua", "au"}
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that an agenda spans.
BLOCK = 64


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` modulo 20 names; there is `gone` where a row is dropped.

    0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes
    its role user. A null role or text is one space, and so is a null in the key.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), times.alias("_copy")).drop("_copy")


def derive(starts: dict[str, tuple[int, str]], rows: list[tuple[str, str]]) -> dict[str, tuple[int, str, str]]:
    """The least (cost, audit, state begun from) per state after rows of (role initial, fault), from the items in starts."""
    agenda = [(cost, audit, 0, q, q) for q, (cost, audit) in starts.items()]
    agenda.sort()
    final: set[tuple[int, str]] = set()
    out, n = {}, len(rows)
    while agenda:
        cost, audit, i, q, origin = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            out[q] = (cost, audit, origin)
        wanted = STEP[q, WANTS[q][0]]
        heappush(agenda, (cost + INSERT, audit + "I", i, wanted, origin))
        if i < n:
            initial, fault = rows[i]
            heappush(agenda, (cost + DELETE, audit + "D", i + 1, q, origin))
            if fault not in ("blank", "duplicate"):
                late = TRUNCATED if fault else 0
                heappush(agenda, (cost + RELABEL + late, audit + "R", i + 1, wanted, origin))
                if (q, initial) in STEP:
                    heappush(agenda, (cost + late, audit + "K", i + 1, STEP[q, initial], origin))
    return out


class _Conversation:
    """One conversation, a row at a time."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.seen, self.turns = conv_id, [], set(), []
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.distinct, self.before, self.audit = 0, None, []
        #: state: cost, audit since the common part, digest of the repaired text, whether it has a row
        self.items = {"": (0, "", hashlib.sha256(), False)}

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            if not self.turns or self.turns[1] != turn:
                self.distinct += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        words, key = text.rstrip(SPACE), hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if not words else "duplicate" if key in self.seen else "truncated" if words[-1] not in STOPS else ""
        self.seen.add(key)
        if fault:
            self.n[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.n["illegal"] += 1
        self.before = role[:1]
        self.rows.append((role, text, fault))
        if len(self.rows) == BLOCK:
            self._block()

    def _block(self) -> None:
        found = derive({q: item[:2] for q, item in self.items.items()}, [(role[:1], fault) for role, _, fault in self.rows])
        items = {}
        for q, (cost, audit, origin) in found.items():
            _, old, digest, any_row = self.items[origin]
            items[q] = (cost, audit, *self._written(origin, audit[len(old) :], digest.copy(), any_row))
        common = commonprefix([item[1] for item in items.values()])
        self.audit.append(common)
        self.items = {q: (cost, audit[len(common) :], *rest) for q, (cost, audit, *rest) in items.items()}
        self.rows = []

    def _written(self, q: str, edits: str, digest, any_row: bool):
        i = 0
        for e in edits:
            role, text, _ = self.rows[i] if e != "I" else ("", "", "")
            i += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else WANTS[q]
            q = STEP[q, role[:1]]
            digest.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
            any_row = True
        return digest, any_row

    def result(self) -> tuple:
        self._block()
        cost, audit, digest, _ = min((self.items[q] for q in GOALS if q in self.items), key=lambda item: item[:2])
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (self.conv_id, gaps, *self.n.values(), cost, "".join(self.audit) + audit, digest.hexdigest())


COLUMNS = {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"}


def repair(rows: DataFrame) -> DataFrame:
    """COLUMNS for every conv_id of rows (conv_id, turn, role, text, gone), a null one included.

    Rows are taken by turn, nulls first, then role and text; those that are gone
    count only in that their conversation has a result. gaps are turns missing
    between the least and the largest; a row's first fault counts (blank, role and
    text seen earlier, no stop at its end); illegal counts neighbours whose roles
    may not follow each other; cost and audit are those of the cheapest edits, ties
    to the least audit. A conversation without rows has zeros, an empty audit and
    the digest of nothing. An empty table gives an empty result; other columns are
    not read. Rows of one conversation are read by one task, as a stream: the
    digest of its repaired text follows all its rows in order.
    """
    dealt = rows.select("conv_id", "turn", "role", "text", "gone").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    kinds = pa.schema([(c, pa.string() if t == "string" else pa.int64()) for c, t in COLUMNS.items()])

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), kinds)], schema=kinds)

    def run(batches):
        now, done = None, []
        for b in slices(batches, 1024):
            for conv_id, turn, role, text, gone in zip(*[b.column(c).to_pylist() for c in range(5)]):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text)
            if len(done) >= 4096:
                yield batch(done)
                done = []
        if now is not None:
            done.append(now.result())
        if done:
            yield batch(done)

    return dealt.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))
