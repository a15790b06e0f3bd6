"""Conversation repair against all edits of short conversations."""

import hashlib
import random
import zlib
from itertools import product

from voxtab.llm import repair as R
from voxtab.llm.repair import damaged, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, gone int, kind string, audit double"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """(cost, audit, repaired lines) by trying all edits, with up to two insertions in a place."""
    marks, best = faults(rows), None

    def go(i, q, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and q in ("", "a"):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if not audit.endswith("II"):
            want = R.WANTS[q]
            go(i, R.STEP[q, want[0]], cost + 3, audit + "I", [*lines, f"{want}:"])
        if i < len(rows):
            (role, text), late = rows[i], 3 * (marks[i] == "truncated")
            if marks[i] in ("", "truncated"):
                if (q, role[:1]) in R.STEP:
                    go(i + 1, R.STEP[q, role[:1]], cost + late, audit + "K", [*lines, f"{role}:{text}"])
                want = R.WANTS[q]
                go(i + 1, R.STEP[q, want[0]], cost + 3 + late, audit + "R", [*lines, f"{want}:{text}"])
            go(i + 1, q, cost + 4, audit + "D", lines)

    go(0, "", 0, "", [])
    return best


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in brute_damage(rows):
        convs[r[0]].append(r)
    out = []
    for conv_id, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in own if r[1] is not None]
        said = [r[2:] for r in own]
        marks = faults(said)
        cost, audit, lines = brute_repair(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        out.append((conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def run(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)
    return sorted(map(tuple, repair(damaged(table)).collect()), key=repr)


def test_random_conversations(spark):
    r = random.Random(1)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "user", "assistant"], ["Yes.", "No", "Why? \n", None, "", " \t", "Yes.", "Ça va!", "x" * 50]
    rows = [(c, r.choice([t, t, t, t + 3, None]), r.choice(roles), r.choice(texts)) for c in [*range(60), None] for t in range(r.randrange(1, 6))]
    assert run(spark, rows) == brute(rows)


def test_empty_and_dropped(spark):
    assert run(spark, []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_every_pattern_of_roles():
    for n in range(5):
        for roles in product("usax", repeat=n):
            said = [(role, f"{k}.") for k, role in enumerate(roles)]
            got = R.derive({"": (0, "")}, [(role, f) for (role, _), f in zip(said, faults(said))])
            assert min(got[q][:2] for q in R.GOALS if q in got) == brute_repair(said)[:2], roles


def test_long_conversation_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant", "system", "tool"]), r.choice([f"{t}.", f"{t}", "", "same."])) for t in range(300)]
    whole = run(spark, rows)
    said = [x[2:] for x in brute_damage(rows)]
    items = R.derive({"": (0, "")}, [(role[:1], f) for (role, _), f in zip(said, faults(said))])
    cost, audit = min(items[q][:2] for q in R.GOALS if q in items)
    assert len(said) > 4 * R.BLOCK and whole[0][6:8] == (cost, audit)
    once = run(spark, [*rows, *[(1, t, "user", "y" * 100_000) for t in range(400, 403)]])
    assert once[0][3] > whole[0][3]  # very long texts, repeated
