"""Conversation repair against a search over whole edit strings."""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import random
import sys
import zlib

import pytest

from siltline.llm.conversations import Steps, across, damage_conversations, edits, repair_conversations

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    """(conv, turn, role, text) with faults, one row at a time."""
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(name.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def brute(rows):
    """What repair_conversations says of one conversation: the least (cost, audit) of all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, last, inserted=0):
        """The cheapest ending from row i on as (cost, audit, roles)."""
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserted < 3:
            for r in follows[last].replace("s", ""):
                c, a, out = best(i, r, inserted + 1)
                found.append((c + 2, "I" + a, (("user" if r == "u" else "assistant", None), *out)))
        if i < len(rows):
            c, a, out = best(i + 1, last)
            found.append((c + 3, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                more, role = faults[i] == "truncated", rows[i][2]
                if role[:1] and role[:1] in follows[last]:
                    c, a, out = best(i + 1, role[:1])
                    found.append((c + more, "K" + a, ((role, i), *out)))
                for r in follows[last].replace("s", ""):
                    c, a, out = best(i + 1, r)
                    found.append((c + more + 2, "R" + a, (("user" if r == "u" else "assistant", i), *out)))
        return min(found) if found else (10**9, "", ())

    cost, audit, out = best(0, "")
    turns = [r[1] for r in rows if r[1] is not None]
    repaired = "\n".join(f"{role}:{'' if i is None else rows[i][3]}" for role, i in out)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(repaired.encode()).hexdigest(),
    }


@pytest.fixture(autouse=True)
def deep():
    """The search calls itself a few times for each row."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    yield
    sys.setrecursionlimit(before)


def compare(spark, rows, block, partitions=3, with_ids=True):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv long, turn long, role string, text string, pos int, key string").repartition(partitions)
    ids = df.select("conv")
    hurt = damage_conversations(df, "conv", "turn", "role", "text")
    got = {r["conv"]: {f: r[f] for f in FIELDS} for r in repair_conversations(hurt, "conv", "turn", "role", "text", ids, block).collect()}
    want = {c: brute([r for r in damaged(rows) if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_random_conversations(spark):
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(80)]:
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"])
            text = rng.choice(["Yes.", "No", "", " \n", None, "Well!\n", "Why?  ", "é。", "Same.", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), role, text))
    compare(spark, rows, 4096)
    compare(spark, rows[:400], 3)


def test_a_long_conversation_over_many_blocks_and_tasks(spark):
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"c{t}!", ""])) for t in range(300)]
    rows += [(8, 0, "user", "same.")] * 40 + [(9, None, None, None)] * 30 + [(10, t, "user" if t % 2 == 0 else "assistant", "x" * 200_000 + f"{t}.") for t in range(4)]
    compare(spark, rows, 7, 5)


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert repair_conversations(none, "conv", "turn", "role", "text").collect() == []
    (row,) = repair_conversations(none, "conv", "turn", "role", "text", spark.createDataFrame([(5,)], "conv long")).collect()
    assert row.asDict() == {"conv": 5, **dict.fromkeys(FIELDS, 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def test_blocks_and_checkpoints_agree_with_one_walk():
    rng, steps, end = random.Random(2), Steps(), (0, 4, 2, 0)
    for _ in range(200):
        kinds = bytes(rng.randrange(12) for _ in range(rng.randrange(1, 30)))
        cut = rng.randrange(len(kinds) + 1)
        whole, _ = edits(kinds, 0, end, True, steps)
        tail = across(kinds[cut:], steps) if cut < len(kinds) else None
        behind = end if tail is None else tuple(min(a + b for a, b in zip(row, end, strict=True)) for row in tail)
        first, state = edits(kinds[:cut], 0, behind, cut == len(kinds), steps)
        second = edits(kinds[cut:], state, end, True, steps)[0] if cut < len(kinds) else ""
        assert first + second == whole
    assert len(steps) < 500  # few different costs occur, however long the texts


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_registered_query(spark):
    from siltline.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: {f: r[f] for f in FIELDS} for r in queries()["op11_conversation_repair"](spark, SF).collect()}
    assert got == {c: brute([r for r in damaged(rows) if r[0] == c]) for c in {r[0] for r in rows}}
