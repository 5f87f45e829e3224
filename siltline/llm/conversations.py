"""Repair of conversation structure by a shortest path with checkpoints every few thousand rows.

A repaired conversation's role initials read ``(s?(ua)+)?``. Each row is kept (cost 0), given the
role user or assistant (2) or deleted (3; a must for blank rows and duplicates), an empty user or
assistant turn is inserted anywhere (2), and a row that stays although its text is cut off adds 1.
The cheapest edits are found over four states: nothing so far, then the last initial s, u or a.

Rows are sorted over all tasks, so that a conversation of any length lies in many of them, and cut
into blocks of ``block`` rows at most. A block gives the costs from each state before it to each
state behind it. Backward over its blocks, a conversation stores the costs to its end at the
blocks' edges only, its checkpoints; forward, one block after the other, the costs inside a block
are computed again from the checkpoint behind it, and the ASCII-least of the edits that keep them
is taken: D, I, K, R. A conversation costs a byte a row there, in blocks, and one block is held at a
time. The digest of a repaired conversation cannot be computed in parts, so its texts pass through
one task as a sorted stream; nothing but the audit, a letter an edit, is held.

Rows go by turn, nulls first; rows of one turn by role, then by their text's SHA-256; equal rows
are interchangeable, and all but the first are duplicates. Null roles and texts are one space: such
a text is blank, such a role must be changed. A null conversation is one of its own. A row's role
counts by its first character, as it stands; an empty role has none and must be changed. Very long
texts are streamed like others. Other columns of the input are not looked at, whatever their names.
An empty table gives no rows. Gaps of turns further apart than 2**63 are not to be had as longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import bounded_batches, discard, saved

NOTHING, S, U, A = range(4)
#: The state behind a user or assistant turn that follows each state; only one of the two may follow.
TURN = (U, U, A, U)
#: The state behind a kept row of role s, u, a or another.
KEPT = ((S, None, None, None), (U, U, None, U), (None, None, A, None), (None, None, None, None))
#: Costs to the end behind the last row: an unanswered s or u is completed by insertions.
END = (0, 4, 2, 0)
ROWS = 4096
SPACE = " \t\n\u000b\f\r"
FIELDS = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")
PIECE = {"distinct": "long", "low": "long", "high": "long"} | dict.fromkeys(SUMS, "long") | {"audit": "string"}


LEGAL = {(0, 1), (1, 2), (2, 1)}
BLOCK = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("kinds", pa.binary()), ("costs", pa.list_(pa.int64())), ("low", pa.int64()), ("high", pa.int64()), ("distinct", pa.int64()), *((x, pa.int64()) for x in SUMS[:4])])
BLOCK_DDL = "key string, pos long, kinds binary, costs array<long>, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long"
WALKED = pa.schema([("key", pa.string()), ("pos", pa.int64()), *((k, pa.string() if t == "string" else pa.int64()) for k, t in PIECE.items())])


class Steps(dict):
    """Costs before a row of a kind, from those behind it; both less the latter's least, so that few occur."""

    def __missing__(self, key: tuple[int, tuple]) -> tuple:
        kind, after = key
        role, fault = divmod(kind, 3)
        costs = [3 + x for x in after]
        if fault < 2:
            for q in range(4):
                stay = [after[KEPT[role][q]]] if KEPT[role][q] is not None else []
                costs[q] = min(costs[q], fault + min([*stay, 2 + after[TURN[q]]]))
        for _ in range(2):  # two insertions lead to any state that insertions reach
            costs = [min(x, 2 + costs[TURN[q]]) for q, x in enumerate(costs)]
        found = self[key] = tuple(costs)
        return found

    def before(self, kind: int, after: tuple) -> tuple:
        least = min(after)
        return tuple(x + least for x in self[kind, tuple(x - least for x in after)])


def across(kinds: bytes, steps: Steps) -> list[list[float]]:
    """Costs of the cheapest edits of a block from each state (first index) to each state behind it."""
    columns = []
    for r in range(4):
        costs = tuple(0 if q == r else inf for q in range(4))
        for kind in reversed(kinds):
            costs = steps.before(kind, costs)
        columns.append(costs)
    return [list(x) for x in zip(*columns, strict=True)]


def edits(kinds: bytes, state: int, behind: tuple, last: bool, steps: Steps) -> tuple[str, int]:
    """The ASCII-least cheapest edits of a block that is entered in ``state``, and the state it is left in."""
    costs = [tuple(behind)]
    for kind in reversed(kinds):
        costs.append(steps.before(kind, costs[-1]))
    costs.reverse()
    out = []
    for i, kind in enumerate(kinds):
        role, fault = divmod(kind, 3)
        here, after = costs[i], costs[i + 1]
        while True:
            if 3 + after[state] == here[state]:
                out.append("D")
                break
            if 2 + here[TURN[state]] == here[state]:
                out.append("I")
                state = TURN[state]
                continue
            kept = KEPT[role][state]
            if kept is not None and fault + after[kept] == here[state]:
                out.append("K")
                state = kept
            else:
                out.append("R")
                state = TURN[state]
            break
    while last and costs[-1][state]:
        out.append("I")
        state = TURN[state]
    return "".join(out), state


def _faults(role: Column, text: Column, repeated: Column) -> Column:
    """3 * (s, u, a, other) + (0: sound, 1: truncated, 2: must go), for each row; bits above tell blank rows from duplicates."""
    end = F.rtrim(text, F.lit(SPACE))
    initial = F.substring(role, 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return place * 3 + F.when(end == "", 2).when(repeated, 2 + 16).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1) + F.when(end == "", 32).otherwise(0)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of successive rows of one conversation: their kinds, their costs and what is counted of them."""
    steps, held, run = Steps(), [], None

    def close() -> None:
        kinds = bytes(k & 15 for k in run["kinds"])
        initials = [k // 3 for k in kinds]
        turns = [t for t in run["turns"] if t is not None]
        held.append({
            "key": run["key"], "pos": run["pos"], "kinds": kinds, "costs": [x if x < inf else -1 for row in across(kinds, steps) for x in row], "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct": len(set(turns)),
            "blank": sum(k >= 32 for k in run["kinds"]), "duplicate": sum(16 <= k < 32 for k in run["kinds"]), "truncated": sum(k % 3 == 1 for k in kinds), "illegal": sum(x not in LEGAL for x in zip(initials, initials[1:], strict=False)),
        })

    for batch in batches:
        for key, pos, turn, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run is None or key != run["key"] or pos != run["pos"] + len(run["kinds"]) or len(run["kinds"]) == most:
                if run is not None:
                    close()
                if len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held, BLOCK)
                    held = []
                run = {"key": key, "pos": pos, "kinds": [], "turns": []}
            run["kinds"].append(kind)
            run["turns"].append(turn)
    if run is not None:
        close()
        yield pa.RecordBatch.from_pylist(held, BLOCK)


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from a conversation's last to its first, each with the costs to the end behind it and whether it is the last."""
    key = costs = None
    for batch in batches:
        behind, last = [], []
        for own, across_ in zip(batch["key"].to_pylist(), batch["costs"].to_pylist(), strict=True):
            last.append(own != key)
            if own != key:
                key, costs = own, list(END)
            behind.append(costs)
            costs = [min(c + d for c, d in zip(across_[4 * q : 4 * q + 4], costs, strict=True) if c >= 0) for q in range(4)]
        yield batch.append_column("behind", pa.array(behind, pa.list_(pa.int64()))).append_column("last", pa.array(last, pa.bool_()))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, each with its edits; counts of what lies across two blocks go to the second."""
    steps, key, state, initial, high = Steps(), None, NOTHING, None, None
    for batch in batches:
        rows = []
        for b in batch.to_pylist():
            kinds, behind = b["kinds"], tuple(b["behind"])
            first = b["key"] != key
            if first:
                key, state, initial, high = b["key"], NOTHING, None, None
                least = behind
                for kind in reversed(kinds):
                    least = steps.before(kind, least)
            audit, state = edits(kinds, state, behind, b["last"], steps)
            rows.append({
                "key": key, "pos": b["pos"], "distinct": b["distinct"] - (high is not None and b["low"] == high), "low": b["low"], "high": b["high"], "blank": b["blank"], "duplicate": b["duplicate"], "truncated": b["truncated"],
                "illegal": b["illegal"] + (initial is not None and (initial, kinds[0] // 3) not in LEGAL), "cost": least[NOTHING] if first else 0, "audit": audit,
            })
            initial, high = kinds[-1] // 3, b["high"] if b["high"] is not None else high
        yield pa.RecordBatch.from_pylist(rows, WALKED)


class _Repaired:
    """One conversation while its edits and rows pass by."""

    def __init__(self, conv) -> None:
        self.conv, self.sums, self.audit, self.digest = conv, dict.fromkeys((*SUMS, "distinct"), 0), [], hashlib.sha256()
        self.low = self.high = self.last = None
        self.todo: Iterator[str] = iter("")

    def take(self, edit: str, role: str | None, text: str) -> None:
        if edit != "K":
            role = "assistant" if self.last == "u" else "user"
        self.digest.update(b"\n" * (self.last is not None) + f"{role}:{text}".encode())
        self.last = role[:1]

    def row(self, role: str, text: str) -> None:
        for edit in self.todo:
            if edit == "D":
                return
            self.take(edit, role, "" if edit == "I" else text)
            if edit != "I":
                return

    def piece(self, p: dict) -> None:
        self.rest()
        self.audit.append(p["audit"])
        self.todo = iter(p["audit"])
        for name in self.sums:
            self.sums[name] += p[name]
        if p["low"] is not None:
            self.low = p["low"] if self.low is None else self.low
            self.high = p["high"]

    def rest(self) -> None:
        for edit in self.todo:
            self.take(edit, None, "")

    def result(self) -> dict:
        self.rest()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["distinct"]
        return {"conv": self.conv, "gaps": gaps, **{x: self.sums[x] for x in SUMS}, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's id, then its blocks' edits, each before the rows that it edits."""
    now, schema = None, None
    for batch in batches:
        done = []
        if schema is None:
            schema = pa.schema([("conv", batch.schema.field("conv").type), *((k, pa.string() if t == "string" else pa.int64()) for k, t in FIELDS.items())])
        for conv, mark, role, text, piece in zip(*(batch[c].to_pylist() for c in ("conv", "mark", "role", "text", "piece")), strict=True):
            if mark == 0:
                if now is not None:
                    done.append(now.result())
                now = _Repaired(conv)
            elif mark == 1:
                now.piece(piece)
            else:
                now.row(role, text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema)


def damage_conversations(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conv, turn, role, text) with faults put in by crc32 of ``conv:turn``, modulo 20; nulls there are one space.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 gives it the role user.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), fate.alias("fate")).where("fate <> 0")
    changed = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = out.withColumns({"text": changed, "role": F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))})
    return out.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv", "turn", "role", "text")


def repair_conversations(rows: DataFrame, conv: str, turn: str, role: str, text: str, ids: DataFrame | None = None, block: int = ROWS) -> DataFrame:
    """One row a conversation: what is wrong with it, its cheapest edits and the digest of what they make of it.

    ``ids``: a table whose ``conv`` column names conversations that may have no rows; they get zeros.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    key = F.when(F.col("conv").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv").cast("string"))).alias("key")
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"))
    named = own.select("conv") if ids is None else ids.select(F.col(conv).alias("conv")).union(own.select("conv"))
    # a number for each row, written down: equal rows can then be told apart and lie in many tasks
    numbered = saved(own.select(key, "turn", "role", "text", F.sha2("text", 256).alias("sha"), F.monotonically_increasing_id().alias("nth")), "conversation-rows")

    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "nth").alias("place")
    firsts = numbered.where(F.rtrim("text", F.lit(SPACE)) != "").groupBy("key", "role", "sha").agg(F.min(place).alias("first"), F.count("*").alias("members")).where("members > 1").drop("members")
    marked = numbered.join(firsts, ["key", "role", "sha"], "left")
    kind = _faults(F.col("role"), F.col("text"), F.col("first").isNotNull() & (F.col("first") != place)).cast("short")
    order = ["key", "turn", "role", "sha", "nth"]
    marked = marked.select(*order, kind.alias("kind"), F.when(kind % 16 % 3 < 2, F.col("text")).alias("text"))
    ordered = saved(marked.repartitionByRange(*order).sortWithinPartitions(*order).select("key", F.monotonically_increasing_id().alias("pos"), "turn", "kind", "role", "text"), "conversations-sorted")
    discard(numbered)

    blocks = ordered.select("key", "pos", "turn", "kind").mapInArrow(lambda batches: _blocks(batches, block), BLOCK_DDL)
    points = blocks.repartition("key").sortWithinPartitions("key", F.desc("pos")).mapInArrow(_checkpoints, BLOCK_DDL + ", behind array<long>, last boolean")
    pieces = points.sortWithinPartitions("key", "pos").mapInArrow(_walk, "key string, pos long, " + ", ".join(f"{k} {t}" for k, t in PIECE.items()))

    nothing = {"conv": F.lit(None).cast(rows.schema[conv].dataType), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "piece": F.lit(None).cast("struct<" + ",".join(f"{k}:{t}" for k, t in PIECE.items()) + ">")}
    columns = ["key", "pos", "mark", *nothing]

    def whole(df: DataFrame, pos: Column, mark: int, **has: Column) -> DataFrame:
        own = {"key": F.col("key"), "pos": pos, "mark": F.lit(mark)} | nothing | has
        return df.select(*(own[c].alias(c) for c in columns))

    stream = whole(named.distinct().select(key, "conv"), F.lit(-1).cast("long"), 0, conv=F.col("conv"))
    stream = stream.unionByName(whole(pieces, F.col("pos"), 1, piece=F.struct(*PIECE)))
    stream = stream.unionByName(whole(ordered, F.col("pos"), 2, role=F.col("role"), text=F.col("text")))
    kind_of = rows.schema[conv].dataType.simpleString()
    done = stream.repartition("key").sortWithinPartitions("key", "pos", "mark").mapInArrow(_digests, f"conv {kind_of}, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()))
    return done.select(F.col("conv").alias(conv), *FIELDS)
