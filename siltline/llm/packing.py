"""Packing of token sequences: shortest-pack-first over the length histogram.

Texts are cut into full pieces of the capacity and one remainder. Only the histogram of piece
lengths (at most ``capacity`` bins) is packed, on the driver: lengths are placed longest first
into the open pattern with most room, patterns carry counts, and a pattern stands for as many
equal sequences. The patterns are then joined back to the pieces by each piece's rank among
those of its length. The plan that tasks get depends on the number of bins, never on the rows. The
table of rank bases has a row for each task and length; it is joined as the engine sees fit, by
broadcast while it is small.

Null and empty texts hold the end id alone; rows with equal ids, or with none, are packed each for
itself. A very long text is encoded in one task and cut into full pieces and one rest. Pieces of equal
length take the places of that length by task and then by order in it, so which of them lies where
depends on how the rows are dealt; lengths and sequences do not. Only the two named columns are read, whatever
others are called. An empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltline.llm.common import binary_list, bounded_batches, saved, slices, text_bytes, thrifty
from siltline.llm.wordbpe import encoder

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank long"


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns (count, lengths) which hold each length as often as the histogram says.

    Lengths go longest first. Each is put into the open pattern with most room; if it does not
    fit there, a new pattern is opened. A pattern with fewer copies than the length has takes
    what it can; one with more is split in two.
    """
    open_at: dict[int, list[list]] = {}
    rooms: list[int] = []
    done: list[tuple[int, list[int]]] = []

    def keep(room: int, count: int, lengths: list[int]) -> None:
        if room == 0:
            done.append((count, lengths))
            return
        if room not in open_at:
            bisect.insort(rooms, room)
            open_at[room] = []
        open_at[room].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, lengths = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop()
                if count > left:
                    keep(room, count - left, lengths)
                took = min(count, left)
                keep(room - length, took, [*lengths, length])
                left -= took
            else:
                each = max(1, capacity // length)  # copies of one length that share a sequence
                full, rest = divmod(left, each)
                if full:
                    keep(capacity - each * length, full, [length] * each)
                if rest:
                    keep(capacity - rest * length, 1, [length] * rest)
                left = 0
    for room in rooms:
        done += [(count, lengths) for count, lengths in open_at[room]]
    return done


def padding(total: np.ndarray | int, capacity: int):
    """Padded ids of a sequence: up to the capacity, but none at a power of two."""
    total = np.asarray(total)
    return np.where((total & (total - 1)) == 0, 0, capacity - total)


def slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Per slot of a pattern, in order of (length, first rank): which ranks it takes and where they go."""
    rows, taken, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, offset))
            taken[length] = first + count
            offset += length
        sequence += count
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), columns.T, strict=True))


def cut_pieces(df: DataFrame, key: str, text: str, vocabulary: str, end: int, capacity: int) -> DataFrame:
    """One row per piece, with its rank among the pieces of its length in its task (``part``)."""

    def cut(batches):
        from pyspark import TaskContext

        part, words, seen = TaskContext.get().partitionId(), encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), binary_list(batch.column(1))
            for a, b in slices(texts):
                ids, counts = words.encode(texts[a:b], end)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = np.repeat(np.cumsum(counts) - counts, n) + start
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                by = length[order]
                new = np.r_[True, by[1:] != by[:-1]]
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(counts[row], pa.int64()), pa.array(np.full(len(row), part), pa.int32()), pa.array(rank, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t")).mapInArrow(thrifty(cut), PIECES)


def pack_documents(df: DataFrame, key: str, text: str, vocabulary: str, end: int = 2, capacity: int = 4096) -> DataFrame:
    """Packs all texts into sequences of at most ``capacity`` ids.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Ranks are a task's base for the length plus the rank within the task, so one length that
    holds most pieces is counted in many tasks.
    """
    pieces = saved(cut_pieces(df, key, text, vocabulary, end, capacity), "pieces")
    by_task = saved(pieces.groupBy("part", "length").count(), "piece-counts")
    bins = by_task.groupBy("length").agg(F.sum("count").alias("n")).collect()  # at most ``capacity`` rows
    plan = slots(pack_histogram({r.length: r.n for r in bins}, capacity))
    bases = by_task.select("part", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("base"))
    span = np.int64(1) << 44
    slot_key = plan["length"] * span + plan["first"]

    def place(batches):
        for batch in batches:
            length = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(5).to_numpy(zero_copy_only=False)
            slot = np.searchsorted(slot_key, length * span + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2)), pa.array(length), *(batch.column(i) for i in (3, 4)), pa.array(plan["sequence"][slot] + rank - plan["first"][slot]), pa.array(plan["offset"][slot])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(thrifty(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
