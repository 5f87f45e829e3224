"""Shards by interleaved strata against a sort of all rows in Python."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter

import pytest

from siltline.llm.sharding import interleaved_shards, write_shards

SF = "/root/testdata/sf0.001"


def placed(rows, shards, seed=7):
    """(id, size, crc, shard, slot) of (id, text, stratum)."""
    strata = {}
    for i, text, stratum in rows:
        raw = (text or "").encode()
        mixed = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        strata.setdefault(stratum, []).append((mixed, (i is not None, i or 0), zlib.crc32(raw), len(raw), i))
    order = []
    for stratum, own in strata.items():
        for k, r in enumerate(sorted(own)):
            order.append(((2 * k + 1) / (2 * len(own)), (stratum is not None, stratum or ""), *r))
    order.sort()
    out, seen = [], Counter()
    for at, r in enumerate(order):
        shard = at * shards // len(order)
        out.append((r[-1], r[-2] + 16, r[-3], shard, seen[shard]))
        seen[shard] += 1
    return out


def plain(rows):
    return sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows), key=str)


def test_hot_strata_copies_and_nulls(spark, docs, awkward):
    rows = [(i, t, "s") for i, t in awkward] + [(1000 + i, f"text {i}", "hot") for i in range(700)] + [(5000, "copy", "hot")] * 300 + [(6000 + i, None, None) for i in range(90)] + [(None, "x", "b")] * 5
    df = spark.createDataFrame([(*r, "a", 1, 2.0) for r in rows], "doc_id long, text string, source string, stratum string, at int, fraction double").repartition(7)
    for shards in (1, 7, 40):
        got = interleaved_shards(df, "doc_id", "text", "source", shards).collect()
        assert plain(got) == sorted(placed(rows, shards), key=str)
        counts = Counter(r["shard"] for r in got)
        assert len(counts) == shards and max(counts.values()) - min(counts.values()) <= 1
    by = Counter((r["shard"], r["source"]) for r in interleaved_shards(df, "doc_id", "text", "source", 40, carry=("source",)).collect())
    for source, n in Counter(s for _, _, s in rows).items():
        assert all(abs(by[s, source] - n / 40) <= 2 for s in range(40))
    fewer = [(1, "a", "x"), (2, "b", "y"), (3, "c", "x")]
    assert plain(interleaved_shards(spark.createDataFrame(fewer, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()) == sorted(placed(fewer, 40), key=str)
    assert interleaved_shards(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source").collect() == []


def test_written_shards_and_the_plan(spark, docs, tmp_path):
    done = interleaved_shards(docs, "doc_id", "text", "source", 5, carry=("text",))
    write_shards(done, str(tmp_path / "shards"))
    again = spark.read.parquet(str(tmp_path / "shards"))
    assert again.count() == done.count() and sorted(f for f in os.listdir(tmp_path / "shards") if f.startswith("shard")) == [f"shard={i}" for i in range(5)]
    slots = [tuple(r) for r in again.select("shard", "slot").collect()]
    assert sorted(slots) == [(s, i) for s, n in sorted(Counter(s for s, _ in slots).items()) for i in range(n)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_registered_query(spark):
    from siltline.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = queries()["op13_sharding"](spark, SF).collect()
    assert plain(got) == sorted(placed(rows, 40), key=str)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
