"""Fill-in-middle texts against slices of strings, and their inverse."""

from __future__ import annotations

import hashlib
import os
import random
import re

import pytest

from siltline.llm.fill_middle import STRIDE, fill_in_middle, restore, restore_texts, reverse, rotate, transform

SF = "/root/testdata/sf0.001"


def plainly(name, text, rate=100, spm=50):
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = [int(hashlib.sha256(f"7:{name}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rotations_in_place():
    import numpy as np

    for n in (0, 1, 2, 5, 2 * STRIDE, 2 * STRIDE + 1, 5 * STRIDE + 3):
        own = np.random.default_rng(n).integers(0, 256, n, np.uint8)
        turned = own.copy()
        reverse(turned, 0, n)
        assert (turned == own[::-1]).all()
        buffer, cut = bytearray(own.tobytes()), n // 3
        rotate(buffer, 0, cut, n)
        assert bytes(buffer) == own.tobytes()[cut:] + own.tobytes()[:cut]


def test_segments_that_look_like_halves_of_sentinels():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("<>PSM\né") for _ in range(rng.randrange(1, 20))).encode()
        if re.search(b"<[PSM]>", text):
            continue
        a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        for form in ("psm", "spm"):
            out = bytes(transform(text, a, b, form))
            p, m, s = b"<P>" + text[:a], b"<M>" + text[a:b], b"<S>" + text[b:]
            assert out == (p + s + m if form == "psm" else s + p + m) and restore(out, form) == text


def test_awkward_texts(spark, docs, awkward):
    more = [(100, "<S> in it\nx"), (101, "\n"), (102, "\n\n\nx"), (103, "no break"), (104, "a\r\nb c\x85d\n"), (105, "x<\n>P>\n<\n"), (None, "a\nb\nc")]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumnsRenamed({"text": "output"})
    got = restore_texts(fill_in_middle(rows, "doc_id", "output")).collect()
    key = lambda x: tuple((v is not None, v or "") if not isinstance(v, int) else (True, str(v)) for v in x)
    want = [(i, *plainly("" if i is None else i, t or ""), t or "") for i, t in [*awkward, *more]]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    some = fill_in_middle(rows, "doc_id", "output", rate=40, spm=20).collect()
    assert sorted(map(tuple, some), key=key) == sorted([(i, *plainly("" if i is None else i, t or "", 40, 20)) for i, t in [*awkward, *more]], key=key)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert restore_texts(fill_in_middle(none, "doc_id", "text")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_registered_query(spark):
    import duckdb

    from siltline.llm.queries import oracle_sql, queries

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted(map(tuple, queries()["op12_fill_in_middle"](spark, SF).collect()))
    want = sorted((i, *plainly(i, t)[:4], sha(plainly(i, t)[4]), sha(t)) for i, t in rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert got == want == sorted(con.sql(oracle_sql()["op12_fill_in_middle"]).fetchall())
