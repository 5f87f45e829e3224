"""Documents of several versions, and what is set aside."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siltline.sources import contracts
from siltline.sources.versions import Chain, Version, checked, read_documents, split

CHAIN = Chain(
    Version("1", "name string NOT NULL, n string", lambda d: F.struct(d["name"].alias("title"), d["n"].try_cast("int").alias("n"))),
    Version("2", "title string NOT NULL, n int", lambda d: F.struct(d["title"].alias("title"), d["n"].alias("n"), F.array(d["title"]).alias("tags"))),
    Version("3", "title string NOT NULL, n int, tags array<string>"),
)
CASES = [
    ({"version": "1", "name": "a", "n": "7"}, ("1", None, ("a", 7, ["a"]))), ({"version": "2", "title": "b", "n": None}, ("2", None, ("b", None, ["b"]))), ({"title": "c", "tags": ["x", "y"]}, ("3", None, ("c", None, ["x", "y"]))),
    ('{"title": "d"', (None, "no JSON", None)), ("[1]", (None, "no JSON object", None)), ('"x"', (None, "no JSON object", None)), ("", (None, "no text", None)), (None, (None, "no text", None)), ({"version": "9", "title": "e"}, (None, "unknown version 9", None)),
    ({"version": "2", "title": "f", "tags": []}, ("2", "unknown keys: tags", None)), ({"title": None, "n": 1}, ("3", "missing keys: title", None)), ({"version": "1"}, ("1", "missing keys: name", None)), ({"title": "g", "n": "one"}, ("3", "values of another type: n", None)),
    ({"title": "é \n \"q\" 日本", "n": 2147483648}, ("3", "values of another type: n", None)), ({"title": "h", "tags": "x"}, ("3", "values of another type: tags", None)),
]


def text(case):
    return json.dumps(case) if isinstance(case, dict) else case


def test_every_case_has_a_row(spark):
    rows = spark.createDataFrame([(i, text(c), "clash") for i, (c, _) in enumerate(CASES)], "i int, text string, title string")
    done = checked(rows, "text", CHAIN)
    got = {r.i: (r.version, r.reason, tuple(r.document) if r.document else None) for r in done.collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    good, aside = split(done.drop("title"))
    assert good.count() == 3 and aside.count() == len(CASES) - 3 and good.columns == ["i", "text", "version", "title", "n", "tags"]
    assert checked(spark.createDataFrame([], "text string"), "text", CHAIN).collect() == []


def test_files_in_are_rows_out_and_set_aside(spark, tmp_path):
    for i, (case, _) in enumerate(CASES):
        (tmp_path / f"{i:02d}.json").write_text(text(case) or "")
    good, aside = split(read_documents(spark, f"file://{tmp_path}", CHAIN))
    assert sorted((r.title, r.n) for r in good.collect()) == [("a", 7), ("b", None), ("c", None)]
    assert {(r.file.rpartition("/")[2], r.reason, r.text) for r in aside.collect()} == {(f"{i:02d}.json", want[1], text(c) or "") for i, (c, want) in enumerate(CASES) if want[1]}


def test_contract_documents_are_neither_lost_nor_stop_the_rest(spark, tmp_path):
    sound = {"version": "1", "id": "x", "display_name": "X", "daily_cap": 3, "min_feeds": 1, "status": "active", "retired_on": None}
    for name, case in (("a", json.dumps(sound)), ("b", "{"), ("c", json.dumps(sound | {"cap": 1})), ("d", json.dumps(sound | {"daily_cap": "x"}))):
        (tmp_path / f"{name}.json").write_text(case)
    rows = contracts.read_checked(spark, "vertical", f"file://{tmp_path}")
    assert sorted((r.file[-6], r.reason, r.document and r.document.daily_cap) for r in rows.collect()) == [("a", None, 3), ("b", "no JSON", None), ("c", "unknown keys: cap", None), ("d", "values of another type: daily_cap", None)]


def test_chains_are_in_order():
    with pytest.raises(ValueError, match="oldest"):
        Chain(Version("2", "a int", lambda d: d), Version("1", "a int"))
    with pytest.raises(ValueError, match="upgrade"):
        Chain(Version("1", "a int"), Version("2", "a int"))
