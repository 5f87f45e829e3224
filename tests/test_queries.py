"""Every registered query with SQL gives the same rows in DuckDB, at the smallest scale."""

from __future__ import annotations

import hashlib
import json
import math
import os

import duckdb
import pytest

from siltline.plans import oracles, queries, runs, stages, stages_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = queries.queries() | stages.queries() | runs.queries(), oracles.oracle_sql() | stages_sql.oracle_sql() | runs.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if isinstance(v, int | bool | str) or v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        quoted = ", ".join(f'"{c}"' for c in columns)
        assert rows == sorted((tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall()), key=str)


def test_digests_of_odd_texts_against_sql(spark, tmp_path):
    """Null texts, blanks of other scripts at the ends, a vertical tab and line ends of Unicode."""
    texts = [None, "\u00a0A. B. C. D. E. \u3000", "A.\vB. C. D. E\v. F", "A. B. C. D. \u2028", "A. B. C. D \x85", "\u2003\u2003A. B", "A. B.\r\nC.\fD.\tE.\n", "\u00c9 \"q\" \\. \U0001f600! C? D. E. F.", "A. B."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("output_digest", "lead_text"):
        df = QUERIES[name](spark, str(tmp_path))
        quoted = ", ".join(df.columns)
        want = con.sql(f"SELECT {quoted} FROM ({SQL[name]}) ORDER BY doc_id").fetchall()
        assert len(want) == len(texts) and [tuple(r) for r in df.orderBy("doc_id").collect()] == want


def test_digests_of_blank_texts_are_those_of_json(spark, tmp_path):
    """DuckDB's SQL writes an empty string as no JSON does, so this one goes against Python."""
    spark.createDataFrame([(0, ""), (1, " \n\t")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = hashlib.sha256((json.dumps({"key_points": [], "summary": ""}, indent=2) + "\n").encode()).hexdigest()
    assert [r.sha256 for r in QUERIES["output_digest"](spark, str(tmp_path)).collect()] == [want] * 2
