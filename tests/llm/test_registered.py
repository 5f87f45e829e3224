"""The registered queries over whole given tables: columns, types, rows, and what can be told by brute force."""

from __future__ import annotations

import itertools
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from siltline.llm.queries import queries
from siltline.llm.wordbpe import vocabulary_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
COLUMNS = {
    "op1_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op2_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op3_sentence_pieces": "doc_id bigint, n_tokens bigint, ids_crc32 bigint, text_crc32 bigint, same boolean",
    "op4_vector_duplicates": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_licenses": "doc_id bigint, license string, reusable boolean, rule string, first_sentence int, last_sentence int",
    "op10_language_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_fill_in_middle": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
    "op13_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
}


@pytest.fixture(scope="module")
def given():
    con = duckdb.connect()
    docs = con.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') ORDER BY doc_id").fetchall()
    vectors = con.sql(f"SELECT vec_id, embedding FROM read_parquet('{SF}/embeddings.parquet') ORDER BY vec_id").fetchall()
    return {"docs": docs, "vectors": vectors}


@pytest.fixture(scope="module")
def results(spark):
    found = {}
    for name, query in queries().items():
        df = query(spark, SF)
        found[name] = (", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), df.toPandas())
    return found


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(results, given, name):
    schema, rows = results[name]
    assert schema == COLUMNS[name]
    if name not in ("op1_packing", "op6_top_k", "op9_licenses", "op11_conversation_repair"):
        key = "vec_id" if name == "op4_vector_duplicates" else "doc_id"
        assert sorted(rows[key]) == [i for i, _ in given["vectors" if key == "vec_id" else "docs"]]
    null = {"op9_licenses": list(rows), "op12_fill_in_middle": ["prefix_chars", "middle_chars"], "op13_sharding": ["grown_shard"]}
    assert not rows.drop(columns=null.get(name, [])).isna().any().any()


def test_packed_and_filed_ids(results, given):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in given["docs"]}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    at = 0
    for r in results["op8_token_files"][1].sort_values("doc_id").itertuples():
        own = [*ids[r.doc_id], 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), crc(own))
        at += len(own)
    pieces = results["op1_packing"][1]
    for doc, own in pieces.sort_values("start").groupby("doc_id"):
        whole, at = [*ids[doc], 2], 0
        for r in own.itertuples():
            assert r.start == at and r.ids_crc32 == crc(whole[at : at + r.length]) and r.doc_tokens == len(whole)
            at += r.length
        assert at == len(whole)
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 4096
    used = pieces.groupby("sequence_id")["length"].sum()
    assert len(used) <= -(-int(pieces["length"].sum()) // 4096) + 1


def components(nodes, links):
    up = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(up[a], up[b])
            if up[a] != low or up[b] != low:
                up[a] = up[b] = low
                changed = True
    return up


def test_near_documents(results, given):
    sets = {}
    for i, t in given["docs"]:
        words = (t or "").encode().lower().split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    for r in results["op2_minhash"][1].itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], r.doc_id == want[r.doc_id])


def test_near_vectors_and_held_out_marks(results, given):
    ids = [i for i, _ in given["vectors"]]
    x = np.array([v for _, v in given["vectors"]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    links = [(ids[a], ids[b]) for a, b in near]
    count, want = Counter(i for link in links for i in link), components(ids, links)
    rows = results["op4_vector_duplicates"][1]
    assert all((r.n_links, r.component_id, r.kept) == (count[r.vec_id], want[r.vec_id], r.vec_id == want[r.vec_id]) for r in rows.itertuples())
    for name, modulus, rest in (("op5_toxicity", 5, 0), ("op7_quality", 4, 2), ("op10_language_model", 5, 1)):
        rows = results[name][1]
        assert (rows["held_out"] == [zlib.crc32(str(i).encode()) % modulus == rest for i in rows["doc_id"]]).all()
    for name, bound in (("op5_toxicity", 0.5), ("op7_quality", 0.7)):
        rows = results[name][1]
        assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= bound)).all()


def test_licence_rows_with_repeated_lines(results):
    rows = results["op9_licenses"][1]
    assert len(rows) and (rows["first_sentence"] <= rows["last_sentence"]).all()
    assert results["op3_sentence_pieces"][1]["same"].all()
