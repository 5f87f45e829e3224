"""The pipeline against a slow version of each stage, and without its folders."""

from __future__ import annotations

import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from siltline.llm import quality, toxicity
from siltline.llm.common import fold
from siltline.llm.wordbpe import vocabulary_path

from .conftest import prose
from .test_duplicates import brute, shingles

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(21)
    docs, labels = [], []
    for i in range(240):
        text = prose(rng, rng.randrange(15, 120))
        good, toxic = i % 4 != 0, i % 5 == 1
        if not good:
            text = "\n".join(" ".join(w + "###" for w in line.split()) for line in text.split("\n"))
        if toxic:
            text = text.replace(" ", " scum ", 1) + " idiot"
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), int(toxic)))
    docs += [(300 + i, docs[i * 3 + 2][1], "en", "s", 1) for i in range(30)]
    docs += [(400 + i, docs[i * 3 + 2][1] + " tail end", "en", "s", 1) for i in range(20)]
    docs += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, docs[2][1], "en", "s", 1), (None, None, None, None, None), (502, docs[3][1], "en", "s", 1), (502, docs[3][1], "en", "s", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_against_slow_versions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    columns, outs = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        outs[name] = (before, docs)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    key = lambda df: sorted(map(tuple, df.select("doc_id", "text").collect()), key=str)
    before, after = outs["quality"]
    crf = quality.train_quality(before, labels, "doc_id", "text", "quality", fold("k", 4) != 2)
    assert key(after) == sorted((r for r in key(before) if quality.quality_scores([(r[1] or "").encode()], crf)[0] >= 0.7), key=str)
    assert not any("###" in (r[1] or "") for r in key(after))
    before, after = outs["toxicity"]
    net = toxicity.learn_toxicity(before, labels, "doc_id", "text", "toxic", fold("k", 5) != 0)
    assert key(after) == sorted((r for r in key(before) if toxicity.toxicity_scores([(r[1] or "").encode()], toxicity.Lookup(net))[0] < 0.5), key=str)
    before, after = outs["near-duplicates"]
    rows = key(before)
    sets, component = brute(rows)
    texts = {s for i, s in sets.items() if s}
    want = [r for r in rows if (component[r[0]] == r[0] if r[0] is not None else shingles(r[1]) not in texts)]
    assert key(after) == sorted(want, key=str)
    before, after = outs["packing"]
    library = Tokenizer.from_file(vocabulary_path())
    assert sorted(r.length for r in after.collect()) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in key(before))
    whole = corpus_pipeline.run(spark, sf)
    pieces = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(whole) == pieces(after)


def test_empty_tables(spark, sf, tmp_path):
    path = str(tmp_path)
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_the_rest_stands_without_these_folders(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'plan_day' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, check=False)
    assert done.returncode == 0, done.stderr
