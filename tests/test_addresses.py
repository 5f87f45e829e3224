"""Literal addresses by expressions and by the standard library."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from siltline.functions import urls as U
from siltline.functions.facts import address_is_global
from siltline.sources import completions


def test_literal_addresses(spark):
    rng = random.Random(1)
    hosts = """:: ::1 ::2 ::ffff:10.0.0.1 ::ffff:8.8.8.8 2001:1::1 2001:1::3 2001:3::5 2001:4:112::9 2001:4:113::9 2001:20:: 2001:2f::1 2001:30:: 2001:40:: 2001:db8::1 2002::1 64:ff9b:1:: 64:ff9b::8.8.8.8 100::5 100:0:0:1::
        2606:4700::1111 ff02::1 1::2::3 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 fd00:: febf:: fec0:: 2001:1ff:: 2001:200:: ::8.8.8.8""".split()
    heads, seconds = [0x2001, 0x2002, 0xFC00, 0xFE80, 0x100, 0x64, 0], [0, 1, 3, 4, 0x20, 0x3F, 0x40, 0xDB8, 0x1FF, 0x200, 0xFF9B]
    for _ in range(300):
        hosts.append(str(ipaddress.IPv6Address(rng.getrandbits(128) if rng.random() < 0.3 else rng.choice(heads) << 112 | rng.choice(seconds) << 96 | rng.getrandbits(8))))
    rows = spark.createDataFrame([(f"http://[{h}]/x", h) for h in hosts], "url string, host string").coalesce(1)
    for r in rows.select("host", U.why_not_dialable(F.col("url")).alias("why"), address_is_global(F.col("host")).alias("library")).collect():
        assert (r.why is None) == (r.library is not False), r.host
    (row,) = spark.createDataFrame([("FTP://x.example/",)], "u string").select(U.why_not_dialable(F.col("u"))).collect()
    assert row[0] == "scheme 'ftp' is not fetchable"


def test_runs_of_arrays_objects_and_text_between(spark, tmp_path):
    (tmp_path / "a.json").write_text('build 1\n[{"model": "/m/a.gguf", "avg_ts": 1.5, "n_prompt": 5}]\nnoise, {"model_filename": "b.gguf", "avg_ts": 2}  \n[]')
    (tmp_path / "b.json").write_text("nothing here")
    got = [(r.model, r.n_prompt, r.avg_ts, r.seq) for r in completions.load_runs(spark, f"file://{tmp_path}").orderBy("seq").collect()]
    assert got == [("a.gguf", 5, 1.5, 0), ("b.gguf", 0, 2.0, 1)]
