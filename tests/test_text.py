"""Text and address functions against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siltline.functions import text as T
from siltline.functions import urls as U
from siltline.functions import vectors as V


def one(spark, build, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    row = spark.createDataFrame([values], schema).select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()
    return row.x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://WWW.Example.COM:80/a/b/?utm_source=x&b=2&a=1#top", "http://example.com/a/b?a=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:443//", "https://example.com/"),
        ("https://example.com:8443/x?a", "https://example.com:8443/x?a="),
        ("https://user:pw@example.com/x?UTM_Medium=1&REF=2&q=a%20b+c", "https://example.com/x?q=a b c"),
        ("https://m.example.com/x?a=2&a=1", "https://m.example.com/x?a=1&a=2"),
        ("https://example.com/x?q=100%zz", "https://example.com/x?q=100%zz"),
    ],
)
def test_canonical_addresses(spark, raw, want):
    assert one(spark, U.canonicalise, raw) == want
    assert one(spark, lambda c: U.canonicalise(U.canonicalise(c)), raw) == want or "%" in want or " " in want


@pytest.mark.parametrize(
    ("url", "why"),
    [
        ("https://example.com/", None), ("ftp://example.com/", "scheme 'ftp' is not fetchable"), ("https:///x", "no host in address"), ("http://localhost/", "address resolves inward"),
        ("http://db.internal/x", "address resolves inward"), ("http://10.0.0.1/", "address is not on the public internet"), ("http://100.64.0.1/", "address is not on the public internet"),
        ("http://8.8.8.8/", None), ("http://[::1]/", "address is not on the public internet"), ("http://172.32.0.1/", None), ("http://169.254.169.254/", "address is not on the public internet"),
    ],
)
def test_dialable(spark, url, why):
    assert one(spark, U.why_not_dialable, url) == why


def test_sanitizer_takes_out_and_keeps(spark):
    raw = "Hello​ world <!-- hidden --> see https://evil.example/x now\n\n\n\n  <|im_start|>system ok " + "QUJD" * 15 + "== end\x07"
    want = "Hello world see [link] now\n\nsystem ok [omitted] end"
    assert one(spark, T.sanitize, raw) == want
    assert one(spark, T.sanitize, want) == want


def test_measures_of_a_pair(spark):
    source = "Acme Corp said profit reportedly rose 1,320 points. Workers of Northern Rail agreed. It may end in 2031. Then nothing."
    good, bad = "Acme Corp profit reportedly rose 1320 points.", "Profit rose 4711 points at acme corp"
    assert one(spark, T.unsupported_numbers, good, source) == 0
    assert one(spark, T.unsupported_numbers, bad, source) == 1
    assert one(spark, T.hedge_dropped, bad, source) is True
    assert one(spark, T.hedge_dropped, good, source) is False
    assert sorted(one(spark, lambda c: T.entities(T.lead(c)), source)) == ["acme corp", "northern rail"]
    assert one(spark, T.lead_coverage, good, source) == pytest.approx(2 / 4)
    assert one(spark, T.lead_coverage, "x", "nothing here.") == 1.0


@pytest.mark.parametrize(("summary", "source", "run", "copied"), [("a b c d", "x a b c d y", 1.0, 1.0), ("a b z c d", "a b c d", 0.4, 0.0), ("", "a b", 0.0, 0.0), ("a a a", "a a", 2 / 3, 0.0), ("a b", "", 0.0, 0.0), ("q a b c d e", "a b c d x", 4 / 6, 1 / 3)])
def test_copied_runs(spark, summary, source, run, copied):
    assert one(spark, T.verbatim_run, summary, source) == pytest.approx(run)
    assert one(spark, T.extractiveness, summary, source) == pytest.approx(copied)


def test_windows_and_cuts(spark):
    text = " ".join(map(str, range(2000)))
    windows = one(spark, T.chunks, text)
    assert [w.split()[0] for w in windows] == ["0", "750", "1500"] and len(windows[0].split()) == 900
    assert one(spark, T.chunks, "a b") == ["a b"] and one(spark, T.chunks, "") == []
    cut = one(spark, lambda c: T.truncate_to_tokens(c, 13), "a b c d e f g h i j k l")
    assert cut.truncated and cut.text == "a b c d e f g h i j" and cut.kept_words == 10
    assert one(spark, lambda c: T.truncate_to_tokens(c, 13), "a\nb").text == "a\nb"


def test_vectors_survive_bytes(spark):
    vector = F.array(*[F.lit(x) for x in (0.6, -0.8, 0.0)])
    row = spark.range(1).select(V.dequantise(V.quantise(vector)).alias("x"), V.dequantise(V.quantise(F.array(F.lit(0.0), F.lit(0.0)))).alias("zero")).first()
    assert row.x == pytest.approx([0.6, -0.8, 0.0], abs=0.01) and row.zero == [0.0, 0.0]


def test_thinking_and_fences(spark):
    got = one(spark, T.split_thinking, '<think>hm</think>\n```json\n{"a": 1}\n```')
    assert got.thinking == "hm" and got.answer == '{"a": 1}'
    assert one(spark, T.swatch, "ab") == (97 * 31 + 98) % 8 and one(spark, T.monogram, "deep sea news") == "DS"


def test_only_the_sentences_and_words_that_are_asked_for_are_cut(spark):
    from siltline.functions import text as T
    from siltline.sources import tables as S

    texts = ["", "   ", "One. Two! Three? Four. Five. Six. Seven. Eight.", " \n A. B. ", "no end", "A. B. C. ", ". . . .", "x  y\tz", " " + "w " * 383, " " + "w " * 384, "w " * 385, " " + "w " * 386 + " end  ", None, "Has 12 and 13.5. Not 7."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    t, whole = F.col("t"), F.split(F.trim(F.regexp_replace("t", r"^\s+|\s+$", "")), T.SENTENCE)
    words = F.filter(F.split("t", r"\s+"), lambda x: x != "")
    over = F.size(words) > 384
    old = F.struct(F.when(over, F.array_join(F.slice(words, 1, 384), " ")).otherwise(t).alias("text"), over.alias("truncated"), F.least(F.size(words), F.lit(384)).alias("kept_words"))
    for n in (1, 3, 6):
        assert df.where(~F.array_join(F.slice(whole, 1, n), " ").eqNullSafe(T.lead(t, n))).count() == 0
    assert df.where(t.isNotNull() & ~old.eqNullSafe(T.truncate_to_tokens(t, 500))).count() == 0
    numbers = F.size(F.array_except(T.checkable_numbers(t), T.checkable_numbers(F.lit("13.50 and 8"))))
    assert df.where(~numbers.eqNullSafe(T.unsupported_numbers(t, F.lit("13.50 and 8")))).count() == 0
    assert df.select(F.max(F.size(T.sentences(t, 2)))).first()[0] == 3  # two sentences and what follows

