"""Table functions in SQL text, and quantities against a scanner without patterns."""

from __future__ import annotations

import random
from decimal import Context, Decimal

from pyspark.sql import functions as F

from siltline.functions import table_functions
from siltline.functions import text as T
from siltline.functions.facts import NOT_A_UNIT, POWERS, numeric_facts, quantities


def scanned(text):
    """(value, raw, unit) by reading signs one after the other."""
    out, i, n = [], 0, len(text)
    word = lambda c: c.isalnum() or c == "_"
    while i < n:
        if i and (word(text[i - 1]) or text[i - 1] in ".-"):
            i += 1
            continue
        j, currency, sign = i, "", ""
        if text[j] in "$£€₹":
            currency, j = text[j], j + 1
            if j < n and text[j].isspace():
                j += 1
        if j < n and text[j] == "-":
            sign, j = "-", j + 1
        start = j
        while j < n and text[j].isdigit():
            j += 1
        if j == start:
            i += 1
            continue
        grouped = j
        if j - start <= 3:
            while grouped < n and text[grouped] == "," and text[grouped + 1 : grouped + 4].isdigit() and len(text[grouped + 1 : grouped + 4]) == 3:
                grouped += 4
        j = grouped
        if j + 1 < n and text[j] == "." and text[j + 1].isdigit():
            j += 1
            while j < n and text[j].isdigit():
                j += 1
        digits = text[start:j]
        while j < n and text[j].isspace():
            j += 1
        power = next((p for p in ("percent", "per cent", "%", "thousand", "mn", "million", "bn", "billion", "tn", "trillion") if text[j : j + len(p)].lower() == p), "")
        j += len(power)
        while j < n and text[j].isspace():
            j += 1
        stop = j
        if stop < n and text[stop].isascii() and text[stop].isalpha():
            while stop < n and text[stop].isascii() and (text[stop].isalpha() or text[stop] == "-"):
                stop += 1
        unit = text[j:stop].lower()
        i = max(stop, i + 1)
        unit = unit[:-1] if len(unit) > 3 and unit.endswith("s") and not unit.endswith("ss") else unit
        unit = "" if unit in NOT_A_UNIT else unit
        value = Context(prec=500).multiply(Decimal(digits.replace(",", "")), Decimal(10 ** POWERS.get(power, 0)))
        unit = "%" if power in ("percent", "per cent", "%") else currency or unit
        if not unit and digits.isdigit() and len(digits) == 4 and 1900 <= value <= 2100:
            continue
        if unit or value > 2:
            out.append((value.copy_negate() if sign else value, currency + sign + digits, unit))
    return out


def test_quantities_by_another_reading():
    rng = random.Random(8)
    parts = ["5", "12", "1,200", "2.5", "1999", "0.5", "$", "€", "-", " ", " ", " ", " million ", "bn", "%", " per cent", " the ", " reactors", "GW-h", ".", ",", "x", "é", "_", "1,20", "98765432109876543210987654321098", "\n"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert [(v, r.replace(" ", ""), u) for v, r, u, _ in quantities(text)] == scanned(text), text


def test_no_quantity_is_dropped(spark):
    text = "99999999999999999999999999999999 units, then 9 million units and 9,000,000 units"
    (facts,) = spark.createDataFrame([(text,)], "t string").select(numeric_facts(F.col("t"))).first()
    assert [(f.value, f.raw, f.unit) for f in facts] == [(None, "9" * 32, "unit"), (Decimal(9_000_000), "9", "unit")]


def test_sql_text_calls_them(spark):
    table_functions.register(spark, limit=3, size=7, overlap=2)
    rng = random.Random(1)
    rows = []
    for doc in range(40):
        for n in range(rng.randrange(0, 6)):
            rows.append((doc, n, rng.choice([None, "", "  ", " ".join(rng.choice(["12 reactors", "a", "b\tc", "$5", "7 per cent"]) for _ in range(rng.randrange(0, 9)))])))
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "doc_id long, n int, line string").repartition(3)
    lines.createOrReplaceTempView("lines_of_texts")
    whole = {}
    for doc, _, line in sorted(rows, key=lambda r: r[:2]):
        whole[doc] = whole.get(doc, "") + "\n" + (line or "")
    texts = spark.createDataFrame(list(whole.items()), "doc_id long, text string")
    got = spark.sql("SELECT key, chunk, words, text FROM text_chunks(TABLE(SELECT doc_id, line, n FROM lines_of_texts) PARTITION BY doc_id ORDER BY n)")
    want = texts.select(F.col("doc_id").cast("string"), F.posexplode(T.chunks(F.col("text"), 7, 2)))
    assert sorted((r.key, r.chunk, r.text) for r in got.collect()) == sorted(map(tuple, want.collect())) and all(r.words == len(r.text.split()) for r in got.collect())
    facts = spark.sql("SELECT key, position, value, unit FROM numeric_facts(TABLE(SELECT doc_id, line, n FROM lines_of_texts) PARTITION BY doc_id ORDER BY n) ORDER BY key, position")
    parted = {}
    for doc, _, line in sorted(rows, key=lambda r: r[:2]):
        own = parted.setdefault(str(doc), [])
        own += [(v, u) for v, _, u, _ in quantities(line) if (v, u) not in own]
    seen = {}
    for r in facts.collect():
        seen.setdefault(r.key, []).append((r.value, r.unit))
        assert r.position == len(seen[r.key]) - 1
    assert seen == {k: list(dict.fromkeys(v))[:3] for k, v in parted.items() if v}
    spark.catalog.dropTempView("lines_of_texts")
