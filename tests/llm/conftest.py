from __future__ import annotations

import random

import pytest

SYLLABLES = "ta ri mo len sha kor vi nu del pra".split()


def prose(rng: random.Random, n: int) -> str:
    """n words in lines of about twelve."""
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empty and very long texts, copies, near copies, repeated rows, odd signs."""
    rng = random.Random(1)
    base = prose(rng, 120)
    long = prose(rng, 30_000)
    rows = [(1, base), (2, base), (3, base.replace("ta", "zu", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "one two three"), (8, "one two three"), (9, long), (10, long + " tail"), (11, "É́à ñ <|endoftext|> '' 42.5%!!! 日本 \x00 x\x85y"), (11, "É́à ñ <|endoftext|> '' 42.5%!!! 日本 \x00 x\x85y"), (None, base), (None, None)]
    return rows + [(20 + i, prose(rng, rng.randrange(1, 300))) for i in range(40)]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    """The rows with further columns of clashing names."""
    clash = [(i, t, "en", "s", 0, "a", 1.0, 2, [1], "b", True) for i, t in awkward]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n_chars long, k string, t double, id int, row array<int>, score string, kept boolean").repartition(3).cache()
