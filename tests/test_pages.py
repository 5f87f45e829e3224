"""Main text of pages against a recursion over whole trees, and over broken mark-up."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siltline.functions.pages import main_lines, main_text

PRIOR = {"article": 50, "main": 30}


def grown(rng, depth):
    """A tree of (name, children) with blocks (p, words, words in links) as leaves."""
    children = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.random()
        if depth and kind < 0.5:
            children.append(grown(rng, depth - 1))
        elif kind < 0.6:
            children.append(("nav", [("p", 30, 0)]))
        else:
            children.append((rng.choice(["p", "h2", "li"]), rng.choice([0, 3, 12, 40, 80]), rng.choice([0, 0, 0, 4, 30])))
    return (rng.choice(["div", "section", "article", "main", "ul"]), children)


def rendered(node, count):
    name, *rest = node
    if len(rest) == 2:
        plain, linked = rest
        words = [f"w{next(count)}" for _ in range(plain + linked)]
        link = f"<a href='/x'>{' '.join(words[plain:])}</a>" if linked else ""
        node_text = " ".join(words)
        return f"<{name}>{' '.join(words[:plain])} {link}</{name}>", [(node_text, plain, linked)] if words else []
    html, blocks = "", []
    for child in rest[0]:
        h, b = rendered(child, count)
        html += h
        blocks.append((child, b))
    return f"<{name}>{html}</{name}>", blocks


def scored(node, blocks):
    """(worth, lines of the best span, any text) of a container, by looking at everything below it again."""
    worth, lines, best, any_text = 0, [], None, False
    for child, own in blocks:
        if child[0] == "nav":
            continue
        if len(child) == 3:
            for text, plain, linked in own:
                worth += plain - 2 * linked - 10 if linked else max(plain - 10, 0)
                lines += [text] if 2 * linked <= plain + linked else []
                any_text = True
        else:
            w, inner, all_lines, some = scored(child, own)
            worth, lines, any_text = worth + w, lines + all_lines, any_text or some
            if some and (best is None or w >= best[0]):
                best = (w, inner)
    worth += PRIOR.get(node[0], 0) if any_text else 0
    return worth, best[1] if best and best[0] >= 0.8 * worth else lines, lines, any_text


def test_scores_of_random_trees():
    import itertools

    rng = random.Random(3)
    found = 0
    for _ in range(1500):
        tree = ("div", [grown(rng, 3) for _ in range(rng.randrange(1, 4))])
        html, blocks = rendered(tree, itertools.count())
        worth, best, _, any_text = scored(("html", []), [(tree, blocks)])
        want = best if worth > 0 and any_text else []
        assert main_lines(f"<!DOCTYPE html><html><body>{html}</body></html>") == want, html
        found += bool(want)
    assert 300 < found < 1500


PROSE = "The operator said that the second survey is planned for spring, and that work starts if it finds no damage."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, None), ("", None), ("plain words alone", None), (f"<p>{PROSE}", PROSE), (f"<div><p>{PROSE}<p>{PROSE}</div>", f"{PROSE}\n{PROSE}"),
        (f"<div class='sidebar'><p>{PROSE}{PROSE}</p></div><div><p>{PROSE}</p></div>", PROSE), (f"<div><p>{PROSE}</p></div></section></p></b><footer>{PROSE}", PROSE), (f"<script>var t='<p>{PROSE}</p>';</script>", None),
        (f"<article><h1>A &amp; B</h1><p>{PROSE}<table><tr><td>{PROSE}</table><!-- {PROSE} --></article>", f"A & B\n{PROSE}"), (f"<ul><li><a href=/a>{PROSE}</a></ul>", None), (f"<nav><ul><li>x<article><p>{PROSE}</article></nav>", None),
        (f"<p title='a > b'>{PROSE}</p>", PROSE), (f"<article><p>{PROSE}", PROSE), (f"<div><nav>menu<p>{PROSE}</div><div><p>{PROSE}</p></div>", PROSE), ("<article><p>Short.</article>", "Short."), (f"<p>1 < 2 {PROSE}<", f"1 < 2 {PROSE}<"),
    ],
)
def test_broken_and_odd_pages(spark, html, want):
    assert spark.createDataFrame([(html,)], "h string").select(main_text(F.col("h")).alias("x")).first().x == want


def test_very_deep_and_very_long_pages():
    deep = "<div>" * 50_000 + f"<p>{PROSE}</p>"
    assert main_lines(deep) == [PROSE]
    long = "<article>" + f"<p>{PROSE}</p>" * 20_000 + "</article>"
    assert len(main_lines(long)) == 20_000
