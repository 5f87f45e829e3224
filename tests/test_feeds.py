"""Feeds with breaks in their mark-up, in tables and in files."""

from __future__ import annotations

import random

import pytest

from siltline.sources.feeds import candidates, candidates_of_files, entries, read_feed_files

HEAD, FOOT = '<?xml version="1.0" encoding="utf-8"?><rss version="2.0"><channel><title>F</title><link>https://f.example/</link>', "</channel></rss>"


def item(n: int, title: str | None = None) -> str:
    return f"<item><title>{title or f'T{n}'}</title><link>https://x.example/{n}</link><pubDate>Fri, 21 Aug 2026 06:00:00 GMT</pubDate></item>"


def row(n: int, title: str | None = None) -> tuple:
    return f"https://x.example/{n}", title or f"T{n}", "2026-08-21T06:00:00Z"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (HEAD + item(1) + item(2) + FOOT, [row(1), row(2)]),
        (HEAD + item(1) + "<item><title>broken <b></title><link>https://x.example/5</item>" + item(2) + FOOT, [row(1), ("https://x.example/5", "broken", None), row(2)]),
        (HEAD + item(1) + "</wrong><bad attr='x<item>" + item(2) + FOOT, [row(1), (None, None, None), row(2)]),
        (HEAD + item(1) + "<item><title>no end<link>https://x.example/7</link>" + item(2), [row(1), ("https://x.example/7", "no end", None), row(2)]),
        (HEAD + item(1, "A &amp; B &nbsp;&bogus; C") + FOOT, [row(1, "A & B \xa0&bogus; C")]),
        (HEAD + item(1, "<![CDATA[a <item> & b]]>") + FOOT, [row(1, "a <item> & b")]),
        (HEAD + item(1) + "<item><title>cut off", [row(1)]),
        (HEAD + item(1) + "<item><title>cut</title><link>https://x.example/9</li", [row(1)]),
        ("<rss><channel><title>Broken<link>https://b.example/<item><title>Truncated", []),
        ("no mark-up", []), ("", []), ("<item/>", []),
        ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="xhtml"><div>A <b>bold</b> one</div></title><link rel="self" href="https://y.example/self"/><link href="https://y.example/b"/><source><title>other</title><link href="https://z.example/"/></source><updated>2026-08-22T08:00:00Z</updated></entry></feed>', [("https://y.example/b", "A bold one", "2026-08-22T08:00:00Z")]),
        ('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>T</a:title><a:link href="https://y.example/c"/></a:entry></a:feed>', [("https://y.example/c", "T", None)]),
        ('<item><guid>https://x.example/g</guid><media:title>m</media:title><dc:date>2026-08-22T08:00:00+02:00</dc:date></item><item><guid isPermaLink="false">https://x.example/h</guid></item>', [("https://x.example/g", None, "2026-08-22T06:00:00Z"), (None, None, None)]),
    ],
)
def test_entries_around_breaks(body, want):
    assert list(entries([body])) == want


def test_pieces_give_the_same_entries():
    rng = random.Random(1)
    body = HEAD + "".join(item(i, rng.choice([None, "x &lt; y", "<![CDATA[ <item> ]]>", "é ü"])) + rng.choice(["", "</x>", "<!-- <item> -->", "<bad"]) for i in range(200)) + FOOT
    want = list(entries([body]))
    assert len(want) == 200
    for size in (1, 7, 64, 1000):
        assert list(entries(body[i : i + size] for i in range(0, len(body), size))) == want


def test_files_and_tables_agree(spark, tmp_path):
    bodies = {"a": HEAD + item(1) + "<bad " + item(2) + item(1), "b": HEAD + item(3) + FOOT, "broken": "<rss><item><title>Truncated", "empty": ""}
    for name, body in bodies.items():
        (tmp_path / f"{name}.xml").write_text(body)
    (tmp_path / "latin.xml").write_bytes('<?xml version="1.0" encoding="iso-8859-1"?><rss>'.encode() + item(8, "é").encode("latin-1"))
    (tmp_path / "_part.xml").write_text(HEAD + item(99))
    files = read_feed_files(spark, f"file://{tmp_path}", piece=64, split_bytes=1)
    assert files.rdd.getNumPartitions() == 5 and read_feed_files(spark, f"file://{tmp_path}").rdd.getNumPartitions() == 1
    assert sorted((r.file.rpartition("/")[2], r.position, r.link, r.title) for r in files.collect()) == [("a.xml", 0, "https://x.example/1", "T1"), ("a.xml", 1, "https://x.example/2", "T2"), ("a.xml", 2, "https://x.example/1", "T1"), ("b.xml", 0, "https://x.example/3", "T3"), ("latin.xml", 0, "https://x.example/8", "é")]
    known = spark.createDataFrame([(n, "v", 1, "draft" if n == "b" else "active", None) for n in bodies], "id string, vertical string, tier int, status string, retired_on string")
    texts = known.join(spark.createDataFrame(list(bodies.items()), "id string, body string"), "id")
    got = sorted(map(tuple, candidates_of_files(known, f"file://{tmp_path}").collect()))
    assert got == sorted(map(tuple, candidates(texts).collect())) and [r[3] for r in got] == ["https://x.example/1", "https://x.example/2"]
    (tmp_path / "none").mkdir()
    assert read_feed_files(spark, f"file://{tmp_path}/none").collect() == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("siltline")]
