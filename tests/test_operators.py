"""Operators at their edges: caps, thresholds, gates, ledgers, streams."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siltline.config import Collect, Evaluation, TierWeights
from siltline.functions.facts import numeric_facts, robots_allows
from siltline.functions.pages import main_text
from siltline.operators import articles, checks, corpus, decide, digest, drift, ledger, rank, retention, route
from siltline.sources import contracts, feeds


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_caps_match_a_greedy_pass(spark):
    rng = random.Random(3)
    cands = [("d", "v", f"u{i}", f"k{i}", str(rng.randrange(4)), rng.choice((1, 2, 3)), rng.choice((None, "2026-01-01", "2026-01-02"))) for i in range(60)]
    df = spark.createDataFrame(cands, "day string, vertical string, canonical_url string, url_key string, source_id string, tier int, published_at string")
    none = spark.createDataFrame([], "url_key string")
    verticals = spark.createDataFrame([("v", 7, 1)], "vertical string, daily_cap int, min_feeds int")
    live = spark.createDataFrame([("v", 4)], "vertical string, live_feeds long")
    got = [r.canonical_url for r in rank.planned(rank.scored(rank.stories(df), none, none), verticals, live).orderBy("ordinal").collect()]
    weight = {1: 1.0, 2: 0.6, 3: 0.3}
    order = sorted(cands, key=lambda c: c[2])
    order.sort(key=lambda c: c[6] or "", reverse=True)
    order.sort(key=lambda c: weight[c[5]], reverse=True)
    took, per = [], {}
    for c in order:
        if len(took) < 7 and per.get(c[4], 0) < 2:
            per[c[4]] = per.get(c[4], 0) + 1
            took.append(c[2])
    assert got == took
    closed = spark.createDataFrame([("v", 7, 5)], "vertical string, daily_cap int, min_feeds int")
    assert rank.planned(rank.scored(rank.stories(df), none, none), closed, live).count() == 0


def test_settings_are_checked():
    with pytest.raises(ValueError):
        TierWeights(0.1, 0.6, 0.3)
    with pytest.raises(ValueError):
        Evaluation(band_high_min=0.4)
    assert Collect().max_per_source == 2


def test_drift_thresholds_are_strict(spark):
    make = lambda words, copy, score: spark.createDataFrame([("d", words, copy, score)], "domain string, words double, extractiveness double, hhem double")
    assert rows_of(drift.compare(make(60.0, 0.5, 0.9), make(100.0, 0.5, 0.9))) == []
    assert [r[1] for r in rows_of(drift.compare(make(59.0, 0.9, 0.9), make(100.0, 0.5, 0.9)))] == ["shorter_sources", "more_copying", "scoring_chrome"]
    assert [r[1] for r in rows_of(drift.compare(make(59.0, 0.5, 0.8), make(100.0, 0.5, 0.9)))] == ["shorter_sources"]
    hosts = spark.createDataFrame([("a", i < 8) for i in range(10)] + [("b", i < 7) for i in range(10)], "host string, ok boolean")
    assert {r.host: r.rotting for r in drift.rot(hosts, "host", F.col("ok")).collect()} == {"a": False, "b": True}


@pytest.mark.parametrize(
    ("own", "other", "verdict"),
    [((0.90, 0.95, 19), (0.99, 40), "rescore_candidates"), ((0.90, 0.85, 20), (0.90, 20), "switch_and_pause"), ((0.90, 0.90, 20), (0.99, 19), "confirmed"), ((0.90, 0.79, 20), (0.80, 20), "rescore_candidates"), ((0.90, 0.85, 20), (0.86, 20), "confirmed")],
)
def test_decisions(spark, own, other, verdict):
    rows = [("me", own[0], own[1], own[2], 0), ("you", 0.9, other[0], other[1], 1)]
    df = spark.createDataFrame(rows, "model_id string, leaderboard_hhem double, measured_hhem double, articles int, position int")
    assert decide.decide(df, "me").first().verdict == verdict
    assert decide.to_rows(df, decide.decide(df, "me"), "me").count() == 2
    assert decide.decide(df.where("model_id = 'me'"), "me").count() == 1


def test_stamps_and_appends(spark):
    now = spark.createDataFrame([("a", "1", None), ("b", "1", "x"), ("c", "2", "x"), ("d", "1", "y"), ("e", "1", "x")], "item string, fingerprint string, output_digest string")
    was = spark.createDataFrame([("b", "1", "x"), ("c", "1", "x"), ("d", "1", "x"), ("e", "1", None)], "item string, fingerprint string, output_digest string")
    seen = {r.item: r.observation for r in ledger.classify(now, was, "item").collect()}
    assert seen == {"a": "first_run", "b": "unchanged", "c": "inputs_changed", "d": "determinism_violation", "e": "unchanged"}
    fresh = spark.createDataFrame([("k", 2), ("k", 1), ("z", 3)], "key string, n int")
    assert rows_of(ledger.append_new(fresh, spark.createDataFrame([("z",)], "key string"), "key", "n")) == [("k", 1)]


def test_days_are_appended_not_reordered(spark):
    before = spark.createDataFrame([("d", "v-01", 1), ("d", "v-02", 2)], "day string, item_id string, position int").withColumn("introduced_by_run", F.lit(1))
    now = spark.createDataFrame([("d", "v-03", 1), ("d", "v-01", 2)], "day string, item_id string, position int")
    got = digest.append_items(before, now, 2).orderBy("position").select("item_id", "introduced_by_run").collect()
    assert [tuple(r) for r in got] == [("v-01", 1), ("v-02", 1), ("v-03", 2)]


def test_article_and_summary_gates(spark):
    long = "word " * 300
    rows = spark.createDataFrame([(1, "t", "ok", long), (2, None, "ok", long), (3, "t", "blocked", None), (4, "t", "ok", "few words"), (5, "t", "ok", None), (6, "t", "transient", long)], "id int, title string, outcome string, body string")
    got = {r.id: (r.status, r.failure_detail) for r in articles.to_articles(rows, F.col("body")).collect()}
    assert got[1] == ("ok", None) and got[2][0] == "extract_failed" and got[3][0] == "robots_denied" and got[4] == ("extract_failed", "only 2 words extracted; page furniture is short") and got[5][0] == "extract_failed" and got[6][0] == "fetch_failed"
    assert articles.to_articles(rows.where("id = 1"), F.col("body")).select("token_count").first()[0] == 390
    body = " ".join(["word"] * 40)
    replies = [(1, "ok", "stop", f'{{"summary": "{body}", "key_points": ["a"]}}'), (2, "ok", "stop", f'{{"summary": "{body}", "key_points": [], "x": 1}}'), (3, "ok", "length", "{"), (4, "failed", "stop", ""), (5, "ok", "stop", '{"summary": "short", "key_points": []}'), (6, "ok", "stop", f'<think>plan</think>{{"summary": "{body}", "key_points": ["a"]}}')]
    got = {r.id: r.status for r in articles.to_summaries(spark.createDataFrame(replies, "id int, article_status string, finish_reason string, content string")).collect()}
    assert got == {1: "ok", 2: "failed", 3: "failed", 4: "failed", 5: "failed", 6: "failed"}


def test_quantities(spark):
    text = "COVID-19 hit in 2020. Sales rose 12 percent to $3.5 billion; 1,200 workers and 1,200 workers left, -5 degrees. About 2 of 3 towns. 15 m deep."
    got = [(f.value, f.unit, f.raw) for f in spark.createDataFrame([(text,)], "t string").select(numeric_facts(F.col("t")).alias("x")).first().x]
    assert (Decimal(12), "%", "12") in [(v.normalize() if v == 12 else v, u, r) for v, u, r in got]
    assert any(v == Decimal(3500000000) and u == "$" for v, u, _ in got)
    assert sum(u == "worker" for _, u, _ in got) == 1 and not any(v in (19, 2020) for v, _, _ in got)
    assert any(v == -5 and u == "degree" for v, u, _ in got) and any(v == 15 and u == "m" for v, u, _ in got)


def test_routes(spark):
    facts = "array<struct<value: decimal(38,10), raw: string, unit: string, context: string>>"
    schema = f"id int, summary_status string, finish_reason string, shape_ok boolean, kind string, points array<struct<label: string, fact_index: int>>, steps array<string>, caption string, reason string, facts {facts}"
    known = [(Decimal(i), str(i), u, "") for i, u in enumerate(("mw", "mw", "mw", "jobs"))]
    bars = [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    rows = [(1, "ok", "stop", True, "chart", bars, [], "cap", "r", known), (2, "ok", "stop", True, "chart", [("a", 9)], [], "cap", "r", known), (3, "ok", "stop", True, "diagram", [], ["x", "y", "z"], "cap", "r", known), (4, "failed", "stop", True, "chart", bars, [], "", "r", known), (5, "ok", "stop", True, "chart", bars[2:], [], "", "r", known), (6, "ok", "stop", True, "none", [], [], "", "dull", known)]
    got = {r.id: r for r in route.to_routes(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].kind == "chart" and '"caption":""' in got[1].spec and got[1].spec.count("label") == 3 and got[1].alt_text.startswith("Bar chart. a 0 mw; b 1 mw")
    assert got[2].kind == "none" and "does not contain" in got[2].rationale
    assert got[3].spec.splitlines()[:3] == ["%% cap", "flowchart TD", '    n0["x"]'] and got[3].spec.splitlines()[-1] == "    n1 --> n2"
    assert [got[i].kind for i in (4, 5, 6)] == ["none"] * 3 and got[6].rationale == "dull"


def test_percentiles_are_nearest_rank_half_even(spark):
    rows = spark.createDataFrame([(v,) for v in (10, 20, 30, 40, 50, 60)], "v int")
    got = corpus.percentiles(rows, "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0}).first()
    assert (got.p50, got.p90, got.p0) == (30, 50, 10)  # 2.5 -> 2, 4.5 -> 4
    assert corpus.percentiles(rows.where("v < 0"), "v", {"p": 0.5}).count() <= 1


def test_costs_interpolate(spark):
    points = spark.createDataFrame([("m", 100, 10.0), ("m", 300, 20.0)], "model string, size int, speed double")
    wanted = spark.createDataFrame([("m", t) for t in (50, 100, 200, 900)], "model string, tokens int")
    assert {r.tokens: r.speed for r in corpus.interpolated(points, wanted).collect()} == {50: 10.0, 100: 10.0, 200: 15.0, 900: 20.0}


def test_pruning_has_a_fuse(spark):
    rows = spark.createDataFrame([(f"2026/01/{d:02d}/a.svg", 10) for d in range(1, 9)] + [("2026/01/01/digest.json", 5), ("x/y.svg", 5), ("2026/13/01/a.svg", 5)], "path string, length long")
    today = F.lit("2026-08-01").cast("date")
    assert tuple(retention.prune_report(rows, today, 6, False, 5).first()) == (8, 5, False, True)
    assert tuple(retention.prune_report(rows, today, -1, False, 5).first()) == (0, 0, False, False)
    assert [r.path[8:10] for r in retention.allowed(rows, today, 6, 2).collect()] == ["01", "02"]


def test_violations_name_the_rule(spark):
    rows = spark.createDataFrame([("d", "v", 1, "v-01", "k", "u", 1, 1, 2.0), ("d", "v", 3, "w-03", "k", "u", 9, 0, 3.0)], "day string, vertical string, ordinal int, item_id string, url_key string, canonical_url string, tier int, carried_by int, rank_score double")
    rules = {r.rule for r in checks.check_plan(rows).collect()}
    assert {"stories are distinct", "scores do not rise", "numbers have no gaps", "tier is known", "key is the digest of the address", "item id is addressed by its vertical"} <= rules


def test_feeds_and_pages(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>https://www.x.example/a?utm_source=f</link><pubDate>Sat, 22 Aug 2026 10:00:00 +0200</pubDate></item><item><link>https://x.example/a/</link></item><item><title>no link</title></item><item><link>ftp://x/</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="https://y.example/b"/><updated>2026-08-22T08:00:00Z</updated></entry></feed>'
    schema = "id string, vertical string, tier int, status string, retired_on string, body string"
    df = spark.createDataFrame([("f", "v", 1, "active", None, rss), ("g", "v", 2, "active", None, atom), ("h", "v", 2, "draft", None, atom), ("i", "v", 2, "active", None, "<broken")], schema)
    got = {(r.source_id, r.canonical_url): (r.title, r.published_at) for r in feeds.candidates(df).collect()}
    assert got == {("f", "https://x.example/a"): ("A & B", "2026-08-22T08:00:00Z"), ("g", "https://y.example/b"): ("T", "2026-08-22T08:00:00Z")}
    html = "<html><nav>menu</nav><article><h1>Head</h1><p>Body text<script>x()</script></p><table><tr><td>cell</td></tr></table></article><footer>foot</footer></html>"
    assert spark.createDataFrame([(html,)], "h string").select(main_text(F.col("h")).alias("x")).first().x == "Head\nBody text"
    robots = spark.createDataFrame([("User-agent: *\nDisallow: /private", "https://x/private/a"), ("User-agent: *\nDisallow: /private", "https://x/a"), (None, "https://x/a")], "r string, u string")
    assert [r.x for r in robots.select(robots_allows(F.col("r"), "bot", F.col("u")).alias("x")).collect()] == [False, True, False]


def test_contracts_and_ledgers(spark, tmp_path):
    assert set(contracts.exported()) == set(contracts.DDL) and contracts.schema("eval_row").names[-1] == "score_ms" and len(contracts.schema("eval_row")) == 31
    path = str(tmp_path / "scores.csv")
    assert contracts.read_ledger(spark, "validation", path).count() == 0
    row = spark.createDataFrame([tuple(["v", "m", True, False, 0.9, 0.8, 20, "2026-08-22", "c", "r", "confirmed", 'a, "quoted" detail'])], contracts.schema("validation"))
    contracts.append_csv(row, "validation", path)
    contracts.append_csv(row.limit(0), "validation", path)
    contracts.append_csv(row, "validation", path)
    assert [r.detail for r in contracts.read_ledger(spark, "validation", path).collect()] == ['a, "quoted" detail'] * 2


def test_streamed_append_writes_nothing_twice(spark, tmp_path):
    from siltline.sources.journal import Journal
    from siltline.streaming.append import append_stream, sessions

    source, ledger_path = str(tmp_path / "in"), str(tmp_path / "ledger")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, n int").write.parquet(source)
    run = lambda: append_stream(spark.readStream.schema("key string, n int").parquet(source), ledger_path, str(tmp_path / "check"), "key", "n").awaitTermination(60)
    run()
    spark.createDataFrame([("b", 4), ("c", 5)], "key string, n int").write.mode("append").parquet(source)
    run()
    assert sorted(rows_of(Journal(spark, ledger_path).read("rows", "key string, n int"))) == [("a", 1), ("b", 3), ("c", 5)]
    times = spark.createDataFrame([("u", "2026-01-01 00:00:00"), ("u", "2026-01-01 00:04:00"), ("u", "2026-01-01 01:00:00")], "g string, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.n for r in sessions(times, "t", "g", "5 minutes").collect()) == [1, 2]


def test_settings_from_json():
    from siltline import config

    own = config.load('{"collect": {"max_per_source": 1, "tier_weights": {"institution": 2.0}}, "visuals": {"enabled": ["diagram"]}}')
    assert own.collect.max_per_source == 1 and own.collect.tier_weights.institution == 2.0 and own.visuals.enabled == ("diagram",) and own.search.limit == 10
    for bad in ('{"x": {}}', '{"evaluation": {"band_high_min": 0.1}}'):
        with pytest.raises(ValueError):
            config.load(bad)


def test_assembled_days(spark):
    from siltline.operators import assemble

    items = spark.createDataFrame([("d", "v-01", "a"), ("d", "v-02", "b")], "day string, item_id string, text string")
    got = {r.item_id: r.vector for r in assemble.embedded(items, F.col("text"), lambda: lambda texts: [[1.0, 0.0] for _ in texts], 2).collect()}
    assert set(got) == {"v-01", "v-02"} and len(set(got.values())) == 1
    other = items.unionByName(items.withColumn("day", F.lit("e"))).repartition("day")
    fail = lambda *_: (_ for _ in ()).throw(RuntimeError("no encoder"))
    assert assemble.embedded(items, F.col("text"), lambda: lambda texts: [[1.0] for _ in texts], 2).count() == assemble.embedded(items, F.col("text"), fail, 2).count() == assemble.embedded(items, F.col("text"), lambda: fail, 2).count() == 0
    assert {r.day for r in assemble.embedded(other.withColumn("text", F.col("day")), F.col("text"), lambda: lambda texts: [[1.0, 0.0]] * len(texts) if set(texts) == {"d"} else fail(texts), 2).collect()} == {"d"}
    read = items.where("item_id = 'v-01'")
    assert [r.item_id for r in assemble.hide_read(items, read, True).collect()] == ["v-02"] and assemble.hide_read(items, read, False).count() == 2



def test_replies_and_benchmark_files(spark, tmp_path):
    from siltline.sources import completions

    reply = '{"choices": [{"message": {"content": "hi"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}'
    got = [r.x for r in spark.createDataFrame([(reply,), ('{"choices": []}',)], "t string").select(completions.parsed(F.col("t")).alias("x")).collect()]
    assert got[0].content == "hi" and got[0].hit_the_budget and got[1].error == "the reply holds no choice" and not got[1].hit_the_budget
    (tmp_path / "runs.json").write_text('[{"model_filename": "/m/a.gguf", "n_prompt": 512, "avg_ts": 9.5}]\n[{"model": "a.gguf", "n_gen": 64, "avg_ts": 3.0}, {"model": "a.gguf", "n_gen": 64, "avg_ts": 4.0}]')
    rows = corpus.throughputs(completions.load_runs(spark, str(tmp_path)))
    assert {(r.model, r.kind): r.speed for r in rows.collect()} == {("a.gguf", "prefill"): 9.5, ("a.gguf", "decode"): 4.0}


def test_canonical_json_is_that_of_python(spark):
    import json

    from siltline.functions import canonical

    texts = ['plain "quoted" \\ back', "tab\tline\nfeed\rbell\x07\x1f\x7f", "é ü 日本 😀   ­", "", None]
    numbers = [0.1, -2.5, 1e-5, 1.5e-7, 123456789.0, 1e7, 12345678.25, 1e15, 1e16, 1e20, -3e-4, 0.001, 0.0, 100.0]
    rows = [(t, numbers[i % len(numbers)], i, [t or "x", "y"], {"b": 1, "a": None, "é": 3}, (True, None), []) for i, t in enumerate(texts * 3)]
    schema = "t string, d double, n long, l array<string>, m map<string,int>, s struct<z: boolean, a: string>, e array<int>"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    got = [r.x for r in df.select(canonical.document(F.struct(*df.columns), df.schema).alias("x")).collect()]
    keys = ("t", "d", "n", "l", "m", "s", "e")
    want = [json.dumps(dict(zip(keys, (t, d, n, lst, m, {"z": s[0], "a": s[1]}, e), strict=True)), indent=2, sort_keys=True) + "\n" for t, d, n, lst, m, s, e in rows]
    assert got == want
    one = spark.createDataFrame([(x,) for x in numbers], "d double").select(canonical.number(F.col("d")).alias("x"))
    assert [r.x for r in one.collect()] == [json.dumps(x) for x in numbers]


def test_digests_of_what_was_published(spark):
    import hashlib
    import json

    rows = [("A\nlíne", ["p", 'q"']), (None, []), ("x", None)]
    df = spark.createDataFrame(rows, "s string, k array<string>").select(articles.output_digest(F.col("s"), F.col("k")).alias("x"))
    want = [hashlib.sha256((json.dumps({"key_points": k or [], "summary": s}, indent=2, sort_keys=True) + "\n").encode()).hexdigest() for s, k in rows]
    assert [r.x for r in df.collect()] == want


def test_documents_and_folders(spark, tmp_path):
    import hashlib

    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([(f"{root}/2026/08/22/digest.json", '{"a": 1}\n'), (f"{root}/2026/08/21/digest.json", "{}\n"), (f"{root}/other/digest.json", "{}\n"), (f"{root}/2026/08/20/run.json", "{}\n")], "path string, document string")
    made = {r.path: r for r in contracts.write_documents(rows, "path", "document").collect()}
    assert len(made) == 4 and not list(tmp_path.rglob("*.part"))
    assert [r.date for r in contracts.days_below(spark, root).collect()] == ["2026-08-22", "2026-08-21"]
    for r in contracts.digests(spark, f"{root}/2026", piece=3).collect():
        assert r.sha256 == hashlib.sha256(open(r.path.removeprefix("file:"), "rb").read()).hexdigest()
    row = spark.createDataFrame([tuple(["v", "m", True, False, 0.9, 0.8, 20, "2026-08-22", "c", "r", "confirmed", "d"])], contracts.schema("validation"))
    contracts.append_csv(row, "validation", str(tmp_path / "s.csv"))
    assert contracts.read_header(spark, str(tmp_path / "s.csv")) == contracts.schema("validation").names


def test_settings_of_a_folder(spark, tmp_path):
    import hashlib

    from siltline import config

    for n in ("app.json", "sources.json", "taxonomy.json", "watchlist.json"):
        (tmp_path / n).write_text('{"search": {"limit": 3}}' if n == "app.json" else '{"x": "é"}')
    settings, files, digests = config.load_folder(spark, str(tmp_path))
    assert settings.search.limit == 3 and files["sources.json"] == {"x": "é"}
    assert digests == tuple((n, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n in sorted(files))
    (tmp_path / "taxonomy.json").unlink()
    with pytest.raises(Exception, match="(?i)exist"):
        config.load_folder(spark, str(tmp_path))


def test_vectors_of_different_lengths_are_an_error(spark):
    from siltline.functions import vectors as V

    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different lengths"):
        df.select(V.dot(F.col("a"), F.col("b"))).collect()
    assert spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), (None, [1.0])], "a array<double>, b array<double>").select(V.dot(F.col("a"), F.col("b")).alias("x")).collect()[0].x == 11.0


def test_spellings_and_addresses(spark):
    from siltline.sources import completions

    assert completions.sampling_spelling(0, 0.95, 7, 400, True) == "temperature=0.0000;top_p=0.9500;seed=7;max_output_tokens=400;thinking=on"
    answers = spark.createDataFrame([("a", "93.184.216.34"), ("a", "10.0.0.1"), ("b", "2606:2800:220:1::1"), ("c", None)], "host string, address string")
    assert {r.host: r.public for r in articles.resolves_to_public(answers).collect()} == {"a": False, "b": True, "c": False}
