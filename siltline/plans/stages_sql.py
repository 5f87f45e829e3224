"""The queries of plans/stages.py in DuckDB's SQL, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from siltline.plans.oracles import BAND, CANDIDATES, CANONICAL, DOMAIN, EVALS, PAIRS, host, lead, part, sentences, split_words, tokens

LATER = f"({sentences('text')})[4:5]"
LINE = "' || chr(10) || '"


def q(t: str) -> str:
    """JSON text of a string with ASCII escapes."""
    short = " ".join(f"WHEN {sign} THEN {by}" for sign, by in (("'\"'", "'\\\"'"), ("'\\'", "'\\\\'"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(8)", "'\\b'"), ("chr(12)", "'\\f'")))
    return f"""('"' || array_to_string(list_transform(string_split({t}, ''), lambda c: CASE c {short} ELSE CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN c
      WHEN unicode(c) > 65535 THEN printf('\\u%04x\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) ELSE printf('\\u%04x', unicode(c)) END END), '') || '"')"""


def json_object(parts: dict[str, str]) -> str:
    """Canonical JSON text of an object whose values are JSON texts."""
    lines = f" || ',{LINE}  ' || ".join(f"'\"{k}\": ' || {v}" for k, v in sorted(parts.items()))
    return f"('{{{LINE}  ' || {lines} || '{LINE}}}{LINE}')"


def json_list(x: str) -> str:
    return f"CASE WHEN len({x}) = 0 THEN '[]' ELSE '[{LINE}    ' || array_to_string(list_transform({x}, lambda x: {q('x')}), ',{LINE}    ') || '{LINE}  ]' END"


def digest(summary: str, points: str) -> str:
    body = json_object({"key_points": json_list(points), "summary": f"coalesce({q(summary)}, 'null')"})
    return f"sha256({body})"


def broken(table: str, key: str, rules: dict[str, str], source: str) -> str:
    """Rows of ``source`` and the rules that they break; a rule that is null is broken."""
    found = ", ".join(f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE '{name}' END" for name, ok in rules.items())
    return f"SELECT '{table}' AS \"table\", CAST({key} AS VARCHAR) AS key, unnest(list_filter([{found}], lambda x: x IS NOT NULL)) AS rule FROM {source}"


def quantised(values: str) -> str:
    byte = f"list_transform({values}, lambda x: CAST(round_even(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * 127, 0) AS INTEGER))"
    return f"base64(unhex(array_to_string(list_transform({byte}, lambda b: lpad(hex(CAST((b + 256) % 256 AS INTEGER)), 2, '0')), '')))"


SIGNS = {"model_sha256": "sha256(o_orderpriority)", "quantisation": "o_orderpriority", "runtime_build": "'b1'", "chat_template_sha256": "'t'", "prompt_sha256": "'p'", "output_schema_sha256": "'s'", "sampling": "'temperature=0.0000;top_p=1.0000;seed=0;max_output_tokens=400;thinking=off'", "runner_class": "'naïve'", "extractor_version": "'1'", "sanitizer_version": "'2'"}
PLAIN = {"truncation_cap_tokens": "2500", "n_ctx": "o_custkey", "n_batch": "512", "n_ubatch": "512", "n_threads": "4"}
REBUILT = f"sha256({json_object({k: q(v) for k, v in SIGNS.items()} | PLAIN)})"
ALTERED = f"sha256({json_object({k: q(v) for k, v in (SIGNS | {'model_sha256': chr(39) + 'other' + chr(39)}).items()} | PLAIN)})"
STAMPED = f"stamped AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN {ALTERED} ELSE {REBUILT} END AS pipeline_fingerprint, {REBUILT} AS rebuilt FROM orders)"
VALIDATION = {"version": q("'1'"), "model_id": q("s_name"), "is_incumbent": "CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END", "selected": "'false'", "leaderboard_hhem": "'0.5'", "measured_hhem": "CAST(s_nationkey / 4 AS VARCHAR)", "articles": "CAST(s_nationkey AS VARCHAR)", "measured_on": q("'2026-08-22'"), "commit_sha": q("'abcdefg'"), "runner": q("'r'"), "verdict": q("'confirmed'"), "detail": q("'naïve \"x\"'")}
RUNS = "runs AS (SELECT day, CAST(ordinal % 2 + 1 AS INTEGER) AS n, count(*) AS items_added FROM pub GROUP BY 1, 2)"
FEEDS = f"""offered AS (
  SELECT page_id // 10 AS f, page_id, url, canonical_url, strftime(DATE '2026-08-01' + CAST(page_id % 28 AS INTEGER), '%Y-%m-%d') || 'T08:00:00Z' AS published_at
  FROM pages JOIN canon USING (page_id) WHERE regexp_matches(lower(url), '^https?://')
), live AS (SELECT * FROM offered WHERE f % 7 <> 3 AND f % 11 <> 5)"""
PATH, HOST = part("url", 3), host("url")
LOCAL = f"regexp_matches({HOST}, '^(localhost|ip6-localhost|ip6-loopback)$|\\.(localhost|local|internal|localdomain)$')"
RETRIES = f"""WITH p AS (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM pages GROUP BY url),
t AS (SELECT url, page_id, html, n, (page_id * 7 + n * 3) % 5 AS k FROM p, (SELECT unnest(generate_series(0, 3)) AS n)),
s AS (SELECT *, CASE k WHEN 0 THEN 503 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 ELSE 500 END AS status, CASE k WHEN 1 THEN 'ok' WHEN 2 THEN 'permanent' ELSE 'transient' END AS o FROM t),
l AS (SELECT DISTINCT ON (url) * FROM s ORDER BY url, o = 'transient', CASE WHEN o = 'transient' THEN -n ELSE n END),
g AS (SELECT *, CASE WHEN {LOCAL} THEN 'address resolves inward' WHEN length({HOST}) % 7 = 0 THEN 'robots.txt could not be read' WHEN starts_with({PATH}, '/fr/') THEN 'robots.txt disallows this path' WHEN length({HOST}) % 5 = 0 THEN 'address is not on the public internet' END AS shut FROM l)
SELECT page_id, CASE WHEN shut IS NULL THEN o WHEN shut LIKE 'robots%' THEN 'robots_denied' ELSE 'blocked' END AS outcome, coalesce(shut, CASE WHEN o <> 'ok' THEN 'HTTP ' || status END) AS detail, CASE WHEN shut IS NULL THEN CAST(status AS INTEGER) END AS status,
  coalesce(shut IS NULL AND o = 'ok' AND octet_length(encode(html)) > 2000, false) AS body_truncated, CASE WHEN shut IS NULL AND o = 'ok' THEN CAST(least(octet_length(encode(html)), 2000) AS INTEGER) END AS bytes, CASE WHEN shut IS NULL THEN CAST(pow(2, n) - 1 AS DOUBLE) ELSE 0.0 END AS waited
FROM g"""
ARTICLES = """(SELECT doc_id, lang AS vertical, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END || '-' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') AS item_id, n_chars >= 200 AS ok, n_chars, text, doc_id AS k, lang, source FROM documents)"""


def article_rules() -> dict[str, str]:
    return {
        "ok has text and title": "NOT ok OR (text <> '' AND n_chars >= 300)", "ok has no failure": "NOT ok OR k % 6 <> 0", "failed has a reason": "ok OR k % 6 = 0", "truncated says where": "(k % 4 = 0) = (k % 8 = 0)", "item id is addressed by its vertical": "k % 10 <> 0", "key is the digest of the address": "k % 15 <> 0 OR k = 0",
        "lenses are distinct": "k % 9 <> 0 AND lang <> source",
    }


def route_rules() -> dict[str, str]:
    return {
        "none has no spec": "k % 3 <> 0 OR k % 12 <> 0", "none has no picture": "k % 3 <> 0 OR k % 4 NOT IN (1, 2)", "format is that of the kind": "k % 3 <> 2 OR k % 5 <> 0", "a kind has a spec": "k % 3 = 0 OR k % 7 <> 0",
        "a path is there if it was drawn": "k % 4 <> 1 OR k % 11 <> 0", "a failed drawing says why": "(k % 4 = 2) = (k % 13 = 0)",
    }


def oracle_sql() -> dict[str, str]:
    plan = f"WITH {CANDIDATES} "
    listed = plan + """, vp AS (SELECT d.day, v.vertical, coalesce(c.n, 0) AS considered, coalesce(p.n, 0) AS planned, coalesce(live_feeds, 0) < min_feeds AS below FROM (SELECT DISTINCT day FROM story) d CROSS JOIN vert v LEFT JOIN live USING (vertical)
      LEFT JOIN (SELECT day, vertical, count(*) AS n FROM story GROUP BY 1, 2) c ON c.day = d.day AND c.vertical = v.vertical LEFT JOIN (SELECT day, vertical, count(*) AS n FROM plan GROUP BY 1, 2) p ON p.day = d.day AND p.vertical = v.vertical) """
    title = "CASE WHEN p.doc_id % 3 = 0 OR trim(p.source) = '' THEN 'Untitled item' ELSE p.source END"
    date = "'2026-08-' || lpad(CAST(p.doc_id % 28 + 1 AS VARCHAR), 2, '0')"
    measures = ", ".join(f"round_even({c}, 6) AS {c}" for c in ("hhem", "hhem_full", "coverage", "compression", "extractiveness", "verbatim_run"))
    ints = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("unsupported_numbers", "source_word_count", "summary_word_count"))
    document = json_object({"doc_id": "CAST(doc_id AS VARCHAR)", "lang": q("lang"), "n_chars": "CAST(n_chars AS VARCHAR)", "note": "CASE WHEN doc_id % 3 > 0 THEN '\"n\"' ELSE 'null' END", "ratio": "CAST(n_chars / 8 AS VARCHAR)", "tags": json_list("[lang, source]"), "text": q("text")})
    same_plan = "(SELECT *, day || '/' || item_id AS k, ordinal = 2 AS second, lag(rank_score + CASE WHEN ordinal = 2 THEN 100 ELSE 0 END) OVER (PARTITION BY day, vertical ORDER BY ordinal) AS before, rank_score + CASE WHEN ordinal = 2 THEN 100 ELSE 0 END AS score, count(*) FILTER (ordinal = 2) OVER (PARTITION BY day) AS seconds FROM plan)"
    return {
        "canonical_json": f"SELECT doc_id, sha256({document}) AS sha256 FROM documents",
        "output_digest": f"SELECT doc_id, {digest(lead('text'), LATER)} AS sha256 FROM documents",
        "text_digests": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "feed_candidates": f"WITH {CANONICAL}, {FEEDS} SELECT 'feed-' || f AS source_id, 'v' || f % 3 AS vertical, CAST(f % 3 + 1 AS INTEGER) AS tier, url AS source_url, canonical_url, sha256(canonical_url) AS url_key, 'Page ' || page_id || ' & more' AS title, published_at FROM (SELECT *, row_number() OVER (PARTITION BY f, canonical_url ORDER BY page_id) AS nth FROM live) WHERE nth = 1",
        "feed_file_candidates": f"WITH {CANONICAL}, {FEEDS} SELECT 'feed-' || f AS source_id, 'v' || f % 3 AS vertical, CAST(f % 3 + 1 AS INTEGER) AS tier, url AS source_url, canonical_url, sha256(canonical_url) AS url_key, 'Page ' || page_id || ' & more' AS title, published_at FROM (SELECT *, row_number() OVER (PARTITION BY f, canonical_url ORDER BY page_id) AS nth FROM live) WHERE nth = 1",
        "front_page_votes": f"WITH {CANONICAL}, {FEEDS} SELECT DISTINCT canonical_url FROM offered",
        "live_feeds": "SELECT 'v' || f % 3 AS vertical, count(*) AS feeds FROM (SELECT DISTINCT page_id // 10 AS f FROM pages) WHERE f % 7 <> 3 AND f % 11 <> 5 GROUP BY 1",
        "feed_links": f"WITH d AS (SELECT page_id // 10 AS feed, {DOMAIN} AS link, min(page_id) AS position FROM pages GROUP BY 1, 2) SELECT feed, link, position FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY position) AS nth FROM d) WHERE nth <= 3",
        "fetch_retries": RETRIES,
        "ledger_roundtrip": "SELECT c_name AS model_id, c_custkey % 2 = 0 AS is_incumbent, CAST(c_nationkey / 4 AS DOUBLE) AS leaderboard_hhem, c_acctbal AS measured_hhem, c_nationkey AS articles, 'a, \"' || c_mktsegment || '\"' AS detail FROM customer",
        "stamp_rows": f"WITH {STAMPED} SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(pipeline_fingerprint, o_orderkey) AS pipeline_fingerprint FROM stamped GROUP BY 1",
        "stamp_checks": "SELECT 'fingerprint' AS \"table\", CAST(o_orderkey AS VARCHAR) AS key, 'fingerprint is rebuilt from its inputs' AS rule FROM orders WHERE o_orderkey % 50 = 0",
        "json_documents": f"SELECT regexp_replace(s_name, '[^A-Za-z0-9]', '-', 'g') || '.json' AS file, sha256({json_object(VALIDATION)}) AS sha256, true AS same FROM supplier",
        "day_folders": plan + "SELECT day AS date, count(*) AS items FROM plan GROUP BY 1",
        "day_partitions": plan + "SELECT day, count(*) FILTER (day[-1:] NOT IN ('0', '2', '4', '6', '8') OR ordinal = 1) AS items FROM plan GROUP BY 1",
        "runs_appended": plan + f", {RUNS} SELECT day, n, items_added + CASE WHEN n = 2 THEN 100 ELSE 0 END AS items_added FROM runs",
        "next_runs": plan + f", {RUNS} SELECT day, max(n) + 1 AS n FROM runs GROUP BY 1",
        "day_vectors": plan + "SELECT day, item_id, CASE WHEN ordinal % 3 = 0 THEN 'new' ELSE 'old' END AS vector FROM plan",
        "bench_runs": "SELECT s_name || '.gguf' AS model, 512 AS n_prompt, 0 AS n_gen, s_acctbal AS avg_ts FROM supplier UNION ALL SELECT s_name || '.gguf', 0, 64, 2.5 FROM supplier",
        "model_calls": """SELECT conv_id, turn, md5('{"model":"m","messages":[{"role":"system","content":"be brief"},{"role":"user","content":"' || role || '\\n\\n<<<UNTRUSTED_SOURCE_TEXT>>>\\n' || role || '\\n<<<END_UNTRUSTED_SOURCE_TEXT>>>"}],"max_tokens":100,"temperature":0.0,"seed":0}') AS request_md5,
          CASE WHEN conv_id % 9 <> 0 THEN md5(text) END AS content_md5, CASE WHEN conv_id % 9 <> 0 THEN CASE WHEN conv_id % 5 = 0 THEN 'length' ELSE 'stop' END END AS finish_reason, conv_id % 9 <> 0 AND conv_id % 5 = 0 AS hit_the_budget, CASE WHEN conv_id % 9 = 0 THEN 'the reply holds no choice' END AS error FROM conversations""",
        "context_fit": f"SELECT doc_id, CAST(trunc(len({split_words('text')}) * 1.3::DOUBLE) AS INTEGER) + 250 + 600 <= 2048 AS fits FROM documents",
        "vertical_page": plan + "SELECT day, item_id, '2 January 2024' AS shown, published_at[12:16] AS clock FROM plan WHERE day = '2024-01-02' AND vertical = 'click'",
        "unread_items": plan + "SELECT day, item_id FROM plan WHERE ordinal % 3 <> 0",
        "searchable_vectors": f"SELECT vec_id // 16 AS day, 'item-' || vec_id AS item_id, md5({quantised('embedding')}) AS md5 FROM embeddings WHERE vec_id % 13 > 0 AND vec_id // 16 % 5 > 0 AND vec_id // 16 % 7 > 0",
        "article_lead": f"SELECT doc_id, md5(array_to_string(({split_words('text')})[1:150], ' ')) AS md5 FROM documents",
        "fact_menu": "SELECT l_orderkey, md5(string_agg(i || ': ' || v || ' ' || u || ' | line ' || n, chr(10) ORDER BY i)) AS md5 FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity) - 1 AS i, CAST(l_quantity AS INTEGER) AS v, l_returnflag AS u, l_linenumber AS n FROM lineitem) GROUP BY 1",
        "reply_parts": "SELECT conv_id, turn, role AS thinking, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS md5 FROM conversations",
        "name_marks": "SELECT c_custkey, upper(c_mktsegment[1] || c_name[1]) AS monogram, CAST(list_reduce(list_transform(string_split(c_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) % 8 AS INTEGER) AS swatch, c_nationkey || CASE WHEN c_nationkey = 1 THEN ' nation' ELSE ' nations' END AS counted FROM customer",
        "asset_paths": "SELECT doc_id, 'digest/2026/08/' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/' || lang || '-' || doc_id || '-' || lpad(CAST(doc_id % 7 AS VARCHAR), 2, '0') || '.svg' AS path FROM documents",
        "config_checks": """WITH e AS (SELECT *, source || '-' || doc_id % 5000 AS id FROM documents)
SELECT 'entity' AS "table", id AS key, 'entity ids are distinct' AS rule FROM e GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'entity feed', f, 'feed ids are distinct across entities' FROM (SELECT unnest([lang || doc_id, 'f' || doc_id % 4001]) AS f FROM e) GROUP BY f HAVING count(*) > 1
UNION ALL SELECT 'entity', CAST(n_chars AS VARCHAR), 'a CIK names one entity' FROM e WHERE doc_id % 3 = 0 GROUP BY n_chars HAVING count(*) > 1
UNION ALL SELECT 'entity', id, 'retired has a date, others none' FROM e WHERE (doc_id % 4 = 0) <> (doc_id % 6 = 0)
UNION ALL SELECT 'source', 'src3', r FROM (SELECT unnest(['it is in the vocabulary']) AS r) WHERE EXISTS (FROM e WHERE source = 'src3')
UNION ALL SELECT 'source', 'src-new', 'it is labelled once' WHERE EXISTS (FROM e)
UNION ALL SELECT 'source', 'src5', 'it is labelled once' WHERE EXISTS (FROM e WHERE source = 'src5')
UNION ALL SELECT 'policy', CAST(doc_id AS VARCHAR), 'a contact is declared where it is enabled' FROM e WHERE doc_id % 10 = 0
UNION ALL SELECT 'policy', CAST(doc_id AS VARCHAR), 'one to ten requests a second' FROM e WHERE doc_id % 12 IN (0, 11)
UNION ALL SELECT 'validation', 'model-' || doc_id, 'a switch does not select the model in use' FROM e WHERE doc_id % 42 = 0""",
        "dual_scores": f"""WITH {PAIRS}, total AS (SELECT count(*) AS total FROM documents),
df AS (SELECT c, count(*) AS n FROM (SELECT DISTINCT doc_id, substr(md5(t), 1, 4) AS c FROM (SELECT doc_id, unnest({tokens('text')}) AS t FROM documents)) GROUP BY c),
split AS (SELECT doc_id, {tokens('summary')} AS h, {tokens('source_text')} AS f, {split_words('source_text')} AS s FROM pairs),
both_ AS (SELECT doc_id, h, f, CASE WHEN len(s) > 384 THEN {tokens("array_to_string(s[1:384], ' ')")} ELSE f END AS s FROM split),
terms AS (SELECT doc_id, list_intersect(list_distinct(h), f) AS f, list_intersect(list_distinct(h), s) AS s, unnest(list_distinct(h)) AS t FROM both_),
told AS (SELECT doc_id, ln((1 + total) / (1 + coalesce(n, 0))) + 1 AS w, list_contains(f, t) AS full_, list_contains(s, t) AS seen FROM terms CROSS JOIN total LEFT JOIN df ON c = substr(md5(t), 1, 4)),
scored AS (SELECT doc_id, round_even(coalesce(sum(w) FILTER (seen), 0) / sum(w), 6) AS score, round_even(coalesce(sum(w) FILTER (full_), 0) / sum(w), 6) AS score_full FROM told GROUP BY 1)
SELECT p.doc_id, coalesce(score, 0) AS score, coalesce(score_full, 0) AS score_full, coalesce(score, 0) - coalesce(score_full, 0) > 0.1 AS flagged FROM pairs p LEFT JOIN scored USING (doc_id)""",
        "item_vectors": plan + f"SELECT day, item_id, {quantised('[length(canonical_url) / 32, 0.5, -0.25]')} AS vector FROM plan",
        "article_checks": broken("article", "doc_id", article_rules(), ARTICLES),
        "summary_checks": broken("summary", "k", {"digest is rebuilt from the words": "k % 20 <> 0", "ok has words and points": f"k % 5 = 0 OR (k % 12 <> 0 AND {lead('text', 1)} <> '')", "ok has no failure": "k % 5 = 0 OR k % 10 <> 0", "failed has a reason": "k % 5 <> 0 OR k % 10 = 0"}, "(SELECT doc_id AS k, text FROM documents)"),
        "route_checks": broken("route", "k", route_rules(), "(SELECT o_orderkey AS k FROM orders)"),
        "plan_checks": listed + broken("plan", "k", {"key is the digest of the address": "NOT second", "tier is known": "ordinal <> 3", "stories are distinct": "NOT second OR seconds = 1", "scores do not rise": "before IS NULL OR score <= before"}, same_plan)
        + " UNION ALL " + broken("plan", "day || '/' || vertical", {"planned is what is listed": "vertical <> 'click'"}, "vp")
        + " UNION ALL " + broken("vertical plan", "day || '/' || vertical", {"planned at most what was considered": "planned + CASE WHEN vertical = 'click' THEN 1 ELSE 0 END <= CASE WHEN vertical = 'error' THEN -1 ELSE considered END", "none planned below the floor": "NOT below OR (planned = 0 AND vertical <> 'click')"}, "vp"),
        "day_checks": plan + f""", {RUNS}, i AS (SELECT *, day || '/' || item_id AS k, CAST(ordinal % 2 + 1 AS INTEGER) AS r, lag(ordinal % 2 + 1) OVER (PARTITION BY day ORDER BY vertical, ordinal) AS before FROM pub), last AS (SELECT day, max(n) AS last FROM runs GROUP BY 1) """
        + broken("day item", "k", {"later runs append": "before IS NULL OR r >= before", "its run is recorded": "r <= last", "its vertical is listed": "vertical <> 'error'"}, "i JOIN last USING (day)")
        + " UNION ALL " + broken("day run", "day || '/' || n", {"runs have no gaps": "n = place", "added is what it introduced": "n <> 2"}, "(SELECT *, row_number() OVER (PARTITION BY day ORDER BY n) AS place FROM runs)")
        + " UNION ALL " + broken("day vertical", "day || '/' || vertical", {"count is what is there": "vertical <> 'click'"}, "(SELECT DISTINCT day, vertical FROM pub WHERE vertical <> 'error')")
        + " UNION ALL " + broken("day", "day", {"partial if some failed": "false", "published and failed fit the plan": "items_published + items_failed <= items_planned"}, "counters"),
        "run_checks": plan + broken("run", "day || '/2'", {"counts add up": "false", "runs have no gaps": "false", "run id is the day and number": "false", "completed says when": "partial"}, "counters") + " UNION ALL " + broken("run", "day || '/1/' || vertical", {"published at most what was planned": "vertical <> 'click'"}, "(SELECT DISTINCT day, vertical FROM plan)"),
        "source_checks": f"WITH f AS (SELECT {DOMAIN} AS id, url, page_id % 4 = 0 AS retired, page_id % 6 = 0 AS dated FROM pages) " + broken("feed", "id", {"retired has a date, others none": "retired = dated"}, "f") + " UNION ALL SELECT 'feed', id, 'feed ids are distinct' FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'feed', url, 'feed addresses are distinct' FROM f GROUP BY url HAVING count(*) > 1",
        "visual_checks": broken("visual", "o_orderkey", {"a path is there if it was drawn": "(o_orderkey % 2 = 0) = (o_orderkey % 3 = 0)"}, "orders"),
        "digest_items": plan + "SELECT day, item_id, vertical, CASE WHEN ordinal % 2 = 0 THEN url_key ELSE 'Untitled item' END AS title, canonical_url AS source_url, source_id, 'user ' || source_id AS source_name, 'reporting' AS source_kind, published_at, CASE WHEN tier < 3 THEN canonical_url ELSE '' END AS summary, CASE WHEN ordinal > 1 THEN item_id || '|' || vertical ELSE '' END AS key_points, vertical AS lenses, '' AS events, '' AS entities, 'low' AS band, ordinal = 1 AS truncated, ordinal AS introduced_by_run, CAST(NULL AS VARCHAR) AS updated_at, CASE WHEN tier = 1 THEN 'v/' || item_id END AS visual_path, CASE WHEN tier = 1 THEN 'chart' END AS visual_kind FROM plan",
        "score_ledger": f"WITH {EVALS} SELECT '1' AS version, {date} AS date, {date} || '-1' AS run_id, p.lang || '-' || p.doc_id AS item_id, sha256(CAST(p.doc_id AS VARCHAR)) AS url_key, 'https://a.example/' || p.doc_id AS source_url, {title} AS title, p.lang AS vertical, 'm' AS model_id, 1 AS attempt, {measures}, round_even(hhem - hhem_full, 6) AS hhem_delta, round_even(hhem - hhem_full, 6) > 0.1 AS truncation_flagged, {ints}, hedge_dropped, p.doc_id % 4 = 0 AS extraction_suspect, {BAND} AS band, CAST(least(source_seen_word_count, 1923) AS INTEGER) AS source_seen_word_count, 'f' AS pipeline_fingerprint, sha256(CAST(p.doc_id AS VARCHAR)) AS output_digest, false AS determinism_violation, 's@01234567;weights-abcdefgh;metrics-1;bands=0.80/0.50' AS scorer_version, '2026-08-22T00:00:00Z' AS scored_at, CASE WHEN p.doc_id % 2 = 0 THEN 7 ELSE 0 END AS score_ms FROM evals e JOIN pairs p USING (doc_id)",
    }
