"""The registered queries in DuckDB's SQL, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from siltline.functions.text import HEDGE_TERMS, NOT_AN_ENTITY
from siltline.functions.urls import RFC, TRACKING_KEYS

WORD = "[A-Za-z0-9][A-Za-z0-9''.,-]*"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '{WORD}')"


def split_words(t: str) -> str:
    return f"list_filter(string_split(regexp_replace({t}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' '), lambda x: x <> '')"


def tokens(t: str) -> str:
    return f"list_transform({words(t)}, lambda w: regexp_replace(lower(w), '^[.,]+|[.,]+$', '', 'g'))"


def sentences(t: str) -> str:
    return f"string_split(regexp_replace(trim(regexp_replace({t}, '^\\s+|\\s+$', '', 'g')), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def lead(t: str, n: int = 3) -> str:
    return f"array_to_string(({sentences(t)})[1:{n}], ' ')"


def numbers(t: str) -> str:
    bare = f"list_transform(regexp_extract_all({t}, '\\d[\\d,]*(?:\\.\\d+)?'), lambda x: replace(x, ',', ''))"
    cut = f"list_transform({bare}, lambda x: CASE WHEN contains(x, '.') THEN regexp_replace(x, '\\.?0+$', '') ELSE x END)"
    return f"list_distinct(list_filter({cut}, lambda x: length(replace(x, '.', '')) >= 2))"


def grams(w: str) -> str:
    return f"CASE WHEN len({w}) >= 4 THEN list_distinct(list_transform(generate_series(1, len({w}) - 3), lambda i: array_to_string(({w})[i:i+3], chr(1)))) ELSE [] END"


def share(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def names(t: str) -> str:
    """Runs of capitalised words: the sign before a run is taken with it, as RE2 cannot look behind."""
    runs = "regexp_extract_all(trim(s), '(^|[^\\p{L}\\p{N}_])([A-Z][\\p{L}\\p{N}_.&''-]*(?:\\s+[A-Z][\\p{L}\\p{N}_.&''-]*)*)', 2)"
    clean = f"list_transform({runs}, lambda r, i: {{'r': lower(regexp_replace(r, '^[ .,]+|[ .,]+$', '', 'g')), 'i': i, 'o': regexp_matches(trim(s), '^[A-Z]')}})"
    kept = f"list_filter({clean}, lambda x: x.r <> '' AND x.r NOT IN ({quoted(NOT_AN_ENTITY)}) AND NOT (x.o AND x.i = 1 AND NOT contains(x.r, ' ')))"
    return f"list_distinct(list_transform(flatten(list_transform({sentences(t)}, lambda s: {kept})), lambda x: x.r))"


HEDGE = "(?i)\\b(?:" + "|".join(HEDGE_TERMS) + ")\\b"
CANDIDATES = """cand AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS vertical, 'https://story.example/' || event_type || '/' || json_extract_string(props, '$.k') AS canonical_url,
    CAST(user_id AS VARCHAR) AS source_id, CAST(user_id % 3 + 1 AS INTEGER) AS tier, min(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS published_at
  FROM events GROUP BY 1, 2, 3, 4, 5
), vert AS (SELECT DISTINCT event_type AS vertical, CASE WHEN event_type = 'click' THEN 5 ELSE 3 END AS daily_cap, 5 AS min_feeds FROM events),
live AS (SELECT vertical, count(DISTINCT source_id) AS live_feeds FROM cand GROUP BY 1),
story AS (
  SELECT day, vertical, sha256(canonical_url) AS url_key, canonical_url, count(*) AS carried_by, arg_min(source_id, (tier, source_id)) AS source_id, min(tier) AS tier, arg_min(published_at, (tier, source_id)) AS published_at
  FROM cand GROUP BY day, vertical, canonical_url
), scored AS (
  SELECT *, canonical_url LIKE '%7' AS watchlist_hit, canonical_url LIKE '%3' AS on_front_page,
    round_even(CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END * (1.0::DOUBLE + (carried_by - 1)) + CASE WHEN canonical_url LIKE '%7' THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN canonical_url LIKE '%3' THEN 0.4::DOUBLE ELSE 0 END, 6) AS rank_score
  FROM story
), per_source AS (
  SELECT *, row_number() OVER (PARTITION BY day, vertical, source_id ORDER BY rank_score DESC, published_at DESC, canonical_url) AS of_source
  FROM scored JOIN vert USING (vertical) JOIN live USING (vertical) WHERE live_feeds >= min_feeds
), numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY day, vertical ORDER BY rank_score DESC, published_at DESC, canonical_url) AS INTEGER) AS ordinal FROM per_source WHERE of_source <= 2),
plan AS (
  SELECT day, vertical, ordinal, vertical || '-' || lpad(CAST(ordinal AS VARCHAR), 2, '0') AS item_id, url_key, canonical_url, source_id, tier, published_at, carried_by, watchlist_hit, on_front_page, rank_score
  FROM numbered WHERE ordinal <= daily_cap
), pub AS (SELECT *, CASE WHEN rank_score >= 2 THEN 'high' WHEN rank_score >= 1 THEN 'medium' ELSE 'low' END AS band FROM plan WHERE ordinal <= 3),
counters AS (
  SELECT day, greatest(p, q) AS items_planned, q AS items_published, greatest(p - q, 0) AS items_failed, p > q AS partial
  FROM (SELECT day, count(*) AS p FROM plan GROUP BY 1) JOIN (SELECT day, count(*) AS q FROM pub GROUP BY 1) USING (day)
)"""
PAIRS = f"""own AS (SELECT doc_id, source, lang, n_chars, text AS source_text, {sentences("text")} AS s FROM documents),
pairs AS (
  SELECT a.doc_id, a.source, a.lang, a.n_chars, a.source_text, array_to_string(list_filter([a.s[2], a.s[4], a.s[6], b.s[1]], lambda x: x IS NOT NULL), ' ') AS summary
  FROM own a LEFT JOIN own b ON b.doc_id = a.doc_id + 1
)"""
LEDGER = """ledger AS (
  SELECT d.doc_id, source, lang, '2026-08-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date, quality * 0.45::DOUBLE + d.doc_id % 10 * 0.05::DOUBLE AS hhem, toxic, n_chars,
    n_chars % 997 AS fetch_ms, n_chars % 499 AS extract_ms, n_chars % 1999 AS summarize_ms, n_chars % 89 AS score_ms
  FROM documents d JOIN labels USING (doc_id)
), banded AS (
  SELECT *, CASE WHEN toxic > 0 THEN 'low' WHEN round_even(hhem, 6) >= 0.8 THEN 'high' WHEN round_even(hhem, 6) >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM ledger
)"""
TOKENS = f"toks AS (SELECT doc_id, {tokens('summary')} AS a, {tokens('source_text')} AS b FROM pairs)"
#: Longest common run: equal tokens on one diagonal are numbered, and each gap starts another island.
RUNS = f"""{PAIRS}, {TOKENS},
x AS (SELECT doc_id, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM toks), y AS (SELECT doc_id, unnest(b) AS t, generate_subscripts(b, 1) AS j FROM toks),
met AS (SELECT doc_id, i - j AS diagonal, i FROM x JOIN y USING (doc_id, t)),
islands AS (SELECT doc_id, diagonal, i - row_number() OVER (PARTITION BY doc_id, diagonal ORDER BY i) AS island FROM met),
best AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) AS n FROM islands GROUP BY doc_id, diagonal, island) GROUP BY doc_id),
runs AS (SELECT doc_id, {share("coalesce(n, 0)", "len(a)")} AS verbatim_run FROM toks LEFT JOIN best USING (doc_id))"""
EXTRACTIVE = f"(SELECT doc_id, {share('len(list_intersect(g, h))', 'len(g)')} AS v FROM (SELECT doc_id, {grams('a')} AS g, {grams('b')} AS h FROM toks))"
COVER = f"""(SELECT doc_id, CASE WHEN len(n) + len(f) = 0 THEN 1.0 ELSE (len(list_filter(n, lambda x: contains(hay, x))) + len(list_intersect(f, g))) / CAST(len(n) + len(f) AS DOUBLE) END AS v
  FROM (SELECT doc_id, lower(summary) AS hay, {names(lead("source_text"))} AS n, {numbers(lead("source_text"))} AS f, {numbers("summary")} AS g FROM pairs))"""
MISSING = f"len(list_filter({numbers('summary')}, lambda x: NOT list_contains({numbers('source_text')}, x)))"
DROPPED = f"regexp_matches({lead('source_text')}, '{HEDGE}') AND NOT regexp_matches(summary, '{HEDGE}')"
EVALS = f"""{RUNS}, evals AS (
  SELECT p.doc_id, quality * 0.45::DOUBLE + p.doc_id % 10 * 0.05::DOUBLE AS hhem_full, quality * 0.45::DOUBLE + p.doc_id % 10 * 0.05::DOUBLE + p.doc_id % 3 * 0.06::DOUBLE AS hhem, c.v AS coverage, {share(f"len({words('summary')})", f"len({words('source_text')})")} AS compression,
    e.v AS extractiveness, r.verbatim_run, {MISSING} AS unsupported_numbers, {DROPPED} AS hedge_dropped, len({words("source_text")}) AS source_word_count, len({split_words("source_text")}) AS source_seen_word_count, len({words("summary")}) AS summary_word_count
  FROM pairs p JOIN labels l USING (doc_id) JOIN {COVER} c USING (doc_id) JOIN {EXTRACTIVE} e USING (doc_id) JOIN runs r USING (doc_id)
)"""
BAND = "CASE WHEN unsupported_numbers > 0 THEN 'low' WHEN hhem >= 0.8 THEN 'high' WHEN hhem >= 0.5 THEN 'medium' ELSE 'low' END"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{RFC}', {group})"


def host(url: str) -> str:
    authority = f"regexp_replace({part(url, 2)}, '^.*@', '')"
    return f"lower(regexp_replace(regexp_extract({authority}, '^(\\[[^\\]]*\\]|[^:]*)', 1), '[\\[\\]]', '', 'g'))"


DOMAIN = f"regexp_replace({host('url')}, '^www\\.', '')"
CANONICAL = f"""canon AS (
  SELECT page_id, scheme || '://' || domain || CASE WHEN port IN ('', CASE scheme WHEN 'http' THEN '80' WHEN 'https' THEN '443' ELSE '' END) THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical_url
  FROM (
    SELECT page_id, lower({part("trim(url)", 1)}) AS scheme, {DOMAIN} AS domain, regexp_replace(regexp_extract({part("trim(url)", 2)}, ':([0-9]+)$', 1), '^0+', '') AS port, regexp_replace({part("trim(url)", 3)}, '/+$', '') AS path,
      array_to_string(list_transform(list_sort(list_filter(list_transform(list_filter(string_split({part("trim(url)", 4)}, '&'), lambda x: x <> ''),
        lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END, '+', ' '))}}),
        lambda p: lower(p.k) NOT IN ({quoted(TRACKING_KEYS)}) AND NOT starts_with(lower(p.k), 'utm_'))), lambda p: p.k || '=' || p.v), '&') AS query
    FROM pages
  )
)"""
SHAPE = f"shape AS (SELECT len({split_words('text')}) AS w, n_chars >= 100 AS ok FROM documents)"
RANKS = ", ".join(f"list_sort(list(w) FILTER (ok))[least(round_even({f} * (count(*) FILTER (ok) - 1), 0), count(*) FILTER (ok) - 1)::BIGINT + 1] AS {n}" for n, f in (("p10_words", "0.1::DOUBLE"), ("p50_words", "0.5::DOUBLE"), ("p90_words", "0.9::DOUBLE")))
BUCKETS = ", ".join(f"count(*) FILTER (ok AND {c}) AS n_{n}, round_even({share(f'count(*) FILTER (ok AND {c})', 'count(*) FILTER (ok)')}, 3) AS share_{n}" for n, c in (("short", "w < 600"), ("medium", "w >= 600 AND w < 2000"), ("long", "w >= 2000")))
STAMPS = "SELECT o_custkey AS item, sha256('{' || chr(10) || '  \"priority\": \"' || arg_max(o_orderpriority, o_orderkey) || '\",' || chr(10) || '  \"sampler\": \"greedy\"' || chr(10) || '}' || chr(10)) AS fingerprint, CASE WHEN arg_max(o_orderstatus, o_orderkey) <> 'P' THEN sha256(arg_max(o_orderstatus, o_orderkey)) END AS output_digest FROM orders WHERE year(o_orderdate) % 2 = {y} GROUP BY 1"
MEDIANS = ", ".join(f"median({c}) AS {c}" for c in ("fetch_ms", "extract_ms", "summarize_ms", "score_ms"))
COUNTS = ", ".join(f"count(*) FILTER (band = '{b}') AS {b}" for b in ("high", "medium", "low"))


COSTS = """WITH x AS (SELECT 'm' || l_suppkey % 3 AS model, l_linenumber * 700 AS size, l_orderkey * 10 + l_linenumber AS seq, max(l_quantity + 1) AS v FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT model, size, arg_max(v, seq) AS speed FROM x GROUP BY 1, 2), d AS (SELECT model, min(speed) AS decode FROM p GROUP BY 1),
w AS (SELECT model, decode, share, o, CAST(trunc(words * 1.3::DOUBLE) AS INTEGER) + 300 AS tokens FROM d, (VALUES (411, 0.5::DOUBLE, 150), (1546, 0.25::DOUBLE, 200), (2769, 0.25::DOUBLE, 250)) b(words, share, o)),
n AS (SELECT w.*, max(size) FILTER (size <= tokens) AS s0, arg_max(speed, size) FILTER (size <= tokens) AS v0, min(size) FILTER (size >= tokens) AS s1, arg_min(speed, size) FILTER (size >= tokens) AS v1 FROM w JOIN p USING (model) GROUP BY ALL),
t AS (SELECT model, sum(share * (tokens / CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL OR s0 = s1 THEN v0 ELSE v0 + (tokens - s0) / CAST(s1 - s0 AS DOUBLE) * (v1 - v0) END + o / decode)) AS b FROM n GROUP BY 1)
SELECT model, round_even(b, 6) AS blended_seconds, round_even(b * 17, 6) AS serial_seconds, round_even(b * 5, 6) AS fanout_seconds FROM t"""
#: Unicode white space, and what makes a word, for RE2, whose classes are ASCII.
WHITE, WORDY = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}", r"\p{L}\p{M}\p{N}_"


def page_lines() -> str:
    """The given pages' mark-up is known: the blocks of their only article are its main text."""
    pieces = "string_split_regex(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?p>|<br>|</?h1>')"
    plain_ = "regexp_replace(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
    return f"array_to_string(list_filter(list_transform({pieces}, lambda p: array_to_string({split_words(plain_)}, ' ')), lambda x: x <> ''), chr(10))"


def sanitized(t: str) -> str:
    """What a stranger's text loses, step by step; a word's start is told by the sign before it."""
    steps = [
        (r"(?s)<!--.*?-->", " "), (r"[\x{ad}\x{200b}-\x{200f}\x{2028}\x{2029}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{e0000}-\x{e007f}]", ""), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", " "),
        (r"(?im)<\|[^|>\n]{0,64}\|>|\[/?INST\]|<</?SYS>>|^[ \t]*#{2,}[ \t]*(?:system|assistant|user)[ \t]*:", " "), (r"(?i)<<<UNTRUSTED_SOURCE_TEXT>>>|<<<END_UNTRUSTED_SOURCE_TEXT>>>", " "),
        (rf"(?i)(^|[^{WORDY}])(?:https?://|www\.|data:)[^{WHITE}<>\"'']+", r"\1[link]"), (rf"(^|[^{WORDY}])[A-Za-z0-9][A-Za-z0-9+/]{{39,}}={{0,2}}", r"\1[omitted]"), (rf"[\t\r\f {WHITE.removeprefix(chr(92) + 's')}]+", " "),
        (" *\n *", "\n"), ("\n{3,}", "\n\n"), (rf"^[{WHITE}]+|[{WHITE}]+$", ""),
    ]
    for pattern, by in steps:
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    return t


def oracle_sql() -> dict[str, str]:
    plan = f"WITH {CANDIDATES} "
    pairs = f"WITH {PAIRS} "
    in_summary, in_source = f"len({words('summary')})", f"len({words('source_text')})"
    position = "row_number() OVER (PARTITION BY day ORDER BY vertical, ordinal)"
    found = {
        "plan_day": plan + "SELECT * FROM plan",
        "vertical_plan": plan + "SELECT d.day, v.vertical, coalesce(c.n, 0) AS considered, coalesce(p.n, 0) AS planned, coalesce(live_feeds, 0) AS live_feeds, coalesce(live_feeds, 0) < min_feeds AS below_feed_floor FROM (SELECT DISTINCT day FROM story) d CROSS JOIN vert v LEFT JOIN live USING (vertical) LEFT JOIN (SELECT day, vertical, count(*) AS n FROM story GROUP BY 1, 2) c ON c.day = d.day AND c.vertical = v.vertical LEFT JOIN (SELECT day, vertical, count(*) AS n FROM plan GROUP BY 1, 2) p ON p.day = d.day AND p.vertical = v.vertical",
        "shard_assignment": plan + f"SELECT day, item_id, CAST(({position} - 1) % 4 AS INTEGER) AS shard FROM plan",
        "visual_ordinals": plan + "SELECT day, item_id, CASE WHEN carried_by > 1 THEN 'chart' ELSE 'none' END AS kind, CASE WHEN carried_by > 1 THEN sum(CASE WHEN carried_by > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY day, vertical ORDER BY ordinal)::BIGINT END AS visual_ordinal FROM plan",
        "url_canonical": f"WITH {CANONICAL} SELECT page_id, canonical_url, sha256(canonical_url) AS url_key FROM canon",
        "url_dedupe": f"WITH {CANONICAL} SELECT sha256(canonical_url) AS url_key, canonical_url, count(*) AS carried_by, min(page_id) AS first_page FROM canon GROUP BY canonical_url",
        "url_dialable": f"SELECT page_id, reason IS NULL AS dialable, reason, robots_url FROM (SELECT page_id, {part('url', 1)} || '://' || {part('url', 2)} || '/robots.txt' AS robots_url, CASE WHEN lower({part('url', 1)}) NOT IN ('http', 'https') THEN 'scheme ''' || lower({part('url', 1)}) || ''' is not fetchable' WHEN {host('url')} = '' THEN 'no host in address' WHEN regexp_matches({host('url')}, '^(localhost|ip6-localhost|ip6-loopback)$|\\.(localhost|local|internal|localdomain)$') THEN 'address resolves inward' WHEN regexp_matches({host('url')}, '^(0|10|127|192\\.168|169\\.254)\\.') THEN 'address is not on the public internet' END AS reason FROM pages)",
        "host_rollup": f"SELECT {DOMAIN} AS domain, count(*) AS pages FROM pages GROUP BY 1",
        "word_counts": f"SELECT doc_id, CAST(len({words('text')}) AS INTEGER) AS words, CAST(len({split_words('text')}) AS INTEGER) AS split_words, CAST(trunc(len({split_words('text')}) * 1.3::DOUBLE) AS INTEGER) AS tokens FROM documents",
        "lead_text": f"SELECT doc_id, {lead('text')} AS lead FROM documents",
        "compression": pairs + f"SELECT doc_id, round_even({share(in_summary, in_source)}, 6) AS compression FROM pairs",
        "extractiveness": f"WITH {PAIRS}, {TOKENS} SELECT doc_id, round_even(v, 6) AS extractiveness FROM {EXTRACTIVE}",
        "verbatim_run": f"WITH {RUNS} SELECT doc_id, round_even(verbatim_run, 6) AS verbatim_run FROM runs",
        "unsupported_numbers": pairs + f"SELECT doc_id, CAST({MISSING} AS INTEGER) AS unsupported_numbers FROM pairs",
        "hedge_dropped": pairs + f"SELECT doc_id, {DROPPED} AS hedge_dropped FROM pairs",
        "lead_coverage": pairs + f"SELECT doc_id, round_even(v, 6) AS lead_coverage FROM {COVER}",
        "entities": f"SELECT doc_id, unnest({names(lead('text'))}) AS entity FROM documents",
        "counterweight_band": pairs + f"SELECT doc_id, CASE WHEN {MISSING} > 0 OR v < 0.3 OR ({DROPPED}) THEN 'low' ELSE 'medium' END AS band FROM pairs JOIN {COVER} USING (doc_id)",
        "eval_row": f"WITH {EVALS} SELECT doc_id, round_even(hhem - hhem_full, 6) > 0.1 AS truncation_flagged, CAST(unsupported_numbers AS INTEGER) AS unsupported_numbers, hedge_dropped, CAST(source_word_count AS INTEGER) AS source_word_count, CAST(source_seen_word_count AS INTEGER) AS source_seen_word_count, CAST(summary_word_count AS INTEGER) AS summary_word_count, {BAND} AS band, round_even(hhem, 6) AS hhem, round_even(hhem_full, 6) AS hhem_full, round_even(round_even(hhem - hhem_full, 6), 6) AS hhem_delta, round_even(coverage, 6) AS coverage, round_even(compression, 6) AS compression, round_even(extractiveness, 6) AS extractiveness, round_even(verbatim_run, 6) AS verbatim_run FROM evals",
        "chunk_scores": f"WITH {PAIRS}, w AS (SELECT doc_id, summary, {split_words('source_text')} AS s FROM pairs), c AS (SELECT doc_id, summary, unnest(CASE WHEN len(s) = 0 THEN [''] WHEN len(s) <= 900 THEN [array_to_string(s, ' ')] ELSE list_transform(generate_series(0, len(s) - 1, 750), lambda i: array_to_string(s[i+1:i+900], ' ')) END) AS p FROM w) SELECT doc_id, round_even(max({share('len(list_intersect(o, ' + tokens('p') + '))', 'len(o)')}), 6) AS score FROM (SELECT doc_id, p, list_distinct({tokens('summary')}) AS o FROM c) GROUP BY doc_id",
        "band_edges": f"WITH {LEDGER} SELECT coalesce(min(round_even(hhem, 6)), 0) AS low, coalesce(max(round_even(hhem, 6)), 0) AS high FROM ledger",
        "band_by_date": f"WITH {LEDGER} SELECT date, {COUNTS} FROM banded GROUP BY 1",
        "console_day": f"WITH {LEDGER} SELECT date, count(*) AS items, {MEDIANS}, round_even(avg(hhem), 6) AS mean_hhem, {COUNTS} FROM banded GROUP BY 1",
        "console_worst": f"WITH {LEDGER}, d AS (SELECT date, {MEDIANS} FROM ledger GROUP BY 1) SELECT greatest(1.0::DOUBLE, max(greatest(fetch_ms, extract_ms, summarize_ms, score_ms))) AS worst_ms FROM d",
        "archive_days": plan + "SELECT day, count(*) AS items, any_value(partial) AS partial FROM pub JOIN counters USING (day) GROUP BY 1",
        "day_notice": plan + f"SELECT day, count(*) AS items, {COUNTS}, any_value(CASE WHEN day IN (SELECT day FROM pub WHERE ordinal % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS later_runs FROM pub GROUP BY 1",
        "day_paging": plan + "SELECT day, least(count(*), 12) AS shown, greatest(count(*) - 12, 0) AS remaining FROM plan GROUP BY 1",
        "latest_date": plan + "SELECT max(day) AS latest FROM plan",
        "corpus_shape": f"WITH {SHAPE} SELECT count(*) FILTER (ok) AS n_extracted, round_even(coalesce(avg(w) FILTER (ok), 0), 1) AS mean_words, round_even(coalesce(stddev_samp(w) FILTER (ok), 0), 1) AS stddev_words, CAST(max(w) FILTER (ok) AS INTEGER) AS max_words, {BUCKETS}, {RANKS}, count(*) AS n_attempted FROM shape",
        "boilerplate_ratio": "WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), k AS (SELECT * FROM l WHERE line <> ''), c AS (SELECT source, line FROM k GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > 1), r AS (SELECT k.source, doc_id, count(*) AS n, count(c.line) AS s FROM k LEFT JOIN c USING (source, line) GROUP BY 1, 2) SELECT d.source, d.doc_id, round_even(coalesce(s / n::DOUBLE, 0), 6) AS boilerplate_ratio FROM documents d LEFT JOIN r USING (source, doc_id)",
        "drift_alerts": f"WITH {PAIRS}, {TOKENS}, o AS (SELECT p.doc_id, source AS domain, CASE WHEN p.doc_id // 20 % 2 = 1 THEN least(len({words('source_text')}), 100) ELSE len({words('source_text')}) END AS w, v AS x, quality AS h FROM pairs p JOIN {EXTRACTIVE} USING (doc_id) JOIN labels USING (doc_id)), m AS (SELECT domain, doc_id // 20 % 2 AS recent, median(w) AS w, median(x) AS x, median(h) AS h FROM o GROUP BY 1, 2), j AS (SELECT a.domain, a.w AS wn, b.w AS wb, a.x AS xn, b.x AS xb, a.h AS hn, b.h AS hb FROM m a JOIN m b ON a.domain = b.domain AND a.recent = 1 AND b.recent = 0) SELECT domain, 'shorter_sources' AS alert, printf('median source fell from %.0f to %.0f words', wb, wn) AS detail FROM j WHERE wb > 0 AND wn < wb * 0.6::DOUBLE UNION ALL SELECT domain, 'more_copying', printf('extractiveness rose from %.2f to %.2f', xb, xn) FROM j WHERE xn - xb > 0.15 UNION ALL SELECT domain, 'scoring_chrome', printf('sources shrank %.0f%% while faithfulness held at %.2f', (1 - wn / wb) * 100, hn) FROM j WHERE wb > 0 AND wn < wb * 0.6::DOUBLE AND hn >= hb",
        "extraction_rot": f"WITH {LEDGER}, c AS (SELECT source, count(*) FILTER (hhem >= 0.5) AS succeeded, count(*) AS attempted FROM ledger GROUP BY 1) SELECT source, succeeded, attempted, round_even(1 - succeeded / attempted::DOUBLE, 6) AS failure_rate, 1 - succeeded / attempted::DOUBLE > 0.2 AS rotting FROM c",
        "validation_decide": f"WITH {LEDGER}, m AS (SELECT 'model-' || lang AS model_id, avg(round_even(hhem, 6)) AS s, CAST(count(*) AS INTEGER) AS articles FROM ledger GROUP BY 1), i AS (SELECT * FROM m WHERE model_id = 'model-en'), b AS (SELECT * FROM m WHERE model_id <> 'model-en' AND articles >= 20 ORDER BY s DESC, model_id LIMIT 1), v AS (SELECT CASE WHEN i.articles < 20 THEN 'rescore_candidates' WHEN coalesce(b.s - i.s >= 0.05, false) THEN 'switch_and_pause' WHEN 0.9 - i.s > 0.1 THEN 'rescore_candidates' ELSE 'confirmed' END AS verdict, CASE WHEN i.articles >= 20 AND coalesce(b.s - i.s >= 0.05, false) THEN b.model_id ELSE 'model-en' END AS winner FROM i LEFT JOIN b ON true) SELECT model_id, model_id = 'model-en' AS is_incumbent, model_id = winner AS selected, 0.9::DOUBLE AS leaderboard_hhem, round_even(s, 6) AS measured_hhem, articles, verdict FROM m, v",
        "fingerprint_classify": "WITH c AS (" + STAMPS.replace("{y}", "1") + "), p AS (" + STAMPS.replace("{y}", "0") + ") SELECT item, o AS observation, o = 'unchanged' AS skippable FROM (SELECT c.item, CASE WHEN p.fingerprint IS NULL THEN 'first_run' WHEN p.fingerprint <> c.fingerprint THEN 'inputs_changed' WHEN c.output_digest IS NULL OR p.output_digest IS NULL THEN 'unchanged' WHEN c.output_digest <> p.output_digest THEN 'determinism_violation' ELSE 'unchanged' END AS o FROM c LEFT JOIN p USING (item))",
        "ledger_append": "SELECT o_custkey AS key, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1",
        "digest_append": plan + f", n AS (SELECT day, item_id, vertical, ordinal, {position} AS p FROM plan), u AS (SELECT day, item_id, vertical, 0 AS part, p, 1 AS introduced_by_run FROM n WHERE ordinal <= 2 UNION ALL SELECT day, item_id, vertical, 1, p, 2 FROM n WHERE ordinal > 2) SELECT day, item_id, vertical, introduced_by_run, CAST(row_number() OVER (PARTITION BY day ORDER BY part, p) AS INTEGER) AS position FROM u",
        "run_manifest": plan + ", s AS (SELECT day, CASE WHEN carried_by > 1 THEN 'ok' WHEN tier = 3 THEN 'skipped' ELSE 'failed' END AS status, 'fp-' || tier AS f FROM plan) SELECT day, day || '-1' AS run_id, 1 AS n, CASE WHEN any_value(partial) THEN 'partial' ELSE 'completed' END AS status, count(*) AS items_planned, count(*) FILTER (s.status = 'ok') AS items_succeeded, count(*) FILTER (s.status = 'failed') AS items_failed, count(*) FILTER (s.status = 'skipped') AS items_skipped, array_to_string(list_sort(list(DISTINCT f)), ',') AS fingerprints FROM s JOIN counters USING (day) GROUP BY day",
        "vertical_counts": plan + 'SELECT day, vertical, count(*) AS "count" FROM pub GROUP BY 1, 2',
        "search_topk": "WITH s AS (SELECT CAST(q.vec_id AS VARCHAR) AS vec_id, 'item-' || lpad(CAST(e.vec_id AS VARCHAR), 6, '0') AS item_id, '2026-08-' || lpad(CAST(e.vec_id % 28 + 1 AS VARCHAR), 2, '0') AS date, round_even(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, date DESC, item_id) AS INTEGER) AS place FROM s WHERE score >= 0.2) SELECT * FROM r WHERE place <= 10",
        "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
        "stream_deduplicated": "SELECT DISTINCT user_id || '/' || event_type AS key FROM events",
        "cost_report": COSTS,
        "page_text": f"""WITH lines AS (SELECT page_id, {sanitized(page_lines())} AS body FROM pages), counted AS (SELECT *, {split_words('body')} AS s, substr(trim(regexp_replace({sanitized("string_split(body, chr(10))[1]")}, '[{WHITE}]+', ' ', 'g')), 1, 500) AS title FROM lines)
SELECT page_id, title, CASE WHEN len(s) < 250 THEN 'extract_failed' ELSE 'ok' END AS status, CASE WHEN len(s) < 250 THEN 'only ' || len(s) || ' words extracted; page furniture is short' END AS failure_detail,
  CASE WHEN len(s) >= 250 THEN CAST(least(len(s), 1923) AS INTEGER) END AS word_count, CASE WHEN len(s) >= 250 THEN CAST(floor(least(len(s), 1923) * 1.3) AS INTEGER) END AS token_count, len(s) > 1923 AS truncated,
  CASE WHEN len(s) >= 250 THEN md5(CASE WHEN len(s) > 1923 THEN array_to_string(s[1:1923], ' ') ELSE body END) END AS md5
FROM counted""",
        "sanitize_text": f"SELECT page_id, md5({sanitized('html')}) AS md5, CAST(length({sanitized('html')}) AS INTEGER) AS length FROM pages",
        "vector_roundtrip": "WITH b AS (SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(round_even(greatest(least(CAST(x AS DOUBLE), 1.0), -1.0) * 127, 0) AS INTEGER)) AS v FROM embeddings) SELECT vec_id, base64(unhex(array_to_string(list_transform(v, lambda x: lpad(hex(CAST((x + 256) % 256 AS INTEGER)), 2, '0')), ''))) AS text, round_even(list_dot_product(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 5) AS kept FROM b",
        "chunk_windows": f"WITH w AS (SELECT doc_id, {split_words('text')} AS s FROM documents), c AS (SELECT doc_id, CASE WHEN len(s) = 0 THEN [] WHEN len(s) <= 900 THEN [s] ELSE list_transform(generate_series(0, len(s) - 1, 750), lambda i: s[i+1:i+900]) END AS x FROM w) SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, CAST(len(w) AS INTEGER) AS words, md5(array_to_string(w, ' ')) AS md5 FROM (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM c)",
        "truncate_tokens": f"WITH w AS (SELECT doc_id, text, {split_words('text')} AS s FROM documents) SELECT doc_id, len(s) > 384 AS truncated, CAST(least(len(s), 384) AS INTEGER) AS kept_words, md5(CASE WHEN len(s) > 384 THEN array_to_string(s[1:384], ' ') ELSE text END) AS md5 FROM w",
        "text_filter": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')",
        "status_classify": "WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 600 AS INTEGER) AS status FROM orders), c AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (408, 425, 429, 500, 502, 503, 504) THEN 'transient' ELSE 'permanent' END AS outcome FROM s) SELECT *, CASE outcome WHEN 'ok' THEN 'ok' ELSE 'fetch_failed' END AS article_status FROM c",
        "retention_report": f"WITH f AS (SELECT DATE '2025-01-01' + CAST(page_id % 600 AS INTEGER) AS d, page_id % 3 < 2 AS visual, octet_length(encode(html)) AS length FROM pages), n AS (SELECT count(*) FILTER (visual AND d < DATE '2026-08-22' - 180) AS c, coalesce(sum(length), 0)::BIGINT AS b, count(*) AS k FROM f) SELECT c AS considered, least(c, 50) AS deleted, false AS dry_run, c > 50 AS fuse_tripped, b AS bytes, k AS files, b / 1000000.0 > 800 AS over_budget, round_even(1024 - b / 1000000.0::DOUBLE, 3) AS headroom_mb FROM n",
        "same_unit_bars": "WITH g AS (SELECT l_orderkey, l_returnflag AS u, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, f, u) AS k, count(*) OVER (PARTITION BY l_orderkey) AS c FROM g) SELECT l_orderkey, u AS unit, CAST(n AS INTEGER) AS bars, CASE WHEN c = 1 THEN u END AS common_unit FROM r WHERE k = 1",
        "summary_gate": f"WITH r AS (SELECT conv_id, turn, text, len({split_words('text')}) AS n FROM conversations WHERE role = 'assistant'), d AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN 'the article did not extract, so there was nothing to summarize' WHEN conv_id % 5 = 0 THEN 'the reply was cut off by the output budget, so it never closed its JSON' WHEN n < 40 OR n > 250 THEN 'summary is ' || n || ' words, outside the publishable range' END AS failure_detail FROM r) SELECT conv_id, turn, CASE WHEN failure_detail IS NULL THEN 'ok' ELSE 'failed' END AS status, failure_detail, CASE WHEN failure_detail IS NULL THEN md5(text) END AS md5 FROM d",
        "fetch_outcome": "WITH s AS (SELECT page_id, page_id % 600 AS status, octet_length(encode(html)) AS n FROM pages), c AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (408, 425, 429, 500, 502, 503, 504) THEN 'transient' ELSE 'permanent' END AS outcome FROM s) SELECT page_id, outcome, n > 2000 AS body_truncated, CAST(least(n, 2000) AS INTEGER) AS bytes, CASE outcome WHEN 'ok' THEN 'ok' ELSE 'fetch_failed' END AS article_status FROM c",
        "route_decide": "WITH o AS (SELECT l_orderkey, count(*) AS n, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_quantity) AS steps FROM lineitem GROUP BY 1), g AS (SELECT l_orderkey, max(c) AS bars FROM (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY 1), r AS (SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN 'the routing reply was cut off by the output budget' WHEN l_orderkey % 4 = 0 THEN 'dull' WHEN l_orderkey % 4 > 1 AND (bars < 3 OR bars > 8) THEN bars || ' of ' || n || ' bars measure the same thing, which is outside the publishable range' WHEN l_orderkey % 4 = 1 AND (n < 3 OR n > 6) THEN n || ' steps is outside the publishable range' END AS refusal FROM o JOIN g USING (l_orderkey)) SELECT l_orderkey, CASE WHEN refusal IS NOT NULL THEN 'none' WHEN l_orderkey % 4 = 1 THEN 'diagram' ELSE 'chart' END AS kind, coalesce(refusal, 'dull') AS rationale, CASE WHEN refusal IS NULL THEN CASE WHEN l_orderkey % 4 = 1 THEN 'mermaid' ELSE 'vega_lite' END END AS spec_format, CASE WHEN refusal IS NULL AND l_orderkey % 4 = 1 THEN md5('%% cap' || chr(10) || 'flowchart TD' || chr(10) || array_to_string(list_transform(steps, lambda x, i: '    n' || (i - 1) || '[\"' || x || '\"]'), chr(10)) || chr(10) || array_to_string(list_transform(steps[2:], lambda x, i: '    n' || (i - 1) || ' --> n' || i), chr(10))) END AS md5 FROM r",
        "assembled_items": plan + "SELECT day, item_id, upper(vertical[1]) || vertical[2:] AS display_name, CASE WHEN CAST(source_id AS BIGINT) % 2 = 0 THEN 'user ' || source_id ELSE source_id END AS source_name, CASE WHEN CAST(source_id AS BIGINT) % 2 = 0 THEN 'community' ELSE 'reporting' END AS source_kind, CASE WHEN ordinal % 2 = 0 THEN 'medium' WHEN rank_score >= 2 THEN 'high' ELSE 'low' END AS band, item_id || '. summary of ' || item_id AS text, CASE WHEN tier = 1 THEN 'v/' || item_id END AS visual_path FROM plan WHERE carried_by > 1",
        "stream_append": "SELECT user_id || '/' || event_type AS key, min(event_id) AS event_id FROM events GROUP BY 1",
        "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(count(*) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
        "integrity_violations": "SELECT 'article' AS \"table\", CAST(doc_id AS VARCHAR) AS key, 'ok has text and title' AS rule FROM documents WHERE n_chars >= 200 AND n_chars < 300 UNION ALL SELECT 'article', CAST(doc_id AS VARCHAR), 'failed has a reason' FROM documents WHERE n_chars < 200 UNION ALL SELECT 'orders', o_custkey || '/' || o_orderstatus || '/' || o_orderpriority, 'one order of a kind' FROM orders GROUP BY o_custkey, o_orderstatus, o_orderpriority HAVING count(*) > 1",
    }
    return found
