"""Text measures as column expressions. Words are ASCII runs; sentences end at . ! ? before white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltline.functions.runs import longest_common_run

#: What counts as a word, a sentence end, a number and a capitalised run; measured rows must stay comparable.
WORD = r"[A-Za-z0-9][A-Za-z0-9'.,-]*"
SENTENCE = r"(?<=[.!?])[ \t\n\f\r]+"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
CAPITALISED = r"(?U)\b[A-Z][\w.&'-]*(?:\s+[A-Z][\w.&'-]*)*"
NGRAM, LEAD_SENTENCES = 4, 3
#: White space at the ends of a text, and the blanks of all scripts (category Zs) that go after it.
SPACE, BLANKS = " \t\n\f\r", " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Words that open sentences more often than they name anything, and the calendar.
NOT_AN_ENTITY = tuple(
    """a an and as at but by for from he her his however in it its meanwhile of on one she that the their then there
    these they this to under we what when where which while who with monday tuesday wednesday thursday friday saturday
    sunday january february march april may june july august september october november december""".split()
)
#: Terms with which a source hedges.
HEDGE_TERMS = (
    "according to", "alleged", "allegedly", "apparently", "claimed", "claims", "could", "expected to", "is said to", "may", "might", "plans to",
    "potential", "purportedly", "reportedly", "reported to", "rumored", "rumoured", "seemingly", "sources say", "unconfirmed", "would",
)
HEDGE = r"(?i)\b(?:" + "|".join(HEDGE_TERMS) + r")\b"
FENCE_OPEN, FENCE_CLOSE = "<<<UNTRUSTED_SOURCE_TEXT>>>", "<<<END_UNTRUSTED_SOURCE_TEXT>>>"
#: What is taken out of a stranger's text, in this order, and what stands for it.
SANITIZER = (
    (r"(?s)<!--.*?-->", " "),
    (r"[\x{ad}\x{200b}-\x{200f}\x{2028}-\x{2029}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{e0000}-\x{e007f}]", ""),
    (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", " "),
    (r"(?imd)<\|[^|>\n]{0,64}\|>|\[/?INST\]|<</?SYS>>|^[ \t]*#{2,}[ \t]*(?:system|assistant|user)[ \t]*:", " "),
    (rf"(?i){FENCE_OPEN}|{FENCE_CLOSE}", " "),
    (r"(?iU)(?:\b(?:https?://|www\.)|\bdata:)[^\s<>\"']+", "[link]"),
    (r"(?U)\b[A-Za-z0-9+/]{40,}={0,2}", "[omitted]"),
    (r"(?U)[^\S\n]+", " "),
)


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once per row; a lambda would work it out for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sanitize(text: Column) -> Column:
    """Takes out what an injection needs and keeps what the text says; doing it twice changes nothing."""
    for pattern, by in SANITIZER:
        text = F.regexp_replace(text, pattern, by)
    lines = F.regexp_replace(F.regexp_replace(text, " *\n *", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


def untrusted_block(text: Column) -> Column:
    return F.concat(F.lit(FENCE_OPEN + "\n"), sanitize(text), F.lit("\n" + FENCE_CLOSE))


def clean_title(raw: Column) -> Column:
    flat = F.trim(F.regexp_replace(sanitize(raw), r"(?U)\s+", " "))
    return F.nullif(F.trim(F.substring(flat, 1, 500)), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def split_words(text: Column, parts: int = -1) -> Column:
    """White-space words: the other of the two word counts. Where ``parts`` is given, the text is cut into so many and the last holds the rest."""
    return F.filter(F.split(text, r"\s+", parts), lambda x: x != "")


def sentences(text: Column, first: int | None = None) -> Column:
    """All sentences, or the ``first`` ones and then what follows as one more: a text is not cut beyond what is asked for."""
    return F.split(F.btrim(F.btrim(text, F.lit(SPACE)), F.lit(BLANKS)), SENTENCE, -1 if first is None else first + 1)


def lead(text: Column, n: int = LEAD_SENTENCES) -> Column:
    return F.array_join(F.slice(sentences(text, n), 1, n), " ")


def tokens(text: Column) -> Column:
    """Words in lower case without full stops and commas at their ends."""
    return F.transform(words(text), lambda w: F.btrim(F.lower(w), F.lit(".,")))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def compression(summary: Column, source: Column) -> Column:
    return ratio(word_count(summary), word_count(source))


def ngrams(tokens_: Column, n: int = NGRAM) -> Column:
    def grams(own: Column) -> Column:
        last = F.greatest(F.size(own) - n + 1, F.lit(1))
        made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(own, i, n), "\x01"))
        return F.when(F.size(own) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(tokens_, grams)


def extractiveness(summary: Column, source: Column) -> Column:
    """Share of the summary's different 4-grams that the source holds."""
    return let(ngrams(tokens(summary)), lambda own: ratio(F.size(F.array_intersect(own, ngrams(tokens(source)))), F.size(own)))


def verbatim_run(summary: Column, source: Column) -> Column:
    """Length of the longest run of the summary's tokens that occurs in the source, as a share of the summary."""
    return ratio(longest_common_run(summary, source, WORD), F.size(tokens(summary)))


def checkable_numbers(text: Column) -> Column:
    """Different numbers of two digits and more, without commas and trailing zeros of decimals."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, ",", ""))
    bare = F.transform(bare, lambda n: F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n))
    return F.array_distinct(F.filter(bare, lambda n: F.length(F.regexp_replace(n, r"\.", "")) >= 2))


def unsupported_numbers(summary: Column, source: Column) -> Column:
    """The source is not read where the summary has no such number."""
    left = lambda own: F.when((F.size(own) == 0) & source.isNotNull(), 0).otherwise(F.size(F.array_except(own, checkable_numbers(source))))
    return let(checkable_numbers(summary), left)


def entities(text: Column) -> Column:
    """Different capitalised runs, less the words that only open sentences."""

    def of_sentence(s: Column) -> Column:
        runs = F.regexp_extract_all(s, F.lit(CAPITALISED), F.lit(0))
        named = F.transform(runs, lambda r, i: F.struct(F.lower(F.regexp_replace(r, r"^[ .,]+|[ .,]+$", "")).alias("r"), i.alias("i")))
        opens = s.rlike("^[A-Z]")
        kept = F.filter(named, lambda x: (x["r"] != "") & ~x["r"].isin(*NOT_AN_ENTITY) & ~(opens & (x["i"] == 0) & ~x["r"].contains(" ")))
        return F.transform(kept, lambda x: x["r"])

    return F.array_distinct(F.flatten(F.transform(F.transform(sentences(text), F.trim), of_sentence)))


def lead_coverage(summary: Column, source: Column) -> Column:
    """Share of the lead's names and numbers that the summary carries; 1 if there are none."""

    def share(x: Column) -> Column:
        kept = F.size(F.filter(x["names"], lambda n: x["hay"].contains(n))) + F.size(F.array_intersect(x["numbers"], x["own"]))
        total = F.size(x["names"]) + F.size(x["numbers"])
        return F.when(total == 0, F.lit(1.0)).otherwise(ratio(kept, total))

    opening = lead(source)
    return let(F.struct(entities(opening).alias("names"), checkable_numbers(opening).alias("numbers"), F.lower(summary).alias("hay"), checkable_numbers(summary).alias("own")), share)


def measures(summary: Column, source: Column) -> Column:
    """Struct of all measures of a summary against its source; each side is cut into tokens, numbers and sentences once."""

    def made(x: Column) -> Column:
        own, hay, opening = x["own"], x["hay"], x["opening"]
        shared = let(ngrams(own), lambda g: ratio(F.size(F.array_intersect(g, ngrams(hay))), F.size(g)))
        named = F.size(F.filter(x["names"], lambda n: F.lower(x["summary"]).contains(n))) + F.size(F.array_intersect(x["lead_numbers"], x["own_numbers"]))
        total = F.size(x["names"]) + F.size(x["lead_numbers"])
        return F.struct(
            F.when(total == 0, F.lit(1.0)).otherwise(ratio(named, total)).alias("coverage"), ratio(F.size(own), F.size(hay)).alias("compression"), shared.alias("extractiveness"), ratio(x["run"], F.size(own)).alias("verbatim_run"),
            F.size(F.array_except(x["own_numbers"], x["numbers"])).alias("unsupported_numbers"), (opening.rlike(HEDGE) & ~x["summary"].rlike(HEDGE)).alias("hedge_dropped"), F.size(hay).alias("source_word_count"), F.size(own).alias("summary_word_count"),
        )

    def with_lead(x: Column) -> Column:
        lead_parts = (entities(x["opening"]).alias("names"), checkable_numbers(x["opening"]).alias("lead_numbers"))
        return F.struct(*[x[c].alias(c) for c in ("own", "hay", "opening", "own_numbers", "numbers", "summary", "run")], *lead_parts)

    cut = F.struct(tokens(summary).alias("own"), tokens(source).alias("hay"), lead(source).alias("opening"), checkable_numbers(summary).alias("own_numbers"), checkable_numbers(source).alias("numbers"), summary.alias("summary"), longest_common_run(summary, source, WORD).alias("run"))
    return let(let(cut, with_lead), made)


def hedge_dropped(summary: Column, source: Column) -> Column:
    return lead(source).rlike(HEDGE) & ~summary.rlike(HEDGE)


def approx_tokens(words_: Column) -> Column:
    return (words_ * F.lit(1.3)).cast("int")


def truncate_to_tokens(text: Column, cap: int) -> Column:
    """Struct of text, truncated and kept words: cut on words, and only where it must be."""
    allowed = int(cap / 1.3)

    def cut(own: Column) -> Column:
        over = F.size(own) > allowed
        return F.struct(F.when(over, F.array_join(F.slice(own, 1, allowed), " ")).otherwise(text).alias("text"), over.alias("truncated"), F.least(F.size(own), F.lit(allowed)).alias("kept_words"))

    return let(split_words(text, allowed + 2), cut)  # an empty part before the first word, the words that stay, and a rest if there are more


def chunks(text: Column, size: int = 900, overlap: int = 150) -> Column:
    """Windows of ``size`` white-space words, each starting ``size - overlap`` after the last; one if all fit, none without words."""

    def windows(own: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(size - overlap))
        many = F.transform(starts, lambda s: F.array_join(F.slice(own, s + 1, size), " "))
        return F.when(F.size(own) == 0, F.array().cast("array<string>")).when(F.size(own) <= size, F.array(F.array_join(own, " "))).otherwise(many)

    return let(split_words(text), windows)


def contains_needle(needle: str, title: Column, summary: Column, key_points: Column) -> Column:
    low = needle.strip().lower()
    if not low:
        return F.lit(True)
    hit = lambda c: F.coalesce(F.lower(c).contains(low), F.lit(False))
    return hit(title) | hit(summary) | F.coalesce(F.exists(key_points, hit), F.lit(False))


def monogram(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.slice(F.filter(F.split(name, r"\s+"), lambda x: x != ""), 1, 2), lambda w: F.substring(w, 1, 1)), ""))


def swatch(name: Column, colours: int = 8) -> Column:
    """31-hash over the characters, kept to 32 bits, modulo the number of colours."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return (F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296) % colours).cast("int")


def split_thinking(reply: Column) -> Column:
    """Struct of thinking and answer; a fence around the answer is taken off."""
    pattern = r"(?is)<think>(.*?)</think>"
    answer = F.regexp_replace(F.regexp_replace(reply, pattern, ""), r"^\s+|\s+$", "")
    return F.struct(F.trim(F.regexp_extract(reply, pattern, 1)).alias("thinking"), F.regexp_replace(answer, r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1").alias("answer"))
