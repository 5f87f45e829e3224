"""RSS and Atom as rows of links: a reader that goes on after broken mark-up, for texts in a table and for files.

Feed bodies are read tag by tag. A tag that does not belong where it stands is passed over, an entry
ends where it says so or the next one begins, and what is cut off at the end counts only as far as it
was read: so entries before and after a break both come out. Entries do not depend on each other, so a
file is read in pieces and one entry is held at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from html import unescape

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltline.functions import urls as U
from siltline.functions.text import clean_title
from siltline.operators.rank import live_feeds

SCHEMA = "position int, link string, title string, published_at string"
PIECE, SPLIT = 1 << 20, 4 << 20
#: What an entry is called, what is read of it, and what holds titles and links of something else.
ENTRIES = frozenset(("item", "entry"))
FIELDS = frozenset(("title", "link", "guid", "pubdate", "published", "updated", "date"))
OTHERS = frozenset(("source", "author", "contributor", "content", "summary", "description", "encoded", "group", "image"))

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[?!][^>]*>|<(?P<end>/?)(?:(?P<prefix>[\w.-]+):)?(?P<tag>[A-Za-z][\w.-]*)(?P<rest>(?:\s+[^\s=>\"'/<]+(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s>\"'<]*))?)*)\s*(?P<empty>/?)>|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def _stamp(raw: str | None) -> str | None:
    """UTC to the second; null where there is no date to read."""
    if not raw:
        return None
    try:
        when = parsedate_to_datetime(raw) if "," in raw or raw[:1].isalpha() else datetime.fromisoformat(raw.replace("Z", "+00:00"))
        when = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
    except (ValueError, TypeError, OverflowError):
        return None
    return when.strftime("%Y-%m-%dT%H:%M:%SZ")


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}


class _Entry:
    """One entry while its tags pass by."""

    def __init__(self, prefix: str | None) -> None:
        self.prefixes = {None, prefix, "atom"}
        self.found: dict[str, str] = {}
        self.field: str | None = None
        self.other: list[str] = []
        self.text: list[str] = []

    def start(self, prefix: str | None, tag: str, rest: str, empty: bool) -> None:
        if self.other or tag in OTHERS:
            if not empty and (not self.other or tag == self.other[0]):
                self.close()
                self.other.append(tag)
            return
        if tag not in FIELDS or prefix not in self.prefixes | ({"dc"} if tag == "date" else set()):
            return
        self.close()
        given = _attributes(rest)
        if tag == "link" and given.get("href"):
            if given.get("rel", "alternate") == "alternate":
                self.found.setdefault("link", given["href"].strip())
        elif not empty and not (tag == "guid" and given.get("ispermalink", "true").lower() != "true"):
            self.field = tag

    def end(self, tag: str) -> None:
        if self.other:
            if tag == self.other[0]:
                self.other.pop()
        elif tag == self.field:
            self.close()

    def close(self) -> None:
        if self.field:
            text = "".join(self.text).strip()
            if text:
                self.found.setdefault(self.field, text)
        self.field, self.text = None, []

    def row(self) -> tuple[str | None, str | None, str | None]:
        own = self.found
        when = own.get("pubdate") or own.get("published") or own.get("updated") or own.get("date")
        return own.get("link") or own.get("guid"), own.get("title"), _stamp(when)


def entries(pieces: Iterable[str]) -> Iterator[tuple[str | None, str | None, str | None]]:
    """(link, title, time) of every entry of a feed that comes in pieces."""
    held, pieces, last = "", iter(pieces), False
    while not last:
        piece = next(pieces, None)
        last = piece is None
        held += piece or ""
        entry, begun = None, None
        for m in TOKEN.finditer(held):
            tag = (m["tag"] or "").lower()
            if tag in ENTRIES:
                if entry is not None:
                    entry.close()
                    yield entry.row()
                entry = None
                if not m["end"] and not m["empty"]:
                    entry, begun = _Entry(m["prefix"]), m.start()
                else:
                    begun = m.end()
            elif entry is None:
                continue
            elif not tag:
                if entry.field and not m[0].startswith(("<!--", "<?", "<!D")):
                    entry.text.append(m["cdata"] if m["cdata"] is not None else unescape(m[0]))
            elif m["end"]:
                entry.end(tag)
            else:
                entry.start(m["prefix"], tag, m["rest"], bool(m["empty"]))
        if last and entry is not None and (entry.found.get("link") or entry.found.get("guid")):
            yield entry.row()
        held = held[begun:] if begun is not None else held


class FeedEntries:
    """Entries of one feed body, as a table function."""

    def eval(self, body: str):
        for place, (link, title, when) in enumerate(entries([body] if body else [])):
            yield place, link, title, when


def parse_feeds(feeds: DataFrame) -> DataFrame:
    """All columns of ``feeds`` (one is ``body``) and the entries of each."""
    return feeds.lateralJoin(F.udtf(FeedEntries, returnType=SCHEMA)(F.col("body").outer()))


def _decoded(stream, piece: int) -> Iterator[str]:
    """A file's text in pieces; its first bytes or its declaration name the encoding, and what is not in it is replaced."""
    import codecs

    head = stream.read(piece)
    named = re.match(rb"(?:\xef\xbb\xbf)?\s*<\?xml[^>]*encoding\s*=\s*[\"']([\w.-]+)", head)
    name = "utf-16" if head[:2] in (b"\xff\xfe", b"\xfe\xff") else named[1].decode() if named else "utf-8-sig"
    try:
        decoder = codecs.getincrementaldecoder("utf-8-sig" if name.lower() in ("utf-8", "utf8") else name)("replace")
    except LookupError:
        decoder = codecs.getincrementaldecoder("utf-8-sig")("replace")
    while head:
        yield decoder.decode(head)
        head = stream.read(piece)
    yield decoder.decode(b"", True)


class FeedSplit(InputPartition):
    """Addresses of the files of one task."""

    def __init__(self, uris: tuple[str, ...]):
        super().__init__(uris)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.piece, self.most = options["path"], int(options.get("piece", PIECE)), int(options.get("split_bytes", SPLIT))

    def partitions(self) -> list[FeedSplit]:
        """Splits of whole files, small ones together up to ``split_bytes``; names that begin with a dot or an underscore are left out."""
        filesystem, root = pyarrow.fs.FileSystem.from_uri(self.path)
        one = filesystem.get_file_info(root)
        listed = [one] if one.is_file else filesystem.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else "file://"
        splits, size = [[]], 0
        for f in sorted(listed, key=lambda f: f.path):
            if f.is_file and not f.base_name.startswith((".", "_")):
                if splits[-1] and size + f.size > self.most:
                    splits.append([])
                    size = 0
                splits[-1].append(scheme + f.path)
                size += f.size
        return [FeedSplit(tuple(s)) for s in splits]

    def read(self, partition: FeedSplit) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for uri in partition.value:
            filesystem, path = pyarrow.fs.FileSystem.from_uri(uri)
            with filesystem.open_input_stream(path) as stream:
                for place, entry in enumerate(entries(_decoded(stream, self.piece))):
                    rows.append((uri, place, *entry))
                    if len(rows) == 1000:
                        yield self.batch(rows)
                        rows = []
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [("file", pa.string()), ("position", pa.int32()), ("link", pa.string()), ("title", pa.string()), ("published_at", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(names)], [n for n, _ in names])


class FeedFiles(DataSource):
    """``spark.read.format("feed_files").load(folder)``: a row for each entry of each feed file."""

    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return f"file string, {SCHEMA}"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)


def read_feed_files(spark: SparkSession, path: str, piece: int = PIECE, split_bytes: int = SPLIT) -> DataFrame:
    """file, position, link, title and published_at of every entry of the feed files below ``path``."""
    spark.dataSource.register(FeedFiles)
    return spark.read.format("feed_files").option("piece", piece).option("split_bytes", split_bytes).load(path)


def _candidates(rows: DataFrame) -> DataFrame:
    rows = rows.where(F.lower("link").rlike("^https?://")).withColumn("canonical_url", U.canonicalise(F.col("link")))
    first = F.row_number().over(Window.partitionBy("id", "canonical_url").orderBy("position"))
    rows = rows.withColumn("nth", first).where("nth = 1")
    return rows.select(F.col("id").alias("source_id"), "vertical", "tier", F.col("link").alias("source_url"), "canonical_url", U.url_key(F.col("canonical_url")).alias("url_key"), clean_title(F.col("title")).alias("title"), "published_at")


def candidates(feeds: DataFrame) -> DataFrame:
    """Links of live feeds: http only, one per feed and canonical address, the first kept.

    feeds has id, vertical, tier, status, retired_on and body.
    """
    return _candidates(parse_feeds(live_feeds(feeds)))


def candidates_of_files(feeds: DataFrame, folder: str) -> DataFrame:
    """The same from files ``<id>.xml`` below ``folder``; feeds is what is known of each id, without a body."""
    rows = read_feed_files(feeds.sparkSession, folder)
    named = rows.withColumn("id", F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1))
    return _candidates(live_feeds(feeds).join(named, "id"))


def salience(feeds: DataFrame) -> DataFrame:
    """Different canonical addresses that aggregator feeds vote for."""
    rows = parse_feeds(feeds).where(F.lower("link").rlike("^https?://"))
    return rows.select(U.canonicalise(F.col("link")).alias("canonical_url")).distinct()


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
