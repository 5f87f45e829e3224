"""The main text of a page by the density of its text and links.

Mark-up is read as a stream of tags; no tree is kept. An open element has a place on a stack with two
sums, and gives them to its parent as it closes, so the score of every subtree is there after one
pass, and the best span of text blocks is known at the end. How it scores:

* A block (paragraph, heading, list item, quotation, or loose text of a container) of n words outside
  links and m words inside is worth ``n - 2 m - 10``, and at least 0 without links: prose is worth its
  length, labels nothing, and links cost something. A block ends where the next one or a container begins.
* A subtree is worth the sum of its blocks, and more if it is an <article> or <main> with any text.
* From the root down, as long as one container below is worth at least four fifths of the one it is
  in, that one is taken. Ties go to the later one. A root worth nothing has no main text.

Of the chosen subtree every block is returned that does not consist of links for the most part, one a line.
Navigation, tables, comments, scripts and elements whose class or id says what they are do not count at
all. Missing end tags are supplied where the next tag needs them, stray ones are passed over.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltline.functions.text import sanitize

#: Elements by their part in a page, words of a class or id that mark furniture, and what an element's name is worth.
AWAY = frozenset("nav header footer aside form table noscript template svg button figure select dialog menu iframe canvas".split())
HIDDEN = frozenset("head script style title".split())
BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd".split())
CONTAINER = frozenset("html body div section article main ul ol dl center".split())
VOID = frozenset("br hr img input link meta source wbr area base col embed param track".split())
FURNITURE = frozenset("ad ads advert advertisement comment comments disqus sidebar related promo share social newsletter cookie cookies breadcrumb breadcrumbs sponsored".split())
PRIOR = {"article": 50, "main": 30}
BLOCK_COST, LINK_COST, MAIN_SHARE = 10, 2, 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|[^<]+|<", re.DOTALL | re.IGNORECASE)
MARKED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)


class MainText:
    """Takes a page's tags and texts one after the other; ``lines`` has the result."""

    def __init__(self) -> None:
        # name, worth, any text, best (span, worth) of the containers inside, first block
        self.stack: list[list] = [["html", 0, False, None, 0]]
        self.blocks: list[tuple[str, bool]] = []
        self.text: list[str] = []
        self.words = self.linked = self.links = 0
        self.away: list[str] = []

    def start(self, tag: str, rest: str) -> None:
        if self.away or tag in AWAY or tag in HIDDEN:
            if tag not in VOID and not rest.endswith("/"):
                self.away.append(tag)
                self.block()
            return
        if tag == "a":
            self.links = 1
        elif tag in BLOCK or tag in CONTAINER:
            self.block()
            if any(w in FURNITURE for m in MARKED.finditer(rest) for w in re.split("[^a-z]+", (m[1] or m[2] or m[3] or "").lower())):
                self.away.append(tag)
            elif tag in CONTAINER:
                self.stack.append([tag, 0, False, None, len(self.blocks)])
        elif tag in ("br", "hr"):
            self.block()

    def end(self, tag: str) -> None:
        if self.away:
            if tag in self.away:
                while self.away.pop() != tag:
                    pass
            elif tag in CONTAINER and any(x[0] == tag for x in self.stack[1:]):
                self.away.clear()
                self.end(tag)
            return
        if tag == "a":
            self.links = 0
        elif tag in BLOCK:
            self.block()
        elif tag in CONTAINER and any(x[0] == tag for x in self.stack[1:]):
            self.block()
            while self.close() != tag:
                pass

    def data(self, text: str) -> None:
        if not self.away:
            self.text.append(text)
            n = len(text.split())
            self.words += n
            self.linked += n * self.links

    def block(self) -> None:
        line = " ".join(unescape("".join(self.text)).split())
        if line:
            top = self.stack[-1]
            worth = self.words - self.linked - LINK_COST * self.linked - BLOCK_COST
            top[1] += worth if self.linked else max(worth, 0)
            top[2] = True
            self.blocks.append((line, 2 * self.linked > self.words))
        self.text, self.words, self.linked, self.links = [], 0, 0, 0

    def close(self) -> str:
        name, worth, any_text, best, first = self.stack.pop()
        if any_text:
            worth += PRIOR.get(name, 0)
        own = (first, len(self.blocks))
        found = (worth, best[1] if best and best[0] >= MAIN_SHARE * worth else own)
        if self.stack:
            top = self.stack[-1]
            top[1], top[2] = top[1] + worth, top[2] or any_text
            if any_text and (top[3] is None or worth >= top[3][0]):
                top[3] = found
        self.found = found
        return name

    def lines(self) -> list[str]:
        self.away.clear()
        self.block()
        while self.stack:
            self.close()
        worth, (first, last) = self.found
        return [line for line, links in self.blocks[first:last] if not links] if worth > 0 else []


def main_lines(html: str) -> list[str]:
    page = MainText()
    for token in TOKEN.finditer(html):
        tag = token["tag"]
        if tag:
            (page.end if token["end"] else page.start)(tag.lower(), *([] if token["end"] else [token["rest"]]))
        elif not token["raw"] and token[0][:2] not in ("<!", "<?"):
            page.data(token[0])
    return page.lines()


def main_text(html: Column) -> Column:
    """The main text of each page, one block a line, sanitised; null if there is none."""

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array(["\n".join(main_lines(x)) if x else None for x in pages.to_pylist()], pa.string())

    return F.nullif(sanitize(extract(html)), F.lit(""))
