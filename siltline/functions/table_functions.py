"""Table functions for SQL: quantities and windows of texts that come in several rows.

``SELECT * FROM numeric_facts(TABLE(SELECT doc_id, line FROM lines) PARTITION BY doc_id ORDER BY n)``

The first column is the key (a text, or cast to one), the second the text; others are not looked at.
Rows of one key that follow each other are one text: PARTITION BY brings them together, ORDER BY into
order. Facts are then told once for all rows of a key, up to the limit; windows run over the ends of
rows. A key's rows are read as a stream, so at most a window of words and the facts found are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltline.functions.facts import distinct_facts

FACTS = "key string, position int, value decimal(38,10), raw string, unit string, context string"
WINDOWS = "key string, chunk int, words int, text string"
BLANKS = " \t\n\v\f\r"


class _Rows:
    """Gathers result rows and gives them as tables."""

    def __init__(self, names: list[tuple[str, pa.DataType]]) -> None:
        self.names, self.held = names, []

    def table(self) -> pa.Table:
        rows, self.held = self.held, []
        return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(self.names)], [n for n, _ in self.names])


def numeric_facts_udtf(limit: int = 16):
    @F.arrow_udtf(returnType=FACTS)
    class NumericFacts:
        def __init__(self) -> None:
            self.key, self.seen = None, None
            self.out = _Rows([("key", pa.string()), ("position", pa.int32()), ("value", pa.decimal128(38, 10)), ("raw", pa.string()), ("unit", pa.string()), ("context", pa.string())])

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for key, text in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if self.seen is None or key != self.key:
                    self.key, self.seen = key, set()
                for fact in distinct_facts(text, self.seen, limit):
                    self.out.held.append((key, len(self.seen) - 1, *fact))
            yield self.out.table()

    return NumericFacts


def chunks_udtf(size: int = 900, overlap: int = 150):
    step = size - overlap

    @F.arrow_udtf(returnType=WINDOWS)
    class Chunks:
        def __init__(self) -> None:
            self.key, self.begun = None, False
            self.out = _Rows([("key", pa.string()), ("chunk", pa.int32()), ("words", pa.int32()), ("text", pa.string())])

        def window(self) -> None:
            own = self.words[:size]
            self.out.held.append((self.key, self.chunk, len(own), " ".join(own)))
            del self.words[:step]
            self.chunk += 1

        def close(self) -> None:
            """The windows that are left: one if all fitted, else until no word starts another."""
            if self.begun:
                if self.words and not self.chunk and len(self.words) <= size:
                    self.window()
                    self.words = []
                while self.words:
                    self.window()

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            for key, text in zip(batch.column(0).cast(pa.string()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not self.begun or key != self.key:
                    self.close()
                    self.key, self.begun, self.words, self.chunk = key, True, [], 0
                self.words += [w for w in (text or "").translate(SPACES).split(" ") if w]
                while len(self.words) > size:
                    self.window()
            yield self.out.table()

        def terminate(self) -> Iterator[pa.Table]:
            self.close()
            yield self.out.table()

    return Chunks


SPACES = str.maketrans(dict.fromkeys(BLANKS, " "))


def register(spark: SparkSession, limit: int = 16, size: int = 900, overlap: int = 150) -> None:
    """Makes ``numeric_facts`` and ``text_chunks`` known to SQL."""
    spark.udtf.register("numeric_facts", numeric_facts_udtf(limit))
    spark.udtf.register("text_chunks", chunks_udtf(size, overlap))
