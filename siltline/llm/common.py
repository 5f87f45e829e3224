"""What the training-data operators share: shared-folder tables, words, hashes and ragged gathers.

Words are runs of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z; on UTF-8 bytes that is exactly
``bytes.lower().split()``, which knows ASCII only.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siltline-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root if root.startswith("/") else root
    return f"{root.rstrip('/')}/siltline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def remove_tables(spark: SparkSession) -> None:
    """Removes what this application's operators wrote between their steps; results that are not yet used go with it."""
    remove(spark, shared_folder(spark, "x").rpartition("/")[0])


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage is cut, lost executors lose nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    table_ = df.sparkSession.read.schema(df.schema).parquet(path)
    table_.siltline_path = path
    return table_


def discard(*tables: DataFrame) -> None:
    """Removes tables of saved() that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.siltline_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def fold(bucket_column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo: how the learning rows are told from the held-out ones."""
    return F.crc32(F.col(bucket_column).cast("string").cast("binary")) % modulus


def held_out(bucket_column: str, modulus: int, remainder: int) -> Column:
    """Whether an id belongs to the rows held out; a null id does not."""
    return F.coalesce(fold(bucket_column, modulus) == remainder, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


class WordHashes(dict):
    """64-bit hash of each word, kept between batches up to a number of entries."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(word_hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole sequence if it is shorter."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(width, n)
    h = word_hashes[: n - width + 1].copy()
    for j in range(1, width):
        h *= MIX
        h += word_hashes[j : n - width + 1 + j]
    return np.unique(mixed(h + np.uint64(width)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i]+lengths[i]-1, one run after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = starts.astype(np.int64) - (np.cumsum(lengths, dtype=np.int64) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


TEXTS_IN_BATCH = 2000
#: Ids up to this number are broadcast, after they are counted; more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Limits the session's Arrow batches: texts are large rows, and both sides hold some batches at once.

    The same for every operator, so that none changes another's plan; who needs more puts batches together.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_IN_BATCH)


def together(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Successive batches joined until they hold about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers live on, and the executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(work):
    """A mapInArrow function that gives back its memory when it ends."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column of a batch; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def binary_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    return column.to_pylist()


def slices(texts: list[bytes], most: int = 4 << 20):
    """Index ranges of consecutive texts of about ``most`` bytes together."""
    at = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
