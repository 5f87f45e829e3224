"""Fill-in-middle texts: a text's middle moved behind its suffix, between sentinels, in place.

A text is cut at two line ends into prefix, middle and suffix. Its bytes lie in one bytearray with
the sentinels put in at the cuts; two neighbouring segments change places by a rotation, three
reversals inside the array, and no second copy of the text is made. The inverse finds the three
sentinels, rotates back and takes them out, so it needs the output and its form alone.

Forms: ``psm`` is <P>prefix<S>suffix<M>middle, ``spm`` is <S>suffix<P>prefix<M>middle, ``plain`` is
the text as it was. Texts that are empty or hold a sentinel are plain: so every other output holds
each sentinel once, also where text and sentinel meet. Cuts and form depend on the row's id and the
seed alone, so repeated rows give equal outputs. Null texts are empty, a null id counts as an empty one.
Positions are counted over UTF-8 bytes and returned in code points. Very long texts are handled whole,
one in a task's memory at a time beside the batch it came in. Names of other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import bounded_batches, bytes_of, text_bytes, thrifty

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
STRIDE = 1 << 16


def reverse(view: np.ndarray, start: int, stop: int) -> None:
    """Reverses view[start:stop] in place, STRIDE bytes from each side at a time."""
    while stop - start > 1:
        n = min(STRIDE, (stop - start) // 2)
        head = view[start : start + n].copy()
        view[start : start + n] = view[stop - n : stop][::-1]
        view[stop - n : stop] = head[::-1]
        start, stop = start + n, stop - n


def rotate(buffer: bytearray, start: int, cut: int, stop: int) -> None:
    """Exchanges buffer[start:cut] and buffer[cut:stop] in place by three reversals."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, cut)
    reverse(view, cut, stop)
    reverse(view, start, stop)


def line_ends(text: bytes) -> np.ndarray:
    """Where each line stops, its break included; the first entry is 0."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    if len(text) and (not len(ends) or ends[-1] != len(text)):
        ends = np.append(ends, len(text))
    return np.concatenate(([0], ends))


def code_points(text: bytes, start: int, stop: int) -> int:
    own = np.frombuffer(text, np.uint8)[start:stop]
    return int(np.count_nonzero((own & 0xC0) != 0x80))


def transform(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with its segments [0, first), [first, second) and the rest in the order of ``form``."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def restore(output: bytes, form: str) -> bytes:
    """The text that transform() gave ``output`` for."""
    if form == "plain":
        return bytes(output)
    buffer = bytearray(output)
    start, cut = (output.index(SUFFIX), output.index(MIDDLE)) if form == "psm" else (0, output.index(PREFIX))
    rotate(buffer, start, cut, len(buffer))
    suffix = start + len(buffer) - cut
    middle = start if form == "psm" else buffer.index(MIDDLE)
    for at in (suffix, middle, 0):
        del buffer[at : at + len(PREFIX)]
    return bytes(buffer)


def cuts(seed: int, name: str, text: bytes, rate: int, spm: int) -> tuple[int, int, int, str]:
    """Number of lines, byte offsets of the two cuts, and the form."""
    ends = line_ends(text)
    n = len(ends) - 1
    hexes = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h = [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, 0, 0, "plain"
    return n, int(ends[low]), int(ends[high]), "spm" if h[3] % 100 < spm else "psm"


def fill_in_middle(docs: DataFrame, identity: str, text: str, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """id, n (lines), form, prefix_chars, middle_chars (null if plain) and output, a text, for every row.

    ``rate``: how many in 100 texts are changed; ``spm``: how many in 100 of these have the suffix first.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(identity).alias("id"), F.coalesce(F.col(identity).cast("string"), F.lit("")).alias("name"), text_bytes(text).alias("text"))

    @thrifty
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, forms, prefixes, middles, outputs = [], [], [], [], []
            for name, own in zip(batch["name"].to_pylist(), bytes_of(batch["text"]), strict=True):
                n, first, second, form = cuts(seed, name, own, rate, spm)
                lines.append(n)
                forms.append(form)
                prefixes.append(None if form == "plain" else code_points(own, 0, first))
                middles.append(None if form == "plain" else code_points(own, first, second))
                outputs.append(own if form == "plain" else bytes(transform(own, first, second, form)))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(lines, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary())],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = docs.schema[identity].dataType.simpleString()
    done = rows.mapInArrow(work, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return done.select(F.col("id").alias(identity), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restore_texts(rows: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """The rows with the text that each output was made of."""
    bounded_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != name]
    sent = rows.select(*kept, text_bytes(output).alias(name))
    at, form_at = len(kept), kept.index(form)

    @thrifty
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(t, f or "plain") for t, f in zip(bytes_of(batch.column(at)), batch.column(form_at).to_pylist(), strict=True)]
            yield batch.set_column(at, name, pa.array(texts, pa.binary()))

    return sent.mapInArrow(work, sent.schema).withColumn(name, F.col(name).cast("string"))


#: The same by string functions: a line's break belongs to it, and SQL counts code points.
FILL_MIDDLE_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
lines AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts, length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS n,
    [CAST('0x' || substr(hex, 8 * i + 1, 8) AS BIGINT) for i in range(4)] AS h FROM docs
),
cuts AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high FROM lines),
segments AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN low = 0 THEN '' WHEN low = len(parts) THEN text ELSE array_to_string(parts[1:low], chr(10)) || chr(10) END AS prefix,
    CASE WHEN high = 0 THEN '' WHEN high = len(parts) THEN text ELSE array_to_string(parts[1:high], chr(10)) || chr(10) END AS head
  FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(head) - length(prefix) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || substr(text, length(head) + 1) || '<M>' || substr(head, length(prefix) + 1)
    ELSE '<S>' || substr(text, length(head) + 1) || '<P>' || prefix || '<M>' || substr(head, length(prefix) + 1) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM segments
"""
