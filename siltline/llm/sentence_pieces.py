"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf; its pieces, scores, kinds and normaliser settings are read from the
wire format, and a tokenizers model (unigram scores, or BPE merges in order of the pieces' scores)
is rebuilt with byte fallback. White space becomes the metaspace sign, with one put before the text.

No piece holds a metaspace after another sign (checked when the model is read), so nothing joins
across the start of a run of spaces: a text is cut there, each different chunk is encoded once, in
multithreaded batches, and its ids are reused. A model for which this does not hold encodes whole
texts. A metaspace sign in a text counts as a space, as the library has it. Model settings that are not
carried over (suffix spaces, unescaped spaces, pieces of the user in BPE) are an error.

Null and empty texts have no ids and decode to the empty text. Repeated rows and rows without an id are
encoded each for itself. Very long texts are encoded whole, chunk by chunk.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import binary_list, bounded_batches, ragged, slices, text_bytes, thrifty

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(raw: bytes):
    """(number, value) of each field of a protobuf message: integers, or bytes of fixed or counted size."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = raw[at]
            at, value, shift = at + 1, value | (byte & 0x7F) << shift, shift + 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(raw):
        head, at = varint(at)
        kind = head & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield head >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    unknown: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @staticmethod
    def parse(raw: bytes) -> PieceModel:
        """Fields left out of the file have the format's defaults."""
        pieces, trainer, normaliser = [], {}, {}
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        if trainer.get(24, 0) or not normaliser.get(5, 1) or (trainer.get(3, UNIGRAM) == BPE and any(kind == USER for _, _, kind in pieces)):
            raise ValueError("suffix spaces, unescaped spaces and pieces of the user in BPE are not carried over")
        unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        return PieceModel(pieces, trainer.get(3, UNIGRAM), unknown, bool(trainer.get(35, 0)), normaliser.get(2, b""), bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)))

    def crosses(self) -> bool:
        """Whether some piece goes on with a metaspace after another sign."""
        return any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER))

    def tokenizer(self):
        """The rebuilt model alone: text is normalised and cut before it."""
        from tokenizers import Tokenizer, models

        if self.kind == UNIGRAM:
            lowest = min((s for _, s, kind in self.pieces if kind == NORMAL), default=0.0)
            scores = [(p, s if kind in (NORMAL, USER) else lowest - 100.0) for p, s, kind in self.pieces]
            return Tokenizer(models.Unigram(scores, self.unknown, self.byte_fallback))
        if self.kind != BPE:
            raise ValueError("only unigram and BPE models are known")
        number = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        score = {p: s for p, s, kind in self.pieces if kind == NORMAL}
        merges = [(-score[p], number[p], number[p[:i]], number[p[i:]], p[:i], p[i:]) for p in score for i in range(1, len(p)) if p[:i] in score and p[i:] in score]
        return Tokenizer(models.BPE(number, [m[4:] for m in sorted(merges)], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback))

    def normaliser(self):
        from tokenizers import normalizers

        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            from tokenizers import Regex

            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        return normalizers.Sequence(steps) if steps else None


class PieceCodec(dict):
    """Chunk bytes -> number; the ids of chunk i are flat[start[i] : start[i] + length[i]]."""

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        with open(path, "rb") as file:
            self.model = PieceModel.parse(file.read())
        self.tokenizer, self.normaliser, self.most = self.model.tokenizer(), self.model.normaliser(), most
        self.cut = None if self.model.crosses() else re.compile(rb" *[^ ]+| +")
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN, UNUSED) else p.replace(SPACE, " ").encode() for p, _, kind in self.model.pieces]
        self.raw[self.model.unknown] = " ⁇ ".encode()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat, self.start, self.length = array("I"), array("q"), array("q")

    def prepared(self, text: bytes) -> bytes:
        """Normalised text, with the dummy space before it; spaces stand for metaspaces."""
        if self.normaliser is not None:
            text = self.normaliser.normalize_str(text.decode("utf-8", "replace")).encode()
        return (b" " + text if text and self.model.dummy_prefix else text).replace(SPACE.encode(), b" ")

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's number of ids."""
        if len(self) > self.most:
            self.forget()
        chunks = [(self.cut.findall(t) if self.cut else [t] if t else []) for t in map(self.prepared, texts)]
        new = list({c for own in chunks for c in own if c not in self})
        if new:
            as_text = [c.decode("utf-8", "replace").replace(" ", SPACE) for c in new]
            for chunk, made in zip(new, self.tokenizer.encode_batch_fast(as_text, add_special_tokens=False), strict=True):
                self[chunk] = len(self.start)
                ids = made.ids
                self.start.append(len(self.flat))
                self.length.append(len(ids))
                self.flat.extend(ids)
        counts = np.fromiter(map(len, chunks), np.int64, len(chunks))
        number = np.fromiter((self[c] for own in chunks for c in own), np.int64, int(counts.sum()))
        if not len(number):
            return np.zeros(0, np.uint32), counts
        start, length, flat = np.array(self.start), np.array(self.length), np.array(self.flat, np.uint32)
        lengths = length[number]
        before = np.concatenate(([0], np.cumsum(lengths)))
        edge = np.concatenate(([0], np.cumsum(counts)))
        return flat[ragged(start[number], lengths)], before[edge[1:]] - before[edge[:-1]]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids, without the dummy space; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.raw.__getitem__, ids.tolist()))
        if self.model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
        return text


_OPEN: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One for each worker process."""
    if path not in _OPEN:
        _OPEN[path] = PieceCodec(path)
    return _OPEN[path]


def parity(path: str, texts: list[str]) -> list[int]:
    """Places of the texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    theirs, own = sentencepiece.SentencePieceProcessor(model_file=path), codec(path)
    ids, counts = own.encode([t.encode() for t in texts])
    edge = np.concatenate(([0], np.cumsum(counts)))
    wanted = theirs.encode(texts, num_threads=1)
    return [i for i, w in enumerate(wanted) if ids[edge[i] : edge[i + 1]].tolist() != w or own.decode(ids[edge[i] : edge[i + 1]]).decode() != theirs.decode(w)]


def encode_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: key and ids of the whole text."""
    bounded_batches(df.sparkSession)

    def work(batches):
        pieces = codec(path)
        for batch in batches:
            texts = binary_list(batch.column(1))
            for a, b in slices(texts):
                ids, counts = pieces.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["key", "ids"])

    return df.select(F.col(key).cast("long").alias("key"), text_bytes(text)).mapInArrow(thrifty(work), "key long, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """Per row: key and the text of its ids; null ids decode to the empty text."""

    def work(batches):
        pieces = codec(path)
        for batch in batches:
            lists = batch.column(1)
            texts = [pieces.decode(np.array(x or [], np.int64)) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode() for t in texts], pa.string())], names=["key", "text"])

    return df.select(F.col(key).cast("long").alias("key"), F.col(ids).alias("ids")).mapInArrow(thrifty(work), "key long, text string")


def round_trips(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Per row: key, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), text_crc32 of the decoded text, same."""
    bounded_batches(df.sparkSession)

    def work(batches):
        pieces = codec(path)
        for batch in batches:
            texts = binary_list(batch.column(1))
            for a, b in slices(texts):
                ids, counts = pieces.encode(texts[a:b])
                edge = np.concatenate(([0], np.cumsum(counts))).tolist()
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                back = [pieces.decode(ids[x:y]) for x, y in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(edge, edge[1:], strict=False)], pa.int64()),
                    pa.array([zlib.crc32(t) for t in back], pa.int64()), pa.array([t == u for t, u in zip(back, texts[a:b], strict=True)]),
                ], names=["key", "n_ids", "ids_crc32", "text_crc32", "same"])

    return df.select(F.col(key).cast("long").alias("key"), text_bytes(text)).mapInArrow(thrifty(work), "key long, n_ids long, ids_crc32 long, text_crc32 long, same boolean")
