from __future__ import annotations

import io
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltline.llm.packing import pack_documents, pack_histogram, padding, slots
from siltline.llm.token_files import TokenFileReader, TokenFileWriter, opened, read_token_files, write_token_files
from siltline.llm.wordbpe import WordEncoder, vocabulary_path


def wanted(rows, end):
    t = Tokenizer.from_file(vocabulary_path())
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4")) for i, x in rows]


def test_word_encoder_is_the_library(awkward):
    texts = [x or "" for _, x in awkward] + ["Don't STOP<|endoftext|>now", "x'll've '' 's he'd. we're,", "élan ÉLAN, İx. ǅ ß. ẞ, “a”. a…, ét., ́., ٣., ñ.!x", "<|STARTOFTEXT|> a<|b.", "a.b,c 3,4"]
    library = Tokenizer.from_file(vocabulary_path())
    for most in (10, 10_000):
        own = WordEncoder(vocabulary_path(), most)
        ids, sizes = own.encode([x.encode() for x in texts], 2)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [[*library.encode(x, add_special_tokens=False).ids, 2] for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_patterns_hold_the_histogram(histogram):
    patterns = pack_histogram(histogram, 64)
    held = Counter()
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64
        for x in lengths:
            held[x] += count
    assert held == Counter(histogram)
    plan = slots(patterns)
    assert len(plan["length"]) == sum(len(own) for _, own in patterns)


def test_padding_is_none_at_powers_of_two():
    assert padding(np.array([4096, 1024, 1000, 1]), 4096).tolist() == [0, 0, 3096, 0]


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_places_every_id_once(docs, awkward, capacity):
    out = pack_documents(docs, "doc_id", "text", vocabulary_path(), 2, capacity).toPandas()
    texts = wanted(awkward, 2)
    crcs = Counter()
    for i, ids in texts:
        for a in range(0, len(ids), capacity):
            piece = ids[a : a + capacity]
            crcs[(i, a, len(piece), zlib.crc32(piece.tobytes()), len(ids))] += 1
    got = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.itertuples())
    assert got == crcs
    total = 0
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= capacity
        total += capacity - own.length.sum()
    assert sorted(set(out.sequence_id)) == list(range(out.sequence_id.nunique()))
    assert total <= 0.1 * out.length.sum() + capacity


def test_packing_of_nothing(docs):
    assert pack_documents(docs.where("false"), "doc_id", "text", vocabulary_path()).count() == 0


def test_files_read_back(docs, awkward):
    files = write_token_files(docs, "doc_id", "text", vocabulary_path(), 1)
    out = read_token_files(files).toPandas().sort_values("start")
    texts = sorted(wanted(awkward, 1), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(out) == len(texts) and out.start.tolist() == [0, *np.cumsum(out.n_ids)[:-1]]
    got = Counter((None if r.key != r.key else int(r.key), r.n_ids, r.ids_crc32) for r in out.itertuples())
    assert got == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in texts)
    keys = out.key.fillna(-1).tolist()
    assert keys == sorted(keys)
    fs, path = opened(files.where("n_rows > 0").orderBy("part").first().path)
    with fs.open_input_file(path) as file:
        reader = TokenFileReader(file)
        for key in set(reader.keys.tolist()) - {-(1 << 63)}:
            assert Counter(x.tobytes() for x in reader.read(key)) == Counter(x.tobytes() for i, x in texts if i == key)
        assert reader.read(12345) == []
    assert read_token_files(write_token_files(docs.where("false"), "doc_id", "text", vocabulary_path(), 1)).count() == 0


def test_frames_stand_alone_and_are_checked():
    out = io.BytesIO()
    writer = TokenFileWriter(out, frame_ids=100)
    rng = np.random.default_rng(0)
    rows = [(k, rng.integers(0, 49408, n).astype(np.uint32)) for k, n in enumerate((5, 0, 250, 90, 20, 1))]
    for k, ids in rows:
        writer.add(np.array([k]), ids, np.array([len(ids)]))
    assert writer.finish() == (6, 366)
    raw = bytearray(out.getvalue())
    reader = TokenFileReader(io.BytesIO(raw))
    assert [reader.read(k)[0].tolist() for k, _ in rows] == [ids.tolist() for _, ids in rows] and len(reader.frames) > 1
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole == b"".join(ids.astype("<u4").tobytes() for _, ids in rows)
    raw[12] ^= 0xFF
    with pytest.raises((ValueError, zstandard.ZstdError)):
        TokenFileReader(io.BytesIO(raw)).read(2)
