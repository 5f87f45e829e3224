"""Token ids in seekable zstandard files.

A file holds independent zstandard frames, a directory frame, and the seek table of the public
zstandard seekable format; the last two are skippable frames, so plain zstandard tools read the
ids alone. Each frame's seek-table entry holds its compressed and decompressed size and the low
32 bits of the XXH64 of its content. The directory gives each frame's first row and each row's id
and number of ids, so a reader finds and decompresses only the frames of the rows it is asked for.

A frame's content is the ids of whole rows as little-endian unsigned 32-bit integers. Rows lie in
ascending order of their key over all files; a null key comes first and reads back as null; rows
with equal keys keep an order fixed by their text. Null and empty texts hold the end id alone; a very long
text is a frame of its own, however many ids it has. No rows give no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.common import binary_list, bounded_batches, shared_folder, slices, text_bytes, thrifty
from siltline.llm.wordbpe import encoder

SKIPPABLE, DIRECTORY, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_IDS = 1 << 18
NULL_KEY = -(1 << 63)


class TokenFileWriter:
    """Writes rows of ids to an open binary file; a frame is closed once it has ``frame_ids`` ids."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 3):
        self.out, self.frame_ids = out, frame_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.frames, self.keys, self.counts, self.rows_of, self.held, self.size = [], [], [], [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Rows one after the other: ``ids`` holds counts[0] ids of the first, and so on."""
        edge = np.cumsum(counts)
        at = row = 0
        while row < len(keys):
            last = int(np.searchsorted(edge, (edge[row - 1] if row else 0) + self.frame_ids - self.size)) + 1
            last = min(max(last, row + 1), len(keys))
            self.held.append(ids[at : edge[last - 1]].astype("<u4", copy=False).tobytes())
            self.size += int(edge[last - 1]) - at
            self.keys.append(keys[row:last])
            self.counts.append(counts[row:last])
            at, row = int(edge[last - 1]), last
            if self.size >= self.frame_ids:
                self._close()

    def _close(self) -> None:
        raw = b"".join(self.held)
        packed = self.compressor.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.rows_of.append(sum(map(len, self.keys)) - sum(self.rows_of))
        self.held, self.size = [], 0

    def finish(self) -> tuple[int, int]:
        """Closes the last frame, writes the directory and the seek table; gives rows and ids."""
        if sum(map(len, self.keys)) > sum(self.rows_of):
            self._close()
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        body = struct.pack("<QI", len(keys), len(self.rows_of)) + np.array(self.rows_of, "<u8").tobytes() + keys.astype("<i8").tobytes() + counts.astype("<u8").tobytes()
        body = self.compressor.compress(body)
        self.out.write(struct.pack("<II", DIRECTORY, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in [*self.frames, (len(body) + 8, 0, 0)]) + struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        return len(keys), int(counts.sum())


class TokenFileReader:
    """Reads a file of TokenFileWriter from a seekable binary file."""

    def __init__(self, file):
        self.file, end = file, file.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end")
        table = np.frombuffer(self._at(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        self.frames, self.place = table[:-1], np.concatenate(([0], np.cumsum(table[:, 0], dtype=np.int64)))
        body = zstandard.ZstdDecompressor().decompress(self._at(int(self.place[frames - 1]) + 8, int(table[-1, 0]) - 8))
        rows, n = struct.unpack_from("<QI", body)
        self.rows_of = np.frombuffer(body, "<u8", n, 12).astype(np.int64)
        self.keys = np.frombuffer(body, "<i8", rows, 12 + 8 * n)
        self.counts = np.frombuffer(body, "<u8", rows, 12 + 8 * (n + rows)).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.rows_of)))

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, i: int) -> np.ndarray:
        packed, raw, checksum = map(int, self.frames[i])
        content = zstandard.ZstdDecompressor().decompress(self._at(int(self.place[i]), packed), max_output_size=raw)
        if len(content) != raw or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} does not match its checksum")
        return np.frombuffer(content, "<u4")

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, counts and ids, a frame at a time."""
        for i in range(len(self.frames)):
            part = slice(self.first[i], self.first[i + 1])
            yield self.keys[part], self.counts[part], self.frame(i)

    def read(self, key: int) -> list[np.ndarray]:
        """The ids of each row with this key; decompresses only the frames that hold one."""
        found, left, right = [], np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, "right")
        open_frame, ids = -1, np.zeros(0, np.uint32)
        for row in range(left, right):
            i = int(np.searchsorted(self.first, row, "right")) - 1
            if i != open_frame:
                open_frame, ids = i, self.frame(i)
            at = int(self.counts[self.first[i] : row].sum())
            found.append(ids[at : at + int(self.counts[row])])
        return found


def opened(uri: str):
    """The pyarrow file system and path of a folder or file, local, object store or HDFS."""
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_token_files(df: DataFrame, key: str, text: str, vocabulary: str, end: int, folder: str | None = None) -> DataFrame:
    """Encodes each text, appends ``end`` and writes files in ascending key order.

    Returns one row per file: path, part, n_rows, n_ids. A task writes under a name of its own
    and moves the whole file in place, so a repeated task leaves the same files.
    """
    bounded_batches(df.sparkSession)
    folder = folder or shared_folder(df.sparkSession, "token-files")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words, fs_path = encoder(vocabulary), opened(folder)
        fs, root = fs_path
        fs.create_dir(root, recursive=True)
        own, path = f"{root}/.{part:06d}-{uuid.uuid4().hex}", f"{root}/part-{part:06d}.zst"
        seen = 0
        with fs.open_output_stream(own) as out:
            writer = TokenFileWriter(out)
            for batch in batches:
                keys, texts = batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False), binary_list(batch.column(1))
                for a, b in slices(texts):
                    ids, counts = words.encode(texts[a:b], end)
                    writer.add(keys[a:b], ids, counts)
                seen += len(texts)
            n_rows, n_ids = writer.finish()
        if seen:
            fs.move(own, path)
            yield pa.RecordBatch.from_pydict({"path": [path], "part": [part], "n_rows": [n_rows], "n_ids": [n_ids]})
        else:
            fs.delete_file(own)

    rows = df.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t"))
    rows = rows.withColumn("tie", F.xxhash64("t")).repartitionByRange("k", "tie").sortWithinPartitions("k", "tie")
    files = rows.select("k", "t").mapInArrow(thrifty(write), "path string, part long, n_rows long, n_ids long")
    manifest = files.collect()  # one row per file
    return df.sparkSession.createDataFrame([(f"{folder}/{r.path.rsplit('/', 1)[1]}", r.part, r.n_rows, r.n_ids) for r in manifest], "path string, part long, n_rows long, n_ids long")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per row of the files: key, start (ids of all rows before it), n_ids, ids_crc32.

    ``files`` is write_token_files()'s result: as many rows as files.
    """
    listed, base = [], 0
    for r in sorted(files.collect(), key=lambda r: r.part):
        listed.append((r.path, base))
        base += r.n_ids

    def read(batches):
        for batch in batches:
            for uri, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = opened(uri)
                with fs.open_input_file(path) as file:
                    for keys, counts, ids in TokenFileReader(file).rows():
                        edge = np.concatenate(([0], np.cumsum(counts)))
                        raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64(), mask=keys == NULL_KEY), pa.array(at + edge[:-1], pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["key", "start", "n_ids", "ids_crc32"])
                        at += int(edge[-1])

    spark = files.sparkSession
    names = spark.createDataFrame(listed, "path string, base long")
    if listed:
        names = names.repartition(len(listed))
    return names.mapInArrow(thrifty(read), "key long, start long, n_ids long, ids_crc32 long")
