"""Token ids in seekable binary files: independent zstandard frames, a trailing seek table, checksums.

A file is a run of zstandard frames, then one skippable frame with the seek table: for each frame its
compressed and its plain size and the low 32 bits of the xxh64 of its plain bytes, all little-endian,
then the number of frames, a descriptor byte (128: checksums are there) and the magic number. This is
the published layout of seekable zstandard files, so any zstandard reader can also read a file whole.

Plain bytes are ids of 2 or 4 bytes. A frame holds whole documents; a document that is longer than a
frame has a frame of its own. ``read`` decompresses only the frames that hold the documents asked for.

``write`` deals documents by id range: bounds come from quantiles of the ids alone, ids are encoded where
the texts lie, and only the ids travel. Each file's task writes under a temporary name and renames, so
a repeated task gives the same file. Words (runs of bytes other than 0x20 and 0x09-0x0D) are encoded
once for each task and kept, in a bounded store, as the tokenizer never joins ids across such bytes.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import read_range, shared_folder, stored, tidy, write_bytes
from thicket.llm._text import chunks, word_bounds, word_hashes

SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 1 << 15
KEPT_WORDS = 3 << 18
BATCH_WORDS = 2048
END_ID = 2
LEVEL = 3
DOCS_PER_FILE = 8192
INDEX = "file int, frame int, at int, rank long, n_tokens long"


def write_file(uri: str, frames: Iterator[np.ndarray]) -> None:
    """Writes arrays of ids as one frame each, and the seek table."""
    _write_compressed(uri, list(_compressed(frames)))


class SeekableFile:
    """A file's seek table, and its frames on request."""

    def __init__(self, uri: str) -> None:
        self.uri = uri
        n, descriptor, magic = struct.unpack("<IBI", read_range(uri, -9, 9))
        if magic != SEEK_MAGIC or descriptor != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        body = read_range(uri, -(17 + 12 * n), 17 + 12 * n)
        if struct.unpack("<II", body[:8]) != (SKIPPABLE, 12 * n + 9):
            raise ValueError(f"{uri} has a broken seek table")
        self.table = np.frombuffer(body[8:-9], "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])

    def frame(self, k: int, kind: np.dtype) -> np.ndarray:
        packed, plain, checksum = self.table[k]
        data = zstandard.ZstdDecompressor().decompress(read_range(self.uri, int(self.starts[k]), int(packed)), max_output_size=int(plain))
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} of {self.uri} does not match its checksum")
        return np.frombuffer(data, kind)


class Encoder:
    """A tokenizer with the ids of the words met so far, in sorted arrays.

    When the store is full, words that only one run of texts had are let go.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words, self.ids = np.zeros(0, np.uint64), np.zeros(0, self.kind)
        self.first, self.count, self.runs = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _ids_of(self, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        before = np.cumsum(count) - count
        return self.ids[np.repeat(first - before, count) + np.arange(int(count.sum()))]

    def _let_go(self) -> None:
        keep = self.runs > 1
        if 2 * keep.sum() > KEPT_WORDS:
            keep[:] = False
        self.ids = self._ids_of(self.first[keep], self.count[keep])
        self.words, self.count, self.runs = self.words[keep], self.count[keep], np.ones(int(keep.sum()), np.int32)
        self.first = np.cumsum(self.count, dtype=np.int64) - self.count

    def _learn(self, words: np.ndarray, texts: Iterator[str]) -> None:
        ids, count = [self.ids], []
        while some := list(itertools.islice(texts, BATCH_WORDS)):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            count += map(len, found)
            ids.append(np.fromiter(itertools.chain.from_iterable(found), self.kind))
        count = np.array(count, np.int32)
        first = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        self.ids = np.concatenate(ids)
        at = np.searchsorted(self.words, words)
        self.words, self.first, self.count, self.runs = (np.insert(a, at, b) for a, b in ((self.words, words), (self.first, first), (self.count, count), (self.runs, 0)))

    def _missing(self, words: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.arange(len(words))
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.flatnonzero(self.words[at] != words)

    def encode(self, raw: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with the end id, and the offsets of the rows."""
        starts, ends, rows = word_bounds(raw, offsets)
        words, sample, place = np.unique(word_hashes(raw, starts, ends, lower=False), return_index=True, return_inverse=True)
        new = self._missing(words)
        if len(self.words) + len(new) > KEPT_WORDS:
            self._let_go()
            new = self._missing(words)
        if len(new):
            data = raw.tobytes()
            self._learn(words[new], (data[s:e].decode() for s, e in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)))
        at = np.searchsorted(self.words, words)
        self.runs[at] += 1
        at = at[place]
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = np.insert(self._ids_of(self.first[at], count), total[rows[1:]], end_id)
        return ids, total[rows] + np.arange(len(rows))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Adds ``ids`` (little-endian ids of 2 or 4 bytes, with the end id) and ``n_tokens``; drops ``text``.

    Null and empty texts have the end id only.
    """
    others = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column(len(others))):
                ids, where = encoder.encode(raw, offsets, end_id)
                data, width = ids.tobytes(), encoder.kind.itemsize
                rows = [data[a:b] for a, b in zip((where[:-1] * width).tolist(), (where[1:] * width).tolist(), strict=True)]
                columns = [batch.column(k).slice(lo, hi - lo) for k in range(len(others))]
                yield pa.record_batch([*columns, pa.array(rows, pa.binary()), pa.array(np.diff(where))], names=[*others, "ids", "n_tokens"])

    return docs.select(*others, "text").mapInArrow(tidy(run), f"{schema}, ids binary, n_tokens long")


def range_of(docs: DataFrame, id_col: str = "doc_id", docs_per_file: int = DOCS_PER_FILE) -> tuple[Column, int]:
    """A column with the number of the id range that a row is in, and how many ranges there are.

    Ranges hold about ``docs_per_file`` rows; null ids come first. Equal ids are in one range.
    """
    rows = docs.select(id_col).where(F.col(id_col).isNotNull())
    n = rows.count()
    files = -(-n // docs_per_file)
    if files < 2:
        return F.lit(0), 1
    cuts = rows.select(F.percentile_approx(id_col, [k / files for k in range(1, files)], 10 * files)).first()[0]
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(id_col)))
    return F.coalesce(place, F.lit(0)), len(cuts) + 1


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS, docs_per_file: int = DOCS_PER_FILE) -> DataFrame:
    """Writes ``docs`` (doc_id, text and others) as files ``folder/<file>.zst`` in ascending id order.

    Returns the index, stored as Parquet below ``folder``: the other columns, file, frame, at (where the
    document starts in its frame), rank (its place in the file) and n_tokens. Equal ids keep a fixed order
    by their ids' checksum. An empty table writes no file.
    """
    kind = _kind(tokenizer)
    others = [c for c in docs.columns if c != "text"]
    part, _ = range_of(docs, "doc_id", docs_per_file)
    encoded = encode(docs, tokenizer, end_id).withColumn("file", part).withColumn("tie", F.crc32("ids"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, index, waiting, size, frame, rank, file = {c: [] for c in others}, [], [], 0, 0, 0, 0

        def frames() -> Iterator[np.ndarray]:
            nonlocal waiting, size, frame, rank, file
            for batch in batches:
                for c in others:
                    columns[c].append(batch.column(c))
                for number, data in zip(batch.column("file").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    file, ids = number, np.frombuffer(data, kind)
                    if waiting and size + len(ids) > frame_ids:
                        yield np.concatenate(waiting)
                        waiting, size, frame = [], 0, frame + 1
                    index.append((frame, size, rank, len(ids)))
                    waiting.append(ids)
                    size, rank = size + len(ids), rank + 1
            if waiting:
                yield np.concatenate(waiting)

        body = list(_compressed(frames()))  # the number of the file is known only with its first row
        _write_compressed(f"{folder}/{file}.zst", body)
        kept = [pa.chunked_array(columns[c]).combine_chunks() for c in others]
        numbers = np.array(index, np.int64)
        yield pa.record_batch([*kept, pa.array(np.full(len(index), file, np.int32)), *(pa.array(numbers[:, k].astype(np.int32 if k < 2 else np.int64)) for k in range(4))], names=[*others, "file", "frame", "at", "rank", "n_tokens"])

    rows = encoded.select(*others, "ids", "file", "tie")

    def pack_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(_ordered(batches))

    packed = rows.groupBy("file").applyInArrow(pack_file, f"{schema}, {INDEX}")
    return stored(packed, f"{folder}/index")


def _kind(tokenizer: str) -> np.dtype:
    return _encoder(tokenizer).kind


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file's rows by id (nulls first), then checksum and ids."""
    table = pa.Table.from_batches(list(batches))
    order = pc.sort_indices(table.select(["doc_id", "tie", "ids"]), sort_keys=[("doc_id", "ascending"), ("tie", "ascending"), ("ids", "ascending")], null_placement="at_start")
    for lo in range(0, len(order), 1024):
        yield table.take(order.slice(lo, 1024)).combine_chunks().to_batches()[0]


def _compressed(frames: Iterator[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    for ids in frames:
        plain = ids.tobytes()
        packed = packer.compress(plain)
        yield packed, struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)


def _write_compressed(uri: str, body: list[tuple[bytes, bytes]]) -> None:
    table = b"".join(row for _, row in body) + struct.pack("<IBI", len(body), CHECKSUMS, SEEK_MAGIC)
    write_bytes(uri, *(packed for packed, _ in body), struct.pack("<II", SKIPPABLE, len(table)) + table)


def read(index: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """The index rows asked for, with ``ids`` read back; only their frames are decompressed."""
    kind = _kind(tokenizer)
    names = index.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, last, frame = None, None, None
        for batch in batches:
            data = []
            for f, k, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "at", "n_tokens")), strict=True):
                if file is None or file[0] != f:
                    file, last = (f, SeekableFile(f"{folder}/{f}.zst")), None
                if last != k:
                    last, frame = k, file[1].frame(k, kind)
                data.append(frame[at : at + n].tobytes())
            yield pa.record_batch([*batch.columns, pa.array(data, pa.binary())], names=[*names, "ids"])

    schema = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in names)
    return index.mapInArrow(tidy(run), f"{schema}, ids binary")


def starts(index: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before each one, in file order."""
    from pyspark.sql import Window

    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    own = Window.partitionBy("file").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = index.withColumn("within", F.sum("n_tokens").over(own) - F.col("n_tokens"))
    return placed.join(before, "file").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def checksums(rows: DataFrame, kind: np.dtype) -> DataFrame:
    """Adds ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers, in place of ``ids``."""
    names = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(crc, pa.int64())], names=[*names, "ids_crc32"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(tidy(run), f"{schema}, ids_crc32 long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_table(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Writes ``docs`` (doc_id, text), reads the files back, and returns doc_id, start, n_tokens, ids_crc32."""
    tokenizer = tokenizer or tokenizer_path()
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    index = write(docs.select("doc_id", "text"), folder, tokenizer)
    back = read(starts(index), folder, tokenizer)
    return checksums(back, _kind(tokenizer)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
