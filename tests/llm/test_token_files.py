import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from tokenizers import Tokenizer

from thicket.llm import token_files as tf
from thicket.llm._store import shared_folder

PATH = tf.tokenizer_path()


def brute(rows):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    texts = [t or "" for _, t in rows]
    ids = [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    tie = [zlib.crc32(np.array(x, "<u2").tobytes()) for x in ids]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, tie[i]))
    for i in order:
        out.append((rows[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    return out


def got(df):
    return [tuple(r) for r in df.orderBy("start").collect()]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(tf.op5_token_files(spark, sf_dir)) == brute(rows)


EDGE = [
    (5, None), (2, ""), (9, " \t\n "), (1, "a b c\x1cd\x85e é é ́x ΑΣ Σ İ"), (7, "<|endoftext|> x<|startoftext|>y # 2"),
    (3, "it's we'll 123 ½ ß 漢字 😀!!"), (3, "it's we'll 123 ½ ß 漢字 😀!!"), (3, "another"), (None, "no id"), (None, None), (4, "long " * 60_000), (6, "w" * 3000),
]


def test_edge_rows_over_several_files(spark):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in EDGE], "doc_id long, text string, start int, file int").repartition(4)
    folder = shared_folder(spark, "t")
    index = tf.write(df.select("doc_id", "text"), folder, PATH, frame_ids=10, docs_per_file=3)
    assert index.select("file").distinct().count() > 2
    out = tf.checksums(tf.read(tf.starts(index), folder, PATH), np.dtype("<u2")).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert got(out) == brute(EDGE)
    assert got(tf.token_table(df, folder=shared_folder(spark, "t"))) == brute(EDGE)


def test_empty_table(spark):
    assert got(tf.token_table(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_bounded_store_of_words(spark, sf_dir, monkeypatch):
    encoder = tf.Encoder(PATH)
    monkeypatch.setattr(tf, "KEPT_WORDS", 40)
    for texts in (["a b c d e f g"] * 3, [" ".join(f"w{i}" for i in range(60)), "a b", ""], ["c d zz", "w3 w4"]):
        raw = "".join(texts).encode()
        offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
        ids, where = encoder.encode(np.frombuffer(raw, np.uint8), offsets, 2)
        want = [Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids + [2] for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(where[:-1], where[1:], strict=True)] == want


def test_file_layout_and_checksums(tmp_path):
    frames = [np.arange(k, k + 1000, dtype="<u2") for k in range(5)]
    path = str(tmp_path / "x.zst")
    tf.write_file(path, iter(frames))
    data = open(path, "rb").read()
    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == b"".join(f.tobytes() for f in frames)
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (n, flags, magic) == (5, 0x80, 0x8F92EAB1)
    file = tf.SeekableFile(path)
    assert file.table[2].tolist()[2] == xxhash.xxh64_intdigest(frames[2].tobytes()) & 0xFFFFFFFF
    assert file.frame(3, np.dtype("<u2")).tolist() == frames[3].tolist()
    broken = bytearray(data)
    broken[int(file.starts[1]) + 12] ^= 1
    open(path, "wb").write(bytes(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tf.SeekableFile(path).frame(1, np.dtype("<u2"))
    assert tf.SeekableFile(path).frame(2, np.dtype("<u2")).tolist() == frames[2].tolist()
