import hashlib
import struct
import zlib

import numpy as np
import pytest

from thicket.llm import media as m


def by_bit(data, lookup_tables, blocks):
    """A plain decoder of one component without restarts, bit by bit."""
    bits = "".join(f"{b:08b}" for b in data.replace(b"\xff\x00", b"\xff"))
    at, out, last = 0, [], 0

    def symbol(codes):
        nonlocal at
        code = ""
        while code not in codes:
            code += bits[at]
            at += 1
        return codes[code]

    def value(size):
        nonlocal at
        v = int(bits[at : at + size] or "0", 2)
        at += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    for _ in range(blocks):
        block = [0] * 64
        last += value(symbol(lookup_tables[0]))
        block[0], k = last, 1
        while k < 64:
            rs = symbol(lookup_tables[1])
            if rs == 0:
                break
            k += rs >> 4
            if rs & 15:
                block[k] = value(rs & 15)
            k += 1
        out.append(block)
    return out


def codes_of(table):
    out, code, k = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[f"{code:0{length}b}"] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


DC = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, *range(12)])  # the standard's table for luminance
AC_SYMBOLS = [0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0xF0, 0x06]
AC = bytes([0, 2, 1, 3, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, *AC_SYMBOLS])


def written(blocks, dc, ac):
    """A plain encoder: the scan of some blocks."""
    dc_codes, ac_codes = ({v: k for k, v in codes_of(t).items()} for t in (dc, ac))
    bits, last = "", 0

    def number(v):
        size = abs(v).bit_length()
        return size, f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else ""

    for block in blocks:
        size, extra = number(block[0] - last)
        bits, last = bits + dc_codes[size] + extra, block[0]
        run = 0
        for v in block[1:]:
            if v == 0:
                run += 1
                continue
            while run > 15:
                bits, run = bits + ac_codes[0xF0], run - 16
            size, extra = number(v)
            bits, run = bits + ac_codes[run << 4 | size] + extra, 0
        if run:
            bits += ac_codes[0]
    bits += "1" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")


def some_blocks(rng, n):
    out = []
    for _ in range(n):
        block = [0] * 64
        block[0] = int(rng.integers(-500, 500))
        for k in (1, 2, 4, 6, 30, 62, 63):
            if rng.random() < 0.5 and (k < 10 or k == 30):
                block[k] = int(rng.choice([-3, -2, -1, 1, 2, 3])) if k < 4 else 1
        block[4:] = [0] * 60 if rng.random() < 0.5 else block[4:]
        for k in range(4, 64):  # only runs that the table has
            block[k] = 0
        out.append(block)
    return out


def file_of(scan, width, height, parts, interval=0):
    sof = struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes(p) for p in parts)
    sos = bytes([len(parts)]) + b"".join(bytes([p[0], 0]) for p in parts) + bytes([0, 63, 0])
    out = bytes([0xFF, m.SOI]) + m._segment(0xE0, b"JFIF\0") + m._segment(m.DQT, b"\0" + bytes([16] + [9] * 63)) + m._segment(m.SOF0, sof)
    out += m._segment(m.DHT, b"\0" + DC + b"\x10" + AC)
    if interval:
        out += m._segment(m.DRI, struct.pack(">H", interval))
    return out + m._segment(m.SOS, sos) + scan + bytes([0xFF, m.EOI])


@pytest.mark.parametrize("interval", [0, 1, 3])
def test_plain_files(interval):
    rng = np.random.default_rng(interval)
    blocks = some_blocks(rng, 12)
    step = interval or 12
    scan = b""
    for k in range(0, 12, step):
        scan += written(blocks[k : k + step], DC, AC) + (bytes([0xFF, 0xD0 + k // step % 8]) if k + step < 12 else b"")
    media = file_of(scan, 30, 21, [(1, 0x11, 0)], interval)
    image, again = m.decode([media, media])
    assert image.blocks[0].tolist() == blocks == again.blocks[0].tolist()
    if not interval:
        assert by_bit(scan, [codes_of(DC), codes_of(AC)], 12) == blocks
    light = m.thumbnail(image)
    assert light.shape == (3, 4)
    assert abs(int(light[1, 2]) - min(max(blocks[6][0] * 2 + 128, 0), 255)) <= 1


def test_sampled_colours():
    rng = np.random.default_rng(5)
    y, cb, cr = some_blocks(rng, 4 * 6), some_blocks(rng, 6), some_blocks(rng, 6)
    # written() keeps one predictor, so one is kept for each component by writing its differences in turn
    scan_blocks, last = [], {"y": 0, "b": 0, "r": 0}
    order, running = [], 0
    for k in range(6):
        order += [("y", b) for b in y[4 * k : 4 * k + 4]] + [("b", cb[k]), ("r", cr[k])]
    for name, block in order:
        running += block[0] - last[name]
        last[name] = block[0]
        scan_blocks.append([running, *block[1:]])
    media = file_of(written(scan_blocks, DC, AC), 40, 25, [(1, 0x22, 0), (2, 0x11, 0), (3, 0x11, 0)])
    (image,) = m.decode([media])
    assert image.blocks[0].tolist() == y and image.blocks[1].tolist() == cb and image.blocks[2].tolist() == cr
    light = m.thumbnail(image)
    assert light.shape == (4, 5)
    # the first unit has the blocks (0, 0), (0, 1), (1, 0), (1, 1)
    for block, at in zip(y[:4], [(0, 0), (0, 1), (1, 0), (1, 1)], strict=True):
        assert abs(int(light[at]) - min(max(block[0] * 2 + 128, 0), 255)) <= 1


@pytest.mark.parametrize("n", [576, 576 * 7, 576 * 2731, 576 * 2800])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    media = m.encode_payload(payload)
    (image,) = m.decode([media])
    assert m.payload_of(image) == payload
    assert image.height <= 65535 and image.width * image.height >= n
    light = m.thumbnail(image)
    assert light.shape == (image.height // 8, image.width // 8)
    assert light[0, 0] == (payload[0] + 256 + 4 >> 3) + 128


@pytest.mark.parametrize("media", [b"", b"text", b"\xff\xd8\xff\xd9", m.encode_payload(b"a" * 576)[:-700], m.encode_payload(b"a" * 576).replace(b"\xff\xc0", b"\xff\xc2")])
def test_broken_files(spark, media):
    rows = m.describe(spark.createDataFrame([(1, media, 5), (2, None, 5), (3, m.encode_payload(b"x" * 576), 5)], "id int, media binary, n int"), keep=("id",)).collect()
    assert [r.width for r in sorted(rows, key=lambda r: r.id)] == [None, None, 24]


def brute(rows):
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        out.append((doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    return sorted(out, key=str)


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = m.op10_media(spark, sf_dir).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows)
    texts = dict(rows)
    for r in got[:20]:
        media = m.encode_payload(m.padded(texts[r.doc_id].encode()))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_edge_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "é" * 288), (3, "x" * 577), (4, "long text " * 30_000), (5, "\x00\xff ÿ")]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, feature string")
    got = m.media_table(df)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows)
    same = [tuple(r)[1:] for r in got.where("n_bytes = 0").collect()]
    assert len(same) == 3 and len(set(same)) == 1
    assert m.media_table(df.limit(0)).count() == 0


def test_stored_column(spark, tmp_path):
    rows = [(1, None), (2, "é" * 288), (3, "x" * 3_000_000), (4, "short")]
    media = m.media_column(spark.createDataFrame(rows, "id long, body string"), "id", "body", str(tmp_path / "media"))
    again = spark.read.parquet(str(tmp_path / "media" / "files"))  # the files are there for later readers
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, media.collect()))
    for r in again.collect():
        (image,) = m.decode([bytes(r.media)])
        assert m.payload_of(image)[: r.n_bytes] == (dict(rows)[r.doc_id] or "").encode()
    got = {r.doc_id: r for r in m.read_back(again).collect()}
    assert sorted((tuple(r)[:5] for r in got.values()), key=str) == brute(rows)
    described = {r.doc_id: r for r in m.describe(media).collect()}
    assert all((r.width, r.height, r.feature) == (described[i].width, described[i].height, described[i].feature) for i, r in got.items())
    assert all(r.feature.split(":")[1] == r.thumbnail for r in got.values())


def test_runs_of_files():
    files = [b"a" * n for n in (5, 5, 30, 1, 1, 9)]
    assert list(m._together(files, 10)) == [(0, 2), (2, 3), (3, 5), (5, 6)] and list(m._together([], 10)) == []
