"""Media columns: baseline JPEG read and written in numpy.

``decode`` parses the markers of baseline files (8-bit, sequential, Huffman-coded, any sampling, with or
without restart intervals), decodes their scans, and gives the quantised coefficients; ``thumbnail``
makes the luminance image of one sample per block from the DC coefficients alone, without any transform.
Scans of all images of a batch are decoded side by side: each restart interval is a lane, and a step decodes one
symbol in every lane.

``encode_payload`` keeps any bytes in a valid baseline file without loss. Its unit is the quantised
coefficient: each byte b is the coefficient 256 + b, 64 of them a block in zigzag order, quantised by 1. Values
256 to 511 all have nine bits, and with one-bit Huffman codes each takes ten, so 64 bytes become 80, and
each block ends on a byte, where a restart marker stands. A comment holds the number of bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored, tidy
from thicket.llm._text import CHUNK_BYTES, chunks

UNIT = 576
WIDTH = 3
MOST_ROWS = 8191
OFFSET, BITS = 256, 9
#: Marker codes of the JPEG standard.
SOI, EOI, SOS, DQT, DHT, DRI, COM, SOF0, RST0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xFE, 0xC0, 0xD0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _codes(kind: int) -> bytes:
    """A Huffman table with the code 0 for nine bits and 10 for none."""
    return bytes([kind, 1, 1, *([0] * 14), BITS, 0])


def encode_payload(payload: bytes) -> bytes:
    """A baseline file that holds ``payload``, whose length is a positive multiple of 64."""
    data = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    across = WIDTH * -(-len(data) // (WIDTH * MOST_ROWS))
    rows = -(-len(data) // across)
    words = (data.astype(np.uint64) + np.uint64(OFFSET)).reshape(-1, 16, 4)
    packed = (words[..., 0] << np.uint64(30)) | (words[..., 1] << np.uint64(20)) | (words[..., 2] << np.uint64(10)) | words[..., 3]
    scan = packed.astype(">u8").view(np.uint8).reshape(-1, 16, 8)[..., 3:].reshape(len(data), 80)
    flat = scan.reshape(-1)
    size = 1 + (flat == 0xFF).astype(np.int64)
    size[79::80] += 2  # a marker after each block
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - size] = flat
    out[ends[79::80] - 2] = 0xFF
    out[ends[79::80] - 1] = RST0 + np.arange(len(data)) % 8
    empty = b"".join(bytes([0xAF, 0xFF, RST0 + k % 8]) for k in range(len(data), across * rows))  # blocks of zeros fill the grid
    head = bytes([0xFF, SOI]) + _segment(COM, b"payload %d" % len(payload)) + _segment(DQT, b"\0" + b"\1" * 64)
    head += _segment(SOF0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * across, 1, 1, 0x11, 0)) + _segment(DHT, _codes(0x00) + _codes(0x10))
    head += _segment(DRI, struct.pack(">H", 1)) + _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))
    return head + (out.tobytes() + empty)[:-2] + bytes([0xFF, EOI])


@dataclass
class Image:
    """What the markers of a file say, and then its coefficients: one array (blocks, 64) per component."""

    width: int = 0
    height: int = 0
    interval: int = 0
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    scan: dict[int, tuple[int, int]] = field(default_factory=dict)  # id: DC and AC table
    comment: bytes = b""
    data: np.ndarray | None = None
    blocks: list[np.ndarray] = field(default_factory=list)

    @property
    def grid(self) -> tuple[int, int, int]:
        """Columns and rows of the units that a scan is made of, and blocks in a unit."""
        if len(self.parts) == 1:
            return -(-self.width // 8), -(-self.height // 8), 1
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v)), sum(p[1] * p[2] for p in self.parts)


def parse(media: bytes) -> Image:
    """Reads the markers; raises ValueError for what is no baseline file of one scan."""
    if media[:2] != bytes([0xFF, SOI]):
        raise ValueError("no JPEG file")
    image, at = Image(), 2
    while at + 4 <= len(media):
        if media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (length,) = struct.unpack(">H", media[at + 2 : at + 4])
        body, at = media[at + 4 : at + 2 + length], at + 2 + length
        if marker == DQT:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == DHT:
            while body:
                n = 17 + sum(body[1:17])
                image.tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == DRI:
            (image.interval,) = struct.unpack(">H", body)
        elif marker == COM:
            image.comment = body
        elif marker == SOF0:
            depth, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if depth != 8 or not image.width or not image.height:
                raise ValueError("unknown depth or size")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == SOS:
            if not image.parts or body[0] != len(image.parts):
                raise ValueError("not a file of one scan")
            image.scan = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, 16 | body[2 + 2 * k] & 15) for k in range(body[0])}
            end = media.rfind(bytes([0xFF, EOI]))
            image.data = np.frombuffer(media, np.uint8)[at : end if end >= at else len(media)]
            return image
    raise ValueError("a file without a scan")


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may follow, the length of the code they begin with, times 256, and its symbol."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed value of so many bits."""
    return np.where((size > 0) & (value < (np.int64(1) << np.maximum(size - 1, 0))), value - (np.int64(1) << size) + 1, value)


class _Lanes:
    """Bit positions in the scans of many images, one for each restart interval."""

    def __init__(self, scans: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in scans])
        raw = np.concatenate([*scans, np.zeros(8, np.uint8)])
        marks = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[marks + 1]
        restarts = marks[(after >= RST0) & (after < RST0 + 8)]
        keep = np.ones(len(raw), bool)
        keep[marks[after == 0] + 1] = False
        keep[restarts] = keep[restarts + 1] = False
        place = np.concatenate([[0], np.cumsum(keep)])
        firsts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        starts = np.sort(np.concatenate([firsts, restarts + 2]))
        self.image = np.searchsorted(firsts, starts, "right") - 1
        self.bits = place[starts] * 8
        plain = np.concatenate([raw[keep], np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
        n = len(plain) - 4
        self.window = np.zeros(n, np.uint64)  # the five bytes from each place on
        for k in range(5):
            self.window |= plain[k : n + k] << np.uint64(32 - 8 * k)
        self.window = self.window.view(np.int64)

    def symbols(self, lanes: np.ndarray, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of some lanes and the value of the bits that follow it."""
        bits = self.bits[lanes]
        window, used = self.window[np.minimum(bits >> 3, len(self.window) - 1)], bits & 7
        found = lookup[(window >> (24 - used)) & 0xFFFF]
        if not found.all():
            raise ValueError("a code that is in no table")
        length, symbol = found >> 8, found & 255
        size = symbol & 15
        value = (window >> (40 - used - length - size)) & ((np.int64(1) << size) - 1)
        self.bits[lanes] = bits + length + size
        return symbol, _extended(value, size)


def _decode_alike(images: list[Image]) -> None:
    """Decodes images that have the same tables, components and restart interval."""
    first = images[0]
    lookups = {p[0]: tuple(_lookup(first.tables[t]) for t in first.scan[p[0]]) for p in first.parts}
    lanes = _Lanes([im.data for im in images])
    units = np.array([im.grid[0] * im.grid[1] for im in images])
    per = units if not first.interval else np.minimum(first.interval, units)
    order = np.arange(len(lanes.image)) - np.searchsorted(lanes.image, lanes.image)  # which interval of its image
    counts = np.minimum(per[lanes.image], units[lanes.image] - order * per[lanes.image])
    if (np.bincount(lanes.image, np.maximum(counts, 0), len(images)) != units).any():
        raise ValueError("restart intervals are missing")
    in_unit = [(k, p[0]) for k, p in enumerate(first.parts) for _ in range(1 if len(first.parts) == 1 else p[1] * p[2])]
    most = int(counts.max(initial=0))
    out = np.zeros((len(lanes.image), most, len(in_unit), 64), np.int16)
    last = np.zeros((len(first.parts), len(lanes.image)), np.int64)
    for unit in range(most):
        live = np.flatnonzero(counts > unit)
        for place, (part, name) in enumerate(in_unit):
            dc, ac = lookups[name]
            _, step = lanes.symbols(live, dc)
            last[part, live] += step
            out[live, unit, place, 0] = last[part, live]
            todo, k = live, np.ones(len(live), np.int64)
            while len(todo):
                symbol, value = lanes.symbols(todo, ac)
                run, size = symbol >> 4, symbol & 15
                at = k + run
                some = (size > 0) & (at < 64)
                if some.all():
                    out[todo, unit, place, at] = value
                else:
                    out[todo[some], unit, place, at[some]] = value[some]
                k = np.where((size == 0) & (run < 15), 64, at + 1)
                if k.max() >= 64:
                    left = k < 64
                    todo, k = todo[left], k[left]
    for i, image in enumerate(images):
        own = lanes.image == i
        rows = out[own]
        flat = rows.reshape(-1, len(in_unit), 64)[np.repeat(counts[own], most) > np.tile(np.arange(most), int(own.sum()))]
        image.blocks = [flat[:, [j for j, (part, _) in enumerate(in_unit) if part == k]].reshape(-1, 64) for k in range(len(image.parts))]


def decode(files: list[bytes]) -> list[Image]:
    """Coefficients of baseline files; those with the same tables are decoded together."""
    images, alike = [parse(x) for x in files], defaultdict(list)
    for image in images:
        alike[tuple(sorted(image.tables.items())), tuple(image.parts), tuple(image.scan.items()), image.interval].append(image)
    for group in alike.values():
        _decode_alike(group)
    return images


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode_payload`` has put into a file."""
    n = int(image.comment.split()[1])
    return (image.blocks[0].reshape(-1)[:n] - OFFSET).astype(np.uint8).tobytes()


def thumbnail(image: Image) -> np.ndarray:
    """Luminance, one sample per block, from DC coefficients: a block's mean is an eighth of its DC."""
    across, down, _ = image.grid
    _, h, v, q = image.parts[0]
    dc = image.blocks[0][:, 0].astype(np.int64) * image.quant[q][0]
    light = np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    if len(image.parts) == 1:
        return light.reshape(down, across)
    light = light.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    tall, wide = max(p[2] for p in image.parts), max(p[1] for p in image.parts)
    return light[: -(-image.height * v // (8 * tall)), : -(-image.width * h // (8 * wide))]


def thumbnail_hash(light: np.ndarray) -> int:
    """64 bits: which of 8 x 8 samples of a thumbnail are above their mean."""
    rows, columns = (np.arange(8) * 2 + 1) * light.shape[0] // 16, (np.arange(8) * 2 + 1) * light.shape[1] // 16
    grid = light[np.ix_(rows, columns)].astype(np.int64)
    return int.from_bytes(np.packbits(64 * grid > grid.sum()).tobytes(), "big")


def feature(image: Image) -> str:
    """Dimensions, hash of the thumbnail, and a checksum of all its samples."""
    light = thumbnail(image)
    return f"{image.width}x{image.height}:{thumbnail_hash(light):016x}:{zlib.crc32(light.tobytes()):08x}"


def describe(media: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds width, height and feature of a column of files; null where there is no baseline file."""
    names = [c for c in media.columns if not keep or c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for x in batch.column(media_col).to_pylist():
                try:
                    (image,) = decode([x or b""])
                    found.append((image.width, image.height, feature(image)))
                except (ValueError, KeyError, IndexError, struct.error):
                    found.append((None, None, None))
            columns = [pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.record_batch([*(batch.column(c) for c in names), *columns], names=[*names, "width", "height", "feature"])

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in names)
    return media.mapInArrow(run, f"{schema}, width int, height int, feature string")


def padded(text: bytes) -> bytes:
    """A text's bytes and bytes of 255 up to a positive multiple of ``UNIT``."""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Each text as a baseline file, stored: doc_id, n_bytes (of the text), media.

    Null and empty texts are one unit of padding. Ids are passed on as they are, repeated and null ones too;
    other columns are not read. The table lies below ``folder``, or ``spark.checkpoint.dir``.
    """
    folder = folder or shared_folder(docs.sparkSession, "media")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in chunks(batch.column(1)):
                data = raw.tobytes()
                texts = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                files = pa.array([encode_payload(padded(t)) for t in texts], pa.binary())
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), files], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, media binary"), f"{folder}/files", "zstd")


def _together(files: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of files of about ``limit`` bytes; a longer file is a run of its own."""
    lo, size = 0, 0
    for k, file in enumerate(files):
        if k > lo and size + len(file) > limit:
            yield lo, k
            lo, size = k, 0
        size += len(file)
    if lo < len(files):
        yield lo, len(files)


def read_back(media: DataFrame) -> DataFrame:
    """What the files of ``media_column`` hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, width, height, thumbnail (its hash)."""
    kind = media.schema["doc_id"].dataType.simpleString()
    fields = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "width": pa.int32(), "height": pa.int32(), "thumbnail": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media").to_pylist()
            for lo, hi in _together(files):
                rows = []
                for file, image in zip(files[lo:hi], decode(files[lo:hi]), strict=True):
                    back, said = payload_of(image), feature(image)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), said, image.width, image.height, said.split(":")[1]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)]
                some = batch.slice(lo, hi - lo)
                yield pa.record_batch([some.column("doc_id"), some.column("n_bytes"), *columns], names=["doc_id", "n_bytes", *fields])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tidy(run), schema)


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores each text as a file (``media_column``), and describes what the stored files hold (``read_back``)."""
    return read_back(media_column(docs, id_col, text_col, folder))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))
