"""Vectorised word handling for Arrow batches: bytes in, 64-bit word hashes out.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. Words are told apart by a
64-bit hash (polynomial over the bytes, then a finaliser); two of n distinct words share one with a
chance of about n * n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = 0x9E6C63D0876A9A47  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about ``limit`` bytes.

    A row is never cut: a longer text makes a longer run. Null reads as the empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    where = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(where, where[lo] + limit, "right")) - 1)
        yield lo, hi, raw[where[lo] : where[hi]], where[lo : hi + 1] - where[lo]
        lo = hi


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | cut[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    folded = (_LOWER[raw] if lower else raw).astype(np.uint64)
    folded += np.uint64(1)
    folded *= power[: len(raw)]
    np.cumsum(folded, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole sequence where it is shorter; none of none."""
    if not len(words):
        return words
    n = min(size, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total *= np.uint64(_BASE)
        total += mix64(words[i : len(words) - n + 1 + i])
    return mix64(total)


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array with equal bytes of its values side by side, which the shuffle compresses better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""


def pack_sorted(values: np.ndarray) -> bytes:
    """``pack`` of the differences of a sorted array of unsigned values."""
    if not len(values):
        return b""
    steps = values.copy()
    steps[1:] -= values[:-1]
    return pack(steps)


def unpack(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    rows = np.frombuffer(data, np.uint8).reshape(width, -1)
    return np.ascontiguousarray(rows.T).reshape(-1).view(kind)


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(data, kind), dtype=kind) if data else np.zeros(0, kind)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    if not len(key):
        return key, count.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count.astype(np.int64), first)
