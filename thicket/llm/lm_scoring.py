"""Interpolated modified Kneser-Ney bigram model: counted in Spark, mapped into memory for scoring.

* ``train`` counts words and word pairs in tasks (one sorted array per task and shard), merges each
  shard in one task and writes it as a sorted array: the vocabulary by word hash, the pairs by first
  and second word. A word's number is its place in the vocabulary. Pairs are sharded by first word;
  the pairs of a frequent first word are spread over all shards, so no shard follows one word.
* ``score`` maps the arrays into memory and looks up the words of each run of texts.

Words are told apart by 64-bit hashes (see ``_text``). Tokens are the words and one end per text. The
vocabulary may have up to 2**32 - 1 words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import mapped, shared_folder, stored, write_bytes
from thicket.llm._text import chunks, merge_counts, mix64, pack, pack_sorted, unpack, unpack_sorted, word_bounds, word_hashes

END = np.uint64(0xE0D5E0D5E0D5E0D5)
HOT_SHARE = 0.001
FOLDS, HELD_OUT = 5, 1
FLUSH = 2_000_000
PIECE = "shard int, keys binary, counts binary"


def held_out(doc_id: object) -> bool:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _with_ends(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all rows with an end after each, and the token offsets of the rows."""
    return np.insert(hashes, rows[1:], END), rows + np.arange(len(rows))


def _train_tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and row offsets of the training rows of a batch."""
    keep = pa.array([not held_out(x) for x in batch.column(0).to_pylist()], pa.bool_())
    for _, _, raw, offsets in chunks(batch.column(1).filter(keep)):
        starts, ends, rows = word_bounds(raw, offsets)
        yield _with_ends(word_hashes(raw, starts, ends), rows)


class _Counter:
    """Counts of keys seen by a task, merged whenever enough have come in."""

    def __init__(self) -> None:
        self.keys, self.counts, self.waiting = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0

    def add(self, keys: np.ndarray) -> None:
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.waiting += len(key)
        if self.waiting > FLUSH:
            self.merge()

    def merge(self) -> None:
        key, count = merge_counts(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [key], [count], 0

    @property
    def size(self) -> int:
        return len(self.keys[0])

    def pieces(self, shard: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
        key, count = self.keys[0], self.counts[0]
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            own = order[cuts[s] : cuts[s + 1]]
            if len(own):
                yield _piece(s, key[own], count[own])


def _piece(shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row of sorted keys with their counts, which are kept in as few bytes as hold them."""
    width = np.uint8 if counts.max() < 256 else np.uint32 if counts.max() < 1 << 32 else np.uint64
    data = bytes([np.dtype(width).itemsize]) + pack(counts.astype(width))
    return pa.record_batch([pa.array([shard], pa.int32()), pa.array([pack_sorted(keys)], pa.binary()), pa.array([data], pa.binary())], names=["shard", "keys", "counts"])


def _counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], {1: np.uint8, 4: np.uint32, 8: np.uint64}[data[0]]).astype(np.int64)


class _Merge:
    """Pieces of one shard merged a few at a time, so that a task holds little more than the result."""

    def __init__(self, kind: type = np.uint64) -> None:
        self.kind, self.keys, self.counts, self.waiting = kind, [], [], 0

    def add(self, keys: bytes, counts: bytes) -> None:
        self.keys.append(unpack_sorted(keys, self.kind))
        self.counts.append(_counts(counts))
        self.waiting += len(self.keys[-1])
        if self.waiting > max(FLUSH, len(self.keys[0])):
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        key, count = merge_counts(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [key], [count], 0
        return key, count


def _merged(batches: Iterator[pa.RecordBatch], kind: type = np.uint64) -> tuple[int, np.ndarray, np.ndarray]:
    merge, shard = _Merge(kind), 0
    for batch in batches:
        for row in batch.to_pylist():
            shard = row["shard"]
            merge.add(row["keys"], row["counts"])
    return shard, *merge.done()


@dataclass(frozen=True)
class Model:
    """Where the arrays of a model lie, and the numbers that hold for all of them.

    ``sizes``: words per vocabulary shard; ``tokens``: training tokens; ``words``: distinct ones;
    ``kinds``: distinct word pairs; ``low``, ``high``: discounts for counts of 1, 2 and more of words
    (by number of distinct predecessors) and of pairs; ``low_mass``: what the former leave to the
    uniform distribution; ``hot``: numbers of the spread first words.
    """

    folder: str
    shards: int
    sizes: tuple[int, ...]
    tokens: int
    words: int
    kinds: int
    low: tuple[float, float, float]
    high: tuple[float, float, float]
    low_mass: float
    hot: tuple[int, ...]


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys with counts of 1, 2, 3 and 4.

    Where too few keys make an estimate impossible, it falls back to at most half a count.
    """
    n1, n2, n3, n4 = seen
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    out = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 0.5, 3 - 4 * y * n4 / n3 if n3 and n4 else 0.5]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))


def _vocabulary(folder: str, sizes: tuple[int, ...]) -> list[np.ndarray]:
    return [mapped(f"{folder}/words-{s}", np.uint64) if n else np.zeros(0, np.uint64) for s, n in enumerate(sizes)]


def _numbers(hashes: np.ndarray, words: list[np.ndarray], sizes: tuple[int, ...]) -> np.ndarray:
    """The number of each word (sorted hashes); -1 where it is not in the vocabulary."""
    out = np.full(len(hashes), -1, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.searchsorted(_shard_of(hashes, len(words)), np.arange(len(words) + 1))
    for s, own in enumerate(words):
        lo, hi = cuts[s], cuts[s + 1]
        if lo < hi and len(own):
            at = np.minimum(np.searchsorted(own, hashes[lo:hi]), len(own) - 1)
            found = own[at] == hashes[lo:hi]
            out[lo:hi][found] = at[found] + first[s]
    return out


def _by_number(folder: str, name: str, kind: type, sizes: tuple[int, ...], numbers: np.ndarray) -> np.ndarray:
    """Values of an array that is stored per vocabulary shard, for sorted word numbers."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.searchsorted(numbers, first)
    out = np.zeros(len(numbers), kind)
    for s in range(len(sizes)):
        if cuts[s] < cuts[s + 1]:
            out[cuts[s] : cuts[s + 1]] = mapped(f"{folder}/{name}-{s}", kind)[numbers[cuts[s] : cuts[s + 1]] - first[s]]
    return out


def _pair_shard(heads: np.ndarray, tails: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    spread = np.isin(heads, hot) if len(hot) else np.zeros(len(heads), bool)
    key = np.where(spread, mix64((heads << np.uint64(32)) | tails), mix64(heads))
    return _shard_of(key, shards)


def _seen(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, folder: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts the training rows of ``docs`` and writes the model's arrays below ``folder``.

    Null texts are empty and still have an end. Repeated rows count each time. An empty table gives a
    model without words, in which every token has the probability of an unknown one. ``shards`` is by
    default the number of shuffle partitions: what a task merges and holds is one shard.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = folder or shared_folder(spark, "lm")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            for tokens, _ in _train_tokens(batch):
                counter.add(tokens)
            if counter.size > FLUSH:
                counter.merge()
                yield from counter.pieces(_shard_of(counter.keys[0], shards), shards)
                counter = _Counter()
        counter.merge()
        yield from counter.pieces(_shard_of(counter.keys[0], shards), shards)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key, count = _merged(batches)
        write_bytes(f"{folder}/words-{s}", key.tobytes())
        write_bytes(f"{folder}/counts-{s}", count.astype(np.uint64).tobytes())
        top = np.argsort(-count, kind="stable")[: round(1 / HOT_SHARE)]
        yield pa.record_batch([pa.array([x]) for x in (s, len(key), int(count.sum()), key[top].view(np.int64).tolist(), count[top].tolist())], names=["shard", "size", "tokens", "top", "top_counts"])

    words = rows.mapInArrow(count_words, PIECE).groupBy("shard").applyInArrow(_grouped(write_words), "shard long, size long, tokens long, top array<long>, top_counts array<long>")
    found = stored(words, f"{folder}/word-shards").orderBy("shard").collect()  # a row for each shard
    sizes = [0] * shards
    for row in found:
        sizes[row.shard] = row.size
    sizes, tokens, n_words = tuple(sizes), sum(r.tokens for r in found), sum(sizes)
    if n_words >= 1 << 32:
        raise ValueError("more than 2**32 - 1 distinct words")
    frequent = sorted(k & 0xFFFFFFFFFFFFFFFF for r in found for k, c in zip(r.top, r.top_counts, strict=True) if c > HOT_SHARE * tokens)
    hot = _numbers(np.array(frequent, np.uint64), _vocabulary(folder, sizes), sizes).tolist() if frequent else []
    hot = tuple(sorted({*hot, n_words}))  # n_words: the begin of a text

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, vocabulary, spread = _Counter(), _vocabulary(folder, sizes), np.array(hot, np.uint64)

        def out() -> Iterator[pa.RecordBatch]:
            counter.merge()
            key = counter.keys[0]
            yield from counter.pieces(_pair_shard(key >> np.uint64(32), key & np.uint64(0xFFFFFFFF), spread, shards), shards)

        for batch in batches:
            for tokens, offsets in _train_tokens(batch):
                distinct, place = np.unique(tokens, return_inverse=True)
                number = _numbers(distinct, vocabulary, sizes)[place].astype(np.uint64)
                before = np.concatenate([np.array([n_words], np.uint64), number[:-1]])
                before[offsets[:-1]] = n_words
                counter.add((before << np.uint64(32)) | number)
            if counter.size > FLUSH:
                yield from out()
                counter = _Counter()
        yield from out()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, key, count = _merged(batches)
        head, tail = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        write_bytes(f"{folder}/heads-{s}", head[first].astype(np.uint32).tobytes())
        write_bytes(f"{folder}/places-{s}", np.append(first, len(key)).astype(np.uint64).tobytes())
        write_bytes(f"{folder}/tails-{s}", tail.tobytes())
        write_bytes(f"{folder}/pair-counts-{s}", np.minimum(count, 255).astype(np.uint8).tobytes())
        large = np.flatnonzero(count >= 255)
        write_bytes(f"{folder}/large-places-{s}", large.astype(np.uint64).tobytes())
        write_bytes(f"{folder}/large-counts-{s}", count[large].astype(np.uint64).tobytes())
        seen = _seen(count)
        yield pa.record_batch([pa.array([x]) for x in (-1 - s, b"", b"", len(key), seen)], names=["shard", "keys", "counts", "kinds", "seen"])
        parts = [np.unique(tail.astype(np.uint64), return_counts=True)]  # distinct predecessors of each word
        parts += [(head[first], np.add.reduceat((count == k if k < 3 else count > 2).astype(np.int64), first)) for k in (1, 2, 3)]
        for kind, (number, n) in enumerate(parts):
            number, n = number[n > 0], n[n > 0]
            of = np.searchsorted(np.cumsum(sizes), number, "right")
            cuts = np.searchsorted(of, np.arange(shards + 2))
            for t in range(shards + 1):
                lo, hi = cuts[t], cuts[t + 1]
                if lo < hi:
                    piece = _piece(t, number[lo:hi], n[lo:hi])
                    yield pa.record_batch([pa.array([t * 4 + kind], pa.int64()), piece.column(1), piece.column(2), pa.array([0]), pa.array([[0]])], names=["shard", "keys", "counts", "kinds", "seen"])

    pairs = rows.mapInArrow(count_pairs, PIECE).groupBy("shard").applyInArrow(_grouped(write_pairs), "shard long, keys binary, counts binary, kinds long, seen array<long>")
    pairs = stored(pairs, f"{folder}/pair-shards")
    found = pairs.where("shard < 0").select("kinds", "seen").collect()  # a row for each shard
    kinds, high = sum(r.kinds for r in found), discounts([sum(r.seen[k] for r in found) for k in range(4)])

    first = np.concatenate([[0], np.cumsum(sizes)])

    def write_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, t = [_Merge() for _ in range(4)], 0
        for batch in batches:
            for row in batch.to_pylist():
                t = row["shard"] // 4
                merges[row["shard"] % 4].add(row["keys"], row["counts"])
        size = sizes[t] if t < shards else 1
        dense = []
        for merge in merges:
            out = np.zeros(size, np.uint64)
            if merge.keys:
                key, count = merge.done()
                out[key.astype(np.int64) - first[t]] = count
            dense.append(out)
        write_bytes(f"{folder}/before-{t}", dense[0].tobytes())
        write_bytes(f"{folder}/mass-{t}", sum(d * n for d, n in zip(high, dense[1:], strict=True)).astype(np.float32).tobytes())
        if t < shards:
            yield pa.record_batch([pa.array([t], pa.int64()), pa.array([_seen(dense[0])])], names=["shard", "seen"])

    by_word = pairs.where("shard >= 0").select("shard", "keys", "counts").withColumn("of", F.floor(F.col("shard") / 4))
    numbers = by_word.groupBy("of").applyInArrow(_grouped(write_numbers), "shard long, seen array<long>")
    found = stored(numbers, f"{folder}/number-shards").collect()  # a row for each shard
    seen = [sum(r.seen[k] for r in found) for k in range(4)]
    low = discounts(seen)
    left = low[0] * seen[0] + low[1] * seen[1] + low[2] * (n_words - seen[0] - seen[1])
    return Model(folder, shards, sizes, tokens, n_words, kinds, low, high, left / kinds if kinds else 1.0, hot)


def _grouped(f: Callable) -> Callable:
    """For applyInArrow: a group's batches, one after the other, through ``f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)

    return run


class Scorer:
    """A model's arrays as a task sees them."""

    def __init__(self, model: Model) -> None:
        self.m, self.vocabulary = model, _vocabulary(model.folder, model.sizes)
        self.files: dict[int, list[np.ndarray]] = {}
        self.begin = (0.0, 0.0)  # what a word at the begin of a text has before it: training texts, and mass left
        if model.kinds:
            texts = _by_number(model.folder, "counts", np.uint64, model.sizes, _numbers(np.array([END]), self.vocabulary, model.sizes))
            self.begin = float(texts[0]), float(mapped(f"{model.folder}/mass-{model.shards}", np.float32)[0])

    def _shard(self, s: int) -> list[np.ndarray]:
        if s not in self.files:
            names = ("heads", np.uint32), ("places", np.uint64), ("tails", np.uint32), ("pair-counts", np.uint8), ("large-places", np.uint64), ("large-counts", np.uint64)
            self.files[s] = [mapped(f"{self.m.folder}/{n}-{s}", k) for n, k in names]
        return self.files[s]

    def _pair_counts(self, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Training counts of word pairs, all of whose numbers are known."""
        out = np.zeros(len(head), np.int64)
        shard = _pair_shard(head, tail, np.array(self.m.hot, np.uint64), self.m.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.m.shards + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own = order[cuts[s] : cuts[s + 1]]
            heads, places, tails, counts, large_at, large = self._shard(int(s))
            if not len(heads):
                continue
            at = np.minimum(np.searchsorted(heads, head[own].astype(np.uint32)), len(heads) - 1)
            there = heads[at] == head[own]
            own, at, want = own[there], at[there], tail[own[there]].astype(np.uint32)
            low, end = places[at].astype(np.int64), places[at + 1].astype(np.int64)
            high = end.copy()
            while len(todo := np.flatnonzero(low < high)):  # binary search, all pairs at once
                middle = (low[todo] + high[todo]) // 2
                less = tails[middle] < want[todo]
                low[todo[less]] = middle[less] + 1
                high[todo[~less]] = middle[~less]
            found = low < end
            found[found] = tails[low[found]] == want[found]
            place = low[found]
            count = counts[place].astype(np.int64)
            if len(many := np.flatnonzero(count == 255)):
                count[many] = large[np.searchsorted(large_at, place[many].astype(np.uint64))]
            out[own[found]] = count
        return out

    def score(self, tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: known tokens, base score, and the model's log10 probability."""
        m = self.m
        distinct, place = np.unique(tokens, return_inverse=True)
        number = _numbers(distinct, self.vocabulary, m.sizes)
        known = number >= 0
        sure = number[known]
        count, before, mass = np.zeros(len(distinct)), np.zeros(len(distinct)), np.zeros(len(distinct))
        count[known] = _by_number(m.folder, "counts", np.uint64, m.sizes, sure)
        before[known] = _by_number(m.folder, "before", np.uint64, m.sizes, sure)
        mass[known] = _by_number(m.folder, "mass", np.float32, m.sizes, sure)
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        alone = _less(before, m.low) / max(m.kinds, 1) + m.low_mass / (m.words + 1)

        number = number[place]
        head = np.concatenate([[m.words], number[:-1]])
        head[offsets[:-1]] = m.words
        total, left = (np.concatenate([[0.0], x[place][:-1]]) for x in (count, mass))
        total[offsets[:-1]], left[offsets[:-1]] = self.begin
        probability = alone[place]
        seen = np.flatnonzero((head >= 0) & (total > 0))
        probability[seen] *= left[seen] / total[seen]
        both = seen[number[seen] >= 0]
        pair, back = np.unique((head[both].astype(np.uint64) << np.uint64(32)) | number[both].astype(np.uint64), return_inverse=True)
        counts = self._pair_counts(pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF)) if len(pair) else np.zeros(0)
        probability[both] += _less(counts, m.high)[back] / total[both]
        first = offsets[:-1]
        return np.add.reduceat(known[place].astype(np.int64), first), np.add.reduceat(base[place], first), np.add.reduceat(np.log10(probability), first)


def _less(counts: np.ndarray, discount: tuple[float, float, float]) -> np.ndarray:
    """Counts less their discounts; 0 stays 0."""
    return np.maximum(counts - np.array([0.0, *discount])[np.minimum(counts, 3).astype(np.int64)], 0)


_scorer: dict[Model, Scorer] = {}


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null and empty texts have one token, their end. Repeated rows are scored each; other columns are
    not read. A null id counts as the empty text when folds are dealt.
    """
    schema = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _scorer:
            _scorer.clear()
            _scorer[model] = Scorer(model)
        scorer = _scorer[model]
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, offsets in chunks(batch.column(1)):
                starts, ends, rows = word_bounds(raw, offsets)
                tokens, where = _with_ends(word_hashes(raw, starts, ends), rows)
                known, base, own = scorer.score(tokens, where)
                some = ids.slice(lo, hi - lo)
                columns = [some, pa.array([held_out(x) for x in some.to_pylist()]), np.diff(where), known, np.full(hi - lo, model.tokens), base, own]
                yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {schema}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs))
