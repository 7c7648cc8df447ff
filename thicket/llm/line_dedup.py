"""Lines that many documents share, found by two Bloom filters over line hashes.

Every task turns its documents into chunks: sorted 128-bit hashes of line keys with the ids that hold them, kept in a
table bucketed by chunk. Only the leading 64 bits travel, delta-coded, to the shard that owns their range. A shard keeps
two Bloom filters: a hash that the once-seen filter already holds enters the twice-seen filter. It answers each chunk
with one bit for each hash, so neither texts nor ids move, and no filter is broadcast or grows with the table: more lines make more
shards. Chunks meet their answers where their buckets lie; only suspected (hash, id) pairs are shuffled, to be counted
exactly on all 128 bits and to choose the document that keeps the line.

A filter has no false negatives, so no repeated line is missed; a false positive is only a pair that travels in vain.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored, tidy
from thicket.llm._text import mix64, pack, pack_sorted, unpack, unpack_sorted

WHITE = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)  # stands for a null id; ids are expected to be larger
CHUNK_LINES = 1 << 19  # (line, document) pairs in a chunk, but for the rest of one document
SHARD_LINES = 1 << 21  # lines that a shard's filters are made for
SLOTS, PROBES = 16, 4  # slots of a filter for each line, and slots that a line sets
SALTS = 16

Batches = Iterator[pa.RecordBatch]


def line_key(line: bytes, least: int = 20) -> bytes | None:
    """The line without white space at its ends and with A-Z lower-cased; None below ``least`` code points."""
    key = line.strip(WHITE).lower()  # bytes.lower changes A-Z only
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class Bloom:
    """A Bloom filter for up to ``n`` 64-bit hashes, a byte to a slot."""

    def __init__(self, n: int):
        self.slots = np.zeros(1 << max(10, (SLOTS * n - 1).bit_length()), bool)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        mixed = mix64(hashes)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return (mixed + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64(len(self.slots) - 1)

    def holds(self, places: np.ndarray) -> np.ndarray:
        return self.slots[places].all(axis=0)

    def add(self, places: np.ndarray) -> None:
        self.slots[places] = True


def _chunk_rows(least: int):
    """mapInArrow from (id, text) to chunks: hashes in order, the other half of each, and ids."""

    def run(batches: Batches) -> Batches:
        task, ordinal = TaskContext.get().partitionId(), 0
        digests: list[bytes] = []
        ids: list[int] = []
        counts: list[int] = []

        def chunk() -> pa.RecordBatch:
            both = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
            owner = np.repeat(np.array(ids, np.int64), counts)
            order = np.lexsort((owner, both[:, 1], both[:, 0]))
            head, tail, owner = both[order, 0], both[order, 1], owner[order]
            row = [[(task << 32) | ordinal], [pack_sorted(head)], [pack(tail)], [pack(owner.astype(np.int64))]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "head", "tail", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                keys = {k for line in text.encode().split(b"\n") if (k := line_key(line, least)) is not None}
                if not keys:
                    continue
                digests += [digest(k) for k in keys]
                ids.append(doc)
                counts.append(len(keys))
                if len(digests) >= CHUNK_LINES:
                    yield chunk()
                    ordinal += 1
                    digests, ids, counts = [], [], []
        if digests:
            yield chunk()

    return tidy(run)


def _distinct(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first entry of each hash, and how many entries it has."""
    first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    return first, np.diff(np.append(first, len(head)))


def _shard_starts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Shards that sorted hashes touch, and where each one's hashes begin (and the end)."""
    shard = (hashes >> np.uint64(64 - bits)) if bits else np.zeros(len(hashes), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return shard[first].astype(np.int64), np.append(first, len(hashes))


def _asked(bits: int):
    """mapInArrow from chunks to (chunk, shard, hashes, which of them the chunk itself holds more than once)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = unpack_sorted(packed, np.uint64)
                first, times = _distinct(head)
                hashes = head[first]
                shards, at = _shard_starts(hashes, bits)
                spans = list(zip(at[:-1], at[1:], strict=True))
                yield pa.record_batch(
                    [
                        pa.array([chunk] * len(shards), pa.int64()),
                        pa.array(shards, pa.int64()),
                        pa.array([pack_sorted(hashes[a:b]) for a, b in spans], pa.binary()),
                        pa.array([np.packbits(times[a:b] > 1).tobytes() for a, b in spans], pa.binary()),
                    ],
                    names=["chunk", "shard", "hashes", "several"],
                )

    return tidy(run)


def _flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def _answers(table: pa.Table) -> pa.Table:
    """One shard: hashes pass the once-seen filter into the twice-seen filter, which then marks them in each chunk."""
    chunks, packed = table.column("chunk").to_pylist(), table.column("hashes").to_pylist()
    hashes = [unpack_sorted(p, np.uint64) for p in packed]
    total = sum(map(len, hashes))
    once, twice = Bloom(total), Bloom(total)
    for h, several in zip(hashes, table.column("several").to_pylist(), strict=True):
        places = once.places(h)
        again = once.holds(places) | _flags(several, len(h))
        once.add(places)
        twice.add(places[:, again])
    shard, out = table.column("shard")[0].as_py(), []
    for c, h in zip(chunks, hashes, strict=True):
        found = twice.holds(twice.places(h))
        if found.any():
            out.append((c, np.packbits(found).tobytes()))
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int64()), "shard": pa.array([shard] * len(out), pa.int64()), "found": pa.array([f for _, f in out], pa.binary())})


def _suspects(bits: int):
    """mapInArrow from chunks with the answers of their shards to suspected (digest, id) pairs."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for packed, tail, ids, answers in zip(*(batch.column(n).to_pylist() for n in ("head", "tail", "ids", "answers")), strict=True):
                head = unpack_sorted(packed, np.uint64)
                first, times = _distinct(head)
                found = np.zeros(len(first), bool)
                shards, at = _shard_starts(head[first], bits)
                where = {s: (a, b) for s, a, b in zip(shards.tolist(), at[:-1], at[1:], strict=True)}
                for answer in answers:
                    a, b = where[answer["shard"]]
                    found[a:b] = _flags(answer["found"], b - a)
                pick = np.repeat(found, times)
                both = np.stack([head[pick], unpack(tail, np.uint64)[pick]], axis=1).astype(">u8")
                data = both.tobytes()
                yield pa.record_batch(
                    [
                        pa.array([data[i : i + 16] for i in range(0, len(data), 16)], pa.binary()),
                        pa.array(unpack(ids, np.int64)[pick], pa.int64()),
                    ],
                    names=["digest", "id"],
                )

    return tidy(run)


def suspected_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20) -> DataFrame:
    """(digest, id) of every line key that may be in two documents or more; the rest is certain to be in one.

    The pairs are distinct but for repeated rows, and are stored below the shared folder.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "line-dedup")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text"))
    chunks = rows.mapInArrow(_chunk_rows(least), "chunk long, head binary, tail binary, ids binary")
    name = f"line_chunks_{uuid.uuid4().hex}"
    chunks.write.format("parquet").bucketBy(parts, "chunk").option("path", f"{folder}/chunks").saveAsTable(name)
    try:
        chunks = spark.table(name)
        lines = chunks.agg(F.sum(F.length("head") / 8)).first()[0] or 0
        bits = (max(int(lines) // SHARD_LINES, parts - 1)).bit_length()
        asked = chunks.select("chunk", "head").mapInArrow(_asked(bits), "chunk long, shard long, hashes binary, several binary")
        answers = asked.groupBy("shard").applyInArrow(_answers, "chunk long, shard long, found binary")
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "found")).alias("answers"))
        found = chunks.join(answers, "chunk").select("head", "tail", "ids", "answers")
        return stored(found.mapInArrow(_suspects(bits), "digest binary, id long"), f"{folder}/suspects")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """(id, digests): for each document the line keys that it loses.

    A key of ``least`` code points found in ``documents`` documents or more is lost by all but the largest id.
    """
    suspects = suspected_lines(docs, id_col, text_col, least)
    counted = suspects.groupBy("digest").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"))
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    frequent = counted.where(F.col("n") >= documents).select("digest", "last", salts)  # a line may be in a third of all documents
    pairs = suspects.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    lost = pairs.join(frequent, ["digest", "salt"]).where("id <> last")
    return lost.groupBy("id").agg(F.collect_set("digest").alias("digests"))


def _kept_lines(least: int):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, lost in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                all_lines = (text or "").split("\n")
                kept = all_lines
                if lost:
                    away = set(lost)
                    kept = [x for x in all_lines if (k := line_key(x.encode(), least)) is None or digest(k) not in away]
                texts.append(text or "" if kept is all_lines else "\n".join(kept))
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(kept))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=["id", "text", "n_lines", "n_dropped"])

    return tidy(run)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 20, documents: int = 3) -> DataFrame:
    """Each document with the lines it keeps: (id, text, n_lines, n_dropped) under the given column names.

    Lines are split at \\n; n_lines counts them before dropping. Null and empty texts are one empty line. Rows that
    share an id are one document: their lines count once and are kept or lost together. A null id is one
    document, less than all others. An empty table gives an empty result. Other columns are not read.
    """
    lost = repeated_lines(docs, id_col, text_col, least, documents).select(F.col("id").alias("key"), "digests")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = rows.join(lost, F.coalesce("id", F.lit(NO_ID)) == F.col("key"), "left").select("id", "text", "digests")
    kept = joined.mapInArrow(_kept_lines(least), "id long, text string, n_lines long, n_dropped long")
    return kept.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same rows by plain grouping. DuckDB's trim takes the characters to strip, translate lower-cases A-Z alone.
SQL = r"""
WITH lines AS (
    SELECT row_id, doc_id, u.line, u.place, translate(trim(u.line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (
        SELECT row_id, doc_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: struct_pack(line := parts[i], place := i))) AS u
        FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), E'\n') AS parts FROM documents)
    )
), frequent AS (
    SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS last
    FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 3
), judged AS (
    SELECT l.*, f.key IS NOT NULL AND coalesce(l.doc_id, -9223372036854775808) <> f.last AS dropped
    FROM lines l LEFT JOIN frequent f ON l.key = f.key AND length(l.key) >= 20
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY row_id, doc_id
"""
