"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is of characters, folded into ``SYMBOLS`` symbols, so texts whose words were never seen still
have a fair probability and odd ones (capitals, marks, tables) a low one. Characters without a symbol of their
own (other scripts above all) share one, ``OTHER``, and a second model of the same kind says which of them it is:
its grams are of whole code points, so it is sparse. Characters that no trusted text has are one member there. A
text's probability is the product of both. A model is trained for each
language that has enough trusted text, and one, ``""``, for all languages together.

* Training counts n-grams in tasks, sums the counts over (lang, gram) and joins them with the counts of their
  contexts and of the contexts' successors, sharded by key. With an alphabet of fixed size a language has
  at most ``SYMBOLS ** ORDER`` folded grams; those of code points grow with the trusted text in other scripts.
* Scoring counts the distinct grams of each document and joins them, a block of documents and a shard of
  grams at a time, with the same shard of the model; partial sums add up per document. ``COPIES`` of each shard
  are dealt out, so that blocks of one language meet it in many tasks.
* A document is rejected if its perplexity is above its language's threshold: a high quantile of trusted
  texts of about the same length, and a margin above it. The same counts give the characters for each
  distinct gram, with a threshold of the same kind: words said over and over are no surprise to the
  model, and show there. Short texts vary more, so thresholds are taken within classes of length; a class
  with too few trusted texts borrows both limits, corrected for its length (``thresholds``).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored, tidy
from thicket.llm._text import chunks, merge_counts, pack, unpack

ORDER = 3
SYMBOLS = 64
BITS = 6
GRAMS = SYMBOLS**ORDER
SHARDS = 16
COPIES = 16  # of each shard of a language's model, for its blocks
POINT_BITS = 21
POINTS = (1 << POINT_BITS) - 1
HELD = 1 << 20  # grams of code points that a task holds before it hands them on
BLOCK_ROWS = 512
COUNTED_LANGS = 8
LEAST_TRUSTED = 30
QUANTILE = 0.99
MARGIN = 0.35
LONGEST_CLASS = 20
WIDE = 3
FAMILIAR, FOREIGN = r"[\x00-\u024F\u1E00-\u1EFF\u2000-\u206F\u20A0-\u20CF]", 0.3  # what the symbols cover; the share outside it, and in no trusted text, that is too much
START, LOWER, UPPER, DIGIT, BLANK, LINE, MARK, OTHER = 0, 1, 27, 28, 29, 30, 31, 63


def _folding() -> np.ndarray:
    """The symbol of each code point of the basic plane: accented letters count as their base letter. What is ``OTHER``
    here is told apart by its code point (``_members``)."""
    table = np.full(1 << 16, OTHER, np.uint8)
    for c in range(1 << 16):
        char = chr(c)
        base = unicodedata.normalize("NFD", char)[:1] if c >= 128 and not 0xD800 <= c < 0xE000 else char
        if "a" <= base <= "z":
            table[c] = LOWER + ord(base) - 97
        elif "A" <= base <= "Z":
            table[c] = UPPER
        elif "0" <= char <= "9":
            table[c] = DIGIT
        elif char in "\n\r\x0b\x0c":
            table[c] = LINE
        elif char.isspace():
            table[c] = BLANK
    marks = [c for c in range(33, 127) if table[c] == OTHER]
    table[marks] = np.minimum(MARK + np.arange(len(marks)), OTHER - 1)
    return table


_table: list[np.ndarray] = []


def _members(points: np.ndarray, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ``OTHER`` characters are, and the gram of code points that ends at each; symbols stay symbols in it."""
    at = np.flatnonzero(symbols == OTHER)
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER if len(at) else 0):
        i = np.maximum(at - k, 0)
        own = np.where(symbols[i] == OTHER, points[i].astype(np.int64) + SYMBOLS, symbols[i])
        gram |= np.where(place[at] >= k, own, START) << (POINT_BITS * k)
    return at, gram


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The gram that ends at each character of the rows, the row of each, the characters of each row, and the
    row and the gram of code points of each ``OTHER`` character."""
    if not _table:
        _table.append(_folding())
    text = raw.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    symbols = np.where(points < 1 << 16, _table[0][np.minimum(points, (1 << 16) - 1)], OTHER).astype(np.int64)
    n = np.diff(heads)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(symbols)) - heads[row]
    gram = symbols.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(symbols), np.int64)
        before[k:] = symbols[:-k] if k < len(symbols) else 0
        gram |= np.where(place >= k, before, START) << (BITS * k)
    at, members = _members(points, symbols, place)
    return gram, row, n, row[at], members


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, points, gram, n) of the texts of ``docs`` (lang, text), and of all languages together as ``""``: grams of
    symbols, and where ``points`` grams of code points that end in an ``OTHER`` character.

    A task adds up its batches, with at most ``COUNTED_LANGS`` languages and about ``HELD`` grams of code points held at a time.
    """

    def rows(totals: dict[str, np.ndarray], members: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = [(lang, False, np.flatnonzero(total), total[np.flatnonzero(total)]) for lang, total in totals.items()]
        for lang, points, gram, n in [*found, *((lang, True, *counted) for lang, counted in members.items())]:
            for name in {lang, ""}:
                yield pa.record_batch([pa.array([name] * len(gram)), pa.array([points] * len(gram)), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["lang", "points", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        members: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array([x or "" for x in batch.column(0).to_pylist()], object)
            for lang in sorted(set(langs)):
                if lang not in totals and len(totals) >= COUNTED_LANGS:
                    yield from rows(totals, members)
                    totals, members = {}, {}
                total = totals.setdefault(lang, np.zeros(GRAMS, np.int64))
                for _, _, raw, offsets in chunks(batch.column(1).filter(pa.array(langs == lang))):
                    gram, _, _, _, own = _grams(raw, offsets)
                    total += np.bincount(gram, minlength=GRAMS)
                    if len(own):
                        known, n = members.get(lang, (own[:0], own[:0]))
                        members[lang] = merge_counts([known, own], [n, np.ones(len(own), np.int64)])
                        if sum(len(g) for g, _ in members.values()) > HELD:
                            yield from rows({}, members)
                            members = {}
        yield from rows(totals, members)

    counted = docs.select("lang", "text").mapInArrow(tidy(run), "lang string, points boolean, gram long, n long")
    return counted.groupBy("lang", "points", "gram").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame, context: str) -> DataFrame:
    """Adds to (lang, gram, n) the share that its count gives and what its context leaves to the lower order.

    Discounts are those of modified Kneser-Ney, from the numbers of grams with counts of 1 to 4 in a
    language; where these are too few, half a count at most.
    """
    seen = counts.groupBy("lang").agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    for k in (1, 2, 3):
        own = F.when((F.col(f"n{k}") > 0) & (F.col(f"n{k + 1}") > 0), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5)
        seen = seen.withColumn(f"d{k}", F.least(F.greatest(own, F.lit(0.05)), F.lit(k - 0.05)))
    rows = counts.join(seen.select("lang", "d1", "d2", "d3"), "lang").withColumn("context", F.expr(context))
    rows = rows.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
    totals = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    joined = rows.join(totals, ["lang", "context"])
    return joined.select("lang", "gram", "context", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("left"))


def train(trusted: DataFrame, folder: str) -> DataFrame:
    """(lang, shard, model, members): log10 probabilities of the grams of a shard, given what precedes them, and the
    tables of ``_member_tables``.

    A gram's shard is its number modulo ``SHARDS``; that of a gram of code points goes by the character before the last. Lower
    orders count distinct predecessors. Only languages with ``LEAST_TRUSTED`` trusted texts have a model of their own.
    """
    enough = trusted.groupBy("lang").count().where(F.col("count") >= LEAST_TRUSTED).select(F.coalesce("lang", F.lit("")).alias("lang"))
    enough = enough.union(enough.sparkSession.range(1).select(F.lit("").alias("lang"))).distinct()
    counted = stored(count_grams(trusted).join(enough, "lang"), f"{folder}/counted")
    members = _member_model(counted.where("points").select("lang", "gram", "n"), folder)
    grams = stored(counted.where("not points").select("lang", F.col("gram").cast("int").alias("gram"), "n"), f"{folder}/grams-{ORDER}")
    parts = []
    for order in range(ORDER, 0, -1):
        parts.append(_discounted(grams, f"gram >> {BITS}" if order > 1 else "0").withColumn("order", F.lit(order)))
        if order > 1:  # distinct predecessors of what follows the first symbol
            low = (1 << BITS * (order - 1)) - 1
            grams = stored(grams.groupBy("lang", F.col("gram").bitwiseAND(F.lit(low)).alias("gram")).agg(F.count("*").alias("n")), f"{folder}/grams-{order - 1}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A language's rows, at most one per gram and order, as dense tables."""
        table = pa.Table.from_batches(list(batches))
        lang = table["lang"][0].as_py()
        gram, context, own, left, order = (table[c].to_numpy() for c in ("gram", "context", "own", "left", "order"))
        lower = np.full(1, 1 / SYMBOLS)
        for k in range(1, ORDER + 1):
            at = order == k
            weight, rest = np.zeros(SYMBOLS**k), np.ones(SYMBOLS ** (k - 1))
            weight[gram[at]] = own[at]
            rest[context[at]] = left[at]
            suffix = lower if k == 1 else np.tile(lower, SYMBOLS)
            lower = weight + np.repeat(rest, SYMBOLS) * (suffix if k > 1 else suffix[0])
        logs = np.log10(lower).astype(np.float32)
        shards = [logs[s::SHARDS].tobytes() for s in range(SHARDS)]
        yield pa.record_batch([pa.array([lang] * SHARDS), pa.array(np.arange(SHARDS, dtype=np.int32)), pa.array(shards, pa.binary())], names=["lang", "shard", "model"])

    dense = rows.groupBy("lang").applyInArrow(tables, "lang string, shard int, model binary")
    return stored(dense.join(members, ["lang", "shard"], "left"), f"{folder}/model")


def _member_model(grams: DataFrame, folder: str) -> DataFrame:
    """(lang, shard, members) from the counts (lang, gram, n) of the grams of code points that end in an ``OTHER`` character."""
    parts = []
    for order in range(ORDER, 0, -1):
        part = _discounted(grams, f"gram >> {POINT_BITS}" if order > 1 else "0L")
        own = [F.lit(s) for s in range(SHARDS)] if order == 1 else [(F.col("context").bitwiseAND(F.lit(POINTS)) % SHARDS).cast("int")]
        parts.append(part.select(F.explode(F.array(*own)).alias("shard"), "lang", F.lit(order).alias("order"), "gram", "context", "own", "left"))
        if order > 1:
            low = (1 << POINT_BITS * (order - 1)) - 1
            grams = stored(grams.groupBy("lang", F.col("gram").bitwiseAND(F.lit(low)).alias("gram")).agg(F.count("*").alias("n")), f"{folder}/members-{order - 1}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)

    def tables(table: pa.Table) -> pa.Table:
        found = _member_tables(*(table[c].to_numpy() for c in ("order", "gram", "context", "own", "left")))
        return pa.table({"lang": [table["lang"][0].as_py()], "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "members": pa.array([found], pa.binary())})

    return rows.groupBy("lang", "shard").applyInArrow(tables, "lang string, shard int, members binary")


def _member_tables(order: np.ndarray, gram: np.ndarray, context: np.ndarray, own: np.ndarray, left: np.ndarray) -> bytes:
    """Sorted tables, with their lengths first: each order's grams and their own shares, from the second on its contexts and
    what they leave. The first order has whole probabilities, the last of them for a character that was never seen."""
    parts: list[np.ndarray] = []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(order == k)
        at = at[np.argsort(gram[at])]
        if k == 1:
            rest = left[at[0]] / (len(at) + 1)
            parts += [np.append(gram[at], -1), np.append(own[at] + rest, rest)]
        else:
            contexts, first = np.unique(context[at], return_index=True)
            parts += [gram[at], own[at], contexts, left[at][first]]
    return b"".join([np.array([len(x) for x in parts], np.int64).tobytes(), *(x.tobytes() for x in parts)])


def _looked_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(asked), default)
    i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[i] == asked, values[i], default)


def _member_logs(tables: bytes | None, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of the last character of each gram of code points among all ``OTHER`` ones, and whether no trusted text has it."""
    if tables is None:
        return np.zeros(len(grams)), np.ones(len(grams), bool)
    ends = np.cumsum(np.frombuffer(tables, np.int64, 4 * ORDER - 2)) * 8 + 8 * (4 * ORDER - 2)
    parts, start = [], 8 * (4 * ORDER - 2)
    for k, end in enumerate(ends.tolist()):
        parts.append(np.frombuffer(tables[start:end], np.int64 if k % 2 == 0 else np.float64))
        start = end
    points, shares = parts[0][:-1], parts[1]
    share = _looked_up(points, shares[:-1], grams & POINTS, shares[-1])
    strange = _looked_up(points, np.zeros(len(points)), grams & POINTS, 1.0) > 0
    for k in range(2, ORDER + 1):
        keys, own, contexts, left = parts[4 * k - 6 : 4 * k - 2]
        asked = grams & ((1 << POINT_BITS * k) - 1)
        share = _looked_up(keys, own, asked, 0.0) + _looked_up(contexts, left, asked >> POINT_BITS, 1.0) * share
    return np.log10(share), strange


def _blocks(docs: DataFrame) -> DataFrame:
    """(lang, shard, rows, grams, counts): for documents of one language, the grams of a shard, each with its
    row's key and its count; keys are (doc_id, th) in ``rows`` of shard 0 .. SHARDS - 1 alike. Grams of code points are
    ``members``, each with its row's place; the first shard has each row's characters and different grams (``kinds``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("model_lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                own = batch.filter(pa.array(langs == lang))
                texts = own.column("text")
                for lo, hi, raw, offsets in chunks(texts):
                    for i in range(0, hi - lo, BLOCK_ROWS):
                        j = min(i + BLOCK_ROWS, hi - lo)
                        some = raw[offsets[i] : offsets[j]]
                        gram, row, n, m_row, m_gram = _grams(some, offsets[i : j + 1] - offsets[i])
                        key, count = np.unique((row << (BITS * ORDER)) | gram, return_counts=True)
                        gram, row = key & (GRAMS - 1), key >> (BITS * ORDER)
                        shard = gram % SHARDS
                        m_row, m_gram, m_count = _distinct(m_row, m_gram)
                        m_shard = (m_gram >> POINT_BITS & POINTS) % SHARDS
                        kinds = np.bincount(row[gram & (SYMBOLS - 1) != OTHER], minlength=j - i) + np.bincount(m_row, minlength=j - i)
                        for s in range(SHARDS):
                            at, m_at = shard == s, m_shard == s
                            starts = np.searchsorted(row[at], np.arange(j - i + 1)).astype(np.uint32)
                            yield pa.record_batch(
                                [
                                    pa.array([lang]), pa.array([s], pa.int32()), pa.array([own.column("doc_id").slice(lo + i, j - i).to_pylist()], pa.list_(own.schema.field("doc_id").type)),
                                    pa.array([own.column("th").slice(lo + i, j - i).to_pylist()], pa.list_(pa.int64())), pa.array([n.tolist() if s == 0 else []], pa.list_(pa.int64())),
                                    pa.array([kinds.tolist() if s == 0 else []], pa.list_(pa.int64())),
                                    pa.array([starts.tobytes()], pa.binary()), pa.array([pack((gram[at] // SHARDS).astype(np.uint16))], pa.binary()),
                                    pa.array([_packed(count[at])], pa.binary()), pa.array([pack(m_row[m_at].astype(np.uint16))], pa.binary()),
                                    pa.array([pack(m_gram[m_at])], pa.binary()), pa.array([_packed(m_count[m_at])], pa.binary()),
                                ], names=["lang", "shard", "ids", "ths", "chars", "kinds", "starts", "grams", "counts", "m_rows", "members", "m_counts"])

    lists = f"ids array<{kind}>, ths array<long>, chars array<long>, kinds array<long>"
    return docs.mapInArrow(tidy(run), f"lang string, shard int, {lists}, starts binary, grams binary, counts binary, m_rows binary, members binary, m_counts binary")


def _distinct(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different grams of each row, by row and gram, and their counts."""
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])]))
    return row[first], gram[first], np.diff(np.append(first, len(row)))


def _packed(counts: np.ndarray) -> bytes:
    if not len(counts):
        return b"\x01"
    kind = np.uint8 if counts.max() < 256 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + pack(counts.astype(kind))


def _unpacked(counts: bytes) -> np.ndarray:
    return unpack(counts[1:], {1: np.uint8, 4: np.uint32}[counts[0]])


def perplexity(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, th, model_lang, chars, grams, strange, logp) of ``docs`` (doc_id, th, lang, text), by the model of their language;
    strange is the number of characters that are ``OTHER`` and in no trusted text of the model.

    Rows that agree in doc_id, th and model are one: sums over them are divided by their number.
    """
    blocks = _blocks(_with_model(docs, model).select("doc_id", "th", "text", "model_lang"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    salt = F.pmod(F.hash("ids", "ths"), F.lit(COPIES))  # a language has many blocks: each shard's are dealt over copies of the model's
    copied = model.withColumnsRenamed({"members": "m_tables"}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    salted = blocks.withColumn("salt", salt).join(copied.hint("merge"), ["lang", "shard", "salt"])  # the planner takes the copies for one model and would broadcast them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids, ths = row.column("ids").flatten(), row.column("ths").flatten()
                starts = np.frombuffer(row.column("starts")[0].as_py(), np.uint32).astype(np.int64)
                data, counts = row.column("grams")[0].as_py(), row.column("counts")[0].as_py()
                part = np.zeros(1)
                if data:
                    logs = np.frombuffer(row.column("model")[0].as_py(), np.float32)
                    part = np.concatenate([[0.0], np.cumsum(logs[unpack(data, np.uint16)].astype(np.float64) * _unpacked(counts))])
                logp, odd = part[starts[1:]] - part[starts[:-1]], np.zeros(len(ids))
                if data := row.column("members")[0].as_py():
                    place, times = unpack(row.column("m_rows")[0].as_py(), np.uint16), _unpacked(row.column("m_counts")[0].as_py())
                    member, new = _member_logs(row.column("m_tables")[0].as_py(), unpack(data, np.int64))
                    logp = logp + np.bincount(place, member * times, len(ids))
                    odd = np.bincount(place, new * times.astype(np.float64), len(ids))
                chars, kinds = row.column("chars").flatten(), row.column("kinds").flatten()
                times = pa.array(np.full(len(ids), len(chars) > 0, np.int64))  # the first shard has the characters, once for each row
                chars, kinds = (x if len(x) else pa.array(np.zeros(len(ids), np.int64)) for x in (chars, kinds))
                names = pa.array(row.column("lang").to_pylist() * len(ids), pa.string())
                yield pa.record_batch([ids, ths, names, times, chars, kinds, pa.array(odd.astype(np.int64)), pa.array(logp)], names=["doc_id", "th", "model_lang", "times", "chars", "grams", "strange", "logp"])

    needed = salted.select("lang", "ids", "ths", "chars", "kinds", "starts", "grams", "counts", "model", "m_rows", "members", "m_counts", "m_tables")
    sums = needed.mapInArrow(tidy(run), f"doc_id {kind}, th long, model_lang string, times long, chars long, grams long, strange long, logp double")
    sums = sums.groupBy("doc_id", "th", "model_lang").agg(*(F.sum(c).alias(c) for c in ("times", "chars", "grams", "strange", "logp")))
    whole = [(F.col(c) / F.col("times")).cast("long").alias(c) for c in ("chars", "grams", "strange")]
    return sums.select("doc_id", "th", "model_lang", *whole, (F.col("logp") / F.col("times")).alias("logp"))


def _with_model(docs: DataFrame, model: DataFrame) -> DataFrame:
    """Adds model_lang: the language whose model judges a row, ``""`` where it has none of its own."""
    langs = model.select(F.col("lang").alias("own_lang")).distinct()
    rows = docs.join(langs, F.coalesce("lang", F.lit("")) == F.col("own_lang"), "left")
    return rows.select(*docs.columns, F.coalesce("own_lang", F.lit("")).alias("model_lang"))


def judge(docs: DataFrame, labels: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, th, lang, chars, perplexity, threshold, repetition, most_repetition, keep, reason) of ``docs`` (doc_id, text, lang).

    ``labels`` (doc_id, quality) names the trusted texts, quality 1; the model is fitted on all of them. Null
    and empty texts have a perplexity of 1 and are kept. Rows that agree in id, text and language are one row here. A language without any trusted text has no limits and is
    kept, and so is a text of no language that is largely in letters that no trusted text has; other texts of no
    language are judged by the model of all languages. Without any trusted text everything is kept. ``reason`` says what
    rejected a document: perplexity or repetition.
    """
    folder = folder or shared_folder(docs.sparkSession, "quality")
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good")).distinct()
    model = train(docs.join(good, F.col("doc_id") == F.col("good"), "left_semi").dropDuplicates(["doc_id", "th", "lang"]), folder)
    scores = perplexity(docs, model).withColumn("perplexity", F.when(F.col("chars") > 0, F.pow(F.lit(10.0), -F.col("logp") / F.col("chars"))).otherwise(1.0))
    scores = scores.withColumn("repetition", F.when(F.col("chars") > 0, F.col("chars") / F.col("grams")).otherwise(1.0))
    scores = stored(scores, f"{folder}/scores")
    nameless = F.coalesce("lang", F.lit("")) == ""
    foreign = F.when(nameless, F.length(F.regexp_replace("text", FAMILIAR, "")) > FOREIGN * F.length("text")).otherwise(F.lit(False))
    own = docs.select("doc_id", "th", "lang", foreign.alias("foreign")).distinct()
    own = _with_model(own, model).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.th") == F.col("s.th")) & (F.col("d.model_lang") == F.col("s.model_lang"))
    scores = own.join(scores.alias("s"), same).select("d.doc_id", "d.th", "d.lang", (F.col("d.foreign") & (F.col("s.strange") > FOREIGN * F.col("s.chars"))).alias("foreign"), "s.chars", "s.perplexity", "s.repetition")
    size = F.least(F.floor(F.log2(F.col("chars") + 1)), F.lit(LONGEST_CLASS)).cast("int")
    grams = docs.sparkSession.read.schema("lang string, points boolean, gram long, n long").parquet(f"{folder}/counted")
    grams = grams.where(F.col("points") | (F.col("gram").bitwiseAND(F.lit(SYMBOLS - 1)) != OTHER))  # as they are counted in a text
    expected = stored(expected_repetition(grams).repartition(1), f"{folder}/expected")  # a row for each language and class
    scores = stored(_with_usual(scores.withColumn("size", size), expected), f"{folder}/sized")
    trusted = scores.where("chars > 0").join(good, F.col("doc_id") == F.col("good"), "left_semi")
    limits = thresholds(trusted, folder)
    heard = trusted.select(F.coalesce("lang", F.lit("")).alias("heard")).distinct()
    langs = limits.select(F.col("lang").alias("known")).distinct()
    named = scores.join(langs, F.coalesce("lang", F.lit("")) == F.col("known"), "left").withColumn("known", F.coalesce("known", F.lit("")))
    named = named.join(heard, F.col("lang") == F.col("heard"), "left").withColumn("judged", (nameless & ~F.col("foreign")) | F.col("heard").isNotNull())
    out = named.alias("n").join(limits.alias("l"), (F.col("n.known") == F.col("l.lang")) & (F.col("n.size") == F.col("l.size")), "left")
    out = out.withColumn("most", F.when(F.col("n.judged"), F.coalesce("l.most_repetition", F.col("l.most_excess") * F.col("n.usual"))))
    out = out.withColumn("limit", F.when(F.col("n.judged"), F.col("l.threshold")))
    reason = F.when(F.col("n.perplexity") > F.col("limit"), "perplexity").when(F.col("n.repetition") > F.col("most"), "repetition")
    out = out.select("n.doc_id", "n.th", "n.lang", "n.chars", "n.perplexity", F.col("limit").alias("threshold"), "n.repetition", F.col("most").alias("most_repetition"), reason.alias("reason"))
    return out.select("doc_id", "th", "lang", "chars", "perplexity", "threshold", "repetition", "most_repetition", F.col("reason").isNull().alias("keep"), "reason")


def expected_repetition(grams: DataFrame) -> DataFrame:
    """(lang, size, low, high): characters for each distinct gram that a text with the gram frequencies of
    ``grams`` (lang, gram, n) would have, at both ends of a class of length."""
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    miss = F.log1p(-F.least(F.col("n") / F.col("total"), F.lit(1 - 1e-12)))
    rows = grams.join(total, "lang").select("lang", miss.alias("miss"))
    distinct = rows.groupBy("lang").agg(*(F.sum(1 - F.exp(F.lit(2.0**k) * F.col("miss"))).alias(f"e{k}") for k in range(LONGEST_CLASS + 2)))
    ends = (F.struct(F.lit(k).alias("size"), (F.lit(2.0**k) / F.col(f"e{k}")).alias("low"), (F.lit(2.0 ** (k + 1)) / F.col(f"e{k + 1}")).alias("high")) for k in range(LONGEST_CLASS + 1))
    return distinct.select("lang", F.explode(F.array(*ends)).alias("at")).select("lang", "at.*")


def _with_usual(scores: DataFrame, expected: DataFrame) -> DataFrame:
    """Adds usual: the expected repetition at the text's length, by its language or by all languages together."""
    own = expected.select(F.col("lang").alias("own"), F.col("size").alias("own_size"), "low", "high")
    every = expected.where("lang = ''").select(F.col("size").alias("any_size"), F.col("low").alias("any_low"), F.col("high").alias("any_high"))
    rows = scores.join(own, (F.coalesce("lang", F.lit("")) == F.col("own")) & (F.col("size") == F.col("own_size")), "left").join(every, F.col("size") == F.col("any_size"), "left")
    low, high = F.coalesce("low", "any_low"), F.coalesce("high", "any_high")
    usual = low * F.pow(high / low, F.log2(F.col("chars") + 1) - F.col("size"))
    return rows.select(*scores.columns, usual.alias("usual"))


def thresholds(trusted: DataFrame, folder: str) -> DataFrame:
    """(lang, size, threshold, most_repetition, most_excess) from the scores of trusted texts, and for all languages as ``""``.

    A text counts in its own class of length and in the two next to it, so limits change evenly. Repetition
    grows with the length: most_excess limits it as a multiple of ``usual``, for classes without a
    most_repetition. A class with fewer than ``LEAST_TRUSTED`` texts takes its limits from the first of these
    that has as many: the class of all languages, the language's classes up to ``WIDE`` away, those of all
    languages, and the whole language, here with one and a half times the limit of perplexity. Perplexities of all
    languages are scaled by the language's own.
    """
    rows = trusted.select(F.explode(F.array_distinct(F.array(F.coalesce("lang", F.lit("")), F.lit("")))).alias("lang"), "size", "perplexity", "repetition", (F.col("repetition") / F.col("usual")).alias("excess"))
    columns = ("perplexity", "repetition", "excess")
    high = [F.percentile_approx(c, QUANTILE, 2000).alias(c) for c in columns]

    def ends(width: int) -> tuple[Column, Column]:
        return F.greatest(F.col("size") - width, F.lit(0)), F.least(F.col("size") + width, F.lit(LONGEST_CLASS))

    def around(width: int) -> Column:
        return F.transform(F.sequence(*ends(width)), lambda x: F.struct(x.alias("size"), F.lit(width).alias("width")))

    # width 0 has all of a language
    places = [around(1), around(WIDE)]
    places.append(F.array(F.struct(F.lit(-1).alias("size"), F.lit(0).alias("width"))))
    placed = rows.select("lang", F.explode(F.concat(*places)).alias("at"), *columns).select("lang", "at.*", *columns)
    found = placed.groupBy("lang", "size", "width").agg(F.count("*").alias("n"), *high).where(F.col("n") >= LEAST_TRUSTED)
    found = stored(found.select("lang", "size", "width", *columns).repartition(1), f"{folder}/limits")  # a few dozen rows for each language

    def named(width: int, name: str, every: bool = False) -> DataFrame:
        limits = found.where(F.col("width") == width).select("lang", "size", *(F.col(c).alias(f"{name}_{c}") for c in columns))
        return limits.where("lang = ''").drop("lang") if every else limits

    whole = found.where("width = 0").select("lang", F.col("perplexity").alias("typical"), F.col("excess").alias("typical_excess"))
    scale = whole.where("lang = ''").select(F.col("typical").alias("any_typical"))
    out = whole.crossJoin(scale).withColumn("size", F.explode(F.sequence(F.lit(0), F.lit(LONGEST_CLASS))))
    for width, name in ((1, "near"), (WIDE, "wide")):
        out = out.join(named(width, name), ["lang", "size"], "left").join(named(width, f"any_{name}", True), "size", "left")
    share = F.col("typical") / F.col("any_typical")
    threshold = F.coalesce("near_perplexity", F.col("any_near_perplexity") * share, "wide_perplexity", F.col("any_wide_perplexity") * share, 1.5 * F.col("typical"))
    excess = F.coalesce("any_near_excess", "wide_excess", "any_wide_excess", "typical_excess")
    return out.select("lang", "size", (threshold * (1 + MARGIN)).alias("threshold"), (F.col("near_repetition") * (1 + MARGIN)).alias("most_repetition"), (excess * (1 + MARGIN)).alias("most_excess"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    bad = judge(docs, labels).where(~F.col("keep")).select("doc_id", "th", "lang").distinct().alias("bad")
    same = F.col("docs.doc_id").eqNullSafe(F.col("bad.doc_id")) & (F.xxhash64(F.coalesce("docs.text", F.lit(""))) == F.col("bad.th"))
    return docs.alias("docs").join(bad, same & F.col("docs.lang").eqNullSafe(F.col("bad.lang")), "left_anti")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).drop("th")
