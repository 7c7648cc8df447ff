"""Similarity join of word-shingle sets: a size-aware heavy-light join, and the components it makes.

Sets link when 100 * intersection >= percent * union, that is when they share at least
``need(s, t) = ceil(percent (s + t) / (100 + percent))`` elements. Words in a shingle and ``percent`` are
parameters; their defaults are 3 and 90.

* Equal sets are one set (``sid``, a hash of the set) from the start, so copies cost nothing later.
* *Light* pairs, whose smaller set has at most ``boundary`` elements: every set enumerates its subsets of
  the needed size, as hashes. Two sets with the same subset share it, so no check has to follow.
* *Heavy* pairs, both larger: inverted lists over each set's rarest elements; any two linked sets meet in
  one of these lists. Lists with the same first member become one group, and groups are compared
  block against block: first by histograms of the sets' hashes, whose common part is never less than the
  intersection, then, for sets that still may link, by exact intersections.
* ``boundary`` is the size at which the rows that subsets would make outweigh those of the lists.

Within a subset or a block only a spanning forest of the links is emitted, never all pairs; components
need no more. "Rarest" is by a fixed order: frequent elements, found by counting all documents, come
last; before them shingles of many bytes come first, as long words seldom meet by chance. The table of
frequent elements is bounded and only an order: it decides cost, not results.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm._graph import connected_components
from thicket.llm._store import shared_folder, stored, tidy
from thicket.llm._text import chunks, merge_counts, mix64, shingle_hashes, word_bounds, word_hashes

SHINGLE = 3
PERCENT = 90
MAX_LIGHT = 32
FREQUENT_ROWS = 100_000
FREQUENT_LEAST = 8
FLUSH_ROWS = 500_000
BLOCK = 512
FINE_FROM = 4096
COLUMNS = 4096
LIST_COST = 12


def need(s: int, t: int, percent: int = PERCENT) -> int:
    """Elements that sets of sizes s and t have to share."""
    return -(-percent * (s + t) // (100 + percent))


def least_partner(s: int, percent: int = PERCENT) -> int:
    """Size of the smallest set that a set of size s can link with."""
    return -(-percent * s // 100)


def prefix(s: int, percent: int = PERCENT) -> int:
    """How many of its rarest elements a set of size s is listed under."""
    return s - least_partner(s, percent) + 1


def subset_classes(s: int, boundary: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(smaller size, larger size) of the light pairs that a set of size s can be part of."""
    own = [(s, t) for t in range(s, s * 100 // percent + 1)] if s <= boundary else []
    return own + [(t, s) for t in range(least_partner(s, percent), min(s - 1, boundary) + 1)]


def choose_boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Largest light size, by the rows that subsets and inverted lists would make.

    ``sizes``: number of distinct sets of each size up to ``MAX_LIGHT * 100 // percent``. A row of a list counts
    ``LIST_COST`` times a row of a subset, because its set has to travel and to be compared.
    """

    def cost(boundary: int) -> int:
        total = 0
        for s, n in sizes.items():
            total += n * sum(math.comb(s, need(a, b, percent)) for a, b in subset_classes(s, boundary, percent))
            total += n * LIST_COST * prefix(s, percent) * (s > boundary)
        return total

    return min(range(MAX_LIGHT + 1), key=lambda x: (cost(x), x))


def _sets(batch_texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct shingle hashes in order, bytes in the words of each) of each text."""
    for lo, hi, raw, offsets in chunks(batch_texts):
        starts, ends, rows = word_bounds(raw, offsets)
        words, length = word_hashes(raw, starts, ends), np.concatenate([[0], np.cumsum(ends - starts)])
        for k in range(hi - lo):
            i, j = rows[k], rows[k + 1]
            elements, at = np.unique(shingle_hashes(words[i:j], size), return_index=True)
            n = min(size, j - i)
            yield lo + k, elements, length[i + at + n] - length[i + at]


def _sid(elements: np.ndarray) -> int:
    return int(mix64(mix64(elements).sum(keepdims=True) + np.uint64(len(elements))).view(np.int64)[0])


def _histogram(elements: np.ndarray) -> bytes:
    """How many elements have each value of their top bits."""
    bits = 8 if len(elements) < FINE_FROM else 11
    count = np.bincount((elements >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return count.astype(np.uint16 if count.max() < 1 << 16 else np.uint32).tobytes()


def _counts(histogram: bytes) -> np.ndarray:
    width = {512: np.uint16, 1024: np.uint32, 4096: np.uint16, 8192: np.uint32}[len(histogram)]
    return np.frombuffer(histogram, width).astype(np.int32)


def _signatures(docs: DataFrame, size: int) -> DataFrame:
    """A row (kind 0) for each document with its set's size and hash; rows (kind 1) of elements that a
    task has met in several sets, with the number of sets."""

    def met_often(held: list[np.ndarray], id_type: pa.DataType) -> pa.RecordBatch:
        many = held[1] > 1
        return pa.record_batch([pa.nulls(int(many.sum()), id_type), pa.array(held[1][many]), pa.array(held[0][many].view(np.int64)), pa.array(np.ones(int(many.sum()), np.int32))], names=["doc_id", "n", "sid", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, empty = None, [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        met, waiting, held = set(), [], empty
        for batch in batches:
            id_type = batch.column(0).type
            n, sid = [], []
            for _, elements, _ in _sets(batch.column(1), size):
                n.append(len(elements))
                sid.append(_sid(elements))
                if sid[-1] not in met:
                    met.add(sid[-1])
                    waiting.append(elements)
                if len(waiting) >= 2000:
                    held, waiting, met = _counted(held, waiting), [], set()
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(np.zeros(len(n), np.int32))], names=["doc_id", "n", "sid", "kind"])
            if len(held[0]) > FLUSH_ROWS:
                yield met_often(held, id_type)
                held = empty
        held = _counted(held, waiting)
        if id_type is not None:
            yield met_often(held, id_type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"doc_id {kind}, n long, sid long, kind int")


def _counted(held: list[np.ndarray], waiting: list[np.ndarray]) -> list[np.ndarray]:
    if not waiting:
        return held
    key, count = np.unique(np.concatenate(waiting), return_counts=True)
    many = count > 1
    return list(merge_counts([held[0], key[many]], [held[1], count[many]]))


def _listed(docs: DataFrame, size: int, percent: int, boundary: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(key, sid, role, histogram): role 1 and 2 for subset keys of sets with the smaller and the larger
    size of their class, 0 for list keys, 3 for one row with the histogram of a listed set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_ROWS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often = sent.value
        for batch in batches:
            keys, sids, roles, met, own, counts = [], [], [], set(), [], []
            for _, elements, length in _sets(batch.column(1), size):
                s = len(elements)
                sid = _sid(elements) if s else 0
                if not s or sid in met:
                    continue
                met.add(sid)
                for small, large in subset_classes(s, boundary, percent):
                    keys.append(_subsets(elements, small, large, percent))
                    sids.append(np.full(len(keys[-1]), sid))
                    roles.append(np.full(len(keys[-1]), 1 if s == small else 2, np.int32))
                if s > boundary:
                    rank = np.zeros(s, np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
                        rank = np.where(common[at] == elements, often[at], 0)
                    keys.append(elements[np.lexsort((elements, -length, rank))[: prefix(s, percent)]])
                    sids.append(np.full(len(keys[-1]), sid))
                    roles.append(np.zeros(len(keys[-1]), np.int32))
                    own.append(sid)
                    counts.append(_histogram(elements))
            names = ["key", "sid", "role", "histogram"]
            if keys:
                columns = np.concatenate(keys).view(np.int64), np.concatenate(sids), np.concatenate(roles)
                yield pa.record_batch([*(pa.array(c) for c in columns), pa.nulls(len(columns[0]), pa.binary())], names=names)
            if own:
                yield pa.record_batch([pa.array(np.zeros(len(own), np.int64)), pa.array(own, pa.int64()), pa.array(np.full(len(own), 3, np.int32)), pa.array(counts, pa.binary())], names=names)

    return docs.mapInArrow(tidy(run), "key long, sid long, role int, histogram binary")


def _subsets(elements: np.ndarray, small: int, large: int, percent: int) -> np.ndarray:
    """Hashes of all subsets of the size that the class needs: the sum of all elements less those left out."""
    mixed = mix64(elements)
    left_out = len(elements) - need(small, large, percent)
    if left_out < 0:
        return np.zeros(0, np.uint64)
    total = mixed.sum(keepdims=True) + np.uint64(small * 1_000_003 + large)
    if not left_out:
        return mix64(total)
    chosen = np.array(list(itertools.combinations(range(len(elements)), left_out)))
    return mix64(total - mixed[chosen].sum(axis=1, dtype=np.uint64))


def _shared(lists: DataFrame) -> DataFrame:
    """The rows of lists with several. The planner takes both sides for a small part of the table that they are cut from,
    where they lie beside histograms, and would broadcast them."""
    several = lists.groupBy("key").count().where("count > 1").select("key")
    return lists.hint("merge").join(several, "key").distinct()


def _groups(lists: DataFrame, sizes: DataFrame, percent: int, folder: str) -> DataFrame:
    """(hub, sid) of sets that share a list; the hub is the first set of the list.

    Lists with the same hub become one group, so a set belongs to few groups however many lists it is in.
    """
    kept = stored(_shared(lists), f"{folder}/lists")
    first = kept.groupBy("key").agg(F.min("sid").alias("hub"))
    members = kept.join(first, "key").select("hub", "sid").distinct().join(sizes, "sid")
    members = stored(members, f"{folder}/members")
    extent = members.groupBy("hub").agg(F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
    extent = extent.where(f"rows > 2 or rows = 2 and {percent} * high <= 100 * low")
    return members.join(extent.select("hub", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "hub")


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    open_, a, b = np.ones(len(linked), bool), [], []
    for root in range(len(linked)):
        if not open_[root]:
            continue
        open_[root], frontier = False, [root]
        while frontier:
            x = frontier.pop()
            found = np.flatnonzero(linked[x] & open_)
            open_[found] = False
            a += [x] * len(found)
            b += found.tolist()
            frontier += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among sets; where both sides occur, of the links between them."""
    sizes = np.array([len(s) for s in sets])
    element, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    used, column = np.unique(column[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, len(used), COLUMNS):
        i, j = np.searchsorted(column, (lo, lo + COLUMNS))
        part = np.zeros((len(sets), min(COLUMNS, len(used) - lo)), np.float32)
        part[owner[i:j], column[i:j] - lo] = 1
        common += part @ part.T
    linked = (100 + percent) * common.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :])
    if side.any() and not side.all():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    return _forest(linked)


def _may_link(histograms: list[bytes], side: np.ndarray, percent: int) -> np.ndarray:
    """Which sets may link with another of theirs (of the other side, where both sides occur)."""
    counts = [_counts(h) for h in histograms]
    width = min(map(len, counts))
    matrix = np.array([c.reshape(width, -1).sum(axis=1) for c in counts])
    sizes = matrix.sum(axis=1)
    out = np.zeros(len(matrix), bool)
    both = side.any() and not side.all()
    for i in range(len(matrix) - 1):
        common = np.minimum(matrix[i], matrix[i + 1 :]).sum(axis=1)
        found = (100 + percent) * common >= percent * (sizes[i] + sizes[i + 1 :])
        if both:
            found &= side[i + 1 :] != side[i]
        if found.any():
            out[i] = True
            out[i + 1 :] |= found
    return out


def _cells(members: DataFrame) -> DataFrame:
    """Each set of a group in the cells (hub, i, j) in which its block meets its own and the other blocks."""
    placed = members.hint("merge").withColumn("block", F.pmod(F.hash("sid"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("hub", "sid", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _by_cell(cells: DataFrame, value: str, compare, percent: int, schema: str) -> DataFrame:
    """``compare(sids, values, side, percent)`` of each cell, whose rows lie together and in order in a partition."""

    def cell(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1 and (rows[0][1] == rows[0][2] or len({r[4] for r in rows}) == 2):
            yield from compare(np.array([r[3] for r in rows]), [r[5] for r in rows], np.array([r[4] for r in rows]) != rows[0][1], percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and row[:3] != waiting[0][:3]:
                    yield from cell(waiting)
                    waiting = []
                waiting.append(row)
        yield from cell(waiting)

    cells = cells.select("hub", "i", "j", "sid", "block", value)
    return cells.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").mapInArrow(tidy(run), schema)


def _survivors(sids: np.ndarray, histograms: list[bytes], side: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    found = sids[_may_link(histograms, side, percent)]
    if len(found):
        yield pa.record_batch([pa.array(found)], names=["sid"])


def _edges(sids: np.ndarray, data: list[bytes], side: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    a, b = _links([np.frombuffer(x, np.uint64) for x in data], side, percent)
    if len(a):
        yield pa.record_batch([pa.array(sids[a]), pa.array(sids[b])], names=["a", "b"])


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, folder: str | None = None, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles (size of its set), component_id (smallest id reachable by links).

    Sets are of ``size`` words to a shingle, and link from a similarity of ``percent`` in a hundred on. Null, empty and blank texts have the empty set and link with nothing: their component is their own
    id. Rows with equal sets link. Null ids count for links but are never the smallest id while another
    is there. Repeated ids are rows of their own. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "jaccard")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    first = stored(_signatures(docs, size), f"{folder}/signatures")
    signed = first.where("kind = 0").select("doc_id", "n", "sid")
    top = first.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "sid").limit(FREQUENT_ROWS).collect()
    element = np.array([r.sid for r in top], np.int64).view(np.uint64)
    order = np.argsort(element)
    frequent = element[order], np.array([r.n for r in top], np.int64)[order]

    own = signed.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    own = stored(own, f"{folder}/sets")
    small = own.where(F.col("n") <= MAX_LIGHT * 100 // percent).groupBy("n").count().collect()  # at most as many rows as sizes
    boundary = choose_boundary({r.n: r["count"] for r in small}, percent)

    listed = stored(_listed(docs, size, percent, boundary, frequent), f"{folder}/listed")
    histograms = listed.where("role = 3").select("sid", "histogram")
    subsets = listed.where("role > 0").select("key", "sid", "role").distinct()
    hub = subsets.where("role = 1").groupBy("key").agg(F.min("sid").alias("hub"))
    hub = stored(hub, f"{folder}/hubs")  # its size is known then: where it is small, a hot key stays spread
    light = subsets.join(hub, "key").where("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b"))

    members = _groups(listed.where("role = 0").select("key", "sid"), own.select("sid", "n"), percent, folder)
    members = stored(members, f"{folder}/grouped")
    sketched = histograms.join(members.select("sid").distinct(), "sid").dropDuplicates(["sid"])
    may = _by_cell(_cells(members).join(sketched, "sid"), "histogram", _survivors, percent, "sid long")
    may = stored(may.distinct(), f"{folder}/survivors")
    wanted = may.join(own, "sid").select("doc_id", F.col("sid").alias("want"))

    def only_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, sid, data = batch.column(0).to_pylist(), [], []
            for row, elements, _ in _sets(batch.column(1), size):
                if len(elements) and _sid(elements) == want[row]:  # an id may be on several texts
                    sid.append(want[row])
                    data.append(elements.tobytes())
            yield pa.record_batch([pa.array(sid, pa.int64()), pa.array(data, pa.binary())], names=["sid", "elements"])

    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("want", "text")
    sets = texts.mapInArrow(tidy(only_sets), "sid long, elements binary").dropDuplicates(["sid"])
    heavy = _by_cell(_cells(members).join(sets, "sid"), "elements", _edges, percent, "a long, b long")

    found = connected_components(light.union(heavy), f"{folder}/components")
    label = signed.join(found.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    label = stored(label, f"{folder}/labels")
    least = label.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = label.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; of rows that agree in id
    and text, one. Documents without shingles stay, and so do null ids that link with no other id."""
    heads = join(docs, size=size, percent=percent).where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("head")).distinct()
    one = docs.join(heads, F.col("doc_id").eqNullSafe(F.col("head")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))))
    return one.withColumn("nth_", nth).where("nth_ = 1").drop("nth_")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
