"""A stored keyword index: which letter runs a text has, written once and added to by batch.

A keyword made of a-z lies inside one maximal run of letters, so the index keeps, for every run, the rows that
have it. Four tables lie below one folder:

* ``postings`` (run, block, places), lists of at most ``2 ** BLOCK_BITS`` row numbers of one block each, partitioned by batch
  and by a bucket of the run;
* ``grams`` (gram, run): the runs by the three letters that begin at each place (fewer at the end), partitioned in the same
  way by the gram, which lead from a keyword to the runs that contain it;
* ``rows`` (row, uri, rid, filter columns and fields) by batch;
* ``ids`` (row, uri, rid) by batch, which lead from row numbers to rows without a text.

A search looks up its keywords' grams and reads the buckets of the runs found: no text and no run that was not
asked for reaches a join. A batch replaces its own folders only, so writing it again after a failure leaves the
same rows.
"""

from __future__ import annotations

import string
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from thicket.functions import questions as Q
from thicket.operators import search as S
from thicket.session import materialise

# task code travels with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
GRAM = 3
BLOCK_BITS = 17  # a list holds places of one block of row numbers
TEXT_BYTES = 1 << 24  # text whose runs are listed together
PAIRS = 500_000  # pairs of rows and questions that one task scores


@dataclass(frozen=True)
class KeywordIndex:
    """A stored index; ``buckets`` is fixed when it is first written."""

    path: str
    buckets: int = BUCKETS


def _bucket(value: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _grams(run: Column) -> Column:
    """Distinct substrings of ``GRAM`` letters, and the shorter ones at the end."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: F.substring(run, i, F.lit(GRAM))))


def _grams_beginning(needle: Column) -> Column:
    """The grams that a run with ``needle`` has: its first letters, and if it is shorter than a gram all that go on from it."""
    first = F.substring(needle, 1, GRAM)
    ends, more = [""], [""]
    for n in range(1, GRAM):
        more = [e + x for e in more for x in string.ascii_lowercase]
        ends += more
    longer = F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: F.concat(first, e))
    return F.when(F.length(first) == GRAM, F.array(first)).otherwise(F.filter(longer, lambda g: F.length(g) <= GRAM))


def _listed(texts: pa.ChunkedArray, rows: np.ndarray) -> pa.RecordBatch:
    """(run, block, places) of some lower-cased texts."""
    split = pc.split_pattern_regex(texts, "[^a-z]+").combine_chunks()
    runs = split.flatten().dictionary_encode()
    codes = runs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    # a row's place among these rows keeps the order of row numbers
    order = np.argsort(rows, kind="stable")
    place = np.empty(len(rows), dtype=np.int64)
    place[order] = np.arange(len(rows))
    pairs = np.unique(codes * len(rows) + place[owner])
    codes, found = pairs // max(len(rows), 1), rows[order][pairs % max(len(rows), 1)]
    blocks = found >> BLOCK_BITS
    starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])]) if len(pairs) else np.zeros(0, dtype=np.int64)
    places = pa.array((found & ((1 << BLOCK_BITS) - 1)).astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(pairs)].astype(np.int32)), places)
    out = pa.RecordBatch.from_arrays(
        [runs.dictionary.take(pa.array(codes[starts])).cast(pa.string()), pa.array(blocks[starts]), lists], ["run", "block", "places"]
    )
    return out.filter(pc.not_equal(out["run"], ""))


def _run_lists(rows: DataFrame) -> DataFrame:
    """(run, block, places): which of ``rows`` (row, text), lower-cased, have a run, in lists made by bounded pieces of a task's rows."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lengths = pc.cumulative_sum(pc.binary_length(batch["text"].slice(at))).to_numpy(zero_copy_only=False)
                n = max(1, int(np.searchsorted(lengths, TEXT_BYTES - size, side="right")))
                held.append(batch.slice(at, n))
                size, at = size + int(lengths[min(n, len(lengths)) - 1]), at + n
                if size >= TEXT_BYTES or at < batch.num_rows:
                    yield _of(held)
                    held, size = [], 0
        if held:
            yield _of(held)

    def _of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return _listed(table["text"], table["row"].to_numpy())

    return rows.mapInArrow(lists, "run string, block long, places array<int>")


def add_batch(index: KeywordIndex, concepts: DataFrame, batch: str = "0") -> None:
    """Indexes concept rows (uri, label, definition, …); the same ``batch`` written again replaces itself.

    Texts are read once. Null labels and definitions have no runs; rows that agree in uri, label and definition
    count once. Rows of a uri in several batches are all searched.
    """
    rows = S._with_missing(concepts, S.FILTER_COLUMNS)
    fields = [c for c in S.CONCEPT_FIELDS if c in rows.columns]
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "uri", S.row_id().alias("rid"), *S.FILTER_COLUMNS, *fields)
    target = f"{index.path}/rows/batch={batch}"
    rows.write.mode("overwrite").parquet(target)
    kept = rows.sparkSession.read.schema(rows.schema).parquet(target)
    kept.select("row", "uri", "rid").write.mode("overwrite").parquet(f"{index.path}/ids/batch={batch}")
    lists = _run_lists(kept.select("row", F.lower(F.concat_ws(" ", "label", "definition")).alias("text")))
    _write(lists.withColumn("bucket", _bucket("run", index.buckets)), f"{index.path}/postings/batch={batch}", "run")
    stored = _postings(rows.sparkSession, index).where(F.col("batch") == batch)
    runs = stored.select("run").distinct()
    grams = runs.select(F.explode(_grams(F.col("run"))).alias("gram"), "run")
    _write(grams.withColumn("bucket", _bucket("gram", index.buckets)), f"{index.path}/grams/batch={batch}", "gram")


def _write(df: DataFrame, path: str, key: str) -> None:
    """By bucket, in runs of equal keys; a frequent key is dealt over several tasks by the rebalance."""
    df.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _postings(spark: SparkSession, index: KeywordIndex) -> DataFrame:
    return spark.read.schema("run string, block long, places array<int>, batch string, bucket int").parquet(f"{index.path}/postings")


def _stored_grams(spark: SparkSession, index: KeywordIndex) -> DataFrame:
    return spark.read.schema("gram string, run string, batch string, bucket int").parquet(f"{index.path}/grams")


def _ids(spark: SparkSession, index: KeywordIndex) -> DataFrame:
    return spark.read.schema("row long, uri string, rid string, batch string").parquet(f"{index.path}/ids")


def stored_rows(spark: SparkSession, index: KeywordIndex) -> DataFrame:
    """The indexed rows with their fields."""
    return spark.read.option("mergeSchema", "true").parquet(f"{index.path}/rows").withColumn("batch", F.col("batch").cast("string"))


def matching_runs(needles: DataFrame, index: KeywordIndex) -> DataFrame:
    """(needle, run, bucket) for every stored run that contains a needle (a-z).

    A needle is looked up by its first letters and compared; one shorter than a gram by all grams that begin with it.
    """
    wanted = needles.select("needle").where("needle > ''").distinct()
    wanted = wanted.select("needle", F.explode(_grams_beginning(F.col("needle"))).alias("gram"))
    wanted = materialise(wanted.withColumn("bucket", _bucket("gram", index.buckets)))
    grams = _stored_grams(needles.sparkSession, index).drop("batch")
    # the comparison says nothing new; it tells the planner that this side picks buckets
    found = grams.join(wanted.where("needle > ''"), ["bucket", "gram"]).where(F.contains("run", "needle"))
    return found.select("needle", "run").distinct().withColumn("bucket", _bucket("run", index.buckets))


def _found_places(needles: DataFrame, index: KeywordIndex) -> DataFrame:
    """(batch, row, needle): the row numbers whose text contains a needle, once for each run that has it."""
    matches = materialise(matching_runs(needles, index))
    lists = _postings(needles.sparkSession, index).join(matches.where("run > ''"), ["bucket", "run"])
    start = F.shiftleft("block", BLOCK_BITS)
    return lists.select("batch", "needle", start.alias("start"), F.explode("places").alias("place")).select(
        "batch", (F.col("start") + F.col("place")).alias("row"), "needle"
    )


def _named(places: DataFrame, index: KeywordIndex, parts: int | None = None) -> DataFrame:
    """(uri, rid, needle) of the ``places``, each once, hash-partitioned by uri."""
    hits = places.join(_ids(places.sparkSession, index), ["batch", "row"]).select("uri", "rid", "needle")
    return (hits.repartition(parts, "uri") if parts else hits.repartition("uri")).distinct()


def found_rows(needles: DataFrame, index: KeywordIndex) -> DataFrame:
    """(uri, rid, needle): the rows whose text contains a needle, each pair once, hash-partitioned by uri."""
    return _named(_found_places(needles, index), index)


def keyword_hits(keywords: DataFrame, index: KeywordIndex) -> DataFrame:
    """J11 from the index: (uri, keyword) for every a-z keyword contained in a text."""
    found = found_rows(keywords.select(F.col("keyword").alias("needle")), index)
    return found.select("uri", F.col("needle").alias("keyword")).distinct()


def _parts(places: DataFrame, asked: DataFrame) -> int:
    """Tasks for the pairs of rows and questions, counted from above."""
    spark = places.sparkSession
    each = asked.groupBy("needle").agg(F.count("*").alias("n"))
    pairs = places.groupBy("needle").agg(F.count("*").alias("rows")).join(each, "needle").agg(F.sum(F.col("rows") * F.col("n"))).first()[0]
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(pairs or 0) // PAIRS))


def stored_scores(questions: DataFrame, index: KeywordIndex) -> DataFrame:
    """R1 before the cut, from the index: what ``search.keyword_scores`` gives for the indexed rows.

    Filter columns are joined where a question can have filters; nothing else of ``rows`` is read. Rows stay partitioned by
    uri from the needles found to the best row of a concept, over as many tasks as the counted pairs of rows and questions need.
    """
    filtered = bool({"concept", "scope", "org"} & set(questions.columns))
    questions = S._with_missing(questions, {"concept": "string", "scope": "string", "org": "string"})
    asked = materialise(S.keyword_rows(questions))
    places = materialise(_found_places(asked.select("needle"), index))
    hits = _named(places, index, _parts(places, asked)).join(asked, "needle")
    pairs = (
        hits.groupBy("uri", "rid", "qid")
        .agg(
            F.sum("weight").alias("hits"),
            F.max("keywords").alias("keywords"),
            F.max("concept_hit").alias("concept_hit"),
            F.max("scope_hit").alias("scope_hit"),
        )
        .filter(F.col("hits") > 0)
    )
    if filtered:
        rows = stored_rows(questions.sparkSession, index).select(F.col("uri"), F.col("rid").alias("_rid"), *S.FILTER_COLUMNS)
        rows = rows.dropDuplicates(["uri", "_rid"]).hint("shuffle_hash")
        # rids have one length, so this is equality; as a join key it would shuffle the pairs by (uri, rid)
        pairs = pairs.join(rows, "uri").where(F.startswith("rid", "_rid")).drop("_rid")
    else:
        pairs = S._with_missing(pairs, S.FILTER_COLUMNS)
    return S.filtered_scores(pairs, questions)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, its places) of each key from 0 up; negative ones are left out."""
    order = np.argsort(keys, kind="stable")
    ends = np.flatnonzero(np.r_[keys[order][1:] != keys[order][:-1], True]) + 1 if len(keys) else []
    start = 0
    for end in ends:
        if keys[order[start]] >= 0:
            yield int(keys[order[start]]), order[start:end]
        start = end


def _kept(best: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Places of the ``k`` largest counts above 0, the first of equal ones; with ``slack`` also all that are at most that much smaller."""
    found = np.flatnonzero(best > 0)
    if len(found) <= k:
        return found
    counts = best[found]
    last = np.partition(counts, len(counts) - k)[len(counts) - k]
    if slack:
        return found[counts >= last - slack]
    above, tied = found[counts > last], found[counts == last]
    return np.concatenate([above, tied[: k - len(above)]])


def _block_hits(lists: pa.Table, ids: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """(qid, uri, rid, hits, keywords): the rows of one block that can be among the best ``k`` of a question.

    ``lists`` are the block's (needle, places) and (needle, askers); ``ids`` its (place, uri, rid). Equal counts go to the
    smaller uri, as in the ranking that follows; where a question has so many keywords that counts can round to one score, all
    rows near the last count are kept.
    """
    if not lists.num_rows or not ids.num_rows:
        return schema.empty_table()
    ids = ids.take(pc.sort_indices(ids, [("uri", "ascending"), ("rid", "descending")], null_placement="at_start"))
    uris, n = ids["uri"].combine_chunks(), ids.num_rows
    codes = uris.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    sizes = np.diff(np.r_[starts, n])
    at = ids["place"].to_numpy()
    where = np.full(1 << BLOCK_BITS, -1, dtype=np.int32)
    where[at] = np.arange(n, dtype=np.int32)

    needles = lists["needle"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    places = lists["places"].combine_chunks()
    values, filled = places.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(places).fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(needles, filled)
    rows = {}
    for needle, found in _groups(owner):
        mine = where[np.unique(values[found])]
        rows[needle] = mine[mine >= 0]

    askers = lists["askers"].combine_chunks()
    asked = needles[pc.list_parent_indices(askers).to_numpy(zero_copy_only=False)]
    flat = askers.flatten()
    qids = flat.field("qid").dictionary_encode()
    weights, keywords = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("weight", "keywords"))
    parts, hits = [], np.zeros(n, dtype=np.int64)
    for qid, mine in _groups(qids.indices.fill_null(-1).to_numpy(zero_copy_only=False)):
        hits[:] = 0
        for i in mine:
            if asked[i] in rows:
                hits[rows[asked[i]]] += weights[i]
        total = int(keywords[mine].max())
        best = np.maximum.reduceat(hits, starts)
        kept = _kept(best, k, total // 1000 + 1 if total >= 1000 else 0)
        if len(kept):
            group = np.zeros(len(starts), dtype=bool)
            group[kept] = True
            shown = np.flatnonzero(np.repeat(group, sizes) & (hits > 0))
            parts.append((np.full(len(shown), qid), shown, hits[shown], np.full(len(shown), total)))
    if not parts:
        return schema.empty_table()
    q, shown, counts, totals = (np.concatenate(p) for p in zip(*parts))
    columns = [qids.dictionary.take(pa.array(q)), uris.take(pa.array(shown)), ids["rid"].take(pa.array(shown)), pa.array(counts), pa.array(totals)]
    return pa.Table.from_arrays(columns, names=schema.names).cast(schema)


def plain_scores(questions: DataFrame, index: KeywordIndex, k: int, named: bool = False) -> DataFrame:
    """(qid, uri, rid, score) holding the best ``k`` concepts of every question without filters, as ``stored_scores`` has them.

    The lists of the runs found meet the names of their rows block by block, so what is shuffled are row numbers in
    lists: pairs of rows and needles, or of rows and questions, are never rows of their own, and each block gives at most
    the rows that can be among a question's best. ``named`` leaves out rows without a uri.
    """
    spark = questions.sparkSession
    asked = materialise(S.keyword_rows(S._with_missing(questions, {"concept": "string", "scope": "string", "org": "string"})))
    asked = asked.where("qid IS NOT NULL")
    matches = materialise(matching_runs(asked.select("needle"), index))
    found = _postings(spark, index).join(matches.where("run > ''"), ["bucket", "run"]).select("batch", "block", "needle", "places")
    ids = _ids(spark, index)
    ids = (ids.where("uri IS NOT NULL") if named else ids).select(
        "batch", F.shiftright("row", BLOCK_BITS).alias("block"),
        F.col("row").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").alias("place"), "uri", "rid",
    )
    askers = asked.join(matches.select("needle").distinct(), "needle", "left_semi").groupBy("needle").agg(
        F.collect_list(F.struct("qid", F.col("weight").cast("long").alias("weight"), F.col("keywords").cast("long").alias("keywords"))).alias("askers")
    )
    blocks = materialise(ids.select("batch", "block").distinct())
    lists = found.unionByName(blocks.crossJoin(materialise(askers)), allowMissingColumns=True)
    schema = pa.schema([
        ("qid", to_arrow_type(asked.schema["qid"].dataType)), ("uri", pa.string()), ("rid", pa.string()),
        ("hits", pa.int64()), ("keywords", pa.int64()),
    ])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block_hits(left, right, k, schema)

    # by number, as the blocks' sizes do not tell their work and small ones would come together in one task
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lists, ids = (side.repartition(parts, "batch", "block") for side in (lists, ids))
    hits = lists.groupBy("batch", "block").cogroup(ids.groupBy("batch", "block")).applyInArrow(
        best, f"qid {asked.schema['qid'].dataType.simpleString()}, uri string, rid string, hits long, keywords long"
    )
    return hits.select("qid", "uri", "rid", S.share_of_keywords(F.lit(0.0)).alias("score"))


def stored_search(questions: DataFrame, index: KeywordIndex, k: int = 10, fields: bool = True) -> DataFrame:
    """R1 from the index: best ``k`` concepts per question, ranked from 1, with their fields unless told otherwise.

    Questions without any filter are cut to their best rows block by block; the others need their rows' filter columns.
    """
    filters = [c for c in ("concept", "scope", "org") if c in questions.columns]
    if filters:
        questions = materialise(questions.select("qid", "query", *filters))
        some = F.coalesce(*[F.col(c) for c in filters]).isNotNull()
        by_filter = questions.where(some).select("qid").distinct()
        scores = plain_scores(questions.join(by_filter, "qid", "left_anti"), index, k, named=True)
        if not by_filter.isEmpty():
            scores = scores.unionByName(stored_scores(questions.join(by_filter, "qid", "left_semi"), index))
    else:
        scores = plain_scores(questions, index, k)
    hits = S.best_hits(scores, k)
    if not fields:
        return hits.drop("rid")
    rows = stored_rows(questions.sparkSession, index)
    rows = rows.select("uri", "rid", *[c for c in S.CONCEPT_FIELDS if c in rows.columns])
    return S.with_fields(rows, hits)


def stored_filtered_search(filters: DataFrame, index: KeywordIndex, k: int, fields: bool = True) -> DataFrame:
    """R4 from the index."""
    return stored_search(S.without_moot_scope(filters), index, k, fields)


def question_hits(questions: DataFrame, index: KeywordIndex, k: int = 10) -> DataFrame:
    """R4 for plain questions (qid, query): filters are read from the text."""
    return stored_filtered_search(Q.extract_filters(questions), index, k, fields=False)
