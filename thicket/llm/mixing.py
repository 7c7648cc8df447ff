"""Mixing sources to target weights by a low-discrepancy schedule, with SQL functions only.

A mix is a run of slots. Slot k is the point ``k * g mod M`` of M points, where g is the number next to M
over the golden ratio that has no divisor in common with M. Every point is met once, and any run of slots
meets every stretch of points about in proportion (a golden-ratio sequence on a lattice). Cumulative
slot numbers of the sources cut the points into stretches, so a point names its source, and the rank of
a slot among those of its source names a block: rank modulo the number of the source's blocks.

Blocks hold equally many words of a source, which are the words of its documents one after the other, in
an order shuffled by a hash of the id. A block may hold parts of several documents and a document may
span blocks. A slot takes the whole block, so each source gets its number of blocks exactly.

No step keeps a source in one task: running sums and ranks go over (source, bucket of hashes) and (source,
chunk of slots), and only the buckets' and chunks' totals are summed per source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCK_WORDS = 64
LEAST_BLOCKS = 256
MOST_SLOTS = 1 << 30
SEED = "mix"
CHUNK = 1 << 16
BUCKET_ROWS = 4096
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): its number, size, target, blocks and slots.

    Sources by code point, null last, weigh ``weights`` in turn. The targets share the sum of all sizes by
    weight, and stop at ``most`` times a source's size; what is above is shared again. With caps sorted by
    cap over weight, the common level is the highest of those that cap the first 0, 1, 2, ... sources.
    The table of sources is the only one that is ordered as a whole.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("level", left / share)
    rows = rows.withColumn("target", F.least(F.max("level").over(everything) * F.col("w"), F.col("cap").cast("double")))
    largest = F.greatest(F.lit(block), F.expr(f"total div {MOST_SLOTS}"))
    rows = rows.withColumn("block", F.greatest(F.lit(1), F.least(largest, F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("long"))
    rows = rows.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    rows = rows.withColumn("slots", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    first = F.sum("slots").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slots")
    return rows.select("source", "s", "source_size", "target", "block", "blocks", "slots", first.alias("first"))


def multiplier(slots: int) -> int:
    """The number from slots over the golden ratio upwards that has no divisor in common with slots."""
    g = max(1, math.floor(slots * GOLDEN))
    while math.gcd(g, slots) > 1:
        g += 1
    return g


def schedule(plan: DataFrame) -> DataFrame:
    """(k, s, rank, block): each slot with its source's number, its rank there and the block it takes."""
    slots = plan.agg(F.sum("slots")).first()[0] or 0  # one number
    back = pow(multiplier(slots), -1, slots) if slots > 1 else 0
    pieces = plan.where("slots > 0").select("s", "blocks", "first", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {CHUNK}"))).alias("piece"))
    pieces = pieces.repartition("s", "piece")
    points = F.sequence(F.col("piece") * CHUNK, F.least((F.col("piece") + 1) * CHUNK, F.col("slots")) - 1)
    rows = pieces.select("s", "blocks", "first", F.explode(points).alias("point"))
    rows = rows.select("s", "blocks", ((F.col("first") + F.col("point")) * F.lit(back) % F.lit(max(slots, 1))).alias("k"))
    rows = rows.withColumn("chunk", F.expr(f"k div {CHUNK}"))
    counts = rows.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("s", "chunk", (F.sum("n").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("k")) - 1
    ranked = rows.withColumn("within", within).join(before.hint("merge"), ["s", "chunk"])  # derived from few rows, which says nothing of its size
    ranked = ranked.withColumn("rank", F.col("before") + F.col("within"))
    return ranked.select("k", "s", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def placed(sizes: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``sizes`` with each row's place among its source's words: s, seq (its place in the shuffled order)
    and start (the words before it)."""
    n = sizes.count()
    buckets = max(1, n // BUCKET_ROWS)
    rows = sizes.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("bucket", F.expr(f"(cast(conv(substr(key, 1, 8), 16, 10) as bigint) * {buckets}) div 4294967296"))
    rows = rows.alias("r").join(plan.select("source", "s").alias("p"), F.col("r.source").eqNullSafe(F.col("p.source"))).select("r.*", "p.s")
    totals = rows.groupBy("s", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    so_far = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.select("s", "bucket", (F.sum("words").over(so_far) - F.col("words")).alias("words_before"), (F.sum("n").over(so_far) - F.col("n")).alias("rows_before"))
    within = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).withColumn("nth", F.count("*").over(within))
    rows = rows.join(totals, ["s", "bucket"])
    return rows.select("doc_id", "source", "size", "th", "s", (F.col("rows_before") + F.col("nth")).alias("seq"), (F.col("words_before") + F.col("upto") - F.col("size")).alias("start"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Per row: doc_id, th (hash of the text), source, size, source_size, target, taken.

    size: words of the text, 0 for null and empty ones, of which nothing can be taken; taken: words the
    mix takes of the row, repeats counted. Repeated rows are rows of their own. Sources without words have a
    target of 0. Ties in the shuffled order are broken by id, size and hash of the text, so reruns agree.
    An empty table gives no rows; other columns are not read.
    """
    folder = folder or shared_folder(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("th")), f"{folder}/sizes")
    plan = stored(sources(sizes), f"{folder}/plan")
    rows = stored(placed(sizes, plan), f"{folder}/placed")
    uses = schedule(plan).groupBy("s", "block").agg(F.count("*").alias("uses"))
    spans = rows.where("size > 0").join(plan.select("s", F.col("block").alias("words")), "s")
    parts = spans.select("s", "seq", "start", "size", "words", F.explode(F.sequence(F.expr("start div words"), F.expr("(start + size - 1) div words"))).alias("block"))
    part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest("start", F.col("block") * F.col("words"))
    taken = parts.join(uses.hint("merge"), ["s", "block"]).groupBy("s", "seq").agg(F.sum(part * F.col("uses")).alias("taken"))
    out = rows.join(taken, ["s", "seq"], "left").join(plan.select("s", "source_size", "target"), "s")
    return out.select("doc_id", "th", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole number.

    Only the document at which a source's last round ends can be taken in part. Rows that agree in id,
    source and text are dealt their common number of copies one by one.
    """
    columns = docs.columns
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int")
    counts = mix(docs).groupBy("doc_id", "th", "source").agg(F.sum(times).alias("times"), F.count("*").alias("alike")).where("times > 0")
    a, b = docs.withColumn("th_", F.xxhash64("text")).alias("a"), counts.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th_") == F.col("b.th")) & F.col("a.source").eqNullSafe(F.col("b.source"))
    both = a.join(b, same).select(*(F.col(f"a.`{c}`") for c in columns), "th", "times", "alike")
    one = both.where("alike = 1").select(*columns, "times")
    several = both.where("alike > 1").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "source", "th").orderBy("doc_id")))
    several = several.select(*columns, F.expr("cast((times + alike - nth) div alike as int)").alias("times"))
    return one.union(several).where("times > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).drop("copy")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("th", "source")


def mix_sql(table: str = "documents", seed: str = SEED) -> str:
    """Reference for rows with unique ids, with plain running sums and ranks."""
    return f"""
WITH sizes AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM {table}),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM sizes GROUP BY source),
weighed AS (SELECT *, s % 3 + 1 AS w, {MOST_REPEATS} * source_size AS cap FROM by_source),
level AS (
  SELECT max((total - above) / CAST(weight - share AS DOUBLE)) AS level, any_value(total) AS total FROM (
    SELECT sum(source_size) OVER () AS total, sum(w) OVER () AS weight,
      coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
      coalesce(sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS share
    FROM weighed)),
plan0 AS (
  SELECT source, s, source_size, least(level * w, CAST(cap AS DOUBLE)) AS target,
    CAST(greatest(1, least(greatest({BLOCK_WORDS}, total // {MOST_SLOTS}), source_size // {LEAST_BLOCKS})) AS BIGINT) AS words
  FROM weighed, level),
plan1 AS (SELECT *, CAST((source_size + words - 1) // words AS BIGINT) AS blocks FROM plan0),
plan2 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target * blocks / source_size) AS BIGINT) ELSE 0 END AS slots FROM plan1),
plan AS MATERIALIZED (SELECT *, CAST(sum(slots) OVER (ORDER BY s) - slots AS BIGINT) AS first FROM plan2),
m AS MATERIALIZED (SELECT CAST(sum(slots) AS BIGINT) AS m FROM plan),
g AS MATERIALIZED (
  SELECT m, (SELECT min(x) FROM range(CAST(greatest(1, floor(m * {GOLDEN!r})) AS BIGINT), CAST(greatest(1, floor(m * {GOLDEN!r})) AS BIGINT) + 10000) t(x) WHERE gcd(x, m) = 1) AS g FROM m),
slots AS (SELECT k, (k * g) % m AS point FROM g, range(0, (SELECT m FROM m)) r(k)),
ranked AS (
  SELECT p.s, p.blocks, row_number() OVER (PARTITION BY p.s ORDER BY k) - 1 AS rank
  FROM slots JOIN plan p ON point >= p.first AND point < p.first + p.slots),
uses AS MATERIALIZED (SELECT s, rank % blocks AS block, count(*) AS uses FROM ranked GROUP BY 1, 2),
placed AS MATERIALIZED (
  SELECT z.doc_id, z.size, p.s, p.words, p.source_size, p.target,
    CAST(sum(z.size) OVER (PARTITION BY p.s ORDER BY md5('{seed}:' || coalesce(CAST(z.doc_id AS VARCHAR), '')), z.doc_id ROWS UNBOUNDED PRECEDING) - z.size AS BIGINT) AS start
  FROM sizes z JOIN plan p ON z.source IS NOT DISTINCT FROM p.source),
parts AS (
  SELECT doc_id, s, words, start, size, unnest(range(start // words, (start + size - 1) // words + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT doc_id, CAST(sum((least(start + size, (block + 1) * words) - greatest(start, block * words)) * uses) AS BIGINT) AS taken
  FROM parts JOIN uses USING (s, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (doc_id)"""


SQL = mix_sql()
