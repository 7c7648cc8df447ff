"""Ranks, limits and ordinals that hold when one key owns much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import materialise

Order = list[Column | str]


def first_n(df: DataFrame, keys: list[str], order: Order, n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1.

    The rank filter sits right on the window, so every task keeps at most ``n``
    rows of a key before the shuffle and a hot key never travels whole.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def top_k(
    df: DataFrame, k: int, score: str = "score", ties: Order = ("uri",), key: str = "qid"
) -> DataFrame:
    """L2: best ``k`` rows per question, best first in ``rank``."""
    return first_n(df, [key], [F.col(score).desc(), *ties], k, "rank")


def dedupe_best(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """The first row of each key in ``order``."""
    return first_n(df, keys, order, 1, "_rn").drop("_rn")


def numbered(df: DataFrame, keys: list[str], order: Order, name: str) -> DataFrame:
    """Row numbers 1..n within ``keys`` without a window over the whole key.

    Rows are range-partitioned by (keys, order), so a hot key spreads over many
    partitions. Each partition numbers its own rows; the number of rows of a key
    in earlier partitions, one summary row per (key, partition), shifts them.
    Rows that tie in (keys, order) share a partition and are ordered by a hash of
    the whole row, so only equal rows can change places. Null is a key like any other.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = (
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order, F.xxhash64(*df.columns))
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_id", 33))
    )
    laid = materialise(laid)
    runs = laid.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.select(
        *keys, "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_first")).alias("_shift"),
    )
    runs = materialise(runs)  # known to be small, when it is: the rows then stay where they lie
    return _null_safe_join(laid, runs, [*keys, "_part"], ["_shift"]).select(
        *df.columns, (F.col("_id") + F.col("_shift")).alias(name)
    )


PLACES = 1 << 18  # positions that one window numbers


def numbered_by_place(df: DataFrame, keys: list[str], pos: str, name: str, rows: int = PLACES) -> DataFrame:
    """``numbered(df, keys, [pos], name)`` where ``pos`` is a number, such as an earlier numbering gave.

    Buckets of ``rows`` positions are numbered side by side, so a hot key spreads over many windows, and no range has to be
    sampled, which would make the rows twice. Only what a key has in earlier buckets is joined to its later ones.
    """
    bucketed = df.withColumn("_bucket", F.floor(F.col(pos) / rows))
    within = Window.partitionBy(*keys, "_bucket").orderBy(pos, F.xxhash64(*df.columns))
    laid = materialise(bucketed.withColumn("_nth", F.row_number().over(within)))
    runs = laid.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(*keys, "_bucket", F.sum("_n").over(earlier).alias("_shift")).where("_shift > 0")
    shifts = materialise(shifts)  # known to be small, when it is: the rows then stay where they lie
    return _null_safe_join(laid, shifts, [*keys, "_bucket"], ["_shift"], "left").select(
        *df.columns, (F.col("_nth") + F.coalesce("_shift", F.lit(0))).alias(name)
    )


def _null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], wanted: list[str], how: str = "inner"
) -> DataFrame:
    """``left`` with the ``wanted`` columns of ``right``; nulls are equal."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *wanted)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def carried(
    df: DataFrame, key: str, pos: str, states: dict[str, Column], rows: int = 50_000
) -> DataFrame:
    """Running maximum of each state up to and including the row, per key.

    ``pos`` is a unique integer within the key, so a bucket of ``rows`` positions
    holds at most ``rows`` rows. Buckets are summarised first; only their
    summaries are ordered per key, then each bucket runs on its own.
    """
    names = list(states)
    bucketed = df.withColumn("_bucket", F.floor(F.col(pos) / rows)).withColumns(states)
    heads = bucketed.groupBy(key, "_bucket").agg(*[F.max(n).alias(n) for n in names])
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(key, "_bucket", *[F.max(n).over(before).alias(f"_in_{n}") for n in names])
    upto = Window.partitionBy(key, "_bucket").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        _null_safe_join(bucketed, heads, [key, "_bucket"], [f"_in_{n}" for n in names])
        .withColumns({n: F.greatest(F.max(n).over(upto), F.col(f"_in_{n}")) for n in names})
        .drop("_bucket", *[f"_in_{n}" for n in names])
    )


# -- open headings as a prefix scan -----------------------------------------

SPAN = 256  # positions that one fold runs over
_EFFECT = "struct<low:int,open:array<struct<level:int,title:string>>>"


def stack_effect(level: Column, title: Column) -> Column:
    """What one heading does to the open headings: closes those of its level or deeper, and opens itself."""
    return F.struct(
        level.cast("int").alias("low"),
        F.array(F.struct(level.cast("int").alias("level"), title.alias("title"))).alias("open"),
    )


def _no_effect() -> Column:
    return F.from_json(F.lit('{"low": 2147483647, "open": []}'), _EFFECT)


def then(first: Column, second: Column) -> Column:
    """Both effects, one after the other: what the second closes is no longer open."""
    still = F.filter(first["open"], lambda h: h["level"] < second["low"])
    return F.struct(
        F.least(first["low"], second["low"]).alias("low"),
        F.concat(still, second["open"]).alias("open"),
    )


def open_stacks(effects: DataFrame, key: str) -> DataFrame:
    """(key, pos, open) with the stack of open headings after each of ``effects`` (key, pos, effect).

    Effects compose associatively and an effect holds one heading for each level at most, so any number of levels
    is one scan: spans of ``SPAN`` positions are folded side by side, their totals are scanned in the same
    way, and each span takes what its predecessors leave open. ``pos`` is a unique integer from 0 up within
    the key; no task sees more than one span of a key, however long it is.
    """
    top = effects.agg(F.max("pos")).first()[0]
    rows = effects.select(F.col(key).alias("k"), F.col("pos").cast("long").alias("i"), F.col("effect").alias("e"))
    done = _scanned(rows, top or 0)
    return done.select(F.col("k").alias(key), F.col("i").alias("pos"), F.col("e.open").alias("open"))


def _scanned(rows: DataFrame, top: int) -> DataFrame:
    """(k, i, before, e): the effect of all earlier rows of a key, and that with the row's own."""
    start = F.array().cast(f"array<struct<i:bigint,before:{_EFFECT},e:{_EFFECT}>>")

    def step(done: Column, row: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["e"], _no_effect())
        return F.array_append(
            done, F.struct(row["i"].alias("i"), before.alias("before"), then(before, row["e"]).alias("e"))
        )

    spans = rows.groupBy("k", F.floor(F.col("i") / SPAN).alias("span")).agg(
        F.sort_array(F.collect_list(F.struct("i", "e"))).alias("rows")
    )
    spans = spans.select("k", "span", F.aggregate("rows", start, step).alias("rows"))
    if top < SPAN:
        return spans.select("k", F.explode("rows").alias("r")).select("k", "r.*")
    spans = materialise(spans)
    totals = spans.select("k", F.col("span").alias("i"), F.element_at("rows", -1)["e"].alias("e"))
    entering = _scanned(totals, top // SPAN).select("k", F.col("i").alias("span"), F.col("before").alias("entering"))
    each = _null_safe_join(spans, entering, ["k", "span"], ["entering"]).select("k", "entering", F.explode("rows").alias("r"))
    return each.select(
        "k", "r.i", then(F.col("entering"), F.col("r.before")).alias("before"),
        then(F.col("entering"), F.col("r.e")).alias("e"),
    )
