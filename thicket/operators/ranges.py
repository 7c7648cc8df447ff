"""Range conditions as equality joins: points against ranges, and ranges against ranges.

Values and the ends of ranges are numbered together in one order, so a range is a run of places. A run is cut into
aligned blocks of 1, ``BASE``, ``BASE`` ** 2, ... places, the fewest there are, and a value lies in one block of each
size: both sides meet on (keys, size, block), and every pair meets once, without a comparison. Blocks stop at
``BASE`` ** ``TOP`` places, so no block holds more than 4,096 values, and a range that covers more is
asked for in as many blocks as its result needs. Values and ranges are joined once however often they occur; rows come
back by equality, so what is written follows the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.ordering import numbered
from thicket.session import materialise

BASE, TOP = 16, 3
_LOW, _HIGH = float("-inf"), float("inf")
_BEFORE, _AT, _AFTER = 0, 1, 2  # ends before a value, the value itself, ends after it


def _ends(ranges: DataFrame, keys: list[str], low: str, high: str, low_open: bool) -> DataFrame:
    """Distinct (keys, _low, _high) that are not empty by themselves; no end is an infinite one."""
    ends = ranges.select(
        *keys,
        F.coalesce(F.col(low).cast("double"), F.lit(_LOW)).alias("_low"),
        F.coalesce(F.col(high).cast("double"), F.lit(_HIGH)).alias("_high"),
    ).distinct()
    some = F.col("_low") < F.col("_high") if low_open else F.col("_low") <= F.col("_high")
    return ends.filter(~F.isnan("_low") & ~F.isnan("_high") & some)


def _pieces(a: Column, b: Column) -> Column:
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def _of_level(blocks: Column, level: int) -> Column:
    return F.transform(blocks, lambda n: F.struct(F.lit(level).alias("level"), n.alias("block")))


def _blocks(runs: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, _level, _block): the aligned blocks of the places from ``_a`` up to but without ``_b``."""
    a, b, rows = F.col("_a"), F.col("_b"), runs
    parts = []
    for level in range(TOP):
        rows = rows.withColumns({
            f"_up{level}": F.expr(f"({BASE - 1} + {'_a' if not level else f'_up{level - 1}'}) div {BASE}"),
            f"_down{level}": F.expr(f"{'_b' if not level else f'_down{level - 1}'} div {BASE}"),
        })
        up, down = F.col(f"_up{level}"), F.col(f"_down{level}")
        ends = F.concat(_pieces(a, up * BASE), _pieces(down * BASE, b))
        parts.append(_of_level(F.when(up < down, ends).otherwise(_pieces(a, b)), level))
        a, b = up, down
    small = rows.select(*keep, F.explode(F.concat(*parts)).alias("_n")).select(
        *keep, F.col("_n.level").alias("_level"), F.col("_n.block").alias("_block")
    )
    wide = BASE**TOP  # large blocks in two steps, so that no list of them is long
    large = rows.filter(a < b).select(
        *keep, a.alias("_x"), b.alias("_y"),
        F.explode(F.sequence(F.floor(a / wide), F.floor((b - 1) / wide))).alias("_w"),
    )
    first, last = F.greatest("_x", F.col("_w") * wide), F.least("_y", (F.col("_w") + 1) * wide)
    large = large.select(*keep, F.lit(TOP).alias("_level"), F.explode(F.sequence(first, last - 1)).alias("_block"))
    return small.unionByName(large)


def points_in_ranges(
    points: DataFrame, ranges: DataFrame, keys: list[str], value: str = "value", low: str = "low",
    high: str = "high", low_open: bool = False,
) -> DataFrame:
    """Every row of ``points`` with every row of ``ranges`` of equal ``keys`` that holds its value.

    Both ends belong to a range, the lower one not if ``low_open``; a null end is none. Columns but the keys
    must have different names on the two sides. Values that are null or not a number, ranges with an end that is
    not a number or with ends in the wrong order, and null keys match nothing; repeated rows are rows of their own.
    """
    clash = (set(points.columns) & set(ranges.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    number = F.col(value).cast("double")
    values = points.select(*keys, number.alias("_value")).filter(number.isNotNull() & ~F.isnan(number)).distinct()
    ends = materialise(_ends(ranges, keys, low, high, low_open))
    low_side = _AFTER if low_open else _BEFORE
    marks = values.withColumn("_side", F.lit(_AT)).unionByName(
        ends.select(*keys, F.col("_low").alias("_value"), F.lit(low_side).alias("_side"))
        .unionByName(ends.select(*keys, F.col("_high").alias("_value"), F.lit(_AFTER).alias("_side")))
        .distinct()
    )
    marks = materialise(numbered(marks, keys, ["_value", "_side"], "_place"))

    def place(side: int, of: str, name: str) -> DataFrame:
        return marks.filter(F.col("_side") == side).select(
            *keys, F.col("_value").alias(of), F.col("_place").alias(name)
        )

    runs = ends.join(place(low_side, "_low", "_from"), [*keys, "_low"]).join(
        place(_AFTER, "_high", "_b"), [*keys, "_high"]
    ).withColumn("_a", F.col("_from") + 1)
    asked = _blocks(runs, [*keys, "_low", "_high"])
    stored = marks.filter(F.col("_side") == _AT).select(
        *keys, "_value",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("level"), F.expr(f"_place div {BASE**n}").alias("block")) for n in range(TOP + 1)
        ])).alias("_n"),
    ).select(*keys, "_value", F.col("_n.level").alias("_level"), F.col("_n.block").alias("_block"))
    pairs = stored.join(asked, [*keys, "_level", "_block"]).select(*keys, "_value", "_low", "_high")
    rest = [c for c in ranges.columns if c not in keys]
    left = points.withColumn("_value", number)
    right = ranges.withColumns({
        "_low": F.coalesce(F.col(low).cast("double"), F.lit(_LOW)),
        "_high": F.coalesce(F.col(high).cast("double"), F.lit(_HIGH)),
    })
    return left.join(pairs, [*keys, "_value"]).join(right, [*keys, "_low", "_high"]).select(*points.columns, *rest)


def overlapping_ranges(
    stored: DataFrame, ranges: DataFrame, keys: list[str], stored_low: str, stored_high: str,
    low: str = "low", high: str = "high",
) -> DataFrame:
    """Every row of ``stored`` with every row of ``ranges`` of equal ``keys`` that shares a number with it.

    Either the stored range begins inside the asked one, or the asked one inside the stored one after its
    beginning: two joins of points with ranges, and no pair is in both. Ends as in ``points_in_ranges``.
    """
    columns = [*stored.columns, *(c for c in ranges.columns if c not in keys)]
    begin, end = F.col(stored_low).cast("double"), F.col(stored_high).cast("double")

    def sound(a: Column, b: Column) -> Column:
        return (a <= b) & ~F.isnan(a) & ~F.isnan(b)

    begin, end = F.coalesce(begin, F.lit(_LOW)), F.coalesce(end, F.lit(_HIGH))
    a, b = F.coalesce(F.col(low).cast("double"), F.lit(_LOW)), F.coalesce(F.col(high).cast("double"), F.lit(_HIGH))
    whole, right = stored.filter(sound(begin, end)), ranges.filter(sound(a, b))
    begins, asked = whole.withColumn("_begin", begin), right.withColumn("_asked", a)
    inside = points_in_ranges(begins, right, keys, "_begin", low, high)
    around = points_in_ranges(asked, whole, keys, "_asked", stored_low, stored_high, low_open=True)
    return inside.select(*columns).unionByName(around.select(*columns))
