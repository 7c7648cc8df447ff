import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import ranges as R

POINTS, RANGES = "k string, id int, value double", "k string, rid int, low double, high double"


def data():
    rng = np.random.default_rng(3)
    points = [("a", i, float(rng.integers(0, 60)) / 2) for i in range(150)]
    points += [("hot", 1000 + i, 7.0) for i in range(80)] + [("hot", 2000 + i, float(i)) for i in range(40)]
    points += [("a", 3000, None), ("a", 3001, math.nan), ("a", 3002, math.inf), ("a", 3003, -math.inf), (None, 3004, 1.0), ("a", 3, 5.0)]
    ends = [None, -math.inf, -1.0, 0.0, 3.25, 7.0, 7.5, 12.0, 29.5, 1e9, math.inf]
    ranges = [(k, 100 * i + 10 * j + (k == "a"), a, b) for i, a in enumerate(ends) for j, b in enumerate(ends) for k in ("a", "hot")]
    return points, [*ranges, ranges[5], (None, -1, None, None), ("a", -2, math.nan, None), ("a", -3, 0.0, math.nan), ("none", -4, None, None)]


def holds(value, low, high, low_open):
    if value is None or math.isnan(value) or any(x is not None and math.isnan(x) for x in (low, high)):
        return False
    a, b = -math.inf if low is None else low, math.inf if high is None else high
    return (a < value if low_open else a <= value) and value <= b


@pytest.mark.parametrize("base,top,low_open", [(16, 3, False), (2, 2, False), (3, 1, True)])
def test_points_in_ranges(spark, monkeypatch, base, top, low_open):
    monkeypatch.setattr(R, "BASE", base)  # few places to a block, so that all sizes of block occur
    monkeypatch.setattr(R, "TOP", top)
    points, ranges = data()
    got = R.points_in_ranges(spark.createDataFrame(points, POINTS), spark.createDataFrame(ranges, RANGES), ["k"], low_open=low_open)
    want = sorted((i, r) for k, i, v in points for q, r, a, b in ranges if k == q and k and holds(v, a, b, low_open))
    assert got.columns == ["k", "id", "value", "rid", "low", "high"]
    assert sorted((r.id, r.rid) for r in got.collect()) == want


def test_blocks_follow_the_result(spark):
    """A range is asked for in few blocks, however many values lie outside it."""
    runs = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate([(5, 6), (1, 4097), (17, 100_000), (9, 9), (10, 2)])], "rid int, _a long, _b long")
    got = R._blocks(runs, ["rid"]).collect()
    for n, a, b in ((0, 5, 6), (1, 1, 4097), (2, 17, 100_000), (3, 9, 9), (4, 10, 2)):
        mine = [(16**r._level * r._block, 16**r._level * (r._block + 1)) for r in got if r.rid == n]
        assert sorted(x for lo, hi in mine for x in range(lo, hi)) == list(range(a, b))
        assert len(mine) <= 30 * 3 + (b - a) // 4096 + 1


def test_overlapping_ranges(spark):
    rng = np.random.default_rng(4)
    some = [None, None, *map(float, range(12)), math.inf, -math.inf]
    pick = lambda: some[rng.integers(len(some))]
    stored = [("a" if i % 3 else "b", i, pick(), pick()) for i in range(150)] + [("a", 900, math.nan, 1.0), (None, 901, 0.0, 1.0)]
    ranges = [("a" if i % 2 else "b", i, pick(), pick()) for i in range(60)] + [("a", 900, 0.0, math.nan), ("b", 901, None, None)]
    df = spark.createDataFrame(stored, "k string, id int, lo double, hi double")
    got = R.overlapping_ranges(df, spark.createDataFrame(ranges, RANGES), ["k"], "lo", "hi").collect()

    def ends(a, b):
        return -math.inf if a is None else a, math.inf if b is None else b

    def shares(x, y):
        (a, b), (c, d) = ends(*x), ends(*y)
        return a <= b and c <= d and a <= d and c <= b  # false with NaN

    want = sorted((i, r) for k, i, a, b in stored for q, r, c, d in ranges if k and k == q and shares((a, b), (c, d)))
    assert sorted((r.id, r.rid) for r in got) == want


def test_empty_and_clashing(spark):
    points, ranges = (spark.createDataFrame(x, s) for x, s in zip(data(), (POINTS, RANGES), strict=True))
    assert R.points_in_ranges(points.limit(0), ranges, ["k"]).count() == 0
    assert R.points_in_ranges(points, ranges.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError):
        R.points_in_ranges(points.withColumn("low", F.lit(1.0)), ranges, ["k"])
