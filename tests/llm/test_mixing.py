from collections import defaultdict

import pytest
from compare import differences

from thicket.llm import mixing as mx


def test_against_sql(spark, sf_dir, duck):
    found = differences(mx.op9_mixing(spark, sf_dir), duck, mx.SQL)
    assert not found, "\n".join(found)


def filled(sizes, weights):
    """Targets by sharing again and again until no source is above its cap."""
    total, caps, target = sum(sizes), [3 * s for s in sizes], [0.0] * len(sizes)
    full = set()
    while True:
        left = total - sum(caps[i] for i in full)
        share = sum(w for i, w in enumerate(weights) if i not in full)
        target = [caps[i] if i in full else left * w / share for i, w in enumerate(weights)]
        over = {i for i, t in enumerate(target) if t > caps[i] + 1e-9}
        if not over:
            return target
        full |= over


SOURCES = {"a": 40_000, "b": 900, "c": 12_000, "Z": 7, "é": 5000, None: 2500, "zero": 0}


def rows():
    out, n = [], 0
    for source, words in SOURCES.items():
        done = 0
        while done < words:
            k = min(words - done, 1 + n * 37 % 400 + (20_000 if n == 3 else 0))
            out.append((n, " ".join(["w"] * k), source))
            done, n = done + k, n + 1
    return out + [(n + 1, None, "zero"), (n + 2, "", "a"), (None, "x y z", "a"), (7, " ".join(["q"] * 50), "a"), (7, " ".join(["q"] * 50), "a"), (7, "another text", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, 5) for i, t, s in rows()], "doc_id long, text string, source string, size int")


def test_targets_and_taken(spark, docs, monkeypatch):
    monkeypatch.setattr(mx, "BUCKET_ROWS", 16)
    monkeypatch.setattr(mx, "CHUNK", 100)
    got = mx.mix(docs).collect()
    assert len(got) == len(rows())
    words, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        words[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    order = sorted((s for s in words if s is not None)) + [None]
    want = dict(zip(order, filled([words[s] for s in order], [i % 3 + 1 for i in range(len(order))]), strict=True))
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(64, 0.01 * words[s])
    assert sum(target.values()) == pytest.approx(sum(words.values()))
    again = mx.mix(docs.repartition(7)).collect()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_is_even(spark, docs, monkeypatch):
    monkeypatch.setattr(mx, "CHUNK", 64)
    sizes = docs.selectExpr("doc_id", "source", "cast(size(split(coalesce(text, ''), ' ')) as bigint) as size", "xxhash64(text) as th")
    plan = mx.sources(sizes)
    share = {r.s: r.slots for r in plan.collect()}
    got = sorted((tuple(r) for r in mx.schedule(plan).collect()))
    assert [r[0] for r in got] == list(range(sum(share.values())))
    seen = defaultdict(int)
    for k, s, rank, _ in got:
        assert rank == seen[s]
        seen[s] += 1
        if k % 50 == 0:
            for x, n in share.items():
                assert abs(seen[x] - n * (k + 1) / len(got)) < 6
    assert seen == {s: n for s, n in share.items() if n}


def test_mixed_rows(docs):
    got = mx.mixed(docs)
    assert got.columns == docs.columns
    counts = {tuple(r)[:3]: r["count"] for r in got.groupBy("doc_id", "source", "text").count().collect()}
    times = defaultdict(int)
    for r in mx.mix(docs).collect():
        if r.size:
            times[r.doc_id, r.source, r.th] += (2 * r.taken + r.size) // (2 * r.size)
    assert sorted(counts.values()) == sorted(n for n in times.values() if n)


@pytest.mark.parametrize("data", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")]])
def test_without_words(spark, data):
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mx.mix(docs).collect()] == [(0, 0.0, 0)] * len(data)
    assert mx.mixed(docs).count() == 0
