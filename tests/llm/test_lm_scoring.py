import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from thicket.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
END = object()


def tokens(text):
    return [*WORD.findall((text or "").translate(FOLD)), END]


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def brute(rows):
    """Every count in plain dictionaries."""
    train = [tokens(t) for i, t in rows if not held_out(i)]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip([None, *t], t))
    heads = Counter(p[0] for t in train for p in zip([None, *t], t))
    before = Counter(w for _, w in pairs)
    total, vocab = sum(count.values()), len(count)
    seen = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    low, high = lm.discounts(seen(before)), lm.discounts(seen(pairs))
    d = lambda c, by: 0 if not c else by[min(c, 3) - 1]
    mass = defaultdict(float)
    for (h, _), c in pairs.items():
        mass[h] += d(c, high)
    left = sum(d(c, low) for c in before.values()) / len(pairs) if pairs else 1.0
    out = {}
    for n, (i, text) in enumerate(rows):
        base = score = known = 0
        last = None
        for w in tokens(text):
            base += math.log10((count[w] + 0.5) / (total + 0.5 * (vocab + 1)))
            known += count[w] > 0
            p = max(before[w] - d(before[w], low), 0) / max(len(pairs), 1) + left / (vocab + 1)
            if heads[last]:
                c = pairs[last, w]
                p = max(c - d(c, high), 0) / heads[last] + mass[last] / heads[last] * p
            score += math.log10(p)
            last = w
        out[n] = (i, held_out(i), len(tokens(text)), known, total, base, score)
    return sorted(out.values(), key=str)


def check(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    model = lm.train(df, **more)
    got = sorted((tuple(r) for r in lm.score(df, model).collect()), key=str)
    want = brute(rows)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-5, abs=1e-5)
    return model


def test_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    model = check(spark, rows, shards=5)
    assert len(model.hot) > 1


def test_edge_rows(spark):
    long = "a b " * 50_000
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "A a b a"), (3, "A a b a"), (None, "x"), (7, long), (8, "z" * 5000), (9, "É é é")]
    check(spark, rows, shards=3)


def test_empty_table(spark):
    check(spark, [], shards=2)


def test_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a", "b a a", "c", "a b", "b b c a"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = lm.Scorer(lm.train(df, shards=2))
    import numpy as np

    from thicket.llm._text import word_bounds, word_hashes

    def hashed(words):
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        return word_hashes(raw, *word_bounds(raw, np.array([0, len(raw)]))[:2])

    for head in ("a", "b", "c"):
        total = 0.0
        for tail in [*hashed(["a", "b", "c", "unknown"]), lm.END]:
            one = np.append(hashed([head]), tail)
            both = scorer.score(one, np.array([0, 2]))[2][0] - scorer.score(one[:1], np.array([0, 1]))[2][0]
            total += 10**both
        assert total == pytest.approx(1, abs=1e-5)
