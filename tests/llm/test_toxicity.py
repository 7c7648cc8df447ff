import zlib

import numpy as np
import pytest

from thicket.llm import toxicity as tx


def distance(a, b):
    """Edit distance with swaps of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_the_edit_distance():
    terms = ["idiot", "moron", "scum", "idiots", "pathetic", "aab"]
    trie, rng = tx.LevenshteinTrie([t.encode() for t in terms]), np.random.default_rng(1)
    words = ["", *terms]
    for _ in range(3000):
        w = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 3)):
            k, c = rng.integers(len(w) + 1), "abcdiotmrscnuphex"[rng.integers(17)]
            kind = rng.integers(4)
            w = [w[:k] + [c] + w[k:], w[:k] + w[k + 1 :], w[:k] + [c] + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k : k + 1] + w[k + 2 :]][kind]
        words.append("".join(w))
    words = [w for w in words if w]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends = tx._bounds(raw, np.array([0, len(raw)]))
    for w, got in zip(words, trie.match(raw, starts, ends).tolist(), strict=True):
        near = [(distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= (1 if len(t) >= 5 else 0)]
        assert (got % 2 if got >= 0 else None) == (min(near)[0] if near else None), w
        if near:
            assert distance(w, terms[got // 2]) == got % 2


def test_quotation_and_abuse():
    c = tx.Classifier([("idiot", 3.0)])
    texts = ["you are an id1ot", 'he said "idiot" there', "the idiott", "nothing", "", "« idiot »"]
    raw = "".join(texts).encode()
    rows = c.features(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)]))
    got = (rows[:, :3] > 0).tolist()
    assert got == [[True, False, True], [False, True, False], [True, False, False], [False] * 3, [False] * 3, [False, True, False]]


def test_held_out_labels(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = tx.op8_toxicity(spark, d).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    test = [r for r in got if r.held_out]
    toxic, clean = [r for r in test if r.toxic], [r for r in test if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)  # some labelled texts hold no term at all
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_edge_rows(spark):
    docs = [(i, ("you moron and idiot " if i % 2 else "a nice day with ") + f"other words {i}", i) for i in range(100)]
    docs += [(None, None, 0), (200, "", 0), (201, "MORON!", 0), (201, "m0ron", 0), (202, "idoit, you " * 100_000, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(100)] + [(None, 1, 1), (3, None, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    rows = tx.score(df, tx.train(df, labels)).collect()
    assert len(rows) == len(docs)
    said = {(r.doc_id, r.predicted) for r in rows}
    assert {(None, 0), (200, 0), (201, 1), (202, 1), (1, 1), (2, 0)} <= said
    assert all(r.score == 0 for r in tx.score(df, tx.train(df, labels.limit(0))).collect())
    assert tx.score(df.limit(0), tx.Classifier([])).count() == 0


def test_regression_finds_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(1 + 2 * x[:, 0])))).astype(float)
    w = tx.fit(x, y)
    p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert np.allclose(x.T @ (y - p) - 0.1 * w[1:], 0, atol=1e-5)
    assert w[1] == pytest.approx(2, abs=0.5)


def test_long_words_and_many_terms(spark):
    rng = np.random.default_rng(6)
    terms = sorted({"".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(1500)})
    trie = tx.LevenshteinTrie([*(t.encode() for t in terms), b"moron"], stems={len(terms)})
    words = [*terms[::7], *(t[1:] for t in terms[::11]), "moron" + "x" * 5000, "moro" + "x" * 5000, "q" * 100_000]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    got = trie.match(raw, *tx._bounds(raw, np.array([0, len(raw)]))).tolist()
    n, m = len(terms[::7]), len(terms[::11])
    assert got[:n] == [2 * k for k in range(0, len(terms), 7)]
    assert got[n : n + m] == [2 * k + 1 for k in range(0, len(terms), 11)]
    assert got[n + m :] == [2 * len(terms), -1, -1]
    assert len(trie.sets) < 40 * len(words)  # sets of states that no word reaches are not made
    docs = spark.createDataFrame([(i, f"{t} here {i}") for i, t in enumerate(terms[:100] * 12)], "doc_id long, text string")
    clean = spark.createDataFrame([(i, f"fine words {i} of the day") for i in range(2000, 2800)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "1 as toxic").union(clean.selectExpr("doc_id", "0 as toxic"))
    learned = tx.train(docs.union(clean), labels)
    assert len(learned.terms) > 64
    assert all(r.predicted == (r.doc_id < 1200) for r in tx.score(docs.union(clean), learned).collect())


def test_empty_table(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.score(docs, tx.train(docs, labels)).count() == 0
