import random
import re

import numpy as np
import pytest

from thicket.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 10 * min(len(a), len(b)) >= 9 * max(len(a), len(b)) and 100 * len(a & b) >= 90 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(root(i)), doc_id) if x is not None]
        least[root(i)] = min(ids) if ids else None
    return sorted(((d, len(s), least[root(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string").repartition(4)
    assert sorted((tuple(r) for r in jj.join(df).collect()), key=str) == brute(rows)


def test_whole_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()])


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return words


@pytest.mark.parametrize("block", [8, 512])
def test_groups_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(jj, "BLOCK", block)
    rng = random.Random(7)
    rows = []
    for length in (9, 11, 12, 13, 16, 21, 22, 24, 30, 60, 150):
        base = [f"w{rng.randrange(400)}" for _ in range(length)]
        for k in range(14):
            words = changed(rng, base, k % 4 if length > 40 else k % 2)
            words = words[: len(words) - k % 3] + ([f"x{k}"] if k % 5 == 0 else [])
            rows.append((len(rows), " ".join(words)))
    line = " ".join(f"common{i}" for i in range(12))
    rows += [(1000 + i, line + " " + " ".join(f"u{rng.random()}" for _ in range(10 + i % 9))) for i in range(40)]
    check(spark, rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "one"), (4, "One"), (5, "one two"), (6, "a b c"), (7, "A B  c"), (7, "other words on the same id"), (None, "a b c"), (None, "lonely text here"), (8, long), (9, long + " more"), (9, long + " more")]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


def test_needed_overlap_is_exact():
    for s in range(1, 60):
        for t in range(s, 70):
            linked = [o for o in range(s + 1) if 100 * o >= 90 * (s + t - o)]
            assert (min(linked) if linked else None) == (jj.need(s, t) if jj.need(s, t) <= s else None)
            assert (t <= s * 10 // 9) == bool(linked) == (s >= jj.least_partner(t))


def test_boundary_follows_cost():
    assert jj.choose_boundary({}) == 0
    assert 9 <= jj.choose_boundary({s: 100 for s in range(1, 36)}) < jj.MAX_LIGHT


def test_forest_spans_without_all_pairs():
    linked = np.ones((50, 50), bool)
    assert len(jj._forest(linked)[0]) == 49


def linked(a, b, percent):
    return 100 * len(a & b) >= percent * len(a | b) if a and b else False


def sets_of(rows, size):
    words = {d: WORD.findall((t or "").translate(FOLD)) for d, t in rows}
    return {d: {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set() for d, w in words.items()}


def planted(rng):
    """Copies with a changed or added word, from short texts to long ones, some of them between the two rules."""
    rows = []
    for length in (5, 8, 9, 12, 13, 14, 15, 18, 20, 24, 29, 36, 44, 60, 150, 200):
        for end in (0, 1, 2, 3):
            base = [f"w{rng.randrange(10_000)}" for _ in range(length)]
            tail = [f"x{rng.random()}" for _ in range(end * length // 16)]
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + tail)), (len(rows) + 2, " ".join(changed(rng, base, 1 + length // 60)))]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (3, 90), (4, 75)])
def test_words_and_threshold_are_parameters(spark, size, percent):
    rows = planted(random.Random(11))
    sets, least = sets_of(rows, size), {d: d for d, _ in rows}
    for _ in range(4):  # as far as a chain of links can reach in a group of three
        for a in least:
            for b in least:
                if linked(sets[a], sets[b], percent):
                    least[a] = min(least[a], least[b])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join(df, size=size, percent=percent).collect()}
    assert got == {d: (len(sets[d]), least[d]) for d, _ in rows}
    assert any(least[d] != d for d in least)


def test_needed_overlap_at_any_threshold():
    for percent in (75, 80, 90, 95, 100):
        for s in range(1, 60):
            for t in range(s, 85):
                shared = [o for o in range(s + 1) if 100 * o >= percent * (s + t - o)]
                assert (min(shared) if shared else None) == (jj.need(s, t, percent) if jj.need(s, t, percent) <= s else None)
                assert bool(shared) == (s >= jj.least_partner(t, percent)) == (t <= s * 100 // percent)


def test_pipeline_stage_drops_pair_between_the_rules(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, *(f"x{i}" for i in range(11))])), (3, " ".join(f"v{i}" for i in range(60)))]
    three, five = sets_of(rows, 3), sets_of(rows, 5)
    assert linked(five[1], five[2], 80) and not linked(three[1], three[2], 90)
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, df, "").collect()) == [1, 3]
    assert sorted(r.doc_id for r in jj.representatives(df).collect()) == [1, 2, 3]


def test_list_keys_are_never_broadcast(spark, tmp_path):
    """Beside histograms, the planner takes the keys of lists for a fraction of what they are."""
    rows = spark.range(1000).selectExpr("id % 10 as key", "id as sid", "0 as role", "cast(null as binary) as histogram")
    rows.write.parquet(str(tmp_path / "listed"))
    shared = jj._shared(spark.read.parquet(str(tmp_path / "listed")).where("role = 0").select("key", "sid"))
    cells = jj._cells(spark.range(3).selectExpr("id as hub", "id as sid", "1 as blocks")).join(spark.range(3).withColumnRenamed("id", "sid"), "sid")
    for df in (shared, cells):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert shared.count() == 1000
