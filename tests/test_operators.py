"""Composite operators on small fixtures and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from thicket import schemas as M
from thicket import vocab as V
from thicket.operators import graph as G
from thicket.operators import ordering
from thicket.operators import search as S
from thicket.operators import stats as A
from thicket.operators import thresholds as T
from thicket.operators import triples as R
from thicket.operators.containment import contained_in, keyword_hits, near_names
from thicket.operators.countries import countries_in_question
from thicket.operators.ordering import carried, numbered
from thicket.plans.build import heading_path


def ex(name):
    return V.EX + name


def toy(spark):
    """The 36-triple graph of the fixtures."""
    rows = []

    def link(s, p, *targets):
        rows.extend((ex(s), p, t if t.startswith("http") else ex(t), "iri", None, None) for t in targets)

    def text(s, p, o, lang=None, dtype=None):
        rows.append((ex(s), p, o, "literal", lang, dtype))

    link("Scheme", V.TYPE, V.SCHEME_CLASS)
    link("Scheme", V.HAS_TOP, "Forest", "Tree")
    for top, other in (("Forest", "Tree"), ("Tree", "Forest")):
        link(top, V.TYPE, V.CONCEPT)
        link(top, V.TOP_OF, "Scheme")
        text(top, V.PREF_LABEL, top, "en")
        link(top, V.RELATED, other)
    for name, land in (("Forest_1", "Country_GIN"), ("Forest_2", "Country_PNG")):
        link(name, V.TYPE, V.CONCEPT)
        link(name, V.BROAD_MATCH, "Forest")
        link(name, V.SPATIAL, land)
    text("Forest_1", V.PREF_LABEL, "FOREST", "en")
    text("Forest_1", V.DEFINITION, "Land with trees", "en")
    text("Forest_1", V.DATE, "2015", None, V.GYEAR)
    text("Forest_1", ex("minAreaHa"), "0.5", None, V.DECIMAL)
    text("Forest_2", V.DEFINITION, "Tree land", "en")
    text("Forest_2", V.DEFINITION, "Terre boisée", "fr")
    text("Forest_2", ex("minAreaHa"), "1.0", None, V.DECIMAL)
    text("Forest_2", ex("minCrownCoverPct"), "30.0", None, V.DECIMAL)
    for land, name in (("Country_GIN", "Guinea"), ("Country_PNG", "Papua New Guinea")):
        link(land, V.TYPE, V.CONCEPT)
        text(land, V.PREF_LABEL, name, "en")
    for coll, inside in (("Countries", ("Country_GIN", "Country_PNG")),
                         ("Continent_Africa", ("Country_GIN",)), ("Scope_National", ("Forest_1",))):
        link(coll, V.TYPE, V.COLLECTION)
        link(coll, V.MEMBER, *inside)
    return spark.createDataFrame(rows, M.TRIPLE)


def test_toy_statistics(spark):
    triples = toy(spark)
    got = A.graph_stats(triples).first().asDict()
    assert got["total_triples"] == 36 and got["total_concepts"] == 6
    assert got["with_broad_match"] == 2 and got["with_definition"] == 3
    assert got["with_thresholds"] == 2 and got["countries_count"] == 2


def test_toy_graph(spark):
    triples = toy(spark)
    edges, nodes = G.build_edges(triples).cache(), G.build_nodes(triples).cache()
    assert edges.count() == 12
    degrees = {r["uri"][len(V.EX):]: r["degree"] for r in G.degree(edges).collect()}
    assert degrees["Forest"] == 6 and degrees["Scheme"] == 4 and sum(degrees.values()) == 24
    assert [r["type"] for r in G.top_edges(edges, nodes).collect()] == ["related"]
    assert {r["label"]: r["n"] for r in G.by_category(nodes).collect()} == {"Forest": 2, "Tree": 0}
    quality = {r["quality"]: (r["n"], r["pct"]) for r in G.coverage(nodes).collect()}
    assert quality == {"definition": (2, 33), "country": (2, 33), "year": (1, 17)}
    labels = {r["uri"]: r["label"] for r in nodes.collect()}
    assert labels[ex("Forest_2")] == "ex:Forest_2"


def test_toy_thresholds(spark):
    triples = toy(spark)
    names = spark.createDataFrame([("guinea",), ("new guinea",)], "name string")
    got = {(r["name"], r["uri"]): r["score"] for r in T.country_thresholds(names, triples).collect()}
    assert got == {("guinea", ex("Forest_1")): 0.25, ("new guinea", ex("Forest_2")): 0.5}
    africa = [r for r in T.continent_thresholds(triples).collect() if r["continent"] == "Africa"]
    assert [(r["country"], round(r["score"], 4)) for r in africa] == [("Guinea", 0.3333)]


def test_most_specific_country(spark):
    dim = spark.createDataFrame([("Guinea", 0), ("Papua New Guinea", 1)], "country string, pos long")
    asked = spark.createDataFrame([(1, "forests of Papua New Guinea")], "qid long, query string")
    assert [r["country"] for r in countries_in_question(asked, dim).collect()] == ["Papua New Guinea"]


def test_fusion(spark):
    vec = spark.createDataFrame([(1, "A", 1, 0.9), (1, "B", 2, 0.8)], "qid long, uri string, rank int, score double")
    kw = spark.createDataFrame([(1, "B", 1, 1.0), (1, "C", 2, 0.5)], "qid long, uri string, rank int, score double")
    got = [(r["uri"], r["rrf_score"]) for r in S.rrf(vec, kw).orderBy("rank").collect()]
    assert got == [("B", 0.032522), ("A", 0.016393), ("C", 0.016129)]


def test_vector_scores(spark):
    docs = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "uri string, embedding array<float>"
    )
    asked = spark.createDataFrame([(1, [2.0, 0.0])], "qid long, embedding array<float>")
    for limit in (10, 0):
        got = {r["uri"]: r["score"] for r in S.vector_search(asked, docs, 3, max(limit, 1)).collect()}
        assert got == {"a": 1.0, "b": 0.5, "c": 0.0}


def test_containment_is_naive_contains(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    needles = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)]
    hay = spark.createDataFrame([(w,) for w in words], "hay string")
    sought = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {tuple(r) for r in contained_in(hay, sought).collect()}
    assert got == {(w, n) for w in set(words) for n in set(needles) if n in w}


def test_keyword_hits_read_whole_texts(spark):
    docs = spark.createDataFrame([("d", "x " * 5000 + "Waldlichtung"), ("e", "nothing")], "uri string, text string")
    words = spark.createDataFrame([("lichtung",), ("thin",)], "keyword string")
    got = {tuple(r) for r in keyword_hits(words, docs).collect()}
    assert got == {("d", "lichtung"), ("e", "thin")}


def test_near_names_is_levenshtein(spark):
    names = ["turkiye", "turkey", "niger", "nigeria", "mali", "malawi", "oman", "iran", "iraq"]
    df = spark.createDataFrame([(n,) for n in names], "hay string")
    got = {(r["hay"], r["near"]) for r in near_names(df, df.withColumnRenamed("hay", "near")).collect()}
    brute = df.crossJoin(df.toDF("near")).filter(F.levenshtein("hay", "near") <= 2)
    assert got == {tuple(r) for r in brute.collect()}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_near_names_of_every_length(spark, k):
    """All pairs of short and long strings, many of them a few edits apart, nulls and empty ones."""
    rng = random.Random(k)
    base = ["", "a", "ab", "abc", "münchen", "a long name of a place with many words", "x" * 60]
    names = set(base)
    for word in base * 12:
        letters = list(word)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(letters) + 1)
            letters[at : at + rng.randrange(2)] = rng.choice(["", "a", "z", "é"])
        names.add("".join(letters))
    df = spark.createDataFrame([(n,) for n in [*names, None]], "hay string")
    got = {tuple(r) for r in near_names(df, df.withColumnRenamed("hay", "near"), k).collect()}
    pairs = df.crossJoin(df.toDF("near")).withColumn("d", F.levenshtein("hay", "near")).filter(F.col("d") <= k)
    assert got == {tuple(r) for r in pairs.collect()} and len(got) > len(names)


def test_near_names_of_the_tables(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("hay"))
    people = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("hay"))
    names = parts.union(people).distinct()
    got = {tuple(r) for r in near_names(names, names.withColumnRenamed("hay", "near")).collect()}
    pairs = names.crossJoin(names.toDF("near")).withColumn("d", F.levenshtein("hay", "near")).filter("d <= 2")
    assert got == {tuple(r) for r in pairs.collect()}


def test_numbering_of_a_hot_key(spark):
    """One key owns most rows; numbers do not depend on the number of partitions."""
    rows = [("hot" if i % 10 else f"k{i}", (i * 7919) % 10007) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, pos long")
    want = {}
    for k in {r[0] for r in rows}:
        for n, (_, p) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            want[(k, p)] = n
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r["k"], r["pos"]): r["n"] for r in numbered(df, ["k"], ["pos"], "n").collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_numbering_of_ties_and_null_keys(spark):
    """Ties are numbered the same way in every layout; null keys keep their rows."""
    rows = [(None if i % 3 else "a", i % 5, f"r{i}") for i in range(60)]
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows[:: 1 if parts == "1" else -1], "k string, pos long, t string")
        seen.append(sorted((r["k"] or "", r["n"], r["t"]) for r in numbered(df, ["k"], ["pos"], "n").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    assert [n for k, n, _ in seen[0] if k == ""] == list(range(1, 41))
    assert [n for k, n, _ in seen[0] if k == "a"] == list(range(1, 21))


def test_running_best_over_batches(spark):
    rng = random.Random(11)
    vectors = [(f"u{i:03d}", [rng.choice([-1.0, 0.5, 1.0]) for _ in range(3)]) for i in range(200)]
    docs = spark.createDataFrame(vectors, "uri string, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(q, vectors[q][1]) for q in range(4)], "qid long, embedding array<float>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    for rows in ("7", before):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        got.append({tuple(r) for r in S.vector_search(asked, docs, 5).collect()})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] and len(got[0]) == 20


def test_carried_over_buckets(spark):
    rng = random.Random(3)
    rows = [("d", i, rng.choice([None, i])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc string, pos long, v long")
    got = {r["pos"]: r["m"] for r in carried(df, "doc", "pos", {"m": F.col("v")}, rows=16).collect()}
    last, want = None, {}
    for _, i, v in rows:
        last = v if v is not None else last
        want[i] = last
    assert got == want


def test_heading_path_is_a_stack(spark):
    rng = random.Random(5)
    rows, want, stack = [], {}, []
    for pos in range(300):
        level = rng.choice([None, None, 1, 2, 3, 5])
        if level is None:
            rows.append(("d", pos, "Normal", f"text {pos}"))
            titles = ([t for _, t in stack if t] + [""] * 4)[:4]
            want[pos] = tuple(titles)
        else:
            title = "" if pos % 17 == 0 else f"T{pos}"
            rows.append(("d", pos, f"Heading {level}", f"1.{pos} {title}"))
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, title))
    df = spark.createDataFrame(rows, "doc_id string, pos long, style string, text string")
    out = heading_path(df).collect()
    assert {r["pos"]: tuple(r[f"title_{i}"] for i in range(1, 5)) for r in out} == want


@pytest.mark.parametrize("span", [4, 256])
def test_heading_levels_without_bound(spark, monkeypatch, span):
    """Levels up to 30, documents of very different length, a null document; spans of 4 need several scans."""
    monkeypatch.setattr(ordering, "SPAN", span)
    rng = random.Random(span)
    rows, want = [], {}
    for doc, n in (("long", 700), ("short", 5), (None, 40), ("none", 3)):
        stack = []
        for pos in range(n):
            level = None if doc == "none" else rng.choice([None, None, rng.randrange(1, 4), rng.randrange(9, 31)])
            if level is None:
                rows.append((doc, pos, "Normal", f"text {pos}"))
                want[doc, pos] = tuple(([t for _, t in stack if t] + [""] * 6)[:6])
            else:
                title = "" if pos % 11 == 0 else f"T{pos}"
                rows.append((doc, pos, f"Heading {level}", f"1.{pos} {title}"))
                stack = [h for h in stack if h[0] < level] + [(level, title)]
    df = spark.createDataFrame(rows, "doc_id string, pos long, style string, text string").repartition(5)
    out = heading_path(df, 6).collect()
    assert len(out) == len(want)
    assert {(r["doc_id"], r["pos"]): tuple(r[f"title_{i}"] for i in range(1, 7)) for r in out} == want
    assert heading_path(df.limit(0)).count() == 0


def test_set_semantics(spark):
    triples = toy(spark)
    assert R.add(triples, triples).count() == 36
    once = R.delete_touching(R.reparent(triples, ex("Scope_National"), [ex("Forest")], ex("Tree")), ex("Scope_National"))
    again = R.delete_touching(R.reparent(once, ex("Scope_National"), [ex("Forest")], ex("Tree")), ex("Scope_National"))
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in again.collect()}
    moved = R.match(once, s=ex("Forest_1"), p=V.BROAD_MATCH).select("o").collect()
    assert [r["o"] for r in moved] == [ex("Tree")]


def test_graph_context(spark):
    triples = toy(spark)
    uris = spark.createDataFrame([(ex("Forest_2"),), (ex("Forest"),)], "uri string")
    got = {r["uri"]: r["graph_context"] for r in T.graph_context(uris, triples).collect()}
    assert got[ex("Forest_2")] == (
        "Parent concept: Forest\nRelated concepts (same category): FOREST\n"
        "Numerical thresholds: minAreaHa: 1.0 | minCrownCoverPct: 30.0"
    )
    assert got[ex("Forest")] == "Associated concepts: Tree"
