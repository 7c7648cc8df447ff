import datetime as dt
import random
import re

from pyspark.sql import functions as F

from thicket.catalog import views as W
from thicket.functions import questions as Q
from thicket.operators import postings as P
from thicket.operators import search as S
from thicket.operators import triples as R
from thicket.operators.containment import keyword_hits
from thicket.session import materialise, shared_folder
from thicket.streaming.annotate import search_stream


def new(spark, name, buckets=7):
    return P.KeywordIndex(f"{shared_folder(spark)}/postings-{name}", buckets)


def concepts(spark, texts, first=0):
    rows = [(f"u{i + first:03d}", f"label{i}" if i % 3 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "uri string, label string, definition string")


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["for", "est", "tree", "land", "can", "opy", "x", "Wald-", "é", "7", " ", " ", ". "]
    return ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(n)] + [None, "", "…"]


NEEDLES = ["forest", "est", "tree", "nopy", "x", "stl", "la", "treeland", "absent", "wald", ""]


def test_hits_are_substring_matches(spark):
    index = new(spark, "brute")
    some = texts(1, 80)
    P.add_batch(index, concepts(spark, some))
    words = spark.createDataFrame([(n,) for n in NEEDLES], "keyword string")
    got = {tuple(r) for r in P.keyword_hits(words, index).collect()}
    want = set()
    for i, t in enumerate(some):
        whole = " ".join(x for x in (f"label{i}" if i % 3 else None, t) if x is not None).lower()
        want |= {(f"u{i:03d}", n) for n in NEEDLES if n and n in whole}
    assert got == want and len(got) > 100


def test_batches_add_up_and_replace_themselves(spark):
    index, whole = new(spark, "parts"), new(spark, "whole")
    first, second = concepts(spark, texts(2, 40)), concepts(spark, texts(3, 40), 100)
    P.add_batch(whole, first.union(second))
    P.add_batch(index, first, "monday")
    P.add_batch(index, second, "tuesday")
    P.add_batch(index, second, "tuesday")  # run again after a failure
    asked = spark.createDataFrame([(1, "forest tree land canopy"), (2, "waldtree and opyland"), (3, "")], "qid long, query string")
    assert P.stored_rows(spark, index).count() == 86
    one, other = (sorted(map(tuple, P.stored_search(asked, i, 10, fields=False).collect())) for i in (index, whole))
    assert one == other and len(one) > 10
    late = concepts(spark, ["forest tree land canopy"], 500)
    P.add_batch(index, late, "wednesday")
    best = P.stored_search(asked, index, 1).where("qid = 1").first()
    assert best.uri in ("u500", *[r[1] for r in one]) and best.score == 1.0


def test_same_rows_as_the_search_over_texts(spark, sf_dir):
    rows = materialise(R.concept_rows(W.kg_triples(spark, sf_dir)))
    filters = Q.extract_filters(W.template_questions(spark, sf_dir))
    index = new(spark, "concepts", 16)
    P.add_batch(index, rows)
    columns = ["qid", "uri", "rank", "score", "label", "definition", "country", "year", "scope", "org"]
    over_texts = S.filtered_search(filters, rows, 36).select(*columns)
    stored = P.stored_filtered_search(filters, index, 36).select(*columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, over_texts.collect()))
    words = filters.select(F.explode(Q.question_keywords("query")).alias("keyword"))
    docs = rows.select("uri", F.concat_ws(" ", "label", "definition").alias("text"))
    assert {tuple(r) for r in P.keyword_hits(words, index).collect()} == {tuple(r) for r in keyword_hits(words, docs).collect()}


def test_a_search_reads_only_asked_buckets_and_no_text(spark, sf_dir):
    index = new(spark, "reads", 64)
    P.add_batch(index, W.documents(spark, sf_dir))
    needles = spark.createDataFrame([("zyzzyvaa",), ("theandof",)], "needle string")
    hits = P.found_rows(needles, index)
    assert not [f for f in hits.inputFiles() if "/rows/" in f]
    hits.collect()
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(1, "which things are here")], "qid long, query string")
    scored = P.stored_scores(asked, index)
    assert not [f for f in scored.inputFiles() if "/rows/" in f]


def test_empty_tables(spark):
    index = new(spark, "empty")
    P.add_batch(index, concepts(spark, [None, "", "123"]).where("label IS NULL").drop("label").withColumn("label", F.lit(None).cast("string")))
    asked = spark.createDataFrame([(1, "forest land")], "qid long, query string")
    assert P.stored_search(asked, index).count() == 0
    P.add_batch(index, concepts(spark, ["forest"]), "1")
    assert P.stored_search(asked, index).count() == 1 and P.stored_search(asked.limit(0), index).count() == 0


def test_a_stream_answers_each_question_once_over_restarts(spark, tmp_path):
    index = new(spark, "stream")
    P.add_batch(index, concepts(spark, texts(4, 60)))
    t = dt.datetime(2024, 1, 1, 12)
    schema = "qid long, query string, asked_at timestamp"

    def ask(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        search_stream(stream, index, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 5).awaitTermination()

    first = [(1, "forest tree land", t), (2, "canopy treeland", t), (1, "forest tree land", t + dt.timedelta(minutes=5))]
    ask("a", first)
    run()
    ask("b", [(2, "canopy treeland", t + dt.timedelta(minutes=20)), (3, "waldtree land", t + dt.timedelta(minutes=21))])
    run()  # a new start from the same checkpoint: 2 was answered, 3 is new
    got = sorted((r.qid, r.uri, r.rank, r.score) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    every = spark.createDataFrame([(1, "forest tree land"), (2, "canopy treeland"), (3, "waldtree land")], "qid long, query string")
    want = sorted((r.qid, r.uri, r.rank, r.score) for r in P.question_hits(every, index, 5).collect())
    assert got == want and {r[0] for r in got} == {1, 2, 3}


def test_runs_are_stored_as_lists_of_rows(spark):
    index = new(spark, "lists")
    P.add_batch(index, concepts(spark, ["forest land, forest"] * 200).drop("label").withColumn("label", F.lit("")).coalesce(2))
    lists = P._postings(spark, index)
    assert lists.count() <= 4 and lists.agg(F.sum(F.size("places"))).first()[0] == 400
    few = spark.createDataFrame([("f",), ("st",), ("d",), ("restl",)], "needle string")
    assert P.found_rows(few, index).groupBy("needle").count().orderBy("needle").collect() == [("d", 200), ("f", 200), ("st", 200)]


def test_texts_are_listed_in_bounded_pieces(spark, monkeypatch):
    whole, pieces = new(spark, "whole-piece"), new(spark, "pieces")
    some = concepts(spark, texts(5, 120)).coalesce(1)
    P.add_batch(whole, some)
    monkeypatch.setattr(P, "TEXT_BYTES", 64)
    P.add_batch(pieces, some)
    assert P._postings(spark, pieces).count() > P._postings(spark, whole).count()
    needles = spark.createDataFrame([(n,) for n in NEEDLES], "needle string")
    one, other = ({tuple(r) for r in P.found_rows(needles, i).collect()} for i in (whole, pieces))
    assert one == other and len(one) > 100


def test_pairs_of_rows_and_questions_are_shuffled_by_uri_only(spark, sf_dir):
    index = new(spark, "by-uri")
    P.add_batch(index, materialise(R.concept_rows(W.kg_triples(spark, sf_dir))))
    filters = Q.extract_filters(W.template_questions(spark, sf_dir))
    best = P.stored_scores(filters, index).groupBy("uri", "qid").agg(F.max(F.struct("score", "rid")))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(uri#", plan) and not re.search(r"hashpartitioning\(uri#\d+, (rid|qid)#", plan)


def test_plain_questions_are_ranked_as_by_scores_of_all_rows(spark):
    index = new(spark, "blocks")
    rng = random.Random(9)
    some = [(f"u{rng.randrange(150):03d}", rng.choice([None, "forest", "é"]), t) for t in texts(8, 300)] + [(None, "forest", "tree")]
    rows = spark.createDataFrame(some, "uri string, label string, definition string")
    P.add_batch(index, rows.repartition(3), "a")
    P.add_batch(index, rows.limit(200).repartition(2), "b")
    asked = [(1, "forest tree land canopy"), (2, "landtree tree forest forest"), (3, "the"), (4, None), (None, "forest land"), (5, "absent words")]
    plain = spark.createDataFrame(asked, "qid long, query string")
    for k in (1, 4, 1000):
        want = S.best_hits(P.stored_scores(plain, index), k)
        got = P.stored_search(plain, index, k, fields=False)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.drop("rid").collect())) and got.count() >= min(k, 100)
    mixed = plain.withColumns({"concept": F.when(F.col("qid") == 2, "forest"), "scope": F.lit(None).cast("string"), "org": F.when(F.col("qid") == 5, "FAO")})
    want = S.best_hits(P.stored_scores(mixed, index), 7).drop("rid")
    assert sorted(map(str, P.stored_search(mixed, index, 7, fields=False).collect())) == sorted(map(str, want.collect()))


def test_pairs_of_rows_and_needles_are_not_shuffled(spark):
    index = new(spark, "few-pairs")
    P.add_batch(index, concepts(spark, ["forest land canopy tree"] * 500).drop("label").withColumn("label", F.lit("")).repartition(2))
    asked = spark.createDataFrame([(i, "forest land canopy tree") for i in range(20)], "qid long, query string")
    assert P.plain_scores(asked, index, 3).count() <= 2 * 20 * 3
    assert P.plain_scores(asked, index, 3).count() < P.stored_scores(asked, index).count()
