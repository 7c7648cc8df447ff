"""Retrieval jobs that combine the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import questions as Q
from thicket.functions import text as X
from thicket.operators import postings as I
from thicket.operators import search as S
from thicket.operators import thresholds as T
from thicket.operators.triples import concept_rows
from thicket.session import materialise

FIELDS = ["text", "label", "definition", "country", "year", "scope", "org"]


def vector_hits(questions: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """R2/R3 with the fields of the documents found; no index rows, no hits."""
    found = materialise(S.vector_search(questions, index, k))
    return index.select("uri", *FIELDS).join(found, "uri")


def keyword_found(
    filters: DataFrame, triples: DataFrame, k: int, postings: I.KeywordIndex | None = None
) -> DataFrame:
    """R4 from a stored keyword index, or over the texts of the graph's concepts where there is none."""
    if postings is not None:
        return I.stored_filtered_search(filters, postings, k)
    return S.filtered_search(filters, materialise(concept_rows(triples)), k)


def keyword_rows(
    filters: DataFrame, triples: DataFrame, k: int, postings: I.KeywordIndex | None = None
) -> DataFrame:
    """R4 with the hit text."""
    found = keyword_found(filters, triples, k, postings)
    text = X.format_hit("label", "definition", "country", "year", "scope", "org")
    return found.withColumn("text", text)


def fuse(vec: DataFrame, kw: DataFrame, k: int) -> DataFrame:
    """R5 with fields: a document found both ways keeps the vector hit's."""
    merged = S.rrf(vec, kw, k)

    def fields(df: DataFrame, prefix: str) -> DataFrame:
        one = df.groupBy("qid", "uri").agg(F.max(F.struct("rank", *FIELDS)).alias("f"))
        return one.select("qid", "uri", F.col("f").alias(prefix))

    both = merged.join(fields(vec, "v"), ["qid", "uri"], "left").join(
        fields(kw, "k"), ["qid", "uri"], "left"
    )

    def pick(name: str) -> Column:
        mine = F.when(F.col("v").isNotNull(), F.col(f"v.{name}")).otherwise(F.col(f"k.{name}"))
        return X.text_or_empty(mine).alias(name)

    return both.select(*merged.columns, *[pick(n) for n in FIELDS])


def hybrid_hits(
    filters: DataFrame, triples: DataFrame, index: DataFrame, k: int = V.TOP_K,
    labels: DataFrame | None = None, postings: I.KeywordIndex | None = None,
) -> DataFrame:
    """R12 up to the cut: both searches at 3k, fused, boosted, best ``k``."""
    vec = vector_hits(filters, index, 3 * k)
    kw = keyword_rows(filters, triples, 3 * k, postings)
    return S.boost(fuse(vec, kw, 3 * k), filters, k, labels)


def hybrid_retrieve(
    questions: DataFrame, triples: DataFrame, index: DataFrame, thresholds: DataFrame,
    k: int = V.TOP_K, labels: DataFrame | None = None, postings: I.KeywordIndex | None = None,
) -> DataFrame:
    """Hits with graph context and thresholds, positions in ``n``.

    ``questions`` is (qid, query, embedding), optionally with filters already
    extracted (a ``concept`` column).
    """
    filters = questions if "concept" in questions.columns else Q.extract_filters(questions)
    hits = materialise(hybrid_hits(filters, triples, index, k, labels, postings))
    return T.enrich_thresholds(filters, hits, triples, thresholds)


def _vector_only(hits: DataFrame) -> DataFrame:
    return hits.select(
        "qid", "uri", *FIELDS, F.array(F.lit("vector")).alias("sources"),
        F.col("rank").alias("vec_rank"), F.lit(None).cast("int").alias("kw_rank"),
        F.col("score").alias("vector_score"), F.lit(0.0).alias("kw_score"),
        F.lit(0.0).alias("rrf_score"), "rank",
    )


def planned_retrieve(
    questions: DataFrame, plans: DataFrame, triples: DataFrame, index: DataFrame,
    thresholds: DataFrame, k: int = 8, postings: I.KeywordIndex | None = None,
) -> DataFrame:
    """Run each question's planned tool calls, merge, add context and thresholds.

    ``plans`` is (qid, text). Filters come from the question itself; a call's
    own text only changes the keywords. Vector calls search with the question's
    vector. Questions whose calls find nothing get vector hits.
    """
    filters = Q.extract_filters(questions)
    calls = (
        filters.join(plans.select("qid", F.col("text").alias("plan")), "qid")
        .select("*", F.posexplode(Q.parse_tool_plan("plan", "query")).alias("call", "c"))
        .select(
            *[c for c in filters.columns if c != "query"], "call",
            F.col("c.tool").alias("tool"), F.col("c.query").alias("query"),
        )
        .withColumn("cid", F.concat_ws(":", "qid", "call"))
    )
    searches = calls.filter(F.col("tool") == "sparql_search")
    owners = materialise(searches.select("cid", F.col("qid").alias("owner"), "call"))
    by_call = searches.withColumn("qid", F.col("cid")).drop("cid", "call", "tool")
    found = keyword_found(by_call, triples, k, postings)
    kw = found.join(owners, found["qid"] == owners["cid"]).select(
        F.col("owner").alias("qid"), "uri",
        X.format_planned_hit("label", "definition").alias("text"),
        *[X.text_or_empty(f).alias(f) for f in FIELDS if f != "text"],
        F.array(F.lit("sparql")).alias("sources"), F.lit(None).cast("int").alias("vec_rank"),
        F.col("rank").alias("kw_rank"), F.lit(0.0).alias("vector_score"),
        F.col("score").alias("kw_score"),
        F.round(F.lit(1.0) / (V.RRF_K + F.col("rank")), 6).alias("rrf_score"), "rank", "call",
    )
    every = materialise(_vector_only(vector_hits(questions, index, k)))
    vector_calls = calls.filter(F.col("tool") == "vector_search").select("qid", "call")
    vec = every.join(vector_calls, "qid")
    merged = S.union_hits(kw.unionByName(vec), every, questions, k)
    hits = merged.drop("call", "rank").withColumnRenamed("n", "rank")
    return T.enrich_thresholds(filters, materialise(hits), triples, thresholds)


def retrieve(
    questions: DataFrame, plans: DataFrame, triples: DataFrame, index: DataFrame,
    thresholds: DataFrame, k: int = V.TOP_K, labels: DataFrame | None = None,
    postings: I.KeywordIndex | None = None,
) -> DataFrame:
    """Hits of every question by its ``mode`` (vector, graph, planned, none)."""

    def part(mode: str) -> DataFrame:
        return questions.filter(F.col("mode") == mode).drop("mode")

    vector = _vector_only(vector_hits(part("vector"), index, k)).withColumns(
        {"graph_context": F.lit(None).cast("string"), "n": F.col("rank").cast("long")}
    )
    graph = hybrid_retrieve(part("graph"), triples, index, thresholds, k, labels, postings)
    planned = planned_retrieve(part("planned"), plans, triples, index, thresholds, k, postings)
    columns = [*T.HIT_COLUMNS, "n"]
    return (
        vector.select(*columns)
        .unionByName(graph.select(*columns))
        .unionByName(planned.select(*columns))
    )


def without_hits(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions that asked for retrieval and got nothing."""
    return questions.filter(F.col("mode") != "none").join(
        hits.select("qid").distinct(), "qid", "left_anti"
    )
