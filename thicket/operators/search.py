"""Keyword search, vector search and rank fusion for many questions at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import questions as Q
from thicket.functions import text as X
from thicket.operators.containment import found_needles
from thicket.operators.ordering import dedupe_best, first_n, top_k
from thicket.session import materialise

# task code travels with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTER_COLUMNS = {
    "parents": "array<string>",
    "scopes": "array<string>",
    "orgs": "array<string>",
    "creators": "array<string>",
    "has_creator": "boolean",
}
CONCEPT_FIELDS = ["label", "definition", "country", "year", "scope", "org"]


def _with_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    gaps = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(gaps) if gaps else df


def concept_filter(concept: Column, parents: Column) -> Column:
    """no parent, or a parent of that name."""
    return (
        concept.isNull()
        | parents.isNull()
        | (F.size(parents) == 0)
        | F.array_contains(parents, F.lower(concept))
    )


def member_or_unclassified(scope: Column, scopes: Column) -> Column:
    """member of the scope, or of no scope at all."""
    return (
        scope.isNull()
        | scopes.isNull()
        | (F.size(scopes) == 0)
        | F.array_contains(scopes, scope)
    )


def org_match(org: Column) -> Column:
    """Member of the organisation's collection, or its key is in a creator (lower-cased)."""
    return F.coalesce(F.array_contains("orgs", org), F.lit(False)) | F.coalesce(
        F.exists("creators", lambda c: F.contains(c, F.lower(org))), F.lit(False)
    )


def org_filter(org: Column) -> Column:
    """F8: matching organisation, or no creator."""
    return org.isNull() | ~F.coalesce("has_creator", F.lit(False)) | org_match(org)


def keyword_rows(questions: DataFrame) -> DataFrame:
    """(needle, qid, weight, concept_hit, scope_hit, keywords) of each question.

    Repeated keywords weigh twice; the filter values whose mention in the text
    earns a bonus are needles too.
    """
    words = Q.question_keywords("query")
    base = questions.select("qid", "concept", "scope", words.alias("words"))
    lit = F.lit
    rows = F.concat(
        F.transform(
            "words",
            lambda w: F.struct(
                w.alias("needle"), lit(1).alias("weight"), lit(0).alias("concept_hit"),
                lit(0).alias("scope_hit"),
            ),
        ),
        F.array(
            F.struct(
                F.lower("concept").alias("needle"), lit(0).alias("weight"),
                lit(1).alias("concept_hit"), lit(0).alias("scope_hit"),
            ),
            F.struct(
                F.lower("scope").alias("needle"), lit(0).alias("weight"),
                lit(0).alias("concept_hit"), lit(1).alias("scope_hit"),
            ),
        ),
    )
    return (
        base.filter(F.size("words") > 0)
        .select("qid", F.size("words").alias("keywords"), F.explode(rows).alias("r"))
        .select("qid", "keywords", "r.*")
        .filter(F.col("needle").isNotNull())
        .groupBy("needle", "qid")
        .agg(
            F.sum("weight").alias("weight"),
            F.max("concept_hit").alias("concept_hit"),
            F.max("scope_hit").alias("scope_hit"),
            F.max("keywords").alias("keywords"),
        )
    )


def row_id() -> Column:
    """Names one label and definition row of a concept."""
    return F.substring(F.md5(F.concat_ws("\u001f", "label", "definition")), 1, 16)


def keyword_scores(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """R1 before the cut: (qid, uri, rid, score) of every concept row with a keyword.

    Concept rows stay hash-partitioned by (uri, rid) from the needles found to
    the score, so the pairs of questions and concepts are made, filtered and
    reduced before anything is shuffled again. The
    filter columns belong to the uri and are grouped by, which keeps the buffers
    plain numbers.
    """
    questions = _with_missing(questions, {"concept": "string", "scope": "string", "org": "string"})
    concepts = _with_missing(concepts, FILTER_COLUMNS)
    asked = materialise(keyword_rows(questions))
    docs = concepts.select(
        "uri",
        row_id().alias("rid"),
        *FILTER_COLUMNS,
        F.concat_ws(" ", "label", "definition").alias("text"),
    )
    found = found_needles(asked.select("needle"), docs, ["uri", "rid"])
    pairs = (
        found.select("uri", *FILTER_COLUMNS, F.explode("found").alias("f"))
        .select("uri", "f.rid", "f.needle", *FILTER_COLUMNS)
        .join(asked, "needle")
        .groupBy("uri", "rid", "qid", *FILTER_COLUMNS)
        .agg(
            F.sum("weight").alias("hits"),
            F.max("keywords").alias("keywords"),
            F.max("concept_hit").alias("concept_hit"),
            F.max("scope_hit").alias("scope_hit"),
        )
        .filter(F.col("hits") > 0)
    )
    return filtered_scores(pairs, questions)


def share_of_keywords(bonus: Column) -> Column:
    """The score of a row: the share of a question's keywords it has, and the bonus."""
    return F.round(F.least(F.col("hits") / F.col("keywords") + bonus, F.lit(1.0)), 3)


def filtered_scores(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, uri, rid, score) of the (qid, uri, rid, hits, keywords, …) ``pairs`` that pass their question's filters."""
    filters = materialise(questions.select("qid", "concept", "scope", "org"))
    org = F.col("org")
    bonus = (
        F.col("concept_hit") * F.lit(0.2)
        + F.col("scope_hit") * F.lit(0.1)
        + F.when(org.isNotNull() & org_match(org), 0.4).otherwise(0.0)
    )
    return (
        pairs.join(filters, "qid")
        .filter(concept_filter(F.col("concept"), F.col("parents")))
        .filter(member_or_unclassified(F.col("scope"), F.col("scopes")))
        .filter(org_filter(org))
        .select(
            "qid", "uri", "rid",
            share_of_keywords(bonus).alias("score"),
        )
    )


def keyword_search(questions: DataFrame, concepts: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` concepts per question with their fields, ranked from 1.

    A concept with several label or definition rows keeps its best one.
    """
    hits = best_hits(keyword_scores(questions, concepts), k)
    fields = concepts.select(
        "uri",
        row_id().alias("rid"),
        *[c for c in CONCEPT_FIELDS if c in concepts.columns],
    )
    return with_fields(fields, hits)


def best_hits(scores: DataFrame, k: int) -> DataFrame:
    """(qid, uri, score, rid, rank): each concept's best row, and the best ``k`` concepts of each question."""
    best = (
        scores.groupBy("uri", "qid")
        .agg(F.max(F.struct("score", "rid")).alias("b"))
        .select("qid", "uri", "b.*")
    )
    return materialise(top_k(best, k))


def with_fields(fields: DataFrame, hits: DataFrame) -> DataFrame:
    """``hits`` with the fields of their row."""
    return dedupe_best(fields.join(hits, ["uri", "rid"]), ["qid", "uri"], ["rid"]).drop("rid")


def without_moot_scope(filters: DataFrame) -> DataFrame:
    """An organisation makes the scope moot."""
    return filters.withColumn("scope", F.when(F.col("org").isNull(), F.col("scope")))


def filtered_search(filters: DataFrame, concepts: DataFrame, k: int) -> DataFrame:
    """R1 with the question's filters; an organisation makes the scope moot."""
    return keyword_search(without_moot_scope(filters), concepts, k)


# -- vectors ----------------------------------------------------------------

BLOCK = 4096
ASKED_AT_ONCE = 256  # queries whose cosines to a block of documents are held at once


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _best_pairs(qids: np.ndarray, queries: np.ndarray, docs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of one block of documents for each query, ``ASKED_AT_ONCE`` queries at a time."""
    uris = docs["uri"].to_numpy()
    units = _unit(docs["embedding"]).T
    by_uri = np.argsort(uris, kind="stable")
    parts = []
    for at in range(0, max(len(qids), 1), ASKED_AT_ONCE):
        cosine = np.round(queries[at : at + ASKED_AT_ONCE] @ units, 12)
        order = by_uri[np.argsort(-cosine[:, by_uri], axis=1, kind="stable")[:, :k]]
        parts.append((order, np.take_along_axis(cosine, order, axis=1)))
    order = np.concatenate([p[0] for p in parts])
    return pd.DataFrame(
        {
            "qid": np.repeat(qids, order.shape[1]),
            "uri": uris[order].ravel(),
            "cosine": np.concatenate([p[1] for p in parts]).ravel(),
        }
    )


def _best_of(best: pd.DataFrame, more: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of two lists for each query, the smaller uri on a tie."""
    both = pd.concat([best, more], ignore_index=True)
    both = both.sort_values(["qid", "cosine", "uri"], ascending=[True, False, True])
    return both.groupby("qid", sort=False).head(k)


def vector_candidates(
    query_vecs: DataFrame, docs: DataFrame, k: int, max_queries: int = BLOCK
) -> DataFrame:
    """(qid, uri, cosine) holding the k nearest documents of every query.

    Few queries (counted) travel to the documents, which stay where they are;
    each task gives at most k rows per query. More queries than that meet
    the documents in a grid of bounded blocks instead.
    """
    queries = query_vecs.select("qid", "embedding")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, uri string, cosine double"
    docs = docs.select("uri", "embedding").filter(F.col("embedding").isNotNull())
    head = queries.limit(max_queries + 1).toPandas()
    if len(head) == 0:
        return docs.sparkSession.createDataFrame([], schema)
    if len(head) <= max_queries:
        shared = docs.sparkSession.sparkContext.broadcast(
            (head["qid"].to_numpy(), _unit(head["embedding"]))
        )

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, matrix = shared.value
            best = None
            for batch in batches:
                if len(batch):
                    pairs = _best_pairs(qids, matrix, batch, k)
                    best = pairs if best is None else _best_of(best, pairs, k)
            if best is not None:
                yield best

        return docs.mapInPandas(nearest, schema)
    return _grid_candidates(queries, docs, k, max_queries, schema)


def _grid_candidates(
    queries: DataFrame, docs: DataFrame, k: int, block: int, schema: str
) -> DataFrame:
    """Blocks of queries against blocks of documents, each pair of blocks one group."""
    q_blocks = max(1, -(-queries.count() // block))
    d_blocks = max(1, -(-docs.count() // block))

    def spread(df: DataFrame, key: str, own: int, own_name: str, other: int, other_name: str):
        return df.withColumn(
            own_name, F.pmod(F.xxhash64(F.lit(17), key), F.lit(own))
        ).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = spread(docs, "uri", d_blocks, "d", q_blocks, "q").withColumn("q", F.col("q").cast("long"))
    right = spread(queries, "qid", q_blocks, "q", d_blocks, "d").withColumn(
        "d", F.col("d").cast("long")
    )

    def nearest(doc_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if doc_rows.empty or query_rows.empty:
            return pd.DataFrame({"qid": [], "uri": [], "cosine": []})
        return _best_pairs(
            query_rows["qid"].to_numpy(), _unit(query_rows["embedding"]), doc_rows, k
        )

    return left.groupBy("d", "q").cogroup(right.groupBy("d", "q")).applyInPandas(nearest, schema)


def vector_search(
    query_vecs: DataFrame, docs: DataFrame, k: int = V.TOP_K, max_queries: int = BLOCK
) -> DataFrame:
    """R2: (qid, uri, score, rank), score ``(1 + cosine) / 2``, nearest first.

    Exact: every document is scored. Ties go to the smaller uri.
    """
    found = vector_candidates(query_vecs, docs, k, max_queries)
    nearest = top_k(found, k, "cosine")
    return nearest.select(
        "qid", "uri", F.round((1 + F.col("cosine")) / 2, 4).alias("score"), "rank"
    )


# -- fusion -----------------------------------------------------------------


def rank_union(vec_hits: DataFrame, kw_hits: DataFrame) -> DataFrame:
    """Full outer merge of two ranked lists by (qid, uri).

    Both inputs have (qid, uri, rank, score); a uri listed twice keeps its last
    rank. Scores missing from a list are 0.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        last = df.groupBy("qid", "uri").agg(F.max(F.struct("rank", "score")).alias("r"))
        return last.select(
            "qid", "uri", F.col("r.rank").alias(f"{prefix}_rank"),
            F.col("r.score").alias(f"{prefix}_score"),
        )

    both = side(vec_hits, "vec").join(side(kw_hits, "kw"), ["qid", "uri"], "full")
    return both.select(
        "qid",
        "uri",
        F.array_compact(
            F.array(
                F.when(F.col("vec_rank").isNotNull(), F.lit("vector")),
                F.when(F.col("kw_rank").isNotNull(), F.lit("sparql")),
            )
        ).alias("sources"),
        "vec_rank",
        "kw_rank",
        F.coalesce("vec_score", F.lit(0.0)).alias("vector_score"),
        F.coalesce("kw_score", F.lit(0.0)).alias("kw_score"),
    )


def rrf_score() -> Column:
    def part(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (V.RRF_K + F.col(rank)), F.lit(0.0))

    return F.round(part("vec_rank") + part("kw_rank"), 6)


def fusion_order() -> list[Column]:
    """Best score first; ties as the lists were read: vector hits, then keyword hits."""
    return [F.col("vec_rank").asc_nulls_last(), F.col("kw_rank").asc_nulls_last(), F.col("uri")]


def rrf(vec_hits: DataFrame, kw_hits: DataFrame, k: int = V.TOP_K) -> DataFrame:
    """Reciprocal-rank fusion, best ``k`` per question."""
    merged = rank_union(vec_hits, kw_hits).withColumn("rrf_score", rrf_score())
    return top_k(merged, k, "rrf_score", fusion_order())


def boost(hits: DataFrame, filters: DataFrame, k: int, labels: DataFrame | None = None) -> DataFrame:
    """+0.05 for each filter value found in the hit's fields, then the best ``k``.

    ``labels(key, label)`` adds a value's display label, so that keys written
    without spaces (``WorldBank``) can match too; a value counts once.
    """
    values = F.array_compact(
        F.concat(
            F.array("concept", "org", "scope", "continent"),
            F.coalesce(F.col("countries"), F.array().cast("array<string>")),
        )
    )
    wanted = filters.select("qid", F.posexplode(values).alias("i", "value"))
    wanted = wanted.filter(F.col("value") != "")
    if labels is not None:
        names = labels.groupBy(F.lower("key").alias("k")).agg(F.min("label").alias("value_label"))
        wanted = wanted.join(names, F.lower("value") == F.col("k"), "left").drop("k")
    else:
        wanted = wanted.withColumn("value_label", F.lit(None).cast("string"))
    wanted = wanted.groupBy("qid").agg(
        F.collect_list(F.struct(F.lower("value").alias("v"), F.lower("value_label").alias("l")))
        .alias("wanted")
    )
    text = F.lower(
        F.concat_ws(
            " ", *[X.text_or_empty(c) for c in ("label", "definition", "country", "org", "scope")]
        )
    )
    matched = F.size(
        F.filter(
            F.coalesce("wanted", F.array().cast("array<struct<v:string,l:string>>")),
            lambda w: F.contains(text, w["v"])
            | F.coalesce(F.contains(text, w["l"]), F.lit(False)),
        )
    )
    ranked = hits.drop("rank").join(wanted, "qid", "left").withColumn(
        "rrf_score", F.round(F.col("rrf_score") + matched * V.FILTER_BOOST, 6)
    )
    return top_k(ranked.drop("wanted"), k, "rrf_score", fusion_order())


def union_hits(hits: DataFrame, fallback: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Tool results of a question, one row per uri, first ``k``; vector hits if none.

    ``hits`` has (qid, call, rank, uri, …); rows without a uri are all kept.
    ``fallback`` has (qid, rank, uri, …) and serves the questions without hits.
    """
    missed = questions.select("qid").join(hits.select("qid").distinct(), "qid", "left_anti")
    rest = fallback.join(missed, "qid", "left_semi").withColumn("call", F.lit(0))
    both = hits.unionByName(rest, allowMissingColumns=True)
    named = dedupe_best(both.filter(F.col("uri") != ""), ["qid", "uri"], ["call", "rank"])
    blank = both.filter(F.coalesce("uri", F.lit("")) == "")
    return first_n(named.unionByName(blank), ["qid"], ["call", "rank"], k, "n")
