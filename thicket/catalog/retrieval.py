"""Queries over search, thresholds, enrichment and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.catalog import views as W
from thicket.catalog.questions import (
    _KEYS_SQL,
    INVENTORY_SQL,
    MENTION_SQL,
    PLAIN,
    filters_cte,
    keywords_cte,
)
from thicket.catalog.registry import query
from thicket.functions import questions as Q
from thicket.functions import text as X
from thicket.operators import countries as C
from thicket.operators import evaluation as E
from thicket.operators import inventory as I
from thicket.operators import neighbours as N
from thicket.operators import postings as K
from thicket.operators import search as S
from thicket.operators import thresholds as T
from thicket.operators import triples as R
from thicket.operators.containment import keyword_hits
from thicket.plans import retrieve as P
from thicket.session import materialise
from thicket.sources.tables import index_rows, threshold_rows

# -- plain documents --------------------------------------------------------

_BENCH = "(SELECT item_id AS qid, text AS query FROM benchmark)"
_RID = "left(md5(concat_ws(chr(31), label, definition)), 16)"


def scored_cte(k: int, filtered: bool) -> str:
    """kwhits: (qid, uri, rid, score, rank) from kw, crow and, when filtered, filters."""
    if filtered:
        bonus = """(CASE WHEN contains(t, lower(f.concept)) THEN 0.2::DOUBLE ELSE 0 END
          + CASE WHEN f.org IS NULL AND contains(t, lower(f.scope)) THEN 0.1::DOUBLE ELSE 0 END)
          + CASE WHEN list_contains(orgs, f.org) OR contains(lower(creators), lower(f.org)) THEN 0.4::DOUBLE ELSE 0 END"""
        where = """WHERE (f.concept IS NULL OR len(parents) = 0 OR list_contains(parents, f.concept))
          AND (f.org IS NOT NULL OR f.scope IS NULL OR len(scopes) = 0 OR list_contains(scopes, f.scope))
          AND (f.org IS NULL OR creators IS NULL OR list_contains(orgs, f.org) OR contains(lower(creators), lower(f.org)))"""
        join = "JOIN filters f USING (qid)"
    else:
        bonus, where, join = "0", "", ""
    return f"""hitc AS (SELECT kw.qid, uri, rid, count(*) AS hits FROM kw JOIN crow ON contains(t, w) GROUP BY ALL),
    nkw AS (SELECT qid, count(*) AS n FROM kw GROUP BY qid),
    scored AS (SELECT hitc.qid, uri, rid, round(least(hits / n + ({bonus}), 1.0::DOUBLE), 3) AS score
      FROM hitc JOIN nkw USING (qid) {join} JOIN crow USING (uri, rid) {where}),
    bestrow AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY qid, uri ORDER BY score DESC, rid DESC) = 1),
    kwhits AS (SELECT *, cast(row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) AS INTEGER) AS rank FROM bestrow
      QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) <= {k})"""


_DOC_ROWS = f"""crow AS (SELECT *, {_RID} AS rid, ' ' || lower(definition) AS t
    FROM (SELECT '' || doc_id AS uri, '' AS label, text AS definition FROM documents))"""


@query(
    "J11",
    "WITH " + keywords_cte(_BENCH)
    + """, k AS (SELECT DISTINCT w AS keyword FROM kw)
    SELECT '' || doc_id AS uri, keyword FROM documents JOIN k ON contains(lower(text), keyword)""",
)
def document_keyword_hits(spark, d):
    asked = W.benchmark_questions(spark, d)
    words = asked.select(F.explode(Q.question_keywords("query")).alias("keyword"))
    docs = W.documents(spark, d).withColumnRenamed("definition", "text")
    return keyword_hits(words, docs)


@query(
    "R1 W3 W4 L1 L2 L3 Q15 Q22",
    "WITH " + keywords_cte(_BENCH) + "," + _DOC_ROWS + "," + scored_cte(10, False)
    + " SELECT qid, uri, score, rank FROM kwhits",
)
def document_keyword_search(spark, d):
    asked = W.benchmark_questions(spark, d).select("qid", "query")
    found = K.stored_search(asked, W.document_postings(spark, d), 10, fields=False)
    return found.select("qid", "uri", "score", "rank")


@query(
    "R1 L3",
    "WITH " + keywords_cte(_BENCH) + "," + _DOC_ROWS + "," + scored_cte(10, False)
    + " SELECT qid, uri, score, rank FROM kwhits",
)
def document_search_over_texts(spark, d):
    """The same search without a stored index: texts are cut into runs for this one batch of questions."""
    asked = W.benchmark_questions(spark, d).select("qid", "query")
    return S.keyword_search(asked, W.documents(spark, d), 10).select("qid", "uri", "score", "rank")


@query(
    "J11",
    "WITH " + keywords_cte(_BENCH)
    + """, k AS (SELECT DISTINCT w AS keyword FROM kw)
    SELECT '' || doc_id AS uri, keyword FROM documents JOIN k ON contains(lower(text), keyword)""",
)
def stored_keyword_hits(spark, d):
    words = W.benchmark_questions(spark, d).select(F.explode(Q.question_keywords("query")).alias("keyword"))
    return K.keyword_hits(words, W.document_postings(spark, d))


def vector_cte(queries: str, docs: str, k: int, name: str = "vechits") -> str:
    """(qid, uri, score, rank): nearest documents by cosine; both tables have ``v`` double[]."""
    return f"""cosine AS (SELECT q.qid, i.uri, round(list_dot_product(q.v, i.v)
      / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(i.v, i.v)), 12) AS c FROM {queries} q, {docs} i),
    {name} AS (SELECT qid, uri, round((1 + c) / 2, 4) AS score,
      cast(row_number() OVER (PARTITION BY qid ORDER BY c DESC, uri) AS INTEGER) AS rank FROM cosine
      QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c DESC, uri) <= {k})"""


_VECS = """qv AS (SELECT item_id AS qid, cast(embedding AS DOUBLE[]) AS v FROM benchmark JOIN embeddings ON vec_id = item_id),
    iv AS (SELECT '' || vec_id AS uri, cast(embedding AS DOUBLE[]) AS v FROM embeddings)"""


@query(
    "R2 R3 L2",
    "WITH " + _VECS + "," + vector_cte("qv", "iv", 12) + " SELECT * FROM vechits",
)
def nearest_vectors(spark, d):
    return S.vector_search(
        W.benchmark_questions(spark, d), W.document_vectors(spark, d), V.TOP_K
    )


@query(
    "R2",
    "WITH " + _VECS + "," + vector_cte("qv", "iv", 12) + " SELECT * FROM vechits",
)
def nearest_vectors_by_blocks(spark, d):
    """The same search once the questions exceed what may travel to the documents."""
    return S.vector_search(
        W.benchmark_questions(spark, d), W.document_vectors(spark, d), V.TOP_K, max_queries=16
    )


def _vector_index(spark, d):
    """The index of all vectors, stored on first use."""
    path = W.stored_once(spark, d, "cells", lambda p: N.build_index(W.document_vectors(spark, d), p))
    return N.open_index(spark, path)


@query("R2 R3", "WITH " + _VECS + "," + vector_cte("qv", "iv", 12) + " SELECT * FROM vechits")
def nearest_vectors_by_all_cells(spark, d):
    """The stored index probed whole, which has to be the exact search."""
    index = _vector_index(spark, d)
    return N.approximate_search(index, W.benchmark_questions(spark, d), V.TOP_K, probes=index.cells)


@query("R2 R3")
def approximate_neighbours(spark, d):
    """Every vector whose id is divisible by 20 against all rows, by the cells nearest to it; no SQL, as it is approximate."""
    asked = W.load(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return N.approximate_search(_vector_index(spark, d), asked, V.TOP_K)


_RRF = """fused AS (SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.uri, k.uri) AS uri, v.rank AS vec_rank, k.rank AS kw_rank,
      coalesce(v.score, 0) AS vector_score, coalesce(k.score, 0) AS kw_score,
      round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + k.rank), 0), 6) AS rrf_score
      FROM vechits v FULL JOIN kwhits k ON v.qid = k.qid AND v.uri = k.uri)"""
_TIES = "rrf_score DESC, vec_rank NULLS LAST, kw_rank NULLS LAST, uri"


def ranked(source: str, k: int, name: str) -> str:
    return f"""{name} AS (SELECT *, cast(row_number() OVER (PARTITION BY qid ORDER BY {_TIES}) AS INTEGER) AS rank
      FROM {source} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY {_TIES}) <= {k})"""


_HYBRID_DOCS = (
    "WITH " + keywords_cte(_BENCH) + "," + _DOC_ROWS + "," + scored_cte(36, False) + "," + _VECS
    + "," + vector_cte("qv", "iv", 36) + "," + _RRF + "," + ranked("fused", 12, "top")
)


def _document_hits(spark, d):
    asked = W.benchmark_questions(spark, d)
    vec = S.vector_search(asked, W.document_vectors(spark, d), 36)
    kw = K.stored_search(asked.select("qid", "query"), W.document_postings(spark, d), 36, fields=False)
    return S.rrf(vec, kw, V.TOP_K)


@query(
    "R5 J8 L2 Q18",
    _HYBRID_DOCS + """ SELECT qid, uri, vec_rank, kw_rank, vector_score, kw_score, rrf_score, rank,
    concat_ws(',', CASE WHEN vec_rank IS NOT NULL THEN 'vector' END, CASE WHEN kw_rank IS NOT NULL THEN 'sparql' END) AS sources
    FROM top""",
)
def fused_document_hits(spark, d):
    return _document_hits(spark, d).withColumn("sources", F.array_join("sources", ","))


@query(
    "R14 P36 A23",
    _HYBRID_DOCS + """, m AS (SELECT top.qid, rank, definition, rrf_score, cast(round(rrf_score * 1000000) AS BIGINT) AS u,
      concat_ws(', ', CASE WHEN vec_rank IS NOT NULL THEN 'vector' END, CASE WHEN kw_rank IS NOT NULL THEN 'sparql' END) AS src
      FROM top JOIN crow USING (uri)),
    b AS (SELECT qid, rank, '[' || rank || ']' || chr(10) || '  Definition: ' || left(definition, 600) || chr(10)
      || '  [Sources: ' || src || ' | RRF: ' || printf('%d.%04d', (u + 50) // 1000000, ((u + 50) // 100) % 10000) || ']' AS t FROM m)
    SELECT qid, count(*) AS docs, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context FROM b GROUP BY qid""",
)
def document_context(spark, d):
    """Question to numbered passages: keywords, vectors, fusion, context text."""
    hits = _document_hits(spark, d).withColumnRenamed("rank", "n")
    texts = W.documents(spark, d)
    none = F.lit(None).cast("string")
    full = texts.join(materialise(hits), "uri").withColumns(
        {c: none for c in ("country", "year", "scope", "org", "graph_context")}
    )
    return E.context_block(full)


# -- the graph as the searched table ----------------------------------------

_CONCEPT_ROWS = f"""clab AS (SELECT s AS uri, coalesce(lang, '') AS lang, min(o) AS label FROM kg
      WHERE p = '{V.PREF_LABEL}' AND coalesce(lang, '') IN ('en', 'fr', '') GROUP BY ALL),
    cland AS (SELECT l.s AS land, min(l.o) AS country FROM kg l WHERE l.p = '{V.PREF_LABEL}'
      AND l.s IN (SELECT o FROM kg WHERE p = '{V.MEMBER}' AND s = '{V.COUNTRIES}') GROUP BY l.s),
    cone AS (SELECT s AS uri, min(o) FILTER (p = '{V.SPATIAL}') AS land, min(o) FILTER (p = '{V.DATE}') AS year,
      min(o) FILTER (p = '{V.SCOPE_NOTE}') AS scope, min(o) FILTER (p = '{V.CREATOR}') AS org,
      string_agg(o, ' ') FILTER (p = '{V.CREATOR}') AS creators,
      list(lower(replace(o, '{V.EX}', ''))) FILTER (p = '{V.BROAD_MATCH}') AS parents FROM kg
      WHERE s IN (SELECT s FROM kg WHERE p = '{V.TYPE}' AND o = '{V.CONCEPT}') GROUP BY s),
    cmem AS (SELECT o AS uri, list(replace(s, '{V.EX}Scope_', '')) FILTER (contains(s, 'Scope_')) AS scopes,
      list(replace(s, '{V.EX}Org_', '')) FILTER (contains(s, 'Org_')) AS orgs FROM kg WHERE p = '{V.MEMBER}' GROUP BY o),
    cfull AS (SELECT d.s AS uri, clab.label, d.o AS definition, coalesce(c.country, '') AS country, cone.year, cone.scope,
      cone.org, creators, coalesce(parents, []) AS parents, coalesce(scopes, []) AS scopes, coalesce(orgs, []) AS orgs
      FROM kg d JOIN cone ON cone.uri = d.s LEFT JOIN clab ON clab.uri = d.s LEFT JOIN cland c ON c.land = cone.land
      LEFT JOIN cmem ON cmem.uri = d.s WHERE d.p = '{V.DEFINITION}'),
    crow AS (SELECT *, {_RID} AS rid, lower(concat_ws(' ', label, definition)) AS t FROM cfull)"""
_ASK_KG = W.with_sql(
    W.KG_SQL, W.ASK_SQL, filters_cte("ask"), keywords_cte("ask"), _CONCEPT_ROWS
)


@query(
    "R1 R4 F7 F8 F9 R20",
    _ASK_KG + "," + scored_cte(36, True)
    + """ SELECT k.qid, k.uri, k.score, k.rank, c.label, c.definition, c.country, c.year, c.scope, c.org
    FROM kwhits k JOIN crow c USING (uri, rid)""",
)
def concept_keyword_search(spark, d):
    filters = Q.extract_filters(W.template_questions(spark, d))
    found = K.stored_filtered_search(filters, W.concept_postings(spark, d), 36)
    return found.select(
        "qid", "uri", "score", "rank", "label", "definition",
        X.text_or_empty("country").alias("country"), "year", "scope", "org",
    )


_INDEX = f"""doc AS (SELECT cone.uri, coalesce(min(label) FILTER (lang = 'en'), min(label) FILTER (lang = 'fr'),
      min(label), '') AS label, any_value(cone.land) AS land, any_value(year) AS year, any_value(org) AS org
      FROM cone LEFT JOIN clab USING (uri) GROUP BY cone.uri),
    ddef AS (SELECT s AS uri, min(o) AS definition FROM kg WHERE p = '{V.DEFINITION}' GROUP BY s),
    dnote AS (SELECT s AS uri, string_agg(DISTINCT o, ', ' ORDER BY o) AS scope FROM kg WHERE p = '{V.SCOPE_NOTE}' GROUP BY s),
    dfull AS (SELECT uri, label, definition, coalesce(c.country, '') AS country, coalesce(year, '') AS year,
      coalesce(org, '') AS org, coalesce(scope, '') AS scope FROM doc JOIN ddef USING (uri) LEFT JOIN dnote USING (uri)
      LEFT JOIN cland c ON c.land = doc.land),
    idx AS (SELECT dfull.*, cast(embedding AS DOUBLE[]) AS v,
      concat_ws(chr(10), CASE WHEN label <> '' THEN 'Term: ' || label END, 'Definition: ' || definition,
        nullif(concat_ws(' | ', CASE WHEN country <> '' THEN 'Country: ' || country END,
          CASE WHEN year <> '' THEN 'Year: ' || year END, CASE WHEN org <> '' THEN 'Organization: ' || org END), ''),
        CASE WHEN scope <> '' THEN 'Scope: ' || scope END) AS text
      FROM dfull LEFT JOIN (SELECT vec_id, embedding FROM embeddings) ON uri = '{V.EX}C_' || vec_id),
    idxv AS (SELECT * FROM idx WHERE v IS NOT NULL),
    qv AS (SELECT qid, cast(embedding AS DOUBLE[]) AS v FROM ask
      JOIN embeddings ON vec_id = qid % 1000000 + 25 * (qid // 1000000))"""


def _index(spark, d):
    vectors = W.load(spark, d, "embeddings").select(
        F.concat(F.lit(V.EX + "C_"), "vec_id").alias("uri"), "embedding"
    )
    return index_rows(R.search_documents(W.kg_triples(spark, d)), vectors)


def _asked(spark, d):
    vectors = W.load(spark, d, "embeddings").select("vec_id", "embedding")
    asked = W.template_questions(spark, d).withColumn(
        "vec_id", F.expr("qid % 1000000 + 25 * (qid div 1000000)")
    )
    return asked.join(vectors, "vec_id").drop("vec_id")


@query(
    "S9 P31 A14",
    _ASK_KG + "," + _INDEX
    + """ SELECT left(sha1(uri), 16) AS id, uri, text, label, definition, country, year, org, scope,
    round(sqrt(list_dot_product(v, v)), 6) AS norm FROM idx""",
)
def index_table(spark, d):
    return _index(spark, d).select(
        "id", "uri", "text", "label", "definition", "country", "year", "org", "scope",
        F.round("norm", 6).alias("norm"),
    )


@query(
    "R3",
    _ASK_KG + "," + _INDEX + "," + vector_cte("qv", "idxv", 12)
    + " SELECT qid, uri, score, rank, text FROM vechits JOIN idx USING (uri)",
)
def vector_only_hits(spark, d):
    hits = P.vector_hits(_asked(spark, d), _index(spark, d), V.TOP_K)
    return hits.select("qid", "uri", "score", "rank", "text")


def _tag(label: str, col: str) -> str:
    return f"CASE WHEN {col} <> '' THEN '{label}' || {col} END"


_FUSED_FIELDS = f"""kwf AS (SELECT k.*, c.label, c.definition, c.country, c.year, c.scope, c.org,
      concat_ws(chr(10), {_tag('Term: ', 'label')}, {_tag('Definition: ', 'definition')}, nullif(concat_ws(' | ',
        {_tag('Country: ', 'country')}, {_tag('Year: ', 'year')}, {_tag('Scope: ', 'scope')}, {_tag('Org: ', 'org')}), '')) AS text
      FROM kwhits k JOIN crow c USING (uri, rid)),
    ff AS (SELECT f.*, """ + ", ".join(
    f"coalesce(CASE WHEN f.vec_rank IS NOT NULL THEN i.{n} ELSE k.{n} END, '') AS {n}"
    for n in ("text", "label", "definition", "country", "year", "scope", "org")
) + """ FROM cut3 f LEFT JOIN idx i ON i.uri = f.uri LEFT JOIN kwf k ON k.qid = f.qid AND k.uri = f.uri)"""
_BOOST = """wanted AS (SELECT qid, unnest([concept, org, scope, continent]) AS v FROM filters),
    wl AS (SELECT qid, lower(v) AS v, lower(label) AS l FROM wanted LEFT JOIN
      (SELECT lower(key) AS key, min(label) AS label FROM inv GROUP BY 1) ON key = lower(v) WHERE v IS NOT NULL),
    hay AS (SELECT qid, uri, lower(concat_ws(' ', label, definition, country, org, scope)) AS t FROM ff),
    matched AS (SELECT hay.qid, uri, count(*) AS m FROM hay JOIN wl ON wl.qid = hay.qid
      AND (contains(t, v) OR contains(t, l)) GROUP BY ALL),
    boosted AS (SELECT ff.* EXCLUDE (rank, rrf_score), round(rrf_score + coalesce(m, 0) * 0.05::DOUBLE, 6) AS rrf_score
      FROM ff LEFT JOIN matched USING (qid, uri))"""
_HYBRID = (
    W.with_sql(
        W.KG_SQL, W.ASK_SQL, W.T3_SQL, W.TS_SQL, _KEYS_SQL, filters_cte("ask"), keywords_cte("ask"),
        _CONCEPT_ROWS, INVENTORY_SQL, scored_cte(36, True), _INDEX, vector_cte("qv", "idxv", 36), _RRF,
        ranked("fused", 36, "cut3"), _FUSED_FIELDS, _BOOST, ranked("boosted", 12, "hits"),
    )
)
_SOURCES = """concat_ws(',', CASE WHEN vec_rank IS NOT NULL THEN 'vector' END,
    CASE WHEN kw_rank IS NOT NULL THEN 'sparql' END)"""


def _labels(spark, d):
    return I.discover_inventory(W.kg_triples(spark, d)).select("key", "label")


@query(
    "R6 R12 Q23",
    _HYBRID + f"""SELECT qid, uri, rank, vec_rank, kw_rank, vector_score, kw_score, rrf_score, text, label, definition,
    country, year, scope, org, {_SOURCES} AS sources FROM hits""",
)
def boosted_hits(spark, d):
    filters = Q.extract_filters(_asked(spark, d))
    hits = P.hybrid_hits(
        filters, W.kg_triples(spark, d), _index(spark, d), V.TOP_K, _labels(spark, d),
        W.concept_postings(spark, d),
    )
    return hits.select(
        "qid", "uri", "rank", "vec_rank", "kw_rank", "vector_score", "kw_score", "rrf_score",
        "text", "label", "definition", "country", "year", "scope", "org",
        F.array_join("sources", ",").alias("sources"),
    )


# -- graph context ----------------------------------------------------------

_PROPS = list(V.NUMERIC_PROPERTIES)
CONTEXT_SQL = f"""glab AS (SELECT s, min(o) AS label FROM kg WHERE p = '{V.PREF_LABEL}' GROUP BY s),
    gpar AS (SELECT s AS uri, o AS parent FROM kg WHERE p = '{V.BROAD_MATCH}'),
    gsib AS (SELECT p.uri, p.parent, b.uri AS child FROM gpar p JOIN gpar b ON b.parent = p.parent AND b.uri <> p.uri
      QUALIFY row_number() OVER (PARTITION BY p.uri, p.parent ORDER BY b.uri) <= 5),
    grel AS (SELECT s AS uri, o FROM kg WHERE p = '{V.RELATED}' QUALIFY row_number() OVER (PARTITION BY s ORDER BY o) <= 3),
    gline AS (SELECT uri, 0 AS a, parent AS b, 0 AS c, 'Parent concept: ' || label AS line FROM gpar JOIN glab ON s = parent
      UNION ALL SELECT uri, 0, parent, 1, 'Related concepts (same category): ' || string_agg(label, ', ' ORDER BY child)
        FROM gsib JOIN glab ON s = child GROUP BY uri, parent
      UNION ALL SELECT uri, 1, '', 0, 'Associated concepts: ' || string_agg(label, ', ' ORDER BY o) FROM grel JOIN glab ON s = o GROUP BY uri
      UNION ALL SELECT s, 2, '', 0, 'Numerical thresholds: ' || string_agg(replace(p, '{V.EX}', '') || ': ' || o, ' | '
        ORDER BY list_position({_PROPS}, replace(p, '{V.EX}', '')), o) FROM kg WHERE replace(p, '{V.EX}', '') IN ({', '.join(f"'{x}'" for x in _PROPS)}) GROUP BY s
      UNION ALL SELECT s, 3, o, 0, 'Exact match (Agrovoc): ' || split_part(o, '/', -1) FROM kg WHERE p = '{V.EXACT_MATCH}'),
    gctx AS (SELECT uri, string_agg(line, chr(10) ORDER BY a, b, c, line) AS graph_context FROM gline GROUP BY uri)"""


@query("R7 J17 W6 A23", W.with_sql(W.KG_SQL, CONTEXT_SQL) + "SELECT * FROM gctx")
def graph_contexts(spark, d):
    triples = W.kg_triples(spark, d)
    return T.graph_context(triples.select(F.col("s").alias("uri")), triples)


# -- thresholds -------------------------------------------------------------

_TS = W.with_sql(W.BASE_SQL, W.T3_SQL, W.TS_SQL, W.NAMES_SQL)
_NKEY = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
LOOKUP_SQL = f"""tk AS (SELECT *, {_NKEY.format('country')} AS key FROM ts),
    nk AS (SELECT DISTINCT name, {_NKEY.format('name')} AS hay FROM names),
    ex AS (SELECT name, hay, tk.* FROM nk JOIN tk ON key = hay),
    fz AS (SELECT name, hay, tk.* FROM nk JOIN tk ON contains(key, hay) OR contains(hay, key)
      WHERE name NOT IN (SELECT name FROM ex)),
    look AS (SELECT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz)
      QUALIFY row_number() OVER (PARTITION BY name, country, is_unfccc ORDER BY pos) = 1)"""


@query("S2 M14", _TS + "SELECT * FROM ts")
def threshold_table(spark, d):
    return threshold_rows(W.thresholds_raw(spark, d))


@query("A22", _TS + "SELECT DISTINCT country FROM ts")
def threshold_countries(spark, d):
    return C.all_countries(threshold_rows(W.thresholds_raw(spark, d)))


_LOOK_COLS = "name, country, is_unfccc, pos, type, area_ha, crown_cover, height_m, width_m, notes, source_row"


@query("R16 F5 J12 W7", _TS.rstrip() + "," + LOOKUP_SQL + f" SELECT {_LOOK_COLS} FROM look")
def threshold_lookup(spark, d):
    return C.thresholds_of(W.names(spark, d), threshold_rows(W.thresholds_raw(spark, d)))


@query(
    "R16 W7",
    _TS.rstrip() + "," + LOOKUP_SQL + " SELECT name, country, pos FROM look WHERE is_unfccc",
)
def threshold_lookup_unfccc(spark, d):
    rows = C.thresholds_of(W.names(spark, d), threshold_rows(W.thresholds_raw(spark, d)), True)
    return rows.select("name", "country", "pos")


@query(
    "F12",
    _TS.rstrip() + "," + LOOKUP_SQL + " SELECT name, country, pos FROM look WHERE crown_cover >= 10 AND area_ha >= 1",
)
def thresholds_reached(spark, d):
    rows = C.search_by_threshold(
        W.names(spark, d), threshold_rows(W.thresholds_raw(spark, d)), crown=10, area=1
    )
    return rows.select("name", "country", "pos")


TEXT_SQL = """tl AS (SELECT name, pos, '  ' || CASE WHEN is_unfccc THEN 'UNFCCC definition' ELSE 'National definition ('
      || CASE WHEN type = '' THEN 'unspecified' ELSE type END || ')' END || ': ' || coalesce(nullif(concat_ws(' | ',
      'min area ' || area_ha || ' ha', 'crown cover ' || crown_cover || '%', 'tree height ' || height_m || ' m',
      'strip width ' || width_m || ' m', CASE WHEN notes <> '' THEN 'note: ' || left(notes, 120) END), ''),
      'no numerical threshold specified') AS line FROM look),
    ttext AS (SELECT name, name || '""" + V.THRESHOLD_CONTEXT_TITLE + """' || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text
      FROM tl GROUP BY name)"""


@query("R17 A23 P36", _TS.rstrip() + "," + LOOKUP_SQL + "," + TEXT_SQL + " SELECT * FROM ttext")
def threshold_contexts(spark, d):
    return C.threshold_context(W.names(spark, d), threshold_rows(W.thresholds_raw(spark, d)))


_BOUND = {k: f"{V.EX}{p}" for k, p in T.PROPERTIES.items()}
CRITERIA_SQL = f"""crit0 AS (SELECT s AS uri, min(o) FILTER (p = '{V.PREF_LABEL}' AND coalesce(lang, '') IN ('en', 'fr', '')) AS label,
      min(o) FILTER (p = '{V.DEFINITION}') AS definition, min(o) FILTER (p = '{V.DATE}') AS year,
      min(o) FILTER (p = '{V.CREATOR}') AS org, """ + ", ".join(
    f"min(o) FILTER (p = '{p}') AS {k}" for k, p in _BOUND.items()
) + f""" FROM kg WHERE s IN (SELECT s FROM kg WHERE p = '{V.TYPE}' AND o = '{V.CONCEPT}') GROUP BY s),
    crit AS (SELECT crit0.*, k.o AS land, CASE WHEN minArea IS NULL THEN 0 ELSE 1 END + CASE WHEN minCrown IS NULL THEN 0 ELSE 1 END
      + CASE WHEN minHeight IS NULL THEN 0 ELSE 1 END + CASE WHEN minWidth IS NULL THEN 0 ELSE 1 END AS richness
      FROM crit0 JOIN kg k ON k.s = crit0.uri AND k.p = '{V.SPATIAL}' WHERE definition IS NOT NULL),
    land AS (SELECT l.s AS land, min(l.o) AS country FROM kg l WHERE l.p = '{V.PREF_LABEL}' AND l.s IN
      (SELECT o FROM kg WHERE p = '{V.MEMBER}' AND s = '{V.COUNTRIES}') GROUP BY l.s)"""
_BOUNDS_TEXT = """definition || coalesce(chr(10) || 'Thresholds: ' || nullif(concat_ws(' | ', 'min area ' || minArea || ' ha',
      '(max ' || maxArea || ' ha)', 'crown cover ' || minCrown || '%', '(max ' || maxCrown || '%)', 'tree height ' || minHeight || ' m',
      '(max ' || maxHeight || ' m)', 'strip width ' || minWidth || ' m', '(max ' || maxWidth || ' m)'), ''), '')"""
COUNTRY_HITS_SQL = f"""chit AS (SELECT name, land FROM (SELECT DISTINCT name FROM names) JOIN land ON lower(country) = lower(name)),
    cany AS (SELECT * FROM chit UNION ALL SELECT name, land FROM (SELECT DISTINCT name FROM names)
      JOIN land ON contains(lower(country), lower(name)) WHERE name NOT IN (SELECT name FROM chit)),
    ct AS (SELECT name, uri, label, definition, {_BOUNDS_TEXT} AS text, country, year, org, least(richness / 4, 1.0::DOUBLE) AS score,
      minArea, minCrown, minHeight, minWidth, cast(richness AS INTEGER) AS richness
      FROM cany JOIN land USING (land) JOIN crit USING (land)
      QUALIFY row_number() OVER (PARTITION BY name, uri ORDER BY country) = 1)"""
_KGN = W.with_sql(W.KG_SQL, W.NAMES_SQL, CRITERIA_SQL)


@query("R8 F5 A16 P34 Q19", _KGN.rstrip() + "," + COUNTRY_HITS_SQL + " SELECT * FROM ct")
def thresholds_by_country(spark, d):
    return T.country_thresholds(W.names(spark, d), W.kg_triples(spark, d))


_CONTINENT_SQL = f"""cc AS (SELECT replace(m.s, '{V.EX}Continent_', '') AS continent, m.o AS land, min(l.o) AS country FROM kg m
      JOIN kg l ON l.s = m.o AND l.p = '{V.PREF_LABEL}' WHERE m.p = '{V.MEMBER}' AND contains(m.s, '/Continent_') GROUP BY ALL),
    cbest AS (SELECT cc.continent, cc.country, crit.* FROM cc JOIN crit USING (land)
      QUALIFY row_number() OVER (PARTITION BY continent, country ORDER BY richness DESC, uri) = 1),
    cont AS (SELECT *, least(richness / 3, 1.0::DOUBLE) AS score, cast(row_number() OVER (PARTITION BY continent ORDER BY richness DESC, country) AS INTEGER) AS rank
      FROM cbest QUALIFY row_number() OVER (PARTITION BY continent ORDER BY richness DESC, country) <= 60)"""


@query("J4 R9", _KGN.rstrip() + "," + _CONTINENT_SQL + " SELECT continent, land AS country_uri, country FROM cc")
def countries_of_continents(spark, d):
    return T.continent_countries(W.kg_triples(spark, d))


@query(
    "R10 A15 A16 Q19",
    _KGN.rstrip() + "," + _CONTINENT_SQL
    + " SELECT continent, country, uri, definition, score, rank, minArea, minCrown FROM cont",
)
def thresholds_by_continent(spark, d):
    rows = T.continent_thresholds(W.kg_triples(spark, d))
    return rows.select(
        "continent", "country", "uri", "definition", "score", "rank", "minArea", "minCrown"
    )


@query(
    "F10",
    _KGN.rstrip() + """ SELECT uri, minCrown, minArea FROM crit WHERE cast(minCrown AS DOUBLE) <= 30 AND cast(minArea AS DOUBLE) >= 4""",
)
def bounded_criteria(spark, d):
    rows = T.criteria(W.kg_triples(spark, d))
    rows = T.apply_threshold(T.apply_threshold(rows, "minCrown", "le", 30.0), "minArea", "ge", 4.0)
    return rows.select("uri", "minCrown", "minArea")


_PASS = """CASE WHEN field IS NULL THEN true ELSE coalesce(CASE op WHEN 'le' THEN bound <= value WHEN 'ge' THEN bound >= value END, false) END"""
_BOUND_CASE = """cast(CASE field WHEN 'minArea' THEN minArea WHEN 'minCrown' THEN minCrown WHEN 'minHeight' THEN minHeight
      WHEN 'minWidth' THEN minWidth END AS DOUBLE)"""


@query(
    "F11 N5",
    W.with_sql(W.KG_SQL, W.ASK_SQL, filters_cte("ask"), CRITERIA_SQL)
    + f"""SELECT qid, uri FROM (SELECT f.qid, crit.uri, field, op, value, {_BOUND_CASE} AS bound FROM filters f
      JOIN land ON contains(f.query, land.country || ' ') JOIN crit USING (land)) WHERE {_PASS}""",
)
def criteria_for_questions(spark, d):
    triples, asked = W.kg_triples(spark, d), W.template_questions(spark, d)
    words = F.explode(F.split("query", " ")).alias("country")
    named = asked.select("qid", words).distinct()
    # a word followed by a space, as the last word of a question carries a mark
    last = asked.select("qid", F.element_at(F.split("query", " "), -1).alias("country"))
    places = named.join(last, ["qid", "country"], "left_anti").join(T.country_names(triples), "country")
    places, rows = places.select("qid", "country_uri"), materialise(T.criteria(triples))
    ranges = materialise(T.stated_ranges(asked).drop("query").join(places, "qid"))
    met = T.criteria_meeting(rows, ranges, ["country_uri"], ["uri", "country_uri"])
    free = places.join(ranges, "qid", "left_anti")  # questions that state no threshold take every row
    return met.select("qid", "uri").union(rows.join(free, "country_uri").select("qid", "uri"))


_ASKED = W.with_sql(W.KG_SQL, W.ASK_SQL, filters_cte("ask"), CRITERIA_SQL)
_FIELDS = "(SELECT DISTINCT uri, minArea, minCrown, minHeight, minWidth, maxArea, maxCrown, maxHeight, maxWidth FROM crit) c"


@query(
    "F10 F11 N5",
    _ASKED + f"""SELECT qid, uri, field, bound FROM (SELECT qid, uri, field, op, value, {_BOUND_CASE} AS bound
      FROM filters, {_FIELDS} WHERE field IS NOT NULL) WHERE CASE op WHEN 'le' THEN bound <= value ELSE bound >= value END""",
)
def criteria_in_stated_ranges(spark, d):
    """The ranges that questions state against every criterion of the graph, whatever its country."""
    rows = T.criteria(W.kg_triples(spark, d)).select("uri", *T.LOWER_BOUNDS).distinct()
    ranges = materialise(T.stated_ranges(W.template_questions(spark, d)).drop("query"))
    return T.criteria_meeting(rows, ranges, [], ["uri"]).select("qid", "uri", "field", "bound")


@query(
    "F10 F11 N5",
    _ASKED + f"""SELECT qid, uri, field, bound, upper FROM (SELECT qid, uri, field, op, value, {_BOUND_CASE} AS bound,
      {_BOUND_CASE.replace('THEN min', 'THEN max')} AS upper FROM filters, {_FIELDS} WHERE field IS NOT NULL)
      WHERE coalesce(bound, upper) IS NOT NULL AND coalesce(bound <= upper, true)
      AND CASE op WHEN 'le' THEN coalesce(bound <= value, true) ELSE coalesce(upper >= value, true) END""",
)
def criteria_overlapping_stated_ranges(spark, d):
    """As above, by the whole range of a criterion, from its lower to its upper bound."""
    rows = T.criteria(W.kg_triples(spark, d)).select("uri", *T.PROPERTIES).distinct()
    ranges = materialise(T.stated_ranges(W.template_questions(spark, d)).drop("query"))
    return T.criteria_overlapping(rows, ranges, ["uri"]).select("qid", "uri", "field", "bound", "upper")


# -- enrichment and complete retrieval --------------------------------------


def enrich_cte(hits: str) -> str:
    """enriched: the hit list of ``hits`` with thresholds, positions in n."""
    words = V.THRESHOLD_WORDS.replace("crit[eè]re", "crit[ex]re")
    cols = "qid, uri, text, label, definition, country, year, scope, org, sources, vec_rank, kw_rank, vector_score, kw_score, rrf_score, graph_context"
    return f"""elig AS (SELECT * FROM filters WHERE regexp_matches({PLAIN.format('query')}, '(?i){words}') OR continent IS NOT NULL),
    {MENTION_SQL.format('(SELECT * FROM elig WHERE continent IS NULL)')},
    regional AS (SELECT qid, country AS name, cast(rank AS BIGINT) AS place FROM (SELECT e.qid, c.country, c.rank, field, op, value,
      {_BOUND_CASE} AS bound FROM elig e JOIN cont c USING (continent)) WHERE {_PASS}),
    ten AS (SELECT qid, country AS name, pos AS place FROM mentioned
      QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos, country) <= 10),
    chosen AS (SELECT * FROM regional UNION ALL SELECT * FROM ten),
    places AS (SELECT * FROM chosen UNION ALL SELECT qid, country, min(rank) FROM {hits} WHERE rank <= 3 AND country <> ''
      AND qid IN (SELECT qid FROM elig) AND qid NOT IN (SELECT qid FROM chosen) GROUP BY qid, country),
    names AS (SELECT DISTINCT name FROM places),
    {COUNTRY_HITS_SQL}, {LOOKUP_SQL}, {TEXT_SQL},
    fresh AS (SELECT p.qid, p.place, ct.* FROM places p JOIN ct USING (name) WHERE (p.qid, ct.uri) NOT IN (SELECT (qid, uri) FROM {hits})
      QUALIFY row_number() OVER (PARTITION BY p.qid, ct.uri ORDER BY p.place, p.name) = 1),
    extra AS (SELECT fresh.qid, fresh.uri, text, coalesce(label, '') AS label, definition, country, coalesce(year, '') AS year,
        'National' AS scope, coalesce(org, '') AS org, CASE WHEN score > 0 THEN 'sparql,threshold' ELSE 'sparql' END AS sources,
        cast(NULL AS INTEGER) AS vec_rank, cast(NULL AS INTEGER) AS kw_rank, 0.0::DOUBLE AS vector_score, score AS kw_score,
        round(0.06::DOUBLE + score * 0.01::DOUBLE, 6) AS rrf_score, coalesce(graph_context, '') AS graph_context,
        1 AS slot, place, -richness AS sub FROM fresh LEFT JOIN gctx ON gctx.uri = fresh.uri
      UNION ALL SELECT p.qid, 'threshold://' || regexp_replace(regexp_replace(lower(p.name), '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g'),
        t.text, p.name || ' forest thresholds', t.text, p.name, '', 'National', '', 'threshold', NULL, NULL, 0, 0, 0.05, t.text, 1, p.place, 0
        FROM places p JOIN ttext t USING (name) WHERE p.name NOT IN (SELECT name FROM ct)),
    every AS (SELECT h.qid, h.uri, text, label, definition, country, year, scope, org, sources, vec_rank, kw_rank, vector_score,
        kw_score, rrf_score, graph_context, CASE WHEN rank = 1 THEN 0 ELSE 2 END AS slot, cast(rank AS BIGINT) AS place, 0 AS sub
        FROM (SELECT * EXCLUDE (graph_context) FROM {hits}) h LEFT JOIN gctx ON gctx.uri = h.uri
      UNION ALL SELECT * FROM extra),
    enriched AS (SELECT {cols}, row_number() OVER (PARTITION BY qid ORDER BY slot, place, sub, uri) AS n FROM every)"""


_ENRICH_BASE = CONTEXT_SQL + "," + CRITERIA_SQL + "," + _CONTINENT_SQL
_FULL = (
    _HYBRID.rstrip() + f""",
    hits2 AS (SELECT *, {_SOURCES} AS sources, NULL AS graph_context FROM hits), """
    + _ENRICH_BASE + "," + enrich_cte("hits2")
)


def _thresholds(spark, d):
    return threshold_rows(W.thresholds_raw(spark, d))


def _flat(hits):
    return hits.withColumn("sources", F.array_join("sources", ","))


@query("R11 R12 J7 L8 N12", _FULL + " SELECT * FROM enriched")
def hybrid_retrieval(spark, d):
    hits = P.hybrid_retrieve(
        _asked(spark, d), W.kg_triples(spark, d), _index(spark, d), _thresholds(spark, d),
        V.TOP_K, _labels(spark, d), W.concept_postings(spark, d),
    )
    return _flat(hits)


_PLANS = """planned AS (SELECT nkey AS qid, 'Which land in ' || nat || ' has an area of canopy?' AS query, plan FROM kgn JOIN texts ON qid = nkey),
    calls AS (SELECT qid, 0 AS call, 'sparql_search' AS tool, '' AS query FROM planned WHERE qid < 8
      UNION ALL SELECT qid, 1, 'vector_search', '' FROM planned WHERE qid < 8
      UNION ALL SELECT qid, 0, 'sparql_search', plan->>'$[0].query' FROM planned WHERE qid >= 8 AND qid < 16
      UNION ALL SELECT qid, 0, 'vector_search', query FROM planned WHERE qid >= 16)"""
def _planned_sql(k: int) -> str:
    return W.with_sql(
        W.KG_SQL, W.T3_SQL, W.TS_SQL, _KEYS_SQL, W.TEXTS_SQL, _PLANS,
        "ask AS (SELECT qid, query FROM planned)", filters_cte("ask"),
        keywords_cte("(SELECT qid, query FROM calls WHERE tool = 'sparql_search')"), _CONCEPT_ROWS,
        scored_cte(k, True), _INDEX, vector_cte("qv", "idxv", k),
    ).rstrip() + f""",
    kwc AS (SELECT c.qid, c.call, k.rank, k.uri, 'Term: ' || coalesce(r.label, '') || ' - ' || r.definition AS text, coalesce(r.label, '') AS label,
      r.definition, coalesce(r.country, '') AS country, coalesce(r.year, '') AS year, coalesce(r.scope, '') AS scope, coalesce(r.org, '') AS org,
      'sparql' AS sources, NULL AS vec_rank, k.rank AS kw_rank, 0.0::DOUBLE AS vector_score, k.score AS kw_score,
      round(1.0::DOUBLE / (60 + k.rank), 6) AS rrf_score FROM kwhits k JOIN crow r USING (uri, rid)
      JOIN calls c ON c.qid = k.qid AND c.tool = 'sparql_search'),
    vall AS (SELECT v.qid, v.rank, v.uri, text, label, definition, country, year, scope, org, 'vector' AS sources, v.rank AS vec_rank,
      NULL AS kw_rank, v.score AS vector_score, 0.0::DOUBLE AS kw_score, 0.0::DOUBLE AS rrf_score FROM vechits v JOIN idx USING (uri)),
    both_ AS (SELECT * FROM kwc UNION ALL BY NAME SELECT vall.*, call FROM vall JOIN calls USING (qid) WHERE tool = 'vector_search'),
    hitsall AS (SELECT * FROM both_ UNION ALL BY NAME SELECT vall.*, 0 AS call FROM vall WHERE qid NOT IN (SELECT qid FROM both_)),
    uniq AS (SELECT * FROM hitsall QUALIFY row_number() OVER (PARTITION BY qid, uri ORDER BY call, rank) = 1),
    hits2 AS (SELECT * EXCLUDE (rank), cast(row_number() OVER (PARTITION BY qid ORDER BY call, rank) AS INTEGER) AS rank,
      NULL AS graph_context FROM uniq QUALIFY row_number() OVER (PARTITION BY qid ORDER BY call, rank) <= {k}),
    """ + _ENRICH_BASE + "," + enrich_cte("hits2")


_PLANNED = _planned_sql(8)


def _planned_questions(spark, d):
    vectors = W.load(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    text = F.expr("'Which land in ' || nat || ' has an area of canopy?'")
    return W.nations(spark, d).select(
        F.col("nkey").cast("long").alias("qid"), text.alias("query")
    ).join(vectors, "qid")


@query("R13 U6 N10 P33", _PLANNED + " SELECT * REPLACE (cast(qid AS BIGINT) AS qid) FROM enriched")
def planned_retrieval(spark, d):
    plans = W.model_texts(spark, d).select(
        F.col("qid").cast("long").alias("qid"), F.col("plan").alias("text")
    )
    return _flat(
        P.planned_retrieve(
            _planned_questions(spark, d), plans, W.kg_triples(spark, d), _index(spark, d),
            _thresholds(spark, d), 8, W.concept_postings(spark, d),
        )
    )


_MODE_ASK = "ask AS (SELECT nkey AS qid, 'Which land in ' || nat || ' has an area of canopy?' AS query FROM kgn WHERE {0})"
_BY_VECTOR = W.with_sql(
    W.KG_SQL, _MODE_ASK.format("nkey BETWEEN 5 AND 11"), _CONCEPT_ROWS, _INDEX, vector_cte("qv", "idxv", 12)
) + "SELECT qid, uri, rank AS n FROM vechits"
_BY_GRAPH = (
    W.with_sql(
        W.KG_SQL, W.T3_SQL, W.TS_SQL, _KEYS_SQL, _MODE_ASK.format("nkey BETWEEN 12 AND 17"), filters_cte("ask"),
        keywords_cte("ask"), _CONCEPT_ROWS, INVENTORY_SQL, scored_cte(36, True), _INDEX, vector_cte("qv", "idxv", 36),
        _RRF, ranked("fused", 36, "cut3"), _FUSED_FIELDS, _BOOST, ranked("boosted", 12, "hits"),
    ).rstrip()
    + f", hits2 AS (SELECT *, {_SOURCES} AS sources, NULL AS graph_context FROM hits), "
    + _ENRICH_BASE + "," + enrich_cte("hits2") + " SELECT qid, uri, n FROM enriched"
)
_BY_PLAN = _planned_sql(12) + " SELECT qid, uri, n FROM enriched WHERE qid >= 18"
_BY_MODE = f"""WITH found AS MATERIALIZED (SELECT * FROM ({_BY_VECTOR}) UNION ALL SELECT * FROM ({_BY_GRAPH})
    UNION ALL SELECT * FROM ({_BY_PLAN})),
  asked AS (SELECT n_nationkey AS qid FROM nation WHERE n_nationkey >= 5)
  SELECT cast(qid AS BIGINT) AS qid, uri, cast(n AS BIGINT) AS n FROM found
  UNION ALL SELECT cast(qid AS BIGINT), '', 0 FROM asked WHERE qid NOT IN (SELECT qid FROM found)"""


@query("R21", _BY_MODE)
def retrieval_by_mode(spark, d):
    """Hits per mode: vectors alone, both searches, or planned calls."""
    mode = F.expr("CASE WHEN qid < 5 THEN 'none' WHEN qid < 12 THEN 'vector' "
                  "WHEN qid < 18 THEN 'graph' ELSE 'planned' END")
    asked = _planned_questions(spark, d).withColumn("mode", mode)
    plans = W.model_texts(spark, d).select(
        F.col("qid").cast("long").alias("qid"), F.col("plan").alias("text")
    )
    hits = materialise(
        P.retrieve(
            asked, plans, W.kg_triples(spark, d), _index(spark, d), _thresholds(spark, d), V.TOP_K,
            _labels(spark, d), W.concept_postings(spark, d),
        )
    )
    missed = P.without_hits(asked, hits).select("qid", F.lit("").alias("uri"), F.lit(0).alias("n"))
    return hits.select("qid", "uri", "n").unionByName(missed)


# -- answers ----------------------------------------------------------------

_ANSWERED = (
    _PLANNED + ", docs AS (SELECT * REPLACE (cast(qid AS BIGINT) AS qid) FROM enriched), "
    "ans AS (SELECT cast(qid AS BIGINT) AS qid, answer FROM texts)"
)


def _answered(spark, d):
    hits = materialise(
        P.planned_retrieve(
            _planned_questions(spark, d),
            W.model_texts(spark, d).select(
                F.col("qid").cast("long").alias("qid"), F.col("plan").alias("text")
            ),
            W.kg_triples(spark, d), _index(spark, d), _thresholds(spark, d), 8,
            W.concept_postings(spark, d),
        )
    )
    answers = W.model_texts(spark, d).select(
        F.col("qid").cast("long").alias("qid"), F.col("answer").alias("text")
    )
    return answers, hits


@query(
    "A19 A20 A21 Q13 Q25",
    _ANSWERED
    + r""", cu AS (SELECT ans.qid, round(len(list_distinct(regexp_extract_all(answer, '\[(\d+)\]', 1))) / n, 3) AS u, n
      FROM ans JOIN (SELECT qid, count(*) AS n FROM docs GROUP BY qid) USING (qid)),
    words AS (SELECT DISTINCT qid, unnest(list_filter(regexp_extract_all(lower(definition), '[\p{L}\p{N}_]+'),
      lambda x: regexp_full_match(x, '[a-z]{5,}'))[1:20]) AS w FROM docs WHERE NOT contains(sources, 'threshold')),
    cov AS (SELECT qid, round(avg(CASE WHEN contains(lower(answer), w) THEN 1.0::DOUBLE ELSE 0 END), 3) AS c
      FROM words JOIN ans USING (qid) GROUP BY qid)
    SELECT ans.qid, coalesce(u, 0) AS context_utilization, coalesce(c, 0) AS answer_coverage, coalesce(n, 0) AS n_docs_retrieved,
      coalesce((SELECT string_agg(DISTINCT country, ',' ORDER BY country) FROM docs WHERE docs.qid = ans.qid AND country <> ''), '') AS sources_used
    FROM ans LEFT JOIN cu USING (qid) LEFT JOIN cov USING (qid)""",
)
def answer_scores(spark, d):
    answers, hits = _answered(spark, d)
    return E.evaluate(answers, hits).withColumn("sources_used", F.array_join("sources_used", ","))


@query(
    "R15 Q25",
    _ANSWERED + " SELECT ans.qid, n, uri, label FROM ans JOIN docs USING (qid) WHERE n IN (1, 2, 3, 9)",
)
def cited_hits(spark, d):
    answers, hits = _answered(spark, d)
    return E.resolve_citations(answers, hits)


@query(
    "R18 R19 P36",
    _ANSWERED
    + """ SELECT qid, n, uri, label, definition, country, year, scope, rrf_score, sources, graph_context,
    CASE WHEN label <> '' THEN label ELSE split_part(uri, '/', -1) END AS title,
    CASE WHEN length(definition) > 160 THEN left(definition, 160) || '…' ELSE definition END AS preview,
    CASE WHEN contains(sources, 'threshold') THEN coalesce(nullif(label, ''), nullif(country, ''), '?') END AS shown FROM docs""",
)
def response_sources(spark, d):
    hits = _answered(spark, d)[1]
    rows = E.to_sources(hits).join(E.source_cards(hits), ["qid", "n"])
    shown = E.threshold_sources(hits).drop("uri")
    return _flat(rows.join(shown, ["qid", "n"], "left"))
