"""Queries over the triples table: patterns, joins, set operations, statistics, roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.catalog import views as W
from thicket.catalog.expressions import _DEPTH_SQL
from thicket.catalog.registry import query
from thicket.functions import text as X
from thicket.operators import stats as A
from thicket.operators import triples as T
from thicket.operators.changes import GraphStore, additions, apply_changes, changes_of, read_graph
from thicket.operators.ordering import first_n
from thicket.plans.build import revise_graph, revise_stored
from thicket.sources import tables as S

KG = W.with_sql(W.KG_SQL)
KP, FAO = V.EX + "Org_KP", V.EX + "Org_FAO"
NATIONAL = V.EX + "Scope_National"


def _p(name: str) -> str:
    return f"p = '{name}'"


@query(
    "F1 F2 F3 F6",
    KG
    + f"""SELECT s, o, lang FROM kg WHERE {_p(V.PREF_LABEL)} AND coalesce(lang, '') IN ('en', '')
    AND starts_with(s, '{V.EX}C_') AND s IN (SELECT s FROM kg WHERE {_p(V.TYPE)} AND o = '{V.CONCEPT}')""",
)
def labelled_concepts(spark, d):
    triples = W.kg_triples(spark, d)
    labels = T.match(T.of_type(triples, V.CONCEPT), p=V.PREF_LABEL)
    return labels.filter(
        T.lang_in("lang", ["en", ""]) & T.iri_startswith("s", V.EX + "C_")
    ).select("s", "o", "lang")


@query(
    "F4",
    KG
    + f"""SELECT s, o FROM kg WHERE {_p(V.DEFINITION)} AND contains(lower(o), lower('TERRE de nation_1'))""",
)
def definitions_containing(spark, d):
    rows = T.match(W.kg_triples(spark, d), p=V.DEFINITION)
    return rows.filter(X.icontains("o", F.lit("TERRE de nation_1"))).select("s", "o")


@query(
    "J1 J4",
    KG
    + f"""SELECT DISTINCT c.s AS concept, m.o AS land, t.o AS top FROM kg m
    JOIN kg c ON c.{_p(V.SPATIAL)} AND c.o = m.o JOIN kg t ON t.{_p(V.BROAD_MATCH)} AND t.s = c.s
    WHERE m.{_p(V.MEMBER)} AND m.s = '{V.EX}Continent_Asia'""",
)
def continent_concepts(spark, d):
    return T.bgp(
        W.kg_triples(spark, d),
        [
            (V.EX + "Continent_Asia", V.MEMBER, "?land"),
            ("?concept", V.SPATIAL, "?land"),
            ("?concept", V.BROAD_MATCH, "?top"),
        ],
    )


@query(
    "J2 J3 F3",
    KG
    + f"""SELECT c.s AS uri, l.o AS label, sp.o AS country_uri, cl.o AS country FROM
    (SELECT DISTINCT s FROM kg WHERE {_p(V.DEFINITION)}) c
    LEFT JOIN kg l ON l.s = c.s AND l.{_p(V.PREF_LABEL)} AND l.lang = 'fr'
    LEFT JOIN kg sp ON sp.s = c.s AND sp.{_p(V.SPATIAL)}
    LEFT JOIN kg cl ON cl.s = sp.o AND cl.{_p(V.PREF_LABEL)} AND coalesce(cl.lang, '') IN ('en', 'fr', '')""",
)
def optional_labels(spark, d):
    triples = W.kg_triples(spark, d)
    concepts = T.match(triples, p=V.DEFINITION).select(F.col("s").alias("uri")).distinct()
    labelled = T.optional(concepts, triples, "uri", V.PREF_LABEL, "label", ["fr"])
    return T.country_label(labelled, triples).select("uri", "label", "country_uri", "country")


@query(
    "J5 U1 U4",
    KG
    + f"""SELECT DISTINCT s AS uri, o AS label FROM kg WHERE {_p(V.PREF_LABEL)} AND s IN
    (SELECT o FROM kg WHERE {_p(V.MEMBER)} AND s IN ('{NATIONAL}', '{KP}'))""",
)
def collection_labels(spark, d):
    triples = W.kg_triples(spark, d)
    labels = T.match(triples, p=V.PREF_LABEL).select(F.col("s").alias("uri"), F.col("o").alias("label"))
    return T.in_collection(labels, T.members(triples), NATIONAL, KP).distinct()


@query(
    "F7 U1",
    KG
    + f""", sc AS (SELECT o AS uri, s FROM kg WHERE {_p(V.MEMBER)} AND s IN ('{NATIONAL}',
    '{V.EX}Scope_International', '{V.EX}Scope_General', '{V.EX}Scope_State'))
    SELECT DISTINCT s AS uri FROM kg WHERE {_p(V.DEFINITION)} AND (s IN (SELECT uri FROM sc WHERE s = '{NATIONAL}')
    OR s NOT IN (SELECT uri FROM sc))""",
)
def national_or_unclassified(spark, d):
    triples = W.kg_triples(spark, d)
    members = T.members(triples)
    concepts = T.match(triples, p=V.DEFINITION).select(F.col("s").alias("uri")).distinct()
    own = members.filter(F.col("coll") == NATIONAL).select("uri", F.lit(True).alias("own"))
    flags = T.any_scope(members).join(own, "uri", "left").withColumn("any", F.lit(True))
    joined = concepts.join(flags, "uri", "left")
    return joined.filter(F.col("own").isNotNull() | F.col("any").isNull()).select("uri")


@query(
    "F8 F9 Q7",
    KG
    + f"""SELECT s AS uri FROM (SELECT DISTINCT s FROM kg WHERE {_p(V.DEFINITION)}) c WHERE
    (s IN (SELECT o FROM kg WHERE {_p(V.MEMBER)} AND s = '{FAO}')
     OR NOT EXISTS (SELECT 1 FROM kg k WHERE k.s = c.s AND k.{_p(V.CREATOR)})
     OR EXISTS (SELECT 1 FROM kg k WHERE k.s = c.s AND k.{_p(V.CREATOR)} AND contains(lower(k.o), 'fao')))
    AND (NOT EXISTS (SELECT 1 FROM kg k WHERE k.s = c.s AND k.{_p(V.BROAD_MATCH)})
     OR EXISTS (SELECT 1 FROM kg k WHERE k.s = c.s AND k.{_p(V.BROAD_MATCH)}
                AND lower(replace(k.o, '{V.EX}', '')) = 'machinery'))""",
)
def org_and_concept_filter(spark, d):
    from thicket.operators.search import concept_filter, org_filter

    rows = T.concept_rows(W.kg_triples(spark, d))
    return rows.filter(
        concept_filter(F.lit("Machinery"), F.col("parents")) & org_filter(F.lit("FAO"))
    ).select("uri").distinct()


@query(
    "J6",
    KG + f"SELECT s, p, o FROM kg WHERE s <> '{KP}' AND NOT (o_kind = 'iri' AND o = '{KP}')",
)
def without_collection(spark, d):
    return T.delete_touching(W.kg_triples(spark, d), KP).select("s", "p", "o")


_TOPS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_TOP_LIST = ", ".join(f"'{V.EX}{t}'" for t in _TOPS)
PARENT = V.EX + "C_500"


@query(
    "J18 U2 U3",
    KG
    + f""", moved AS (SELECT o AS uri FROM kg WHERE {_p(V.MEMBER)} AND s = '{KP}' AND o <> '{PARENT}')
    SELECT s, p, o, o_kind, lang, dtype FROM kg WHERE NOT ({_p(V.BROAD_MATCH)} AND o IN ({_TOP_LIST})
      AND s IN (SELECT uri FROM moved))
    UNION SELECT uri, '{V.BROAD_MATCH}', '{PARENT}', 'iri', NULL, NULL FROM moved""",
)
def reparented_members(spark, d):
    tops = [V.EX + t for t in _TOPS]
    return T.reparent(W.kg_triples(spark, d), KP, tops, PARENT)


@query(
    "U2",
    KG + "SELECT DISTINCT s, p, o, o_kind, lang, dtype FROM kg",
)
def triples_added_twice(spark, d):
    triples = W.kg_triples(spark, d)
    return T.add(triples, triples.filter(F.col("p") == V.MEMBER))


@query(
    "J19",
    KG
    + f""", c AS (SELECT s FROM kg WHERE {_p(V.TYPE)} AND o = '{V.CONCEPT}'),
    pairs AS (SELECT s AS a, o AS b FROM kg WHERE {_p(V.RELATED)} OR {_p(V.EXACT_MATCH)}),
    ok AS (SELECT * FROM pairs WHERE a IN (SELECT s FROM c) AND b IN (SELECT s FROM c))
    SELECT a AS s, b AS o FROM ok UNION SELECT b, a FROM ok""",
)
def symmetric_relations(spark, d):
    triples = W.kg_triples(spark, d)
    pairs = triples.filter(F.col("p").isin(V.RELATED, V.EXACT_MATCH)).select(
        F.col("s").alias("a"), F.col("o").alias("b")
    )
    concepts = T.instances(triples, V.CONCEPT).withColumnRenamed("s", "uri")
    return T.related_links(pairs, concepts).select("s", "o")


_STATS = f"""count(*) AS total_triples,
    count(*) FILTER ({_p(V.TYPE)} AND o = '{V.CONCEPT}') AS total_concepts,
    count(DISTINCT s) FILTER ({_p(V.BROAD_MATCH)}) AS with_broad_match,
    count(*) FILTER ({_p(V.DEFINITION)}) AS with_definition,
    count(DISTINCT s) FILTER ({_p(V.EX + 'minAreaHa')}) AS with_thresholds,
    count(*) FILTER ({_p(V.EXACT_MATCH)} AND starts_with(o, '{V.ALIGN_PREFIX}')) AS agrovoc_aligned"""
_UNFCCC = f"count(*) FILTER ({_p(V.MEMBER)} AND s = '{V.EX}Org_UNFCCC')"
_IS_COLL = f"{_p(V.TYPE)} AND o = '{V.COLLECTION}'"


@query(
    "A1 Q10",
    KG
    + f"""SELECT {_STATS}, count(DISTINCT o) FILTER ({_p(V.SPATIAL)}) AS countries_count,
    count(*) FILTER ({_p(V.BROAD_MATCH)} AND o = '{V.EX}BUILDING') AS unfccc_concepts FROM kg""",
)
def graph_statistics(spark, d):
    return A.graph_stats(W.kg_triples(spark, d), V.EX + "BUILDING")


@query(
    "A2",
    KG
    + f"""SELECT {_STATS}, {_UNFCCC} AS unfccc_concepts, count(*) FILTER ({_p(V.TOP_OF)}) AS top_concepts,
    count(*) FILTER ({_IS_COLL} AND starts_with(s, '{V.EX}Scope_')) AS scope_collections,
    count(*) FILTER ({_IS_COLL} AND starts_with(s, '{V.EX}Type_')) AS type_collections FROM kg""",
)
def build_statistics(spark, d):
    return A.build_stats(W.kg_triples(spark, d))


@query(
    "A3",
    KG
    + f""", st AS (SELECT {_STATS}, {_UNFCCC} AS unfccc_concepts,
    count(*) FILTER ({_p(V.TOP_OF)}) AS top_concepts, count(*) FILTER ({_IS_COLL}) AS collections,
    count(DISTINCT o) FILTER ({_p(V.SPATIAL)}) AS countries FROM kg)
    """
    + " UNION ALL ".join(
        f"SELECT '{label}' AS metric, {name} AS value FROM st"
        for name, label in A.REPORT_LABELS.items()
    ),
)
def statistics_report(spark, d):
    return A.stats_report(W.kg_triples(spark, d))


@query(
    "A17",
    KG
    + rf"""SELECT count(*) FILTER (length(replace(o, '(', '')) <> length(replace(o, ')', ''))) AS parenthesis,
    count(*) FILTER (regexp_matches(o, '(?i)\s+and\s*$')) AS trailing_and FROM kg WHERE {_p(V.DEFINITION)}""",
)
def definition_problems(spark, d):
    return A.definition_issues(W.kg_triples(spark, d))


_FIELD = f"""CASE WHEN contains(p, 'prefLabel') THEN 'label' WHEN contains(p, 'definition') THEN 'definition'
    WHEN contains(p, 'scopeNote') THEN 'scopeNote' WHEN contains(p, 'altLabel') THEN 'altLabel'
    WHEN contains(p, 'spatial') THEN 'country' WHEN contains(p, 'date') THEN 'year'
    WHEN contains(p, 'creator') THEN 'organization' WHEN contains(p, 'source') THEN 'source'
    WHEN contains(p, 'broadMatch') THEN 'broadMatch'
    WHEN regexp_matches(p, 'minArea|maxArea|CrownCover|TreeHeight|StripWidth') THEN replace(p, '{V.EX}', '') END"""


@query(
    "A13 R20",
    KG
    + f""", f AS (SELECT s AS uri, {_FIELD} AS field, o AS value FROM kg),
    lab AS (SELECT s, min(o) AS shown FROM kg WHERE {_p(V.PREF_LABEL)} GROUP BY s),
    one AS (SELECT uri, field, max(value) AS value FROM f WHERE field IN
      ('country', 'year', 'organization', 'broadMatch') GROUP BY ALL)
    SELECT uri, field, value FROM f WHERE field IS NOT NULL AND field NOT IN
      ('country', 'year', 'organization', 'broadMatch')
    UNION ALL SELECT uri, field, CASE WHEN field = 'country' THEN coalesce(shown, value) ELSE value END
    FROM one LEFT JOIN lab ON lab.s = one.value AND field = 'country'""",
)
def concept_details(spark, d):
    return T.concept_detail(W.kg_triples(spark, d))


@query(
    "A14 P31 P32 Q12",
    KG
    + f""", lab AS (SELECT s, coalesce(min(o) FILTER (lang = 'en'), min(o) FILTER (lang = 'fr'),
      min(o) FILTER (lang IS NULL)) AS label FROM kg WHERE {_p(V.PREF_LABEL)} GROUP BY s),
    one AS (SELECT s, min(o) FILTER ({_p(V.DEFINITION)}) AS def, min(o) FILTER ({_p(V.DATE)}) AS year,
      min(o) FILTER ({_p(V.CREATOR)}) AS org, min(o) FILTER ({_p(V.SPATIAL)}) AS land,
      string_agg(DISTINCT o, ', ' ORDER BY o) FILTER ({_p(V.SCOPE_NOTE)}) AS scope FROM kg GROUP BY s),
    doc AS (SELECT one.s AS uri, coalesce(l.label, '') AS label, def AS definition, coalesce(c.label, '') AS country,
      coalesce(year, '') AS year, coalesce(org, '') AS org, coalesce(scope, '') AS scope FROM one
      LEFT JOIN lab l ON l.s = one.s LEFT JOIN lab c ON c.s = one.land WHERE def IS NOT NULL)
    SELECT left(sha1(uri), 16) AS id, uri, label, definition, country, year, org, scope, '' AS parent,
      concat_ws(chr(10), CASE WHEN label <> '' THEN 'Term: ' || label END, 'Definition: ' || definition,
      nullif(concat_ws(' | ', CASE WHEN country <> '' THEN 'Country: ' || country END,
        CASE WHEN year <> '' THEN 'Year: ' || year END,
        CASE WHEN org <> '' THEN 'Organization: ' || org END), ''),
      CASE WHEN scope <> '' THEN 'Scope: ' || scope END) AS text FROM doc""",
)
def search_document_rows(spark, d):
    return T.search_documents(W.kg_triples(spark, d))


_ORD = ", ".join(f"'{p}'" for p in V.LITERAL_ORDER)


@query(
    "L6 P35",
    KG
    + f"""SELECT s AS uri, p AS predicate, o AS value, list_position([{_ORD}], p) - 1 AS ord,
    '"' || o || '"' || CASE WHEN lang IS NOT NULL THEN '@' || lang WHEN dtype IS NOT NULL
      THEN '^^xsd:' || split_part(dtype, '#', -1) ELSE '' END AS shown FROM kg
    WHERE o_kind = 'literal' AND p IN ({_ORD})""",
)
def display_literals(spark, d):
    rows = T.literals(W.kg_triples(spark, d)).withColumn("ord", F.col("ord").cast("int"))
    return rows.select("uri", "predicate", "value", "ord", "shown")


@query(
    "W6",
    KG
    + f"""SELECT s, p, o, rn FROM (SELECT s, p, o, cast(row_number() OVER (PARTITION BY s ORDER BY p, o) AS INTEGER) AS rn
    FROM kg WHERE o_kind = 'literal' AND split_part(p, '#', -1) NOT IN
    ('definition', 'prefLabel', 'altLabel', 'scopeNote', 'note', 'inScheme')) WHERE rn <= 3""",
)
def other_literals(spark, d):
    return T.extra_literals(W.kg_triples(spark, d), 3).select("s", "p", "o", "rn")


@query(
    "W6",
    KG
    + f"""SELECT o AS coll, s AS uri, rn FROM (SELECT s, o, cast(row_number() OVER (PARTITION BY o ORDER BY s) AS INTEGER) AS rn
    FROM kg WHERE {_p(V.BROAD_MATCH)}) WHERE rn <= 5""",
)
def first_children(spark, d):
    rows = T.match(W.kg_triples(spark, d), p=V.BROAD_MATCH).select(
        F.col("o").alias("coll"), F.col("s").alias("uri")
    )
    return first_n(rows, ["coll"], ["uri"], 5).select("coll", "uri", "rn")


_ESC = r"""replace(replace(o, '\', '\\'), '"', '\"')"""


@query(
    "S4",
    KG
    + f"""SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>'
    ELSE '"' || {_ESC} || '"' || CASE WHEN lang IS NOT NULL THEN '@' || lang WHEN dtype IS NOT NULL
    THEN '^^<' || dtype || '>' ELSE '' END END || ' .' AS value FROM kg""",
)
def triple_text_lines(spark, d):
    return S.triple_lines(W.kg_triples(spark, d))


@query("S3", KG + "SELECT s, p, o, o_kind, lang, dtype FROM kg")
def triples_read_back(spark, d):
    """Triples written as text lines and parsed again."""
    return S.parse_triples(S.triple_lines(W.kg_triples(spark, d)))


@query(
    "S3",
    KG
    + f"""SELECT reason, count(*) AS lines FROM (SELECT CASE WHEN {_p(V.PREF_LABEL)} THEN 'no closing dot'
    WHEN {_p(V.DATE)} THEN 'predicate is no IRI' WHEN {_p(V.NOTATION)} THEN 'object does not parse' END AS reason
    FROM kg) WHERE reason IS NOT NULL GROUP BY reason""",
)
def rejected_triple_lines(spark, d):
    """Lines of three predicates damaged in a way of their own, counted by the reason found."""
    value = F.col("value")

    def has(predicate):
        return F.contains(value, F.lit(f" <{predicate}> "))

    damaged = (
        F.when(has(V.PREF_LABEL), F.regexp_replace(value, r" \.$", ""))
        .when(has(V.DATE), F.replace(value, F.lit(f"<{V.DATE}>"), F.lit(V.DATE)))
        .when(has(V.NOTATION), F.regexp_replace(value, r'" \.$', " ."))
        .otherwise(value)
    )
    lines = S.triple_lines(W.kg_triples(spark, d)).select(damaged.alias("value"))
    return S.rejected_lines(lines).groupBy("reason").agg(F.count("*").alias("lines"))


@query(
    "S11",
    W.with_sql(W.KG_SQL)
    + f"""SELECT k.s, '{V.DEFINITION}' AS p, min(lower(e.s) || ' text') AS o FROM kg k
    JOIN kg t ON t.s = k.s AND t.{_p(V.TOP_OF)} JOIN kg e ON e.{_p(V.EXACT_MATCH)} AND e.o = k.o
    WHERE k.{_p(V.EXACT_MATCH)} GROUP BY k.s""",
)
def vocabulary_definitions(spark, d):
    """The alignments' targets, described by a vocabulary derived from the graph itself."""
    triples = W.kg_triples(spark, d)
    aligned = T.match(triples, p=V.EXACT_MATCH)
    node = F.concat(F.lit("_:"), F.md5("s"))
    none = F.lit(None).cast("string")
    links = aligned.select(
        F.col("o").alias("s"), F.lit(V.DEFINITION).alias("p"), node.alias("o"),
        F.lit("iri").alias("o_kind"), none.alias("lang"), none.alias("dtype"),
    )
    spoken = F.explode(F.array(F.lit("en-GB"), F.lit("fr"))).alias("lang")
    texts = aligned.select(node.alias("s"), "s", spoken).toDF("s", "own", "lang").select(
        "s", F.lit(V.RDF + "value").alias("p"),
        F.when(F.col("lang") == "fr", F.lit("aa")).otherwise(
            F.concat(F.lower("own"), F.lit(" text"))
        ).alias("o"),
        F.lit("literal").alias("o_kind"), "lang", none.alias("dtype"),
    )
    return S.enrich_from_vocab(triples, links.unionByName(texts)).select("s", "p", "o")


_REVISED = (
    KG
    + f""", moved AS (SELECT o AS uri FROM kg WHERE {_p(V.MEMBER)} AND s = '{KP}' AND o <> '{PARENT}'),
    r1 AS (SELECT s, p, o, o_kind, lang, dtype FROM kg WHERE NOT ({_p(V.BROAD_MATCH)} AND o IN ({_TOP_LIST})
      AND s IN (SELECT uri FROM moved))
      UNION SELECT uri, '{V.BROAD_MATCH}', '{PARENT}', 'iri', NULL, NULL FROM moved),
    r2 AS (SELECT * FROM r1 WHERE s <> '{KP}' AND NOT (o_kind = 'iri' AND o = '{KP}')
      AND NOT (s = '{V.EX}MACHINERY' AND p IN ('{V.DEFINITION}', '{V.EXACT_MATCH}'))),
    r3 AS (SELECT * FROM r2
      UNION SELECT '{V.EX}MACHINERY', '{V.DEFINITION}', '{V.REVISED_FOREST_DEFINITION}', 'literal', 'en', NULL
      UNION SELECT '{V.EX}MACHINERY', '{V.SOURCE}', '{V.REVISED_FOREST_SOURCE}', 'literal', NULL, '{V.ANY_URI}'),
    src AS (SELECT DISTINCT o AS id, o AS t FROM r3 WHERE {_p(V.DEFINITION)}),
    """
    + _DEPTH_SQL
    + f"""SELECT DISTINCT s, p, CASE WHEN {_p(V.DEFINITION)} THEN CASE WHEN done.c = '' THEN o ELSE done.c END
      ELSE o END AS o, o_kind, lang, dtype FROM (SELECT r3.s, r3.p, r3.o, r3.o_kind, r3.lang, r3.dtype, done.c
      FROM r3 LEFT JOIN done ON r3.{_p(V.DEFINITION)} AND done.id = r3.o) done"""
)
_REVISION = {"coll": KP, "parent": PARENT, "concept": V.EX + "MACHINERY", "tops": [V.EX + t for t in _TOPS]}


@query("G11 J18 J6 U3", _REVISED)
def revised_graph(spark, d):
    return revise_graph(W.kg_triples(spark, d), **_REVISION)


def _revised_store(spark, d):
    def write(path):
        apply_changes(GraphStore(path), additions(W.kg_triples(spark, d)), 0)
        revise_stored(spark, GraphStore(path), 1, **_REVISION)

    return GraphStore(W.stored_once(spark, d, "graph-versions", write))


@query("G11 U3 G10", _REVISED)
def revised_by_changes(spark, d):
    return read_graph(spark, _revised_store(spark, d))


@query("U2 U3", KG + "SELECT DISTINCT s, p, o, o_kind, lang, dtype FROM kg")
def graph_before_changes(spark, d):
    return read_graph(spark, _revised_store(spark, d), 0)


@query(
    "G11 U2 U3",
    f"""WITH rev AS ({_REVISED}), kgs AS ({KG} SELECT s, p, o, o_kind, lang, dtype FROM kg)
    SELECT *, 'add' AS change FROM (FROM rev EXCEPT FROM kgs)
    UNION ALL SELECT *, 'remove' AS change FROM (FROM kgs EXCEPT FROM rev)""",
)
def changed_triples(spark, d):
    return changes_of(spark, _revised_store(spark, d), 0)
