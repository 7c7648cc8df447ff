"""Queries over nodes and edges: sub-graphs, facets, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.catalog import views as W
from thicket.catalog.registry import query
from thicket.operators import graph as G
from thicket.operators.stats import row_count
from thicket.operators.triples import members

_STRUCT = ", ".join(f"'{V.SKOS}{t}'" for t in V.STRUCTURAL_TYPES)
EDGE_SQL = f"""edges AS (SELECT DISTINCT s AS src, o AS dst, split_part(p, '#', -1) AS type FROM kg
    WHERE p IN ({_STRUCT}) AND o_kind = 'iri' AND s <> o)"""
_FRAG = (
    "CASE WHEN starts_with({0}, '" + V.EX + "') THEN 'ex:' || replace({0}, '" + V.EX + "', '') "
    "WHEN contains({0}, '#') THEN split_part({0}, '#', -1) ELSE split_part({0}, '/', -1) END"
)
NODE_SQL = f"""tops AS (SELECT s AS uri FROM kg WHERE p = '{V.TOP_OF}'
    UNION SELECT o FROM kg WHERE p = '{V.HAS_TOP}'),
ids AS (SELECT s AS uri FROM kg UNION SELECT o FROM kg WHERE o_kind = 'iri' AND p IN ({_STRUCT}, '{V.SPATIAL}')),
lab AS (SELECT s AS uri, coalesce(max(o) FILTER (p = '{V.PREF_LABEL}' AND coalesce(lang, 'en') = 'en'),
      min(o) FILTER (p = '{V.PREF_LABEL}' AND coalesce(lang, 'en') <> 'en')) AS pref,
    min(o) FILTER (p = '{V.ALT_LABEL}') AS alt,
    count(*) FILTER (p = '{V.DEFINITION}') AS definitions, max(o) FILTER (p = '{V.DATE}') AS year,
    max(o) FILTER (p = '{V.CREATOR}') AS creator, max(o) FILTER (p = '{V.SPATIAL}') AS land,
    bool_or(p = '{V.TYPE}' AND o = '{V.SCHEME_CLASS}') AS is_scheme,
    bool_or(p = '{V.TYPE}' AND o = '{V.COLLECTION}') AS is_coll,
    bool_or(p = '{V.TYPE}' AND o = '{V.CONCEPT}') AS is_concept,
    max(o) FILTER (p = '{V.BROAD_MATCH}' AND o IN (SELECT uri FROM tops)) AS top_uri FROM kg GROUP BY s),
nodes AS (SELECT ids.uri, coalesce(l.pref, l.alt, {_FRAG.format('ids.uri')}) AS label,
    {_FRAG.format('ids.uri')} AS short_id,
    CASE WHEN l.is_scheme THEN 'scheme' WHEN l.is_coll THEN 'collection'
      WHEN ids.uri IN (SELECT uri FROM tops) THEN 'topConcept' WHEN l.is_concept THEN 'concept'
      ELSE 'resource' END AS kind, l.top_uri, t.pref AS top_label, c.pref AS country, l.year, l.creator,
    coalesce(l.definitions, 0) AS definitions
    FROM ids LEFT JOIN lab l ON l.uri = ids.uri LEFT JOIN lab c ON c.uri = l.land
    LEFT JOIN lab t ON t.uri = l.top_uri)"""
E = W.with_sql(W.KG_SQL, EDGE_SQL)
N = W.with_sql(W.KG_SQL, EDGE_SQL, NODE_SQL)
IS_CONCEPT = "kind IN ('concept', 'topConcept')"


def _edges(spark, d):
    return G.build_edges(W.kg_triples(spark, d))


def _nodes(spark, d):
    return G.build_nodes(W.kg_triples(spark, d))


@query("V2 M7", E + "SELECT src, dst, type FROM edges")
def graph_edges(spark, d):
    return _edges(spark, d)


@query("V1 V3 Q11", N + "SELECT * FROM nodes")
def graph_nodes(spark, d):
    return _nodes(spark, d)


@query("A12", E + "SELECT uri, count(*) AS degree FROM (SELECT src AS uri FROM edges UNION ALL SELECT dst FROM edges) GROUP BY uri")
def node_degrees(spark, d):
    return G.degree(_edges(spark, d))


@query("V13", E + "SELECT src AS uri, dst AS peer FROM edges UNION SELECT dst, src FROM edges")
def neighbour_pairs(spark, d):
    return G.adjacency(_edges(spark, d))


_INSIDE = f"SELECT uri FROM nodes WHERE kind = 'topConcept' OR year = '1995'"


@query(
    "F15",
    N + f"SELECT * FROM edges WHERE src IN ({_INSIDE}) AND dst IN ({_INSIDE})",
)
def induced_edges(spark, d):
    nodes = _nodes(spark, d).filter((F.col("kind") == "topConcept") | (F.col("year") == "1995"))
    return G.edges_between(_edges(spark, d), nodes)


@query(
    "V4 U8 Q16",
    N
    + """SELECT min(src) AS src, arg_min(dst, src) AS dst, type FROM edges
    WHERE src IN (SELECT uri FROM nodes WHERE kind = 'topConcept')
    AND dst IN (SELECT uri FROM nodes WHERE kind = 'topConcept')
    GROUP BY least(src, dst), greatest(src, dst), type""",
)
def top_level_edges(spark, d):
    return G.top_edges(_edges(spark, d), _nodes(spark, d))


@query(
    "V5",
    N
    + """, kids AS (SELECT top_uri AS parent, uri, 0 AS via FROM nodes WHERE top_uri IS NOT NULL
    UNION ALL SELECT dst, src, 1 FROM edges WHERE type IN ('broader', 'narrower')),
    one AS (SELECT parent, uri, min(via) AS via FROM kids WHERE parent IN
      (SELECT uri FROM nodes WHERE kind = 'topConcept') GROUP BY ALL)
    SELECT parent, uri FROM one QUALIFY row_number() OVER (PARTITION BY parent ORDER BY via, uri) <= 60""",
)
def children_of_tops(spark, d):
    nodes = _nodes(spark, d)
    tops = nodes.filter(F.col("kind") == "topConcept")
    return G.children(nodes, _edges(spark, d), tops).select("parent", "uri")


@query(
    "V6",
    N
    + """, one AS (SELECT top_uri AS parent, uri FROM nodes WHERE top_uri IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY top_uri ORDER BY uri) <= 40),
    inside AS (SELECT * FROM one UNION ALL SELECT uri, uri FROM nodes WHERE kind = 'topConcept')
    SELECT a.parent, src, dst, type FROM edges JOIN inside a ON a.uri = src
    JOIN inside b ON b.uri = dst AND b.parent = a.parent""",
)
def children_with_edges(spark, d):
    nodes = _nodes(spark, d)
    tops = nodes.filter(F.col("kind") == "topConcept")
    return G.children_subgraph(nodes, _edges(spark, d), tops)


_HUBS = "SELECT uri FROM nodes WHERE kind = 'topConcept' OR country = 'NATION_3'"


def _hubs(nodes):
    return nodes.filter((F.col("kind") == "topConcept") | (F.col("country") == "NATION_3"))


@query(
    "V7 J16",
    N
    + f"""SELECT src AS uri, dst AS peer, type, 'out' AS direction FROM edges WHERE src IN ({_HUBS})
    UNION ALL SELECT dst, src, type, 'in' FROM edges WHERE dst IN ({_HUBS})""",
)
def neighbourhoods(spark, d):
    return G.neighbors(_edges(spark, d), _hubs(_nodes(spark, d)))


@query(
    "V8 P36",
    N
    + f"""SELECT src AS uri, dst AS target, type, 'out' AS direction, NULL AS label FROM edges WHERE src IN ({_HUBS})
    UNION ALL SELECT dst, src, type, 'in', NULL FROM edges WHERE dst IN ({_HUBS})
    UNION ALL SELECT s, CASE WHEN p = '{V.DEFINITION}' AND length(o) > 50 THEN left(o, 49) || '…'
      WHEN p <> '{V.DEFINITION}' AND length(o) > 35 THEN left(o, 34) || '…' ELSE o END, 'other', 'out',
      CASE p """
    + " ".join(f"WHEN '{p}' THEN '{n}'" for p, n in V.EXPANDED_LITERALS.items())
    + f""" END FROM kg WHERE o_kind = 'literal' AND s IN ({_HUBS}) AND p IN ("""
    + ", ".join(f"'{p}'" for p in V.EXPANDED_LITERALS)
    + ")",
)
def neighbourhoods_with_literals(spark, d):
    triples = W.kg_triples(spark, d)
    return G.expand_with_literals(triples, G.build_edges(triples), _hubs(G.build_nodes(triples)))


@query(
    "V14 W5",
    N
    + f""", r AS (SELECT src AS uri, type, dst AS peer, 'out' AS direction FROM edges
      UNION ALL SELECT dst, type, src, 'in' FROM edges),
    u AS (SELECT uri, type, peer, max(direction) AS direction FROM r GROUP BY ALL)
    SELECT uri, type, peer, direction, cast(row_number() OVER (PARTITION BY uri ORDER BY type, peer) AS INTEGER) AS rn,
      count(*) OVER (PARTITION BY uri) AS total FROM u
    QUALIFY row_number() OVER (PARTITION BY uri ORDER BY type, peer) <= 8""",
)
def relation_panels(spark, d):
    return G.relations(_edges(spark, d), _nodes(spark, d))


@query(
    "W5",
    N
    + f""", r AS (SELECT src AS uri, type, dst AS peer FROM edges UNION SELECT dst, type, src FROM edges),
    u AS (SELECT * FROM r WHERE type IN ({", ".join(f"'{t}'" for t in V.DETAIL_RELATION_TYPES)}) AND uri IN ({_HUBS}))
    SELECT uri, type, peer, count(*) OVER (PARTITION BY uri) AS total FROM u
    QUALIFY row_number() OVER (PARTITION BY uri ORDER BY type, peer) <= 6""",
)
def detail_relations(spark, d):
    rows = G.relations(
        _edges(spark, d), _hubs(_nodes(spark, d)), 6, V.DETAIL_RELATION_TYPES
    )
    return rows.select("uri", "type", "peer", "total")


@query(
    "U7",
    N
    + """SELECT uri, kind FROM nodes WHERE kind IN ('topConcept', 'scheme')
    UNION SELECT n.uri, n.kind FROM nodes n JOIN edges ON dst = n.uri AND type = 'related'""",
)
def expanded_view(spark, d):
    nodes, edges = _nodes(spark, d), _edges(spark, d)
    visible = nodes.filter(F.col("kind").isin("topConcept", "scheme")).select("uri", "kind")
    targets = edges.filter(F.col("type") == "related").select(F.col("dst").alias("uri"))
    return G.expand(visible, nodes.select("uri", "kind").join(targets, "uri"), ["uri"])


_FACET = f"""SELECT uri, label FROM nodes WHERE {IS_CONCEPT}
    AND (top_uri = '{V.EX}MACHINERY' OR uri = '{V.EX}MACHINERY')
    AND uri IN (SELECT dst FROM edges WHERE type = 'member' AND src = '{V.EX}Org_FAO')
    AND (contains(lower(label), '#00000') OR contains(lower(short_id), '#00000'))"""


@query("F13 J5", N + _FACET)
def faceted_concepts(spark, d):
    triples = W.kg_triples(spark, d)
    found = G.filter_concepts(
        G.build_nodes(triples), members(triples), category=V.EX + "MACHINERY",
        org=V.EX + "Org_FAO", query="#00000",
    )
    return found.select("uri", "label")


@query(
    "F13 L7",
    N + f"SELECT uri FROM nodes WHERE {IS_CONCEPT} AND country = 'NATION_7' AND year = '1997' ORDER BY uri LIMIT 40",
)
def faceted_concepts_limited(spark, d):
    triples = W.kg_triples(spark, d)
    found = G.filter_concepts(
        G.build_nodes(triples), members(triples), 40, country="NATION_7", year="1997"
    )
    return found.select("uri")


@query(
    "V10",
    N
    + f""", hit AS (SELECT uri FROM nodes WHERE {IS_CONCEPT} AND uri IN (SELECT dst FROM edges
      WHERE type = 'member' AND src = '{V.EX}Scope_International') ORDER BY uri LIMIT 60)
    SELECT 'node' AS part, uri AS a, '' AS b FROM hit UNION ALL SELECT type, src, dst FROM edges
    WHERE src IN (SELECT uri FROM hit) AND dst IN (SELECT uri FROM hit)""",
)
def filtered_view(spark, d):
    triples = W.kg_triples(spark, d)
    nodes, edges = G.filtered_subgraph(
        G.build_nodes(triples), G.build_edges(triples), members(triples),
        scope=V.EX + "Scope_International",
    )
    rows = nodes.select(F.lit("node").alias("part"), F.col("uri").alias("a"), F.lit("").alias("b"))
    return rows.unionByName(
        edges.select(F.col("type").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    )


@query(
    "V10",
    N
    + """SELECT 'node' AS part, uri AS a, '' AS b FROM nodes WHERE kind IN ('scheme', 'topConcept')
    UNION ALL SELECT type, min(src), arg_min(dst, src) FROM edges
    WHERE src IN (SELECT uri FROM nodes WHERE kind = 'topConcept')
    AND dst IN (SELECT uri FROM nodes WHERE kind = 'topConcept')
    GROUP BY least(src, dst), greatest(src, dst), type""",
)
def default_view(spark, d):
    triples = W.kg_triples(spark, d)
    nodes, edges = G.filtered_subgraph(
        G.build_nodes(triples), G.build_edges(triples), members(triples), country="Nowhere"
    )
    rows = nodes.select(F.lit("node").alias("part"), F.col("uri").alias("a"), F.lit("").alias("b"))
    return rows.unionByName(
        edges.select(F.col("type").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    )


@query(
    "V11",
    N
    + f""", c AS (SELECT * FROM nodes WHERE {IS_CONCEPT}),
    bars AS (SELECT 'category' AS facet, top_uri AS value, uri, label FROM c WHERE top_uri IS NOT NULL
      UNION SELECT 'category', uri, uri, label FROM c WHERE kind = 'topConcept'
      UNION SELECT 'country', country, uri, label FROM c WHERE country IS NOT NULL
      UNION SELECT 'year', year, uri, label FROM c WHERE year IS NOT NULL
      UNION SELECT CASE WHEN contains(src, '/Org_') THEN 'org' ELSE 'scope' END, src, c.uri, label
        FROM edges JOIN c ON c.uri = dst WHERE type = 'member' AND regexp_matches(src, '/(Org|Scope|Type)_'))
    SELECT facet, value, uri, label FROM bars
    QUALIFY row_number() OVER (PARTITION BY facet, value ORDER BY uri) <= 60""",
)
def drill_down_lists(spark, d):
    triples = W.kg_triples(spark, d)
    rows = G.drill_down(G.build_nodes(triples), members(triples))
    return rows.select("facet", "value", "uri", "label")


@query(
    "V9 F4",
    N
    + f""", asked AS (SELECT DISTINCT lower(n_name) AS query FROM nation UNION SELECT 'client ' || n_nationkey FROM nation
      UNION SELECT '#00000000' || n_nationkey FROM nation),
    hay AS (SELECT DISTINCT s AS uri, lower(o) AS t FROM kg WHERE p IN ('{V.PREF_LABEL}', '{V.ALT_LABEL}'))
    SELECT query, uri FROM (SELECT DISTINCT query, uri FROM asked JOIN hay ON contains(t, query))
    QUALIFY row_number() OVER (PARTITION BY query ORDER BY uri) <= 20""",
)
def label_search(spark, d):
    spelled = F.expr(
        "explode(array(lower(n_name), 'client ' || n_nationkey, '#00000000' || n_nationkey))"
    )
    asked = W.load(spark, d, "nation").select(spelled.alias("query")).distinct()
    return G.search_labels(W.kg_triples(spark, d), asked).select("query", "uri")


_SIMPLE = ", ".join(f"'{V.SKOS}{t}'" for t in V.SIMPLE_GRAPH_TYPES)


@query(
    "V12",
    W.with_sql(W.KG_SQL)
    + f""", e AS (SELECT s AS src, o AS dst FROM kg WHERE p IN ({_SIMPLE}) AND o_kind = 'iri' AND s <> o),
    deg AS (SELECT uri, count(*) AS degree FROM (SELECT src AS uri FROM e UNION ALL SELECT dst FROM e) GROUP BY uri),
    k AS (SELECT s AS uri, max(CASE o WHEN '{V.CONCEPT}' THEN 1 WHEN '{V.SCHEME_CLASS}' THEN 2 END)
      FILTER (p = '{V.TYPE}') AS k, max(o) FILTER (p = '{V.PREF_LABEL}') AS label FROM kg
      WHERE p = '{V.PREF_LABEL}' OR (p = '{V.TYPE}' AND o IN ('{V.CONCEPT}', '{V.SCHEME_CLASS}')) GROUP BY s)
    SELECT uri, coalesce(label, replace(split_part(uri, '#', -1), '_', ' ')) AS label,
      CASE k WHEN 1 THEN 'concept' WHEN 2 THEN 'scheme' ELSE 'resource' END AS kind,
      coalesce(degree, 0) AS degree FROM k FULL JOIN deg USING (uri)""",
)
def simple_graph_nodes(spark, d):
    return G.simple_graph(W.kg_triples(spark, d))[0]


@query(
    "A4",
    N
    + """SELECT t.uri, t.label, count(c.uri) AS n FROM nodes t LEFT JOIN nodes c ON c.top_uri = t.uri
    WHERE t.kind = 'topConcept' GROUP BY ALL""",
)
def concepts_by_category(spark, d):
    return G.by_category(_nodes(spark, d))


@query("A5", E + "SELECT type, count(*) AS n FROM edges GROUP BY type")
def edges_by_type(spark, d):
    return G.by_edge_type(_edges(spark, d))


@query(
    "A6",
    N
    + f"""SELECT count(*) FILTER ({IS_CONCEPT}) AS concepts, (SELECT count(*) FROM edges) AS edges,
    count(*) FILTER (kind = 'topConcept') AS top_concepts, count(*) FILTER (kind = 'collection') AS collections
    FROM nodes""",
)
def graph_totals(spark, d):
    return G.totals(_nodes(spark, d), _edges(spark, d))


_COLL_LABEL = "CASE replace(c.uri, '" + V.EX + "', '') " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in V.COLLECTION_LABELS.items()
) + " END"


@query(
    "A7",
    N
    + f"""SELECT c.uri, replace(c.uri, '{V.EX}', '') AS key, {_COLL_LABEL} AS label, count(dst) AS n FROM nodes c
    LEFT JOIN edges ON src = c.uri AND type = 'member'
    WHERE kind = 'collection' AND regexp_matches(c.uri, '/(Scope|Type|Org)_') GROUP BY ALL""",
)
def sizes_of_collections(spark, d):
    return G.collection_sizes(_nodes(spark, d), _edges(spark, d), ("Scope_", "Type_", "Org_"))


@query(
    "A8",
    N
    + f"""SELECT 'country' AS facet, country AS value, count(*) AS n FROM nodes WHERE {IS_CONCEPT} AND country IS NOT NULL
    GROUP BY country UNION ALL SELECT 'year', year, count(*) FROM nodes WHERE {IS_CONCEPT} AND year IS NOT NULL GROUP BY year""",
)
def concepts_by_country_and_year(spark, d):
    nodes = _nodes(spark, d)
    by_country = G.by_country(nodes).select(
        F.lit("country").alias("facet"), F.col("country").alias("value"), "n"
    )
    by_year = G.by_year(nodes).select(F.lit("year").alias("facet"), F.col("year").alias("value"), "n")
    return by_country.unionByName(by_year)


@query(
    "A9",
    N
    + f""", t AS (SELECT count(*) AS total, count(*) FILTER (definitions > 0) AS d,
      count(country) AS c, count(year) AS y FROM nodes WHERE {IS_CONCEPT})
    SELECT 'definition' AS quality, d AS n, cast(round(d * 100.0 / total) AS BIGINT) AS pct FROM t
    UNION ALL SELECT 'country', c, cast(round(c * 100.0 / total) AS BIGINT) FROM t
    UNION ALL SELECT 'year', y, cast(round(y * 100.0 / total) AS BIGINT) FROM t""",
)
def coverage_quality(spark, d):
    return G.coverage(_nodes(spark, d))


@query(
    "A10 A11",
    N
    + f"""SELECT 'span' AS what, min(year) || '-' || max(year) AS value FROM nodes WHERE {IS_CONCEPT}
    UNION ALL SELECT DISTINCT 'year', year FROM nodes WHERE year IS NOT NULL
    UNION ALL SELECT DISTINCT 'country', country FROM nodes WHERE country IS NOT NULL
    UNION ALL SELECT DISTINCT 'creator', creator FROM nodes WHERE creator IS NOT NULL""",
)
def facet_values(spark, d):
    nodes = _nodes(spark, d)
    rows = G.year_span(nodes).select(
        F.lit("span").alias("what"), F.concat_ws("-", "lo", "hi").alias("value")
    )
    for name in ("year", "country", "creator"):
        values = G.distinct_values(nodes, name)
        rows = rows.unionByName(values.select(F.lit(name).alias("what"), F.col(name).alias("value")))
    return rows


@query(
    "F14 Q20",
    N
    + f"""SELECT year, count(*) AS n FROM nodes WHERE {IS_CONCEPT} AND year BETWEEN '1993' AND '2003' GROUP BY year""",
)
def years_in_range(spark, d):
    return G.year_between(G.by_year(_nodes(spark, d)), "1993", "2003")


@query(
    "L5 A12",
    N
    + f"""SELECT uri, label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN (SELECT uri, count(*) AS degree
      FROM (SELECT src AS uri FROM edges UNION ALL SELECT dst FROM edges) GROUP BY uri) USING (uri)
    WHERE {IS_CONCEPT} ORDER BY degree DESC, uri LIMIT 15""",
)
def best_connected(spark, d):
    return G.top_degree(_nodes(spark, d), _edges(spark, d))


@query("A24", W.with_sql(W.KG_SQL) + "SELECT count(*) AS n FROM kg")
def stored_rows(spark, d):
    return row_count(W.kg_triples(spark, d))
