"""Nodes, edges, facets and statistics of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import text as X
from thicket.operators.containment import contained_in
from thicket.operators.ordering import first_n
from thicket.operators.triples import match

# -- nodes and edges --------------------------------------------------------


def build_edges(triples: DataFrame) -> DataFrame:
    """V2: distinct (src, dst, type) of the structural predicates, no self loops."""
    structural = [V.SKOS + t for t in V.STRUCTURAL_TYPES]
    rows = triples.filter(
        F.col("p").isin(structural) & (F.col("o_kind") == "iri") & (F.col("s") != F.col("o"))
    )
    return rows.select(
        F.col("s").alias("src"), F.col("o").alias("dst"), X.edge_type("p").alias("type")
    ).distinct()


def top_nodes(triples: DataFrame) -> DataFrame:
    """V3: subjects of topConceptOf and objects of hasTopConcept."""
    subjects = match(triples, p=V.TOP_OF).select(F.col("s").alias("uri"))
    objects = match(triples, p=V.HAS_TOP).select(F.col("o").alias("uri"))
    return subjects.unionByName(objects).distinct()


def schemes(triples: DataFrame) -> DataFrame:
    return match(triples, p=V.TYPE, o=V.SCHEME_CLASS).select(F.col("s").alias("uri")).distinct()


def degree(edges: DataFrame) -> DataFrame:
    """Edges touching each node."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uri"))
    return ends.groupBy("uri").agg(F.count("*").alias("degree"))


def _first_label(facts: DataFrame) -> Column:
    return F.coalesce("pref_en", "pref_other", "alt")


def build_nodes(triples: DataFrame) -> DataFrame:
    """V1: one row per subject or linked resource.

    Kind by precedence scheme, collection, top concept, concept, resource. Of
    several values the last in text order counts, for labels the last English or
    untagged one and otherwise the first. Only scalars are aggregated.
    """
    literal = F.col("o_kind") == "literal"
    english = (F.coalesce("lang", F.lit("")).isin("en", "")) & (F.col("o") != "")
    cls = F.when(F.col("p") == V.TYPE, F.col("o"))

    def lit_of(p: str) -> Column:
        return F.when(literal & (F.col("p") == p), F.col("o"))

    structural = [V.SKOS + t for t in V.STRUCTURAL_TYPES]
    linked = triples.filter(
        ~literal & (F.col("p").isin(structural) | (F.col("p") == V.SPATIAL))
    ).select(F.col("o").alias("s"))
    facts = triples.select("s", "p", "o", "o_kind", "lang").unionByName(
        linked, allowMissingColumns=True
    )
    pref = lit_of(V.PREF_LABEL)
    raw = facts.groupBy(F.col("s").alias("uri")).agg(
        F.max(cls == V.SCHEME_CLASS).alias("is_scheme"),
        F.max(cls == V.COLLECTION).alias("is_collection"),
        F.max(cls == V.CONCEPT).alias("is_concept"),
        F.max(F.when(english, pref)).alias("pref_en"),
        F.min(F.when(~english & (F.col("o") != ""), pref)).alias("pref_other"),
        F.min(F.when(F.col("o") != "", lit_of(V.ALT_LABEL))).alias("alt"),
        F.count(lit_of(V.DEFINITION)).alias("definitions"),
        F.max(lit_of(V.SPATIAL)).alias("country_text"),
        F.max(F.when(~literal & (F.col("p") == V.SPATIAL), F.col("o"))).alias("country_uri"),
        F.max(lit_of(V.DATE)).alias("year"),
        F.max(lit_of(V.CREATOR)).alias("creator"),
    )
    tops = top_nodes(triples)
    parents = (
        match(triples, p=V.BROAD_MATCH)
        .join(tops.withColumnRenamed("uri", "o"), "o", "left_semi")
        .groupBy(F.col("s").alias("uri"))
        .agg(F.max("o").alias("top_uri"))
    )
    spatial = match(triples, p=V.SPATIAL).select(F.col("o").alias("s")).distinct()
    names = _labels(triples.join(spatial, "s", "left_semi"), pref_only=True).select(
        F.col("uri").alias("country_uri"), F.col("label").alias("country_name")
    )
    top_names = _labels(
        triples.join(tops.withColumnRenamed("uri", "s"), "s", "left_semi")
    ).select(F.col("uri").alias("top_uri"), F.col("label").alias("top_name"))
    kind = (
        F.when(F.col("is_scheme"), F.lit("scheme"))
        .when(F.col("is_collection"), F.lit("collection"))
        .when(F.col("is_top"), F.lit("topConcept"))
        .when(F.col("is_concept"), F.lit("concept"))
        .otherwise(F.lit("resource"))
    )
    return (
        raw.join(tops.withColumn("is_top", F.lit(True)), "uri", "left")
        .join(parents, "uri", "left")
        .join(names, "country_uri", "left")
        .join(top_names, "top_uri", "left")
        .select(
            "uri",
            F.coalesce(_first_label(raw), X.short_frag("uri")).alias("label"),
            X.short_frag("uri").alias("short_id"),
            kind.alias("kind"),
            "top_uri",
            F.when(
                F.col("top_uri").isNotNull(), F.coalesce("top_name", X.short_frag("top_uri"))
            ).alias("top_label"),
            F.coalesce("country_text", "country_name").alias("country"),
            "year",
            "creator",
            "definitions",
        )
    )


def _labels(rows: DataFrame, pref_only: bool = False) -> DataFrame:
    """(uri, label): the label a node shows."""
    pref = (F.col("p") == V.PREF_LABEL) & (F.col("o") != "")
    english = F.coalesce("lang", F.lit("")).isin("en", "")
    picked = rows.groupBy(F.col("s").alias("uri")).agg(
        F.max(F.when(pref & english, F.col("o"))).alias("a"),
        F.min(F.when(pref & ~english, F.col("o"))).alias("b"),
        F.min(F.when((F.col("p") == V.ALT_LABEL) & (F.col("o") != ""), F.col("o"))).alias("c"),
    )
    names = ["a", "b"] if pref_only else ["a", "b", "c"]
    return picked.select("uri", F.coalesce(*names).alias("label")).filter("label is not null")


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degree(edges), "uri", "left").withColumn(
        "degree", F.coalesce("degree", F.lit(0))
    )


def simple_graph(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over eight predicates; edges are not deduplicated.

    Kinds are concept, scheme, class and resource; a later type statement
    replaces an earlier one, so the order concept, scheme, class decides.
    """
    predicates = [V.SKOS + t for t in V.SIMPLE_GRAPH_TYPES]
    edges = triples.filter(
        F.col("p").isin(predicates) & (F.col("o_kind") == "iri") & (F.col("s") != F.col("o"))
    ).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    kinds = F.array(*[F.lit(c) for c in (V.CONCEPT, V.SCHEME_CLASS, V.RDFS + "Class")])
    rank = F.when(F.col("p") == V.TYPE, F.array_position(kinds, F.col("o")))
    labels = F.col("p").isin(V.PREF_LABEL, V.RDFS_LABEL) & (F.col("o_kind") == "literal")
    described = (
        triples.filter((rank > 0) | labels)
        .groupBy(F.col("s").alias("uri"))
        .agg(F.max(rank).alias("k"), F.max(F.when(labels, F.col("o"))).alias("label"))
    )
    ends = edges.select(F.explode(F.array("src", "dst")).alias("uri"))
    counts = ends.groupBy("uri").agg(F.count("*").alias("degree"))
    kind = F.when(
        F.col("k") > 0,
        F.element_at(
            F.array(F.lit("concept"), F.lit("scheme"), F.lit("class")), F.col("k").cast("int")
        ),
    ).otherwise(F.lit("resource"))
    plain = F.replace(F.substring_index("uri", "#", -1), F.lit("_"), F.lit(" "))
    nodes = described.join(counts, "uri", "full").select(
        "uri",
        F.coalesce("label", plain).alias("label"),
        F.coalesce(kind, F.lit("resource")).alias("kind"),
        F.coalesce("degree", F.lit(0)).alias("degree"),
    )
    return nodes, edges


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct (uri, peer) in both directions; one row per neighbour."""
    return (
        edges.select(F.col("src").alias("uri"), F.col("dst").alias("peer"))
        .unionByName(edges.select(F.col("dst").alias("uri"), F.col("src").alias("peer")))
        .distinct()
    )


# -- sub-graphs -------------------------------------------------------------


def edges_between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with both ends among the nodes."""
    uris = nodes.select("uri").distinct()
    return edges.join(uris.withColumnRenamed("uri", "src"), "src", "left_semi").join(
        uris.withColumnRenamed("uri", "dst"), "dst", "left_semi"
    ).select(*edges.columns)


def undirected(edges: DataFrame) -> DataFrame:
    """U8: one edge per unordered pair and type, the smaller (src, dst) kept."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    kept = edges.groupBy(*pair, "type").agg(F.min(F.struct("src", "dst")).alias("e"))
    return kept.select("e.src", "e.dst", "type")


def top_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """V4."""
    return undirected(edges_between(edges, nodes.filter(F.col("kind") == "topConcept")))


def children(nodes: DataFrame, edges: DataFrame, parents: DataFrame, n: int = 60) -> DataFrame:
    """V5: (parent, uri): children by top concept first, then by broader/narrower edges."""
    asked = parents.select(F.col("uri").alias("parent")).distinct()
    by_top = nodes.select(F.col("top_uri").alias("parent"), "uri", F.lit(0).alias("via"))
    by_edge = edges.filter(F.col("type").isin("broader", "narrower")).select(
        F.col("dst").alias("parent"), F.col("src").alias("uri"), F.lit(1).alias("via")
    )
    found = (
        by_top.unionByName(by_edge)
        .join(asked, "parent", "left_semi")
        .groupBy("parent", "uri")
        .agg(F.min("via").alias("via"))
    )
    return first_n(found, ["parent"], ["via", "uri"], n).select("parent", "uri", "rn")


def children_subgraph(
    nodes: DataFrame, edges: DataFrame, parents: DataFrame, n: int = 40
) -> DataFrame:
    """V6: (parent, src, dst, type) of the edges among a node and its children."""
    kids = children(nodes, edges, parents, n).select("parent", "uri")
    own = parents.select(F.col("uri").alias("parent"), "uri").distinct()
    inside = kids.unionByName(own)
    left = inside.withColumnRenamed("uri", "src")
    right = inside.withColumnRenamed("uri", "dst")
    return edges.join(left, "src").join(right, ["parent", "dst"]).select(
        "parent", "src", "dst", "type"
    )


def neighbors(edges: DataFrame, uris: DataFrame) -> DataFrame:
    """(uri, peer, type, direction) of every edge at the given nodes."""
    asked = uris.select("uri").distinct()
    out = edges.select(
        F.col("src").alias("uri"), F.col("dst").alias("peer"), "type",
        F.lit("out").alias("direction"),
    )
    back = edges.select(
        F.col("dst").alias("uri"), F.col("src").alias("peer"), "type",
        F.lit("in").alias("direction"),
    )
    return out.unionByName(back).join(asked, "uri", "left_semi")


def expand_with_literals(triples: DataFrame, edges: DataFrame, uris: DataFrame) -> DataFrame:
    """V8: neighbours plus one row per displayed literal, its value shortened."""
    near = neighbors(edges, uris).select(
        "uri", F.col("peer").alias("target"), "type", "direction",
        F.lit(None).cast("string").alias("label"),
    )
    shown = F.coalesce(
        *[F.when(F.col("p") == p, F.lit(n)) for p, n in V.EXPANDED_LITERALS.items()]
    )
    value = F.when(F.col("p") == V.DEFINITION, X.preview("o", 50)).otherwise(X.preview("o", 35))
    rows = (
        triples.filter((F.col("o_kind") == "literal") & shown.isNotNull())
        .join(uris.select(F.col("uri").alias("s")).distinct(), "s", "left_semi")
        .select(
            F.col("s").alias("uri"), value.alias("target"), F.lit("other").alias("type"),
            F.lit("out").alias("direction"), shown.alias("label"),
        )
    )
    return near.unionByName(rows)


def relations(edges: DataFrame, uris: DataFrame, cap: int = 8, types: list[str] | None = None):
    """First ``cap`` distinct (type, peer) of each node and how many there are.

    The total is an aggregate and the cap a rank of its own, so a hub's edges
    are counted and cut before they meet.
    """
    rows = neighbors(edges, uris).filter(F.col("type").isin(types or V.STRUCTURAL_TYPES))
    distinct = rows.groupBy("uri", "type", "peer").agg(F.max("direction").alias("direction"))
    total = distinct.groupBy("uri").agg(F.count("*").alias("total"))
    shown = first_n(distinct, ["uri"], ["type", "peer"], cap)
    return shown.join(total, "uri")


def expand(visible: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Growth of a visible set; rows already there stay as they are."""
    fresh = new.join(visible.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return visible.unionByName(fresh)


# -- facets -----------------------------------------------------------------


def filter_concepts(
    nodes: DataFrame, member_rows: DataFrame, limit: int | None = None, *,
    category: str | None = None, country: str | None = None, year: str | None = None,
    org: str | None = None, scope: str | None = None, query: str | None = None,
) -> DataFrame:
    """concepts passing every facet, in uri order when limited."""
    out = nodes.filter(F.col("kind").isin("concept", "topConcept"))
    if category:
        out = out.filter((F.col("top_uri") == category) | (F.col("uri") == category))
    for col, value in (("country", country), ("year", year)):
        if value:
            out = out.filter(F.col(col) == value)
    for coll in (org, scope):
        if coll:
            inside = member_rows.filter(F.col("coll") == coll).select("uri")
            out = out.join(inside, "uri", "left_semi")
    if query:
        needle = F.lit(query)
        out = out.filter(X.icontains("label", needle) | X.icontains("short_id", needle))
    return out if limit is None else out.orderBy("uri").limit(limit)


def year_between(df: DataFrame, lo: str | None = None, hi: str | None = None) -> DataFrame:
    """string comparison, both ends included."""
    if lo:
        df = df.filter(F.col("year") >= lo)
    if hi:
        df = df.filter(F.col("year") <= hi)
    return df


def filtered_subgraph(
    nodes: DataFrame, edges: DataFrame, member_rows: DataFrame, limit: int = 60, **facets
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a filter; the top-level graph without a filter or a result."""
    found = filter_concepts(nodes, member_rows, limit, **facets) if any(facets.values()) else None
    if found is None or found.isEmpty():
        return nodes.filter(F.col("kind").isin("scheme", "topConcept")), top_edges(edges, nodes)
    return found, edges_between(edges, found)


DRILL_DOWNS = ["category", "country", "org", "scope", "year"]


def drill_down(nodes: DataFrame, member_rows: DataFrame, n: int = 60) -> DataFrame:
    """(facet, value, uri, label): first ``n`` concepts behind every bar at once."""
    concepts = nodes.filter(F.col("kind").isin("concept", "topConcept"))
    bars = F.array(
        F.struct(F.lit("category").alias("facet"), F.col("top_uri").alias("value")),
        F.struct(
            F.lit("category").alias("facet"),
            F.when(F.col("kind") == "topConcept", F.col("uri")).alias("value"),
        ),
        F.struct(F.lit("country").alias("facet"), F.col("country").alias("value")),
        F.struct(F.lit("year").alias("facet"), F.col("year").alias("value")),
    )
    scalar = concepts.select("uri", "label", F.explode(bars).alias("b")).select(
        "b.*", "uri", "label"
    )
    name = X.local_name("coll")
    facet = F.when(name.startswith("Org_"), F.lit("org")).when(
        name.startswith("Scope_") | name.startswith("Type_"), F.lit("scope")
    )
    grouped = (
        member_rows.select(facet.alias("facet"), F.col("coll").alias("value"), "uri")
        .filter(F.col("facet").isNotNull())
        .join(concepts.select("uri", "label"), "uri")
    )
    rows = scalar.filter(F.col("value").isNotNull()).unionByName(grouped).distinct()
    return first_n(rows, ["facet", "value"], ["uri"], n)


def search_labels(triples: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """V9: (query, uri): first ``n`` nodes whose labels, joined by spaces, contain the text.

    ``queries(query)`` is the handful of texts typed into the box; each is one
    containment test on the label text.
    """
    pref = F.when(F.col("p") == V.PREF_LABEL, F.col("o"))
    alt = F.when(F.col("p") == V.ALT_LABEL, F.col("o"))
    labels = triples.filter(F.col("p").isin(V.PREF_LABEL, V.ALT_LABEL)).select(
        F.col("s").alias("uri"), F.lower(F.coalesce(pref, alt)).alias("hay")
    )
    asked = queries.filter(F.trim("query") != "").select(
        "query", F.lower("query").alias("needle")
    ).distinct()
    found = (
        labels.join(contained_in(labels, asked), "hay")
        .join(asked, "needle")
        .select("query", "uri")
        .distinct()
    )
    return first_n(found, ["query"], ["uri"], n)


# -- statistics -------------------------------------------------------------


def by_category(nodes: DataFrame) -> DataFrame:
    """A4: concepts per top concept; empty categories stay with 0."""
    tops = nodes.filter(F.col("kind") == "topConcept").select("uri", "label")
    counts = nodes.filter(F.col("top_uri").isNotNull()).groupBy(
        F.col("top_uri").alias("uri")
    ).agg(F.count("*").alias("n"))
    return tops.join(counts, "uri", "left").select(
        "uri", "label", F.coalesce("n", F.lit(0)).alias("n")
    ).orderBy(F.col("n").desc(), "uri")


def by_edge_type(edges: DataFrame) -> DataFrame:
    """A5."""
    return edges.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "type")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of overall counts."""
    kind = F.col("kind")
    counted = nodes.agg(
        F.count_if(kind.isin("concept", "topConcept")).alias("concepts"),
        F.count_if(kind == "topConcept").alias("top_concepts"),
        F.count_if(kind == "collection").alias("collections"),
    )
    n_edges = edges.agg(F.count("*").alias("edges")).scalar()
    return counted.select("concepts", n_edges.alias("edges"), "top_concepts", "collections")


def collection_sizes(
    nodes: DataFrame, edges: DataFrame, prefixes: tuple[str, ...] = ("Scope_", "Type_"),
    keep_empty: bool = True,
) -> DataFrame:
    """Members per collection of the given prefixes, with the display label."""
    name = X.local_name("uri")
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | name.startswith(prefix)
    shown = F.coalesce(
        *[F.when(F.col("key") == F.lit(k), F.lit(v)) for k, v in V.COLLECTION_LABELS.items()],
        F.regexp_replace("key", "^Org_", ""),
    )
    colls = nodes.filter((F.col("kind") == "collection") & wanted).select(
        "uri", name.alias("key")
    )
    counts = edges.filter(F.col("type") == "member").groupBy(F.col("src").alias("uri")).agg(
        F.count("*").alias("n")
    )
    out = colls.join(counts, "uri", "left").select(
        "uri", "key", shown.alias("label"), F.coalesce("n", F.lit(0)).alias("n")
    )
    return out if keep_empty else out.filter(F.col("n") > 0)


def _concepts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin("concept", "topConcept"))


def by_country(nodes: DataFrame) -> DataFrame:
    """A8."""
    return _concepts(nodes).filter("country is not null").groupBy("country").agg(
        F.count("*").alias("n")
    )


def by_year(nodes: DataFrame) -> DataFrame:
    """A8."""
    return _concepts(nodes).filter("year is not null").groupBy("year").agg(F.count("*").alias("n"))


def coverage(nodes: DataFrame) -> DataFrame:
    """(quality, n, pct) of concepts with a definition, a country and a year."""
    tests = {
        "definition": F.col("definitions") > 0,
        "country": F.col("country").isNotNull(),
        "year": F.col("year").isNotNull(),
    }
    one = _concepts(nodes).agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in tests.items()]
    )
    rows = one.unpivot(["total"], list(tests), "quality", "n")
    pct = F.when(
        F.col("total") > 0, F.round(F.col("n") * 100.0 / F.col("total")).cast("long")
    ).otherwise(F.lit(0))
    return rows.select("quality", "n", pct.alias("pct"))


def year_span(nodes: DataFrame) -> DataFrame:
    """A10."""
    return _concepts(nodes).agg(F.min("year").alias("lo"), F.max("year").alias("hi"))


def distinct_values(nodes: DataFrame, col: str) -> DataFrame:
    """A11."""
    return nodes.select(col).filter(F.coalesce(col, F.lit("")) != "").distinct().orderBy(col)


def top_degree(nodes: DataFrame, edges: DataFrame, n: int = 15) -> DataFrame:
    """Concepts with most edges."""
    ranked = with_degree(_concepts(nodes).select("uri", "label"), edges)
    return ranked.orderBy(F.col("degree").desc(), "uri").limit(n)
