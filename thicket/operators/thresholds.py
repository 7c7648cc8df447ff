"""National thresholds held in the graph, and enriching hit lists with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import questions as Q
from thicket.functions import text as X
from thicket.operators.countries import (
    countries_in_question,
    exact_else_contains,
    threshold_context,
)
from thicket.operators.ordering import dedupe_best, first_n, numbered, top_k
from thicket.operators.ranges import overlapping_ranges, points_in_ranges
from thicket.operators.triples import TEXT_LANGS, lang_in, match, members
from thicket.session import materialise

PROPERTIES = {
    "minArea": "minAreaHa", "maxArea": "maxAreaHa",
    "minCrown": "minCrownCoverPct", "maxCrown": "maxCrownCoverPct",
    "minHeight": "minTreeHeightM", "maxHeight": "maxTreeHeightM",
    "minWidth": "minStripWidthM", "maxWidth": "maxStripWidthM",
}
LOWER_BOUNDS = ["minArea", "minCrown", "minHeight", "minWidth"]


def richness(columns: list[str] = LOWER_BOUNDS) -> Column:
    """How many of the lower bounds are present, 0 to 4."""
    return sum(F.col(c).isNotNull().cast("int") for c in columns)


def criteria(triples: DataFrame) -> DataFrame:
    """One row per (concept with a definition, country): text fields, bounds, richness.

    Several values of a field count as their smallest in text order; one
    aggregation of scalars over the predicates of interest.
    """
    wanted = {V.PREF_LABEL: "label", V.DEFINITION: "definition", V.DATE: "year", V.CREATOR: "org"}
    wanted |= {V.EX + name: key for key, name in PROPERTIES.items()}
    allowed = (F.col("p") != V.PREF_LABEL) | lang_in("lang", TEXT_LANGS)
    is_concept = (F.col("p") == V.TYPE) & (F.col("o") == V.CONCEPT)
    rows = triples.filter(is_concept | (F.col("p").isin(list(wanted)) & allowed))
    fields = rows.groupBy(F.col("s").alias("uri")).agg(
        F.max(is_concept).alias("is_concept"),
        *[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in wanted.items()],
    )
    fields = fields.filter(F.col("is_concept") & F.col("definition").isNotNull()).drop("is_concept")
    places = match(triples, p=V.SPATIAL).select(
        F.col("s").alias("uri"), F.col("o").alias("country_uri")
    ).distinct()
    return fields.join(places, "uri").withColumn("richness", richness())


def country_names(triples: DataFrame, coll: str = V.COUNTRIES) -> DataFrame:
    """(country_uri, country): labels of the members of a country collection."""
    inside = members(triples).filter(F.col("coll") == coll).select(F.col("uri").alias("s"))
    labels = match(triples, p=V.PREF_LABEL).join(inside, "s", "left_semi")
    return labels.groupBy(F.col("s").alias("country_uri")).agg(F.min("o").alias("country"))


def country_thresholds(names: DataFrame, triples: DataFrame) -> DataFrame:
    """Every concept of the named countries, richest first by ``score``.

    A name equal to a country label wins; only without one do labels containing
    the name count. Nothing is cut; ``score`` is richness / 4.
    """
    asked = names.select("name").distinct().withColumn("hay", F.lower("name"))
    labels = country_names(triples).withColumn("key", F.lower("country"))
    found = exact_else_contains(asked, labels, both_ways=False)
    places = materialise(
        asked.join(found, "hay").join(labels, "key").select("name", "country_uri", "country")
    )
    rows = criteria(triples).join(places, "country_uri")
    best = dedupe_best(rows, ["name", "uri"], ["country"])
    return best.select(
        "name", "uri", "label", "definition",
        X.format_thresholds("definition", {k: k for k in PROPERTIES}).alias("text"),
        "country", "year", "org",
        F.least(F.col("richness") / 4, F.lit(1.0)).alias("score"),
        *LOWER_BOUNDS, "richness",
    )


def continent_countries(triples: DataFrame) -> DataFrame:
    """(continent, country_uri, country) of every continent collection."""
    rows = members(triples).filter(F.col("coll").startswith(V.EX + "Continent_"))
    places = rows.select(
        X.local_name("coll", "Continent_").alias("continent"), F.col("uri").alias("country_uri")
    )
    labels = match(triples, p=V.PREF_LABEL).groupBy(F.col("s").alias("country_uri")).agg(
        F.min("o").alias("country")
    )
    return labels.join(places, "country_uri").select("continent", "country_uri", "country")


def best_per_country(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The richest concept of each country, the smaller uri on a tie."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(
        F.min_by(
            F.struct(*rest), F.struct((-F.col("richness")).alias("r"), F.col("uri").alias("u"))
        ).alias("b")
    )
    return best.select(*keys, "b.*")


CONTINENT_ROWS = 60


def continent_thresholds(
    triples: DataFrame, continents: DataFrame | None = None, k: int | None = CONTINENT_ROWS
):
    """Per continent its countries' richest concepts, best ``k`` (all: None).

    ``score`` is min(richness / 3, 1).
    """
    places = continent_countries(triples)
    if continents is not None:
        places = places.join(continents.select("continent").distinct(), "continent", "left_semi")
    rows = criteria(triples).join(places, "country_uri")
    best = best_per_country(rows, ["continent", "country"]).withColumn(
        "score", F.least(F.col("richness") / 3, F.lit(1.0))
    )
    if k is None:  # one row for each country of the continent
        order = Window.partitionBy("continent").orderBy(F.col("richness").desc(), "country")
        return best.withColumn("rank", F.row_number().over(order))
    return top_k(best, k, "richness", ["country"], "continent")


def apply_threshold(df: DataFrame, field: str, op: str, value: float) -> DataFrame:
    """rows whose bound is at most (``le``) or at least (``ge``) the value."""
    number = F.col(field).try_cast("double")
    return df.filter(number <= value if op == "le" else number >= value)


def passes_threshold(threshold: Column) -> Column:
    """rows meeting the question's threshold; every row when it states none."""
    bound = F.coalesce(
        *[F.when(threshold["field"] == f, F.col(f).try_cast("double")) for f in LOWER_BOUNDS]
    )
    ok = F.when(threshold["op"] == "le", bound <= threshold["value"]).when(
        threshold["op"] == "ge", bound >= threshold["value"]
    )
    return threshold.isNull() | threshold["op"].isNull() | F.coalesce(ok, F.lit(False))


def filter_by_question(df: DataFrame, questions: DataFrame, legacy: bool = False) -> DataFrame:
    """rows (qid, bounds …) that meet the threshold their question states."""
    parsed = questions.select("qid", Q.detect_threshold("query", legacy).alias("_threshold"))
    return df.join(parsed, "qid").filter(passes_threshold(F.col("_threshold"))).drop("_threshold")


def stated_ranges(questions: DataFrame, legacy: bool = False) -> DataFrame:
    """The columns of ``questions`` with the field and the range (low, high) that each one's threshold states;
    questions without a threshold are left out."""
    parsed = questions.withColumn("_t", Q.detect_threshold("query", legacy))
    value = F.col("_t.value")
    return parsed.filter(F.col("_t.op").isin("le", "ge") & value.isNotNull()).select(
        *questions.columns, F.col("_t.field").alias("field"),
        F.when(F.col("_t.op") == "ge", value).alias("low"), F.when(F.col("_t.op") == "le", value).alias("high"),
    )


def _by_field(rows: DataFrame, keep: list[str], pairs: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row for each field of ``pairs`` that is present, with its numbers as ``bound`` and ``upper``."""
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), *[F.col(c).try_cast("double").alias(n) for c, n in zip(cs, ("bound", "upper"))])
        for f, cs in pairs.items()
    ])
    return rows.select(*keep, F.explode(fields).alias("_f")).select(*keep, "_f.*")


def criteria_meeting(rows: DataFrame, ranges: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """F11 for any number of questions: (keep, field, bound, columns of ``ranges``) of the criteria ``rows`` whose
    lower bound lies in the range asked for, among those of equal ``keys``. No question meets a row that it
    does not match."""
    bounds = _by_field(rows, keep, {f: (f,) for f in LOWER_BOUNDS}).filter(F.col("bound").isNotNull())
    return points_in_ranges(materialise(bounds), ranges, ["field", *keys], "bound")


def criteria_overlapping(rows: DataFrame, ranges: DataFrame, keep: list[str]) -> DataFrame:
    """F10 with both bounds: (keep, field, bound, upper, columns of ``ranges``) of the criteria whose range from
    the lower to the upper bound shares a number with the range asked for. A criterion without either bound of the
    field has no range."""
    pairs = {f: (f, f.replace("min", "max")) for f in LOWER_BOUNDS}
    stored = _by_field(rows, keep, pairs).filter(F.col("bound").isNotNull() | F.col("upper").isNotNull())
    return overlapping_ranges(materialise(stored), ranges, ["field"], "bound", "upper")


# -- graph context ----------------------------------------------------------


def _first_labels(triples: DataFrame) -> DataFrame:
    return match(triples, p=V.PREF_LABEL).groupBy("s").agg(F.min("o").alias("label"))


def _joined_labels(rows: DataFrame, keys: list[str], prefix: str, sep: str = ", ") -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("rn", "label")))["label"]
    return rows.groupBy(*keys).agg(
        F.concat(F.lit(prefix), F.array_join(listed, sep)).alias("line")
    )


def graph_context(uris: DataFrame, triples: DataFrame) -> DataFrame:
    """(uri, graph_context): parents, siblings, related, bounds, alignments.

    Siblings are read from the first six children of each parent in uri order:
    five of them are never the concept itself, so the children of a large parent
    are cut before they meet its concepts.
    """
    asked = materialise(uris.select("uri").distinct())
    own = triples.filter(
        F.col("p").isin(V.BROAD_MATCH, V.RELATED, V.EXACT_MATCH, *[V.EX + n for n in V.NUMERIC_PROPERTIES])
    ).join(asked, F.col("s") == F.col("uri")).select("uri", "p", "o")

    parents = own.filter(F.col("p") == V.BROAD_MATCH).select("uri", F.col("o").alias("parent"))
    parent_keys = materialise(parents.select("parent").distinct())
    all_children = match(triples, p=V.BROAD_MATCH).select(
        F.col("o").alias("parent"), F.col("s").alias("child")
    ).distinct()
    kids = first_n(
        all_children.join(parent_keys, "parent", "left_semi"), ["parent"], ["child"], 6, "k"
    )
    brothers = first_n(
        parents.join(kids, "parent").filter(F.col("child") != F.col("uri")),
        ["uri", "parent"], ["child"], 5,
    )
    related = first_n(
        own.filter(F.col("p") == V.RELATED).select("uri", F.col("o").alias("peer")).distinct(),
        ["uri"], ["peer"], 3,
    )
    named = materialise(
        parent_keys.select(F.col("parent").alias("s"))
        .unionByName(brothers.select(F.col("child").alias("s")))
        .unionByName(related.select(F.col("peer").alias("s")))
        .distinct()
    )
    labels = _first_labels(triples.join(named, "s", "left_semi"))

    def label_of(df: DataFrame, col: str) -> DataFrame:
        return df.join(labels.withColumnRenamed("s", col), col)

    none = F.lit("")
    titled = label_of(parents, "parent")
    parent_lines = titled.select(
        "uri", F.lit(0).alias("a"), F.col("parent").alias("b"), F.lit(0).alias("c"),
        F.concat(F.lit("Parent concept: "), F.col("label")).alias("line"),
    )
    sibling_lines = _joined_labels(
        label_of(brothers, "child").join(titled.select("uri", "parent"), ["uri", "parent"], "left_semi"),
        ["uri", "parent"], "Related concepts (same category): ",
    ).select("uri", F.lit(0).alias("a"), F.col("parent").alias("b"), F.lit(1).alias("c"), "line")
    related_lines = _joined_labels(
        label_of(related, "peer"), ["uri"], "Associated concepts: "
    ).select("uri", F.lit(1).alias("a"), none.alias("b"), F.lit(0).alias("c"), "line")

    names = list(V.NUMERIC_PROPERTIES)
    name = X.local_name("p")
    bounds = own.filter(F.col("p").startswith(V.EX)).select(
        "uri",
        F.struct(F.array_position(F.lit(names), name), F.col("o")).alias("rn"),
        F.concat(name, F.lit(": "), F.col("o")).alias("label"),
    )
    bound_lines = _joined_labels(bounds, ["uri"], "Numerical thresholds: ", " | ").select(
        "uri", F.lit(2).alias("a"), none.alias("b"), F.lit(0).alias("c"), "line"
    )
    alignment_lines = own.filter(F.col("p") == V.EXACT_MATCH).select(
        "uri", F.lit(3).alias("a"), F.col("o").alias("b"), F.lit(0).alias("c"),
        F.concat(F.lit("Exact match (Agrovoc): "), X.local_name("o")).alias("line"),
    )
    lines = parent_lines
    for more in (sibling_lines, related_lines, bound_lines, alignment_lines):
        lines = lines.unionByName(more)
    ordered = F.sort_array(F.collect_list(F.struct("a", "b", "c", "line")))["line"]
    return lines.groupBy("uri").agg(F.array_join(ordered, "\n").alias("graph_context"))


# -- enrichment -------------------------------------------------------------

HIT_COLUMNS = [
    "qid", "uri", "text", "label", "definition", "country", "year", "scope", "org", "sources",
    "vec_rank", "kw_rank", "vector_score", "kw_score", "rrf_score", "graph_context",
]
LIST_COLUMNS = HIT_COLUMNS[:-1]


def insert_after_first(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Hits with ``extra`` placed after the best one, positions in ``n``.

    ``hits`` are ordered by ``rank``, ``extra`` by (place, sub); a question can
    gain any number of rows, so positions are numbered without one sort per
    question.
    """
    natural = hits.select(
        *LIST_COLUMNS,
        F.when(F.col("rank") == 1, 0).otherwise(2).alias("slot"),
        F.col("rank").cast("long").alias("place"),
        F.lit(0).alias("sub"),
    )
    added = extra.select(*LIST_COLUMNS, F.lit(1).alias("slot"), "place", "sub")
    both = natural.unionByName(added)
    # stored, as its rows are read twice: for the bounds of the ranges and for the rows in them
    return numbered(materialise(both), ["qid"], ["slot", "place", "sub", "uri"], "n").drop("slot", "place", "sub")


#: Countries that a question names, and hits that lend theirs.
NAMED_COUNTRIES, LENDING_HITS = 10, 3


def enrichment_countries(
    filters: DataFrame,
    hits: DataFrame,
    triples: DataFrame,
    thresholds: DataFrame,
    named_countries: int = NAMED_COUNTRIES,
    lending_hits: int = LENDING_HITS,
) -> DataFrame:
    """(qid, name, place): the countries whose thresholds each question gets.

    All of the continent's countries that pass the threshold, unless countries are
    given; else the first ``named_countries`` of those given or named in the
    question; else those of the first ``lending_hits`` hits.
    """
    asked = filters.filter(
        Q.is_threshold_question("query") | F.col("continent").isNotNull()
    ).withColumn("listed", F.size(F.coalesce("countries", F.array().cast("array<string>"))) > 0)
    by_continent = F.col("continent").isNotNull() & ~F.col("listed")

    regional = asked.filter(by_continent)
    candidates = continent_thresholds(triples, regional, None)
    first = (
        regional.select("qid", "continent", "threshold")
        .join(candidates, "continent")
        .filter(passes_threshold(F.col("threshold")))
        .select("qid", F.col("country").alias("name"), F.col("rank").cast("long").alias("place"))
    )
    given = asked.filter(F.col("listed")).select(
        "qid", F.posexplode("countries").alias("place", "name")
    ).select("qid", "name", F.col("place").cast("long").alias("place"))
    mentioned = countries_in_question(
        asked.filter(~by_continent & ~F.col("listed")), thresholds
    ).select("qid", F.col("country").alias("name"), F.col("pos").cast("long").alias("place"))
    named = first_n(given.unionByName(mentioned), ["qid"], ["place", "name"], named_countries)
    chosen = first.unionByName(named.select("qid", "name", "place"))
    missed = asked.select("qid").join(chosen.select("qid").distinct(), "qid", "left_anti")
    from_hits = (
        hits.filter((F.col("rank") <= lending_hits) &(F.coalesce("country", F.lit("")) != ""))
        .join(missed, "qid", "left_semi")
        .groupBy("qid", F.col("country").alias("name"))
        .agg(F.min("rank").cast("long").alias("place"))
    )
    return chosen.unionByName(from_hits)


def enrich_thresholds(
    filters: DataFrame, hits: DataFrame, triples: DataFrame, thresholds: DataFrame
) -> DataFrame:
    """Hit lists with the threshold concepts of their countries, positions in ``n``.

    ``filters`` are the questions with their filters, ``hits`` their ranked
    hits. A country without any concept gets its threshold-table text instead.
    Every concept of the result, found or added, gets its graph context.
    """
    asked = materialise(enrichment_countries(filters, hits, triples, thresholds))
    names = asked.select("name").distinct()
    concepts = materialise(country_thresholds(names, triples))  # read for the hits and for the countries without any
    rows = asked.join(concepts, "name")
    fresh = rows.join(hits.select("qid", "uri"), ["qid", "uri"], "left_anti")
    fresh = fresh.groupBy("qid", "uri").agg(
        F.min_by(
            F.struct(*[c for c in fresh.columns if c not in ("qid", "uri")]),
            F.struct("place", "name"),
        ).alias("b")
    ).select("qid", "uri", "b.*")
    empty = F.lit("")
    no_rank = F.lit(None).cast("int")
    from_graph = fresh.select(
        "qid", "uri", "text", X.text_or_empty("label").alias("label"), "definition", "country",
        X.text_or_empty("year").alias("year"), F.lit("National").alias("scope"),
        X.text_or_empty("org").alias("org"),
        F.when(F.col("score") > 0, F.array(F.lit("sparql"), F.lit("threshold")))
        .otherwise(F.array(F.lit("sparql"))).alias("sources"),
        no_rank.alias("vec_rank"), no_rank.alias("kw_rank"),
        F.lit(0.0).alias("vector_score"), F.col("score").alias("kw_score"),
        F.round(F.lit(0.06) + F.col("score") * 0.01, 6).alias("rrf_score"),
        "place", (-F.col("richness")).alias("sub"),
    )
    bare = asked.join(concepts.select("name").distinct(), "name", "left_anti")
    table_text = threshold_context(bare.select("name"), thresholds)
    from_table = bare.join(table_text, "name").select(
        "qid", F.concat(F.lit("threshold://"), X.norm_country_slug("name")).alias("uri"), "text",
        F.concat("name", F.lit(" forest thresholds")).alias("label"),
        F.col("text").alias("definition"), F.col("name").alias("country"), empty.alias("year"),
        F.lit("National").alias("scope"), empty.alias("org"),
        F.array(F.lit("threshold")).alias("sources"),
        no_rank.alias("vec_rank"), no_rank.alias("kw_rank"),
        F.lit(0.0).alias("vector_score"), F.lit(0.0).alias("kw_score"),
        F.lit(0.05).alias("rrf_score"), "place", F.lit(0).alias("sub"),
    )
    listed = insert_after_first(hits, from_graph.unionByName(from_table))
    context = graph_context(listed.select("uri"), triples)
    added = F.array_contains("sources", "threshold") | (F.col("rrf_score") == 0.06)
    shown = F.when(F.col("uri").startswith("threshold://"), F.col("text")).otherwise(
        F.coalesce("graph_context", F.when(added, empty))
    )
    return listed.join(context, "uri", "left").select(*LIST_COLUMNS, shown.alias("graph_context"), "n")
