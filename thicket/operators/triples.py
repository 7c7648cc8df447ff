"""Patterns, joins and set operations over the triples table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import text as X
from thicket.functions.text import ColumnOrName, _c
from thicket.operators.ordering import first_n
from thicket.schemas import TRIPLE_COLS

# -- building triples -------------------------------------------------------


def term(
    predicate: str, value: Column, kind: str = "literal", lang: Column | str | None = None,
    dtype: str | None = None, subject: Column | None = None,
) -> Column:
    """One (s, p, o, o_kind, lang, dtype) struct; rows whose value is null are dropped later.

    Without ``subject`` the row's own subject is used.
    """
    tag = lang if isinstance(lang, Column) else F.lit(lang).cast("string")
    own = F.lit(None).cast("string") if subject is None else subject
    text = value.cast("string")
    return F.struct(
        own.alias("s"),
        F.lit(predicate).alias("p"),
        (text if subject is None else F.when(own.isNotNull(), text)).alias("o"),
        F.lit(kind).alias("o_kind"),
        tag.alias("lang"),
        F.lit(dtype).cast("string").alias("dtype"),
    )


def iri(predicate: str, value: Column) -> Column:
    return term(predicate, value, "iri")


def terms(predicate: str, values: Column, **kwargs) -> Column:
    """One struct per element of an array column."""
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(values, empty), lambda v: term(predicate, v, **kwargs))


def member_of(coll: Column, uri: str = "uri") -> Column:
    """Membership of the row's ``uri`` in a collection; null collections give nothing."""
    return term(V.MEMBER, F.col(uri), "iri", subject=coll)


def members_of(colls: Column, uri: str = "uri") -> Column:
    return F.transform(colls, lambda c: member_of(c, uri))


def unpivot_terms(
    df: DataFrame, subject: ColumnOrName, *single: Column, lists: tuple[Column, ...] = ()
) -> DataFrame:
    """All terms of each row as triples, in one pass over ``df``.

    ``single`` are structs, ``lists`` arrays of structs, made by the helpers above.
    A row gives no triple twice, so rows with subjects of their own need no
    further distinct.
    """
    arrays = [F.array(*single), *lists] if single else list(lists)
    own = _c(subject).alias("_own")
    out = df.select(own, F.explode(F.array_distinct(F.concat(*arrays))).alias("t")).select(
        F.coalesce("t.s", "_own").alias("s"), "t.p", "t.o", "t.o_kind", "t.lang", "t.dtype"
    )
    return out.filter(F.col("s").isNotNull() & F.col("o").isNotNull())


# -- patterns and filters ---------------------------------------------------


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None):
    """triples with the given positions fixed."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.filter(F.col(name) == value)
    return triples


def instances(triples: DataFrame, cls: str) -> DataFrame:
    return match(triples, p=V.TYPE, o=cls).select("s").distinct()


def of_type(triples: DataFrame, cls: str) -> DataFrame:
    """triples whose subject is an instance of ``cls``."""
    return triples.join(instances(triples, cls), "s", "left_semi")


def lang_in(col: ColumnOrName, langs: list[str]) -> Column:
    """language tag among ``langs``; ``''`` stands for untagged."""
    return F.coalesce(_c(col), F.lit("")).isin(langs)


def lang_matches(col: ColumnOrName, lang: str) -> Column:
    return _c(col).rlike(f"(?i)^{lang}(-|$)")


def iri_startswith(col: ColumnOrName, prefix: str) -> Column:
    """F6."""
    return _c(col).startswith(prefix)


def members(triples: DataFrame) -> DataFrame:
    """M8: (coll, uri) of every collection membership."""
    return match(triples, p=V.MEMBER).select(F.col("s").alias("coll"), F.col("o").alias("uri"))


def in_collection(df: DataFrame, member_rows: DataFrame, *colls: str) -> DataFrame:
    """Rows whose uri is a member of any of the collections."""
    keep = member_rows.filter(F.col("coll").isin(list(colls))).select("uri")
    return df.join(keep, "uri", "left_semi")


def any_scope(member_rows: DataFrame) -> DataFrame:
    """Uris in any scope collection."""
    scopes = [f"{V.EX}Scope_{k}" for k in V.SCOPES]
    return member_rows.filter(F.col("coll").isin(scopes)).select("uri").distinct()


def bgp(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Conjunctive patterns; names starting with ``?`` are shared variables."""

    def one(pattern: tuple[str, str, str]) -> DataFrame:
        out = triples
        for column, value in zip(("s", "p", "o"), pattern):
            if not value.startswith("?"):
                out = out.filter(F.col(column) == value)
        return out.select(
            *[F.col(c).alias(v[1:]) for c, v in zip("spo", pattern) if v.startswith("?")]
        )

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [c for c in right.columns if c in left.columns]
        if not shared:
            raise ValueError("every pattern has to share a variable with an earlier one")
        return left.join(right, shared)

    return reduce(joined, [one(p) for p in patterns]).distinct()


def optional(
    df: DataFrame, triples: DataFrame, key: str, predicate: str, name: str,
    langs: list[str] | None = None,
) -> DataFrame:
    """Left outer pattern ``key predicate ?name``; several values give several rows.

    The language test is part of the pattern, so a row whose values all fail it
    stays with a null.
    """
    values = match(triples, p=predicate)
    if langs is not None:
        values = values.filter(lang_in("lang", langs))
    values = values.select(F.col("s").alias(key), F.col("o").alias(name)).distinct()
    return df.join(values, key, "left")


def country_label(df: DataFrame, triples: DataFrame, key: str = "uri") -> DataFrame:
    """The label of the country a concept points to."""
    langs = ["en", "fr", ""]
    linked = optional(df, triples, key, V.SPATIAL, "country_uri")
    return optional(linked, triples, "country_uri", V.PREF_LABEL, "country", langs)


def exclude_seen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (qid, uri) was not retrieved before."""
    return df.join(seen.select("qid", "uri"), ["qid", "uri"], "left_anti")


# -- set operations ---------------------------------------------------------


def distinct_triples(triples: DataFrame) -> DataFrame:
    return triples.select(*TRIPLE_COLS).dropDuplicates()


def union_triples(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*TRIPLE_COLS) for p in parts])


def add(triples: DataFrame, *more: DataFrame) -> DataFrame:
    """Set insert; a triple that is already there changes nothing."""
    return union_triples(triples, *more).dropDuplicates()


def delete_touching(triples: DataFrame, node: str) -> DataFrame:
    """Drop every triple with ``node`` as subject or object."""
    is_object = (F.col("o_kind") == "iri") & (F.col("o") == node)
    return triples.filter((F.col("s") != node) & ~is_object)


def reparent(
    triples: DataFrame, coll: str, tops: list[str], parent: str
) -> DataFrame:
    """Members of ``coll`` lose their top-concept parents and get ``parent``."""
    moved = (
        members(triples)
        .filter((F.col("coll") == coll) & (F.col("uri") != parent))
        .select(F.col("uri").alias("s"))
        .distinct()
    )
    dropped = (F.col("p") == V.BROAD_MATCH) & F.col("o").isin(tops)
    kept = triples.filter(~dropped).unionByName(
        triples.filter(dropped).join(moved, "s", "left_anti")
    )
    added = unpivot_terms(moved, "s", iri(V.BROAD_MATCH, F.lit(parent)))
    return add(kept, added)


def replace_definitions(triples: DataFrame) -> DataFrame:
    """U3 with P28/P29: definitions cleaned in place, language kept."""
    is_definition = (F.col("p") == V.DEFINITION) & (F.col("o_kind") == "literal")
    cleaned = F.when(is_definition, X.clean_definition("o")).otherwise(F.col("o"))
    changed = cleaned != F.col("o")
    return distinct_triples(
        triples.withColumns(
            {"dtype": F.when(changed, F.lit(None)).otherwise(F.col("dtype")), "o": cleaned}
        )
    )


def related_links(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Both directions of each (a, b) pair whose ends are both concepts (uri)."""
    known = concepts.select("uri")
    kept = pairs.join(known.withColumnRenamed("uri", "a"), "a", "left_semi").join(
        known.withColumnRenamed("uri", "b"), "b", "left_semi"
    )
    both = kept.select("a", "b").unionByName(
        kept.select(F.col("b").alias("a"), F.col("a").alias("b"))
    )
    return distinct_triples(unpivot_terms(both, "a", iri(V.RELATED, F.col("b"))))


# -- concept rows -----------------------------------------------------------

TEXT_LANGS = ["en", "fr", ""]


def _value(predicate: str) -> Column:
    return F.when(F.col("p") == predicate, F.col("o"))


def concept_fields(triples: DataFrame) -> DataFrame:
    """One row per concept: a label per text language, scalars and filter columns.

    One aggregation over the triples of interest. Fields with several values
    take the smallest; parents and creators are kept whole, as questions may
    ask for any of them.
    """
    lang = F.coalesce("lang", F.lit(""))
    wanted = [V.TYPE, V.PREF_LABEL, V.SPATIAL, V.DATE, V.CREATOR, V.SCOPE_NOTE, V.BROAD_MATCH]
    rows = triples.filter(F.col("p").isin(wanted)).filter(
        (F.col("p") != V.TYPE) | (F.col("o") == V.CONCEPT)
    )
    aggregates = [
        F.max(F.col("p") == V.TYPE).alias("is_concept"),
        *[
            F.min(F.when((F.col("p") == V.PREF_LABEL) & (lang == tag), F.col("o"))).alias(
                f"label_{tag}"
            )
            for tag in TEXT_LANGS
        ],
        F.min(_value(V.SPATIAL)).alias("country_uri"),
        F.min(_value(V.DATE)).alias("year"),
        F.min(_value(V.SCOPE_NOTE)).alias("scope"),
        F.min(_value(V.CREATOR)).alias("org"),
        F.max(F.col("p") == V.CREATOR).alias("has_creator"),
        F.collect_set(F.lower(X.local_name(_value(V.BROAD_MATCH)))).alias("parents"),
        F.sort_array(F.collect_set(F.lower(_value(V.CREATOR)))).alias("creators"),
    ]
    grouped = rows.groupBy(F.col("s").alias("uri")).agg(*aggregates).filter("is_concept")
    return grouped.select(
        "uri",
        F.array_compact(F.array(*[F.col(f"label_{t}") for t in TEXT_LANGS])).alias("labels"),
        "country_uri", "year", "scope", "org", "has_creator", "parents", "creators",
    )


def collection_keys(triples: DataFrame) -> DataFrame:
    """(uri, scopes, orgs): keys of the scope and organisation collections of each member."""
    rows = members(triples).filter(
        F.col("coll").startswith(V.EX + "Scope_") | F.col("coll").startswith(V.EX + "Org_")
    )
    name = X.local_name("coll")
    return rows.groupBy("uri").agg(
        F.collect_set(F.when(name.startswith("Scope_"), F.substr(name, F.lit(7)))).alias("scopes"),
        F.collect_set(F.when(name.startswith("Org_"), F.substr(name, F.lit(5)))).alias("orgs"),
    )


def country_labels(triples: DataFrame) -> DataFrame:
    """(country_uri, country) of the members of the country collection."""
    countries = in_collection(
        match(triples, p=V.PREF_LABEL).filter(lang_in("lang", TEXT_LANGS)).withColumnRenamed(
            "s", "uri"
        ),
        members(triples), V.COUNTRIES,
    )
    return countries.groupBy(F.col("uri").alias("country_uri")).agg(F.min("o").alias("country"))


def concept_rows(triples: DataFrame) -> DataFrame:
    """(uri, label, definition, …): the rows that keyword search scores.

    A concept has one row per definition and label in a text language, also
    where a language has several labels; concepts without a definition have none.
    """
    definitions = (
        match(triples, p=V.DEFINITION).select(F.col("s").alias("uri"), F.col("o").alias("definition"))
        .distinct()
    )
    labels = (
        match(triples, p=V.PREF_LABEL).filter(lang_in("lang", TEXT_LANGS))
        .select(F.col("s").alias("uri"), F.col("o").alias("label"))
        .distinct()
    )
    return (
        concept_fields(triples)
        .drop("labels")
        .join(definitions, "uri")
        .join(collection_keys(triples), "uri", "left")
        .join(labels, "uri", "left")
        .join(country_labels(triples), "country_uri", "left")
    )


# -- roll-ups ---------------------------------------------------------------


def detail_field(predicate: Column) -> Column:
    """Field of the concept detail a predicate fills."""
    name = F.regexp_extract(predicate, r"([^/#]*)$", 1)
    return (
        F.when(F.contains(predicate, F.lit("prefLabel")), F.lit("label"))
        .when(F.contains(predicate, F.lit("definition")), F.lit("definition"))
        .when(F.contains(predicate, F.lit("scopeNote")), F.lit("scopeNote"))
        .when(F.contains(predicate, F.lit("altLabel")), F.lit("altLabel"))
        .when(F.contains(predicate, F.lit("spatial")), F.lit("country"))
        .when(F.contains(predicate, F.lit("date")), F.lit("year"))
        .when(F.contains(predicate, F.lit("creator")), F.lit("organization"))
        .when(F.contains(predicate, F.lit("source")), F.lit("source"))
        .when(F.contains(predicate, F.lit("broadMatch")), F.lit("broadMatch"))
        .when(predicate.rlike("minArea|maxArea|CrownCover|TreeHeight|StripWidth"), name)
    )


SCALAR_DETAILS = ["country", "year", "organization", "broadMatch"]


def concept_detail(triples: DataFrame, uris: DataFrame | None = None) -> DataFrame:
    """(uri, field, value) of the given concepts, or of all.

    Lists are rows, so a concept with many values never becomes one huge row.
    Scalar fields keep their last value in text order; a country is shown by its
    label.
    """
    rows = triples if uris is None else triples.join(
        uris.select(F.col("uri").alias("s")).distinct(), "s", "left_semi"
    )
    rows = rows.select(
        F.col("s").alias("uri"), detail_field(F.col("p")).alias("field"), F.col("o").alias("value")
    ).filter(F.col("field").isNotNull())
    lists = rows.filter(~F.col("field").isin(SCALAR_DETAILS))
    last = (
        rows.filter(F.col("field").isin(SCALAR_DETAILS))
        .groupBy("uri", "field")
        .agg(F.max("value").alias("value"))
    )
    labels = match(triples, p=V.PREF_LABEL).groupBy(F.col("s").alias("value")).agg(
        F.min("o").alias("shown")
    )
    is_country = F.col("field") == "country"
    countries = (
        last.filter(is_country)
        .join(labels, "value", "left")
        .select("uri", "field", F.coalesce("shown", "value").alias("value"))
    )
    return lists.unionByName(countries).unionByName(last.filter(~is_country))


def literals(triples: DataFrame) -> DataFrame:
    """Displayed literals with their place in the display order."""
    rank = F.array_position(F.lit(V.LITERAL_ORDER), F.col("p")) - 1
    rows = triples.filter((F.col("o_kind") == "literal") & F.col("p").isin(V.LITERAL_ORDER))
    return rows.select(
        F.col("s").alias("uri"), F.col("p").alias("predicate"), F.col("o").alias("value"),
        "lang", "dtype", rank.alias("ord"),
        X.format_literal("o", "lang", "dtype").alias("shown"),
    )


def extra_literals(triples: DataFrame, n: int = 15) -> DataFrame:
    """First ``n`` literals of a concept beyond its labels, definitions and notes."""
    shown = ["definition", "prefLabel", "altLabel", "scopeNote", "note", "inScheme"]
    rows = triples.filter(
        (F.col("o_kind") == "literal") & ~X.short_predicate("p").isin(shown)
    )
    return first_n(rows, ["s"], ["p", "o"], n)


def search_documents(triples: DataFrame) -> DataFrame:
    """(id, uri, text, metadata fields) of every concept with a definition.

    Each field takes its first value in text order; scope notes are joined.
    """
    notes = (
        match(triples, p=V.SCOPE_NOTE).select(F.col("s").alias("uri"), F.col("o").alias("note"))
        .distinct()
        .groupBy("uri")
        .agg(F.array_join(F.sort_array(F.collect_set("note")), ", ").alias("notes"))
    )
    definitions = match(triples, p=V.DEFINITION).groupBy(F.col("s").alias("uri")).agg(
        F.min("o").alias("definition")
    )
    parents = match(triples, p=V.BROADER).groupBy(F.col("s").alias("uri")).agg(
        F.min("o").alias("parent")
    )
    docs = (
        concept_fields(triples)
        .drop("scope")
        .join(definitions, "uri")
        .join(notes, "uri", "left")
        .join(parents, "uri", "left")
        .join(country_labels(triples), "country_uri", "left")
        .withColumn("label", F.get("labels", 0))
    )
    fields = {n: X.text_or_empty(n) for n in
              ("label", "definition", "country", "year", "org", "parent")}
    fields["scope"] = X.text_or_empty("notes")
    return docs.select("uri", *[c.alias(n) for n, c in fields.items()]).select(
        X.doc_id("uri").alias("id"),
        "uri",
        X.document_text("label", "definition", "country", "year", "org", "scope", "parent").alias(
            "text"
        ),
        "label", "definition", "country", "year", "org", "scope", "parent",
    )
