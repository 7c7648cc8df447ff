"""Country names: mentions, look-up, resolution and the threshold table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import questions as Q
from thicket.functions import text as X
from thicket.operators.containment import contained_in, near_names
from thicket.session import materialise

# -- country mentions in notes ----------------------------------------------


def note_countries(notes: DataFrame, countries: DataFrame, strict: bool = True) -> DataFrame:
    """P10's choice: (note, name, found) with the country each distinct note names.

    Whole words only, the longest name first, then the earliest; ``found`` is
    the text as the note spells it. ``strict=False`` takes the first country in
    list order whose name occurs anywhere.
    """
    distinct = materialise(notes.select("note").filter(F.col("note") != "").distinct())  # read twice below
    names = countries.select("name", "ord", F.lower("name").alias("needle"))
    pairs = contained_in(
        distinct.select(F.lower("note").alias("hay")), names.select("needle")
    )
    hits = (
        distinct.withColumn("hay", F.lower("note"))
        .join(pairs, "hay")
        .join(names, "needle")
    )
    if strict:
        pattern = F.concat(
            F.lit(r"(?U)(?<!\w)\Q"), F.col("needle"), F.lit(r"\E(?!\w)")
        )
        at = F.regexp_instr("hay", pattern)
        rank = F.struct((-F.length("needle")).alias("a"), at.alias("b"), F.col("ord").alias("c"))
        hits = hits.withColumn("at", at).filter("at > 0")
    else:
        hits = hits.withColumn("at", F.instr(F.col("hay"), F.col("needle")))
        rank = F.struct(F.col("ord").alias("a"))
    best = hits.groupBy("note").agg(
        F.min_by(F.struct("name", "needle", "at"), rank).alias("b")
    )
    found = F.substr(F.col("note"), F.col("b.at"), F.length("b.needle"))
    return best.select("note", F.col("b.name").alias("name"), F.col("b.at").alias("at"),
                       found.alias("found"))


def attribute_notes(
    df: DataFrame, countries: DataFrame, note: str = "source", scope: str = "scope",
    strict: bool = True, notes: DataFrame | None = None,
) -> DataFrame:
    """Adds ``country`` and ``organization`` read from the source note.

    International and general scopes name no country; state and federal notes of
    the United States keep their place in the organisation. ``notes(note)`` can
    name the notes where they are cheaper to read than from ``df``.
    """
    if notes is None:
        notes = df.select(F.col(note).alias("note"))
    found = note_countries(notes, countries, strict)
    found = found.withColumnRenamed("note", note)
    usa = F.lower(F.trim(note)).rlike("^usa-(state|fed)")
    no_country = F.coalesce(F.col(scope), F.lit("")).isin("International", "General")
    text = X.text_or_empty(note)
    plain = F.lit(None).cast("string")
    usa_org = X.strip(F.regexp_replace(text, r"(19|20)\d{2}", ""), r" \-;.&")
    matched = F.when(~no_country, F.col("found"))
    return (
        df.join(found, note, "left")
        .withColumn(
            "country",
            F.when(usa, F.lit("United States"))
            .when(no_country, F.lit(""))
            .otherwise(F.coalesce("name", F.lit(""))),
        )
        .withColumn(
            "organization",
            F.when(usa, usa_org)
            .when(matched.isNull(), X.organisation_residue(text, plain, F.lit(1)))
            .otherwise(X.organisation_residue(text, matched, F.col("at"))),
        )
        .drop("name", "at", "found")
    )


# -- resolution to the reference list ---------------------------------------


def resolve_country(names: DataFrame, countries: DataFrame, edits: int = 2) -> DataFrame:
    """(raw, iso3, display, how) of each distinct name; non-countries are left out.

    Tried in turn: exact name or code, a reference name containing it, a
    reference name at most ``edits`` edits away. What is left keeps its own name
    under a code made from it (``how = 'unresolved'``).
    """
    raw = F.trim(X.text_or_empty("raw"))
    low = F.lower(raw)
    listed = ~low.isin("", "nan", *V.NOT_A_COUNTRY) & ~F.contains(low, F.lit("table 3"))
    bare = F.trim(F.regexp_replace(raw, r"\(\s*\)", ""))
    alias = F.coalesce(
        *[F.when(F.lower(bare) == F.lit(k), F.lit(v)) for k, v in V.COUNTRY_ALIASES.items()], bare
    )
    asked = materialise(  # the distinct names feed every branch below
        names.select("raw").filter(listed).distinct().withColumn("hay", F.lower(alias))
    )
    ref = countries.select("iso3", "name", "alpha2", "ord")
    spellings = ref.select(
        "iso3", "name", "ord",
        F.explode(F.array(F.lower("name"), F.lower("iso3"), F.lower("alpha2"))).alias("hay"),
    ).filter(F.col("hay").isNotNull())
    exact = asked.join(spellings, "hay").select(
        "raw", "iso3", "name", F.lit(0).alias("step"), F.lit(0).alias("cost"), "ord"
    )
    rest = asked.join(exact.select("raw").distinct(), "raw", "left_anti")
    by_name = ref.withColumn("near", F.lower("name"))
    inside = contained_in(
        by_name.select(F.col("near").alias("hay")), rest.select(F.col("hay").alias("needle"))
    ).select(F.col("hay").alias("near"), F.col("needle").alias("hay"))
    partial = rest.join(inside, "hay").join(by_name, "near").select(
        "raw", "iso3", "name", F.lit(1).alias("step"),
        F.instr(F.col("near"), F.col("hay")).alias("cost"), "ord",
    )
    close = near_names(rest, by_name, edits)
    fuzzy = rest.join(close, "hay").join(by_name, "near").select(
        "raw", "iso3", "name", F.lit(2).alias("step"), F.col("distance").alias("cost"), "ord"
    )
    best = (
        exact.unionByName(partial)
        .unionByName(fuzzy)
        .groupBy("raw")
        .agg(F.min(F.struct("step", "cost", "ord", "iso3", "name")).alias("b"))
    )
    code = F.upper(F.substring(F.regexp_replace(F.trim("raw"), "[^A-Za-z0-9]", "_"), 1, 10))
    how = F.element_at(
        F.array(F.lit("exact"), F.lit("partial"), F.lit("near")), F.col("b.step") + 1
    )
    return asked.join(best, "raw", "left").select(
        "raw",
        F.coalesce("b.iso3", code).alias("iso3"),
        F.coalesce("b.name", F.trim("raw")).alias("display"),
        F.coalesce(F.when(F.col("b").isNotNull(), how), F.lit("unresolved")).alias("how"),
    )


# -- the threshold table ----------------------------------------------------


def threshold_keys(thresholds: DataFrame) -> DataFrame:
    return thresholds.withColumn("key", X.norm_country_key("country")).filter(F.col("key") != "")


def exact_else_contains(names: DataFrame, dim: DataFrame, both_ways: bool) -> DataFrame:
    """(hay, key): keys equal to the name, or if none is, those containing it.

    ``both_ways`` also accepts keys contained in the name. Inputs are
    ``names(hay)`` and ``dim(key)``, already normalised.
    """
    names = names.select("hay").filter(F.col("hay") != "").distinct()
    keys = dim.select("key").distinct()
    exact = names.join(keys, F.col("hay") == F.col("key")).select("hay", "key")
    rest = names.join(exact, "hay", "left_anti")
    found = contained_in(
        keys.select(F.col("key").alias("hay")), rest.select(F.col("hay").alias("needle"))
    ).select(F.col("needle").alias("hay"), F.col("hay").alias("key"))
    if both_ways:
        inside = contained_in(rest, keys.select(F.col("key").alias("needle")))
        found = found.unionByName(inside.withColumnRenamed("needle", "key"))
    return exact.unionByName(found.distinct())


def dedupe_threshold_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first row, by ``pos``, of each (country, is_unfccc)."""
    keys = [*by, "country", "is_unfccc"]
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min(F.struct("pos", *[c for c in rest if c != "pos"])).alias("b"))
    return first.select(*keys, "b.*")


def thresholds_of(
    names: DataFrame, thresholds: DataFrame, unfccc_only: bool = False
) -> DataFrame:
    """Threshold rows (one per country and kind) of each distinct ``name``."""
    asked = names.select("name").distinct().withColumn("hay", X.norm_country_key("name"))
    keyed = threshold_keys(thresholds)
    found = exact_else_contains(asked, keyed, both_ways=True)
    rows = asked.join(found, "hay").join(keyed, "key").drop("hay", "key")
    if unfccc_only:
        rows = rows.filter("is_unfccc")
    return dedupe_threshold_rows(rows, ["name"])


def threshold_line(note_chars: int = 120) -> Column:
    def part(col: str, before: str, after: str) -> Column:
        return F.when(
            F.col(col).isNotNull(), F.concat(F.lit(before), F.col(col).cast("string"), F.lit(after))
        )

    kind = F.coalesce(X.blank_to_null(X.text_or_empty("type")), F.lit("unspecified"))
    tag = F.when(F.col("is_unfccc"), F.lit("UNFCCC definition")).otherwise(
        F.concat(F.lit("National definition ("), kind, F.lit(")"))
    )
    note = X.clean_null("notes")
    body = F.concat_ws(
        " | ",
        part("area_ha", "min area ", " ha"),
        part("crown_cover", "crown cover ", "%"),
        part("height_m", "tree height ", " m"),
        part("width_m", "strip width ", " m"),
        F.when(note.isNotNull(), F.concat(F.lit("note: "), F.substring(note, 1, note_chars))),
    )
    body = F.coalesce(X.blank_to_null(body), F.lit("no numerical threshold specified"))
    return F.concat(F.lit("  "), tag, F.lit(": "), body)


def threshold_context(names: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(name, text) with one line per threshold row, in table order."""
    rows = thresholds_of(names, thresholds).withColumn("line", threshold_line())
    lines = F.sort_array(F.collect_list(F.struct("pos", "line")))["line"]
    return rows.groupBy("name").agg(lines.alias("lines")).select(
        "name",
        F.concat(
            F.col("name"), F.lit(V.THRESHOLD_CONTEXT_TITLE), F.lit("\n"),
            F.array_join("lines", "\n"),
        ).alias("text"),
    )


def search_by_threshold(
    names: DataFrame, thresholds: DataFrame, crown: float | None = None,
    area: float | None = None, height: float | None = None,
) -> DataFrame:
    """threshold rows of the names that reach every bound given."""
    rows = thresholds_of(names, thresholds)
    for col, bound in (("crown_cover", crown), ("area_ha", area), ("height_m", height)):
        if bound is not None:
            rows = rows.filter(F.col(col) >= bound)
    return rows


def all_countries(thresholds: DataFrame) -> DataFrame:
    return thresholds.select("country").distinct()


# -- countries in questions -------------------------------------------------


def countries_in_question(questions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(qid, country, pos) of keys that occur as whole words, maximal keys only.

    ``pos`` is the country's first row in the table, the order countries are used in.

    Word n-grams of the question, as long as the longest key, join the keys on
    equality. A key contained in another one found in the same question yields.
    """
    keyed = threshold_keys(thresholds)
    names = keyed.groupBy("key").agg(F.min(F.struct("pos", "country")).alias("f")).select(
        "key", "f.country", "f.pos"
    )
    longest = keyed.agg(F.max(F.size(F.split("key", " "))).alias("n"))
    words = F.split(X.norm_country_key("query"), " ")
    grams = (
        questions.select("qid", words.alias("w"))
        .select("qid", "w", F.explode(F.sequence(F.lit(1), longest.scalar())).alias("n"))
        .filter(F.size("w") >= F.col("n"))
        .select(
            "qid", "w", "n",
            F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"),
        )
        .select("qid", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("key"))
        .distinct()
    )
    found = grams.join(names, "key")
    per_question = found.groupBy("qid").agg(F.collect_set("key").alias("others"))
    longer = F.exists(
        "others", lambda o: (o != F.col("key")) & F.contains(o, F.col("key"))
    )
    kept = found.join(per_question, "qid").filter(~longer)
    return kept.groupBy("qid", "country").agg(F.min("pos").alias("pos"))


def question_countries(
    questions: DataFrame, thresholds: DataFrame, continent_countries: DataFrame
) -> DataFrame:
    """The continent's countries that have a threshold row, else the countries named.

    ``continent_countries`` is (continent, country).
    """
    asked = questions.withColumn("continent", Q.detect_continent("query"))
    keys = threshold_keys(thresholds).select("key").distinct()
    by_continent = (
        asked.join(continent_countries, "continent")
        .withColumn("key", X.norm_country_key("country"))
        .join(keys, "key", "left_semi")
        .select("qid", "country")
        .distinct()
    )
    rest = questions.join(by_continent.select("qid").distinct(), "qid", "left_anti")
    return by_continent.unionByName(
        countries_in_question(rest, thresholds).select("qid", "country")
    )
