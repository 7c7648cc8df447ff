"""What the graph contains, and checking suggestions against it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import questions as Q
from thicket.functions import text as X
from thicket.operators.countries import exact_else_contains
from thicket.operators.triples import instances, match

COLLECTION_KINDS = {"org": "Org_", "scope": "Scope_", "continent": "Continent_"}


def top_concepts(triples: DataFrame, scheme: str = V.SCHEME) -> DataFrame:
    """(uri, label): top concepts of the scheme with their English label."""
    tops = match(triples, p=V.TOP_OF, o=scheme).select("s")
    labels = match(triples, p=V.PREF_LABEL).filter(F.col("lang") == "en")
    return labels.join(tops, "s", "left_semi").select(
        F.col("s").alias("uri"), F.col("o").alias("label")
    ).distinct()


def discover_inventory(triples: DataFrame, scheme: str = V.SCHEME) -> DataFrame:
    """(kind, key, label) of top concepts and of the prefixed collections."""
    concepts = top_concepts(triples, scheme).select(
        F.lit("concept").alias("kind"), X.local_name("uri").alias("key"), "label"
    )
    labelled = (
        match(triples, p=V.PREF_LABEL)
        .filter(F.col("s").startswith(V.EX))
        .join(instances(triples, V.COLLECTION), "s", "left_semi")
    )
    name = X.local_name("s")
    kind = F.coalesce(
        *[F.when(name.startswith(p), F.lit(k)) for k, p in COLLECTION_KINDS.items()]
    )
    key = F.regexp_replace(name, "^(Org|Scope|Continent)_", "")
    collections = labelled.select(kind.alias("kind"), key.alias("key"), F.col("o").alias("label"))
    rows = concepts.unionByName(collections.filter(F.col("kind").isNotNull()))
    return rows.groupBy("kind", "key").agg(F.min("label").alias("label"))


def pattern_keys(spark: SparkSession) -> DataFrame:
    """(kind, key) the question patterns can produce."""
    tables = {
        "concept": V.CONCEPT_PATTERNS, "org": V.ORG_PATTERNS, "scope": V.SCOPE_PATTERNS,
        "continent": V.CONTINENT_PATTERNS,
    }
    rows = sorted({(kind, key) for kind, table in tables.items() for _, key in table})
    return spark.createDataFrame(rows, "kind string, key string")


def validate_patterns(inventory: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kind, key, reason) of keys only the patterns or only the graph knows."""
    left = patterns.select("kind", "key", F.lower("key").alias("low"))
    right = inventory.select("kind", "key", F.lower("key").alias("low"))
    dead = left.join(right, ["kind", "low"], "left_anti").withColumn("reason", F.lit("dead pattern"))
    unseen = right.join(left, ["kind", "low"], "left_anti").withColumn(
        "reason", F.lit("no pattern")
    )
    return dead.unionByName(unseen).select("kind", "key", "reason")


def validate(filters: DataFrame, inventory: DataFrame) -> DataFrame:
    """Filter values in the inventory's spelling; unknown ones become null."""

    def checked(df: DataFrame, kind: str) -> DataFrame:
        known = (
            inventory.filter(F.col("kind") == kind)
            .groupBy(F.lower("key").alias("_low"))
            .agg(F.min("key").alias("_key"))
        )
        joined = df.join(known, F.lower(kind) == F.col("_low"), "left")
        return joined.withColumn(kind, F.col("_key")).drop("_low", "_key")

    return reduce(checked, ["concept", "org", "scope", "continent"], filters)


def validate_countries(filters: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Suggested countries as the threshold table spells them, in their order.

    Exact names first, else names contained in one another; the smallest name
    wins when several match.
    """
    known = thresholds.select("country").distinct().withColumn("key", F.lower("country"))
    asked = filters.select("qid", F.posexplode("countries").alias("i", "name"))
    asked = asked.withColumn("hay", F.lower("name"))
    found = exact_else_contains(asked, known, both_ways=True)
    named = found.join(known, "key").groupBy("hay").agg(F.min("country").alias("country"))
    listed = (
        asked.join(named, "hay")
        .groupBy("qid")
        .agg(F.sort_array(F.collect_list(F.struct("i", "country")))["country"].alias("_found"))
    )
    empty = F.array().cast("array<string>")
    return (
        filters.join(listed, "qid", "left")
        .withColumn("countries", F.coalesce("_found", empty))
        .drop("_found")
    )


FILTER_VALUES = ["concept", "org", "scope", "continent"]


def _threshold_value(side: str, field: str) -> Column:
    return F.col(f"{side}threshold")[field]


def merge_filters(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Base values win, suggestions fill the gaps; a suggested row marks the source."""
    names = [*FILTER_VALUES, "countries", "threshold"]
    side = extra.select("qid", *[F.col(n).alias(f"s_{n}") for n in names], F.lit(True).alias("s_"))
    listed = F.size(F.coalesce("countries", F.array().cast("array<string>"))) > 0
    merged = base.join(side, "qid", "left")
    threshold = F.struct(
        *[
            F.coalesce(_threshold_value("", f), _threshold_value("s_", f)).alias(f)
            for f in ("field", "op", "value")
        ]
    )
    return merged.select(
        *[c for c in base.columns if c not in (*names, "source")],
        *[F.coalesce(n, f"s_{n}").alias(n) for n in FILTER_VALUES],
        F.when(listed, F.col("countries"))
        .otherwise(F.coalesce("s_countries", F.array().cast("array<string>")))
        .alias("countries"),
        F.when(threshold["field"].isNotNull() | threshold["op"].isNotNull()
               | threshold["value"].isNotNull(), threshold).alias("threshold"),
        F.when(F.col("s_"), F.lit("llm")).otherwise(F.col("source")).alias("source"),
    )


def apply_suggestions(
    base: DataFrame, suggestions: DataFrame, inventory: DataFrame, thresholds: DataFrame,
    mode: str = "auto",
) -> DataFrame:
    """Suggestions (qid, text), parsed, validated and merged.

    ``off`` ignores them, ``auto`` uses them for questions without a specific
    filter, ``always`` for every question.
    """
    if mode == "off":
        return base
    allowed = base.select("qid") if mode == "always" else base.filter(Q.is_unspecific()).select("qid")
    parsed = (
        suggestions.join(allowed, "qid", "left_semi")
        .select("qid", Q.parse_filter_json("text").alias("f"))
        .filter(F.col("f").isNotNull())
        .select("qid", "f.*")
    )
    known = validate_countries(validate(parsed, inventory), thresholds)
    return merge_filters(base, known)
