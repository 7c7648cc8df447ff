"""Question text to structured filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket import vocab as V
from thicket.functions.text import ColumnOrName, _c, first_match, folded, matches_folded


def detect_concept(q: ColumnOrName) -> Column:
    return first_match(folded(q), V.CONCEPT_PATTERNS)


def detect_scope(q: ColumnOrName) -> Column:
    return first_match(folded(q), V.SCOPE_PATTERNS)


def detect_org(q: ColumnOrName) -> Column:
    return first_match(folded(q), V.ORG_PATTERNS)


def detect_continent(q: ColumnOrName) -> Column:
    return first_match(folded(q), V.CONTINENT_PATTERNS)


def is_threshold_question(q: ColumnOrName) -> Column:
    return matches_folded(folded(q), V.THRESHOLD_WORDS)


def _direction(low: Column, legacy: bool) -> Column:
    if legacy:
        return F.when(matches_folded(low, V.LE_WORDS), F.lit("le")).when(
            matches_folded(low, V.GE_WORDS), F.lit("ge")
        )
    return (
        F.when(matches_folded(low, r"\bno\s+less\s+than\b"), F.lit("ge"))
        .when(matches_folded(low, r"\bno\s+more\s+than\b"), F.lit("le"))
        .when(matches_folded(low, rf"\b(?:{V.LE_WORDS})\b"), F.lit("le"))
        .when(matches_folded(low, rf"\b(?:{V.GE_WORDS})\b"), F.lit("ge"))
    )


def detect_threshold(q: ColumnOrName, legacy: bool = False) -> Column:
    """struct<field, op, value> of the first field named with a number and a direction.

    Direction words match whole words, and ``no less than`` is read before
    ``less than``; ``legacy`` matches them anywhere in the text instead.
    """
    return _threshold(folded(q), legacy)


def _threshold(low: Column, legacy: bool) -> Column:
    """N5 over folded text; numbers and directions are looked for where a field is named."""
    op = _direction(low, legacy)
    found = []
    for field, keyword, unit in V.THRESHOLD_FIELDS:
        number = F.regexp_extract(low, rf"(?U)(\d+(?:\.\d+)?)\s*(?:{unit})", 1)
        found.append(
            F.when(
                matches_folded(low, keyword) & (number != "") & op.isNotNull(),
                F.struct(
                    F.lit(field).alias("field"),
                    op.alias("op"),
                    number.try_cast("double").alias("value"),
                ),
            )
        )
    return F.coalesce(*found)


def question_words(q: ColumnOrName) -> Column:
    """Lower-cased ASCII words of three or more letters, in text order."""
    words = F.regexp_extract_all(_c(q), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.transform(F.filter(words, lambda w: w.rlike("^[A-Za-z]{3,}$")), lambda w: F.lower(w))


def drop_stopwords(words: Column) -> Column:
    """words without stop words, or all of them when nothing would be left."""
    kept = F.filter(words, lambda w: ~w.isin(V.STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def question_keywords(q: ColumnOrName, n: int = 8) -> Column:
    """The ``n`` longest words, longest first, ties in text order; repeats stay."""
    words = drop_stopwords(question_words(q))
    ranked = F.array_sort(
        F.transform(
            words,
            lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")),
        )
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["w"])


def extract_filters(questions: DataFrame, legacy: bool = False) -> DataFrame:
    """Every question column plus the filters its text states."""
    low = F.col("_folded")  # the text is folded once for all patterns
    return questions.withColumn("_folded", folded("query")).select(
        *questions.columns,
        first_match(low, V.CONCEPT_PATTERNS).alias("concept"),
        first_match(low, V.ORG_PATTERNS).alias("org"),
        first_match(low, V.SCOPE_PATTERNS).alias("scope"),
        first_match(low, V.CONTINENT_PATTERNS).alias("continent"),
        F.array().cast(T.ArrayType(T.StringType())).alias("countries"),
        _threshold(low, legacy).alias("threshold"),
        F.lit("regex").alias("source"),
    )


def is_unspecific() -> Column:
    """Nothing but a concept was found (``forest`` is in nearly every question)."""
    return (
        F.col("org").isNull()
        & F.col("scope").isNull()
        & F.col("continent").isNull()
        & (F.coalesce(F.size("countries"), F.lit(0)) <= 0)
        & F.col("threshold").isNull()
    )


# -- model output -----------------------------------------------------------


def _parsed(text: Column, opening: str, closing: str, kind: str) -> Column:
    """The text, or its widest bracketed part, when that is valid JSON of ``kind``."""
    whole = F.try_parse_json(F.trim(text))
    part = F.try_parse_json(
        F.regexp_extract(text, rf"(?s)(\{opening}.*\{closing})", 1)
    )
    return F.when(
        whole.isNotNull(), F.when(F.schema_of_variant(whole).startswith(kind), whole)
    ).otherwise(F.when(F.schema_of_variant(part).startswith(kind), part))


def _string_field(value: Column, path: str) -> Column:
    node = F.try_variant_get(value, path, "variant")
    text = F.try_variant_get(value, path, "string")
    return F.when((F.schema_of_variant(node) == "STRING") & (text != ""), text)


def parse_filter_json(text: ColumnOrName) -> Column:
    """Struct of suggested filters, null when the text holds no JSON object."""
    value = _parsed(_c(text), "{", "}", "OBJECT")
    names = F.try_variant_get(value, "$.countries", "array<variant>")
    countries = F.transform(
        F.filter(names, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.try_variant_get(v, "$", "string"),
    )
    threshold = F.struct(
        _string_field(value, "$.threshold_field").alias("field"),
        _string_field(value, "$.threshold_op").alias("op"),
        F.try_variant_get(value, "$.threshold_value", "double").alias("value"),
    )
    return F.when(
        value.isNotNull(),
        F.struct(
            *[_string_field(value, f"$.{k}").alias(k)
              for k in ("concept", "org", "scope", "continent")],
            F.coalesce(countries, F.array().cast("array<string>")).alias("countries"),
            threshold.alias("threshold"),
        ),
    )


def parse_tool_plan(text: ColumnOrName, query: ColumnOrName) -> Column:
    """array<struct<tool, query>>; both default tools when the text holds no array.

    A call that names no query runs on the question itself.
    """
    value = _parsed(_c(text), "[", "]", "ARRAY")
    calls = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda v: F.struct(
            F.coalesce(F.try_variant_get(v, "$.tool", "string"), F.lit("")).alias("tool"),
            F.coalesce(F.try_variant_get(v, "$.query", "string"), _c(query)).alias("query"),
        ),
    )
    default = F.array(
        *[F.struct(F.lit(t).alias("tool"), F.lit("").alias("query")) for t in V.DEFAULT_TOOLS]
    )
    return F.coalesce(calls, default)
