"""Row types of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_TEXTS = T.ArrayType(T.StringType())

TRIPLE = T.StructType(_strings("s", "p", "o", "o_kind", "lang", "dtype"))
TRIPLE_COLS = TRIPLE.fieldNames()

DEFINITION_RECORD = T.StructType(
    _strings("title_1", "title_2", "title_3", "title_4", "bold_terms", "sources")
    + [T.StructField("urls", _TEXTS), T.StructField("references", _TEXTS)]
    + _strings("definition", "organization", "country", "year")
)
DEFINITION_COLS = DEFINITION_RECORD.fieldNames()

THRESHOLD_RAW = T.StructType(
    _strings(
        "countries", "definition_type", "area_ha", "crown_cover_percent", "tree_height_m",
        "strip_width_m", "notes",
    )
)
THRESHOLD_FILE = T.StructType(
    THRESHOLD_RAW.fields + _strings("country_clean", "definition_type_clean", "is_unfccc")
)

RUN = T.StructType([T.StructField("text", T.StringType()), T.StructField("bold", T.BooleanType())])
PARAGRAPH = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("style", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("runs", T.ArrayType(RUN)),
    ]
)
CELL = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("table_no", T.LongType()),
        T.StructField("row_no", T.LongType()),
        T.StructField("col_no", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
COUNTRY = T.StructType(
    _strings("iso3", "name", "alpha2", "continent") + [T.StructField("ord", T.LongType())]
)
EDGE = T.StructType(_strings("src", "dst", "type"))
INVENTORY = T.StructType(_strings("kind", "key", "label"))
THRESHOLD = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
FILTERS = T.StructType(
    _strings("qid", "concept", "org", "scope", "continent")
    + [
        T.StructField("countries", _TEXTS),
        T.StructField("threshold", THRESHOLD),
        T.StructField("source", T.StringType()),
    ]
)
TOOL_CALLS = T.ArrayType(T.StructType(_strings("tool", "query")))
