"""Patterns over folded text against the case-blind patterns they stand for."""

import pytest
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import questions as Q
from thicket.functions.text import folded, matches_folded

PATTERNS = [p for rows in (V.CONCEPT_PATTERNS, V.SCOPE_PATTERNS, V.ORG_PATTERNS, V.CONTINENT_PATTERNS) for p, _ in rows]
PATTERNS += [V.THRESHOLD_WORDS, V.LE_WORDS, V.GE_WORDS, *[f[1] for f in V.THRESHOLD_FIELDS]]
TEXTS = [
    "FOREST lands", "reſoreſtation, deforestat1on", "Kyoto  PROTOCOL", "İPCC and ıucn", "sub-national",
    "SUBnational", "Semi-Natural FORESTS", "european\nCommission", "UN-FA0 unfccc un-ep UNEP-WCMC", "usa-fed", "kpl KP", "nonforest",
    "the area is 5 ha", "10 Hectares or LESS", "CRITÈRE", "critère", "Americas", "land use LANDCOVER", "Σtree coverΣ", "", None,
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "qid int, query string")


def test_folded_patterns_find_the_same(texts):
    assert all(p == p.lower() for p in PATTERNS)
    old = F.array(*[F.col("query").rlike(f"(?iU){p}") for p in PATTERNS])
    new = F.array(*[matches_folded(folded("query"), p) for p in PATTERNS])
    rows = texts.select("query", old.alias("old"), new.alias("new")).collect()
    assert [(r["query"], r["new"]) for r in rows] == [(r["query"], r["old"]) for r in rows]


def test_filters_read_a_text_folded_once(texts):
    found = Q.extract_filters(texts)
    assert found.columns[:2] == ["qid", "query"] and "_folded" not in found.columns
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(?iU)" not in plan and plan.count("translate(") == 1
