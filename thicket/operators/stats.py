"""Scalar statistics of the triples table, one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.functions import text as X


def _p(predicate: str) -> Column:
    return F.col("p") == predicate


def _distinct(col: str, when: Column) -> Column:
    return F.count_distinct(F.when(when, F.col(col)))


def _common() -> dict[str, Column]:
    aligned = _p(V.EXACT_MATCH) & F.col("o").startswith(V.ALIGN_PREFIX)
    return {
        "total_triples": F.count("*"),
        "total_concepts": F.count_if(_p(V.TYPE) & (F.col("o") == V.CONCEPT)),
        "with_broad_match": _distinct("s", _p(V.BROAD_MATCH)),
        "with_definition": F.count_if(_p(V.DEFINITION)),
        "with_thresholds": _distinct("s", _p(V.EX + "minAreaHa")),
        "agrovoc_aligned": F.count_if(aligned),
    }


def _agg(triples: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return triples.agg(*[c.alias(n) for n, c in columns.items()])


def graph_stats(triples: DataFrame, unfccc_parent: str = V.EX + "Forest_500") -> DataFrame:
    """A1: eight counts; definitions and alignments count triples, the rest nodes."""
    columns = _common() | {
        "countries_count": _distinct("o", _p(V.SPATIAL)),
        "unfccc_concepts": F.count_if(_p(V.BROAD_MATCH) & (F.col("o") == unfccc_parent)),
    }
    return _agg(triples, columns)


def _unfccc_members() -> Column:
    return F.count_if(_p(V.MEMBER) & (F.col("s") == V.EX + "Org_UNFCCC"))


def build_stats(triples: DataFrame) -> DataFrame:
    """A2: ten values after a build."""

    def collections(prefix: str) -> Column:
        named = F.col("s").startswith(V.EX + prefix)
        return F.count_if(_p(V.TYPE) & (F.col("o") == V.COLLECTION) & named)

    columns = _common() | {
        "unfccc_concepts": _unfccc_members(),
        "top_concepts": F.count_if(_p(V.TOP_OF)),
        "scope_collections": collections("Scope_"),
        "type_collections": collections("Type_"),
    }
    return _agg(triples, columns)


REPORT_LABELS = {
    "total_triples": "Total triples",
    "total_concepts": "Total skos:Concept",
    "with_broad_match": "With skos:broadMatch",
    "with_definition": "With definition",
    "unfccc_concepts": "UNFCCC concepts",
    "with_thresholds": "With threshold minAreaHa",
    "agrovoc_aligned": "Alignments",
    "top_concepts": "Top concepts",
    "collections": "SKOS collections",
    "countries": "Countries (dct:spatial)",
}


def stats_report(triples: DataFrame) -> DataFrame:
    """A3: (metric, value) rows of a stored graph."""
    columns = _common() | {
        "unfccc_concepts": _unfccc_members(),
        "top_concepts": F.count_if(_p(V.TOP_OF)),
        "collections": F.count_if(_p(V.TYPE) & (F.col("o") == V.COLLECTION)),
        "countries": _distinct("o", _p(V.SPATIAL)),
    }
    one = _agg(triples, {REPORT_LABELS[n]: columns[n] for n in REPORT_LABELS})
    return one.unpivot([], list(REPORT_LABELS.values()), "metric", "value")


def definition_issues(triples: DataFrame) -> DataFrame:
    """Definitions with unbalanced parentheses and with a trailing ``and``."""
    definitions = triples.filter(_p(V.DEFINITION) & (F.col("o_kind") == "literal"))
    return definitions.agg(
        F.count_if(X.unbalanced_parens("o")).alias("parenthesis"),
        F.count_if(X.has_trailing_and("o")).alias("trailing_and"),
    )


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    """A24."""
    return df.agg(F.count("*").alias(name))
