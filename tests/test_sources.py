"""A threshold file (named by THICKET_THRESHOLD_FILE) and escapes of triple lines."""

import os

import pytest
from pyspark.sql import functions as F

from thicket import schemas as M
from thicket import vocab as V
from thicket.operators.search import org_filter
from thicket.operators.thresholds import richness
from thicket.operators.triples import concept_rows
from thicket.sources import tables as S

TABLE = os.environ.get("THICKET_THRESHOLD_FILE", "")


@pytest.mark.skipif(not TABLE, reason="no threshold file named")
def test_threshold_scan(spark):
    rows = S.read_thresholds(spark, TABLE).cache()
    assert rows.count() == 310
    assert rows.filter("is_unfccc").count() == 89
    crown = rows.groupBy("is_unfccc").agg(F.count("crown_cover"), F.round(F.avg("crown_cover"), 4))
    assert {tuple(r) for r in crown.collect()} == {(False, 92, 24.5543), (True, 88, 21.6761)}
    rich = rows.withColumn("n", richness(["area_ha", "crown_cover", "height_m", "width_m"]))
    got = {r["n"]: r["count"] for r in rich.groupBy("n").count().collect()}
    assert got == {0: 104, 1: 39, 2: 30, 3: 109, 4: 28}
    assert rows.filter("crown_cover >= 30").count() == 69
    assert rows.filter("crown_cover <= 30").count() == 162


HEAD = ",".join(M.THRESHOLD_FILE.fieldNames())
FILES = {
    "b.csv": [
        "Some caption,Some caption,,,,,,Table 3 some caption,,False",
        'Alphaland,Forest,0.5-1,10-30,"2, 3 or 5",nan,"a note, with commas",Alphaland,Forest,False',
        'Betaland,nan,>1,nan,nan,20,"two\nlines and ""quotes""",Betaland,nan,True',
        "nobody,x,1,1,1,1,,nan,,False",
        "Gammaland,,nan,nan,nan,nan,nan,Gammaland,,",
    ],
    "a.csv": [f"L{i},Forest,{i},10,5,nan,nan,L{i},Forest,{i % 2 == 0}" for i in range(500)],
}


@pytest.mark.parametrize("order", [("a.csv", "b.csv"), ("b.csv", "a.csv")])
def test_places_in_files(spark, tmp_path, order):
    for name in order:  # the larger file goes first to a task, whatever its name
        (tmp_path / name).write_text("\n".join([HEAD, *FILES[name]]) + "\n")
    rows = {r.pos: r for r in S.read_thresholds(spark, str(tmp_path)).collect()}
    named = [*range(500), 501, 502, 504]  # the caption and the row without a country have places, too
    assert sorted(rows) == named
    assert [rows[i].country for i in range(500)] == [f"L{i}" for i in range(500)]
    a, b, c = rows[501], rows[502], rows[504]
    assert (a.country, a.area_ha, a.crown_cover, a.width_m, a.notes) == ("Alphaland", 0.5, 10.0, None, "a note, with commas")
    assert (b.country, b.is_unfccc, b.width_m, b.notes) == ("Betaland", True, 20.0, 'two\nlines and "quotes"')
    assert (c.country, c.area_ha, c.is_unfccc, c.notes) == ("Gammaland", None, False, "")


def test_triple_escapes(spark, tmp_path):
    rows = [
        ("http://a/x", "http://a/p", 'say "hi" \\ there\nnext\tcol', "literal", "en", None),
        ("http://a/x", "http://a/p", "plain", "literal", None, "http://a/t"),
        ("_:b0", "http://a/p", "http://a/y", "iri", None, None),
    ]
    df = spark.createDataFrame(rows, M.TRIPLE)
    S.write_triples(df, str(tmp_path / "t"))
    assert {tuple(r) for r in S.read_triples(spark, str(tmp_path / "t")).collect()} == set(rows)
    S.write_triples(df, str(tmp_path / "t.parquet"))
    assert {tuple(r) for r in S.read_triples(spark, str(tmp_path / "t.parquet")).collect()} == set(rows)


def test_unicode_escape(spark):
    lines = spark.createDataFrame([(r'<http://a/x> <http://a/p> "café \'s"@fr .',), ("# note",)], "value string")
    assert [r["o"] for r in S.parse_triples(lines).collect()] == ["café 's"]


def test_rejected_lines(spark):
    good = '<http://a/x> <http://a/p> "" .'
    bad = {
        '<http://a/x> <http://a/p> "a"': "no closing dot",
        'x <http://a/p> "a" .': "subject is no IRI or blank node",
        '<http://a/x> p "a" .': "predicate is no IRI",
        '<http://a/x> <http://a/p> "a .': "object does not parse",
    }
    lines = spark.createDataFrame([(t,) for t in (good, "", "  # note", *bad)], "value string")
    assert {r["value"]: r["reason"] for r in S.rejected_lines(lines).collect()} == bad
    assert [r["o"] for r in S.parse_triples(lines).collect()] == [""]


def test_every_label_of_a_concept_is_searched(spark):
    rows = [
        ("http://a/x", V.TYPE, V.CONCEPT, "iri", None, None),
        ("http://a/x", V.PREF_LABEL, "one", "literal", "en", None),
        ("http://a/x", V.PREF_LABEL, "two", "literal", "en", None),
        ("http://a/x", V.DEFINITION, "text", "literal", "en", None),
        ("http://a/x", V.CREATOR, "Some Office (XYZ)", "literal", None, None),
    ]
    found = concept_rows(spark.createDataFrame(rows, M.TRIPLE))
    assert sorted(r["label"] for r in found.collect()) == ["one", "two"]
    assert found.filter(org_filter(F.lit("xyz"))).count() == 2
    assert found.filter(org_filter(F.lit("abc"))).count() == 0
