"""Column expressions on literal values."""

import pytest
from pyspark.sql import functions as F

from thicket.functions import questions as Q
from thicket.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def cases(spark, fn, pairs):
    got = spark.range(1).select(*[fn(F.lit(a)).alias(f"c{i}") for i, (a, _) in enumerate(pairs)])
    assert list(got.first()) == [b for _, b in pairs]


def test_headings_and_titles(spark):
    cases(spark, X.heading_level, [("Heading 2", 2), ("heading", 1), ("Normal", None)])
    cases(spark, X.clean_title, [("1.2 Basic terms", "Basic terms")])


def test_bold_term(spark):
    runs = [[("Forest ", True), ("land", True), (" is", False)], [("x", False), ("y", True)], []]
    df = spark.createDataFrame([(r,) for r in runs], "runs array<struct<text:string,bold:boolean>>")
    assert [r[0] for r in df.select(X.bold_term("runs")).collect()] == ["Forest land", "", ""]


def test_terms_and_links(spark):
    cases(spark, X.inline_term, [("(FAO 2000) Closed forest - land with trees", "Closed forest")])
    cases(spark, X.parentheses, [("a (b) (c (d))", ["b", "d"])])
    cases(spark, X.urls, [("see http://a.org/x. and http://a.org/x", ["http://a.org/x"])])
    cases(spark, X.references, [("abc Ref. 12;", ["Ref. 12"])])


def test_remove_first_takes_text_literally(spark):
    got = X.remove_first(F.lit(r"a.b \E a.b (x)"), F.lit(r" \E"))
    assert value(spark, got) == "a.b a.b (x)"
    assert value(spark, X.remove_first(F.lit("aab"), F.lit("a"))) == "ab"
    assert value(spark, X.remove_first(F.lit("aab"), F.lit(""))) == "aab"
    assert value(spark, X.remove_first(F.lit("(a)(a)"), F.lit("(a)"))) == "(a)"


def test_junk(spark):
    cases(spark, X.is_junk, [("—", True), ("1.2", True), ("( )", True), ("ok", False), ("--", True)])
    assert value(spark, X.is_junk(F.lit("--"), single_dash=True)) is False


def test_threshold_types(spark):
    cases(
        spark, X.map_threshold_type,
        [("Civer", "Land cover"), ("Admin", "Declared"), ("Topography and cover", "Land cover"),
         ("Potential", "Potential")],
    )


def test_ranges(spark):
    pairs = [("20/30", (20.0, 30.0)), ("0.0625- 0.25", (0.0625, 0.25)), ("0.5", (0.5, None)),
             ("NS", (None, None)), ("<5", (5.0, None)), ("10 to 30", (None, None))]
    cases(spark, X.parse_range, pairs)
    cases(spark, X.lower_bound, [("20/30", 20.0), ("0.0625- 0.25", 0.0625), ("nan", None), ("5d", None)])


def test_country_names(spark):
    cases(spark, X.norm_country_builder, [("Antigua & Barbuda", "Antigua Barbuda"), ("Brazil 2015 KP", "Brazil")])
    cases(spark, X.norm_country_csv, [("UN FRA 2000", "UN FRA")])
    cases(spark, X.norm_country_key, [("Côte d'Ivoire", "cote d ivoire"), ("Antigua & Barbuda", "antigua barbuda")])
    cases(spark, X.norm_country_slug, [("New Zealand", "new-zealand")])


def test_labels(spark):
    cases(spark, X.camel, [("carbon stock", "CarbonStock"), ("semi-natural forest", "SemiNaturalForest")])
    bases = [("", "forest/forest land", "Forest"), ("", "zz", "Concept"), ("--", "TREE", "Concept")]
    for term, title, base in bases:
        assert value(spark, X.base_label(F.lit(term), F.lit(title))) == base


def test_parentheses_cut(spark):
    cases(
        spark, X.strip_paren,
        [("a (b) c (d (e) f", "a (b) c "), ("x ) y (z", "x ) y "), ("(all", ""), ("((a)", ""),
         ("a(b)(c", "a(b)"), ("a) (b) c", "a) (b) c")],
    )
    cases(spark, X.clean_definition, [("land and", "land"), ("(all", "(all"), ("a and.", "a and")])


def test_language(spark):
    cases(spark, X.detect_lang, [("le chat est dans la maison", "fr"), ("xyz", "en"), ("", None)])


def test_question_parts(spark):
    text = F.lit("What is the FAO definition of deforestation?")
    assert value(spark, Q.question_keywords(text)) == ["deforestation", "definition", "fao"]
    assert value(spark, Q.detect_concept(text)) == "deforestation"
    assert value(spark, Q.detect_org(text)) == "FAO"
    assert value(spark, Q.question_keywords(F.lit("the why"))) == ["the", "why"]


@pytest.mark.parametrize(
    "text, new, old",
    [
        ("crown cover of 30% or less", ("minCrown", "le", 30.0), ("minCrown", "le", 30.0)),
        ("area of at least 0.5 ha", ("minArea", "ge", 0.5), ("minArea", "ge", 0.5)),
        ("crown cover 30%", None, ("minCrown", "ge", 30.0)),
        ("tree height no less than 5 m", ("minHeight", "ge", 5.0), ("minHeight", "le", 5.0)),
    ],
)
def test_thresholds_in_questions(spark, text, new, old):
    assert value(spark, Q.detect_threshold(F.lit(text))) == new
    assert value(spark, Q.detect_threshold(F.lit(text), legacy=True)) == old


def test_model_output(spark):
    assert value(spark, Q.parse_filter_json(F.lit("nope"))) is None
    assert value(spark, Q.parse_filter_json(F.lit('x {"org":"FAO","scope":3} y')))["org"] == "FAO"
    assert value(spark, Q.parse_filter_json(F.lit('{"scope":3}')))["scope"] is None
    plan = value(spark, Q.parse_tool_plan(F.lit("nope"), F.lit("q")))
    assert [c["tool"] for c in plan] == ["sparql_search", "vector_search"]


def test_a_text_without_anything_left_has_no_text(spark):
    odd = [None, "", " ", "\t\n\x0b\f\r", "a", " a ", "\n-", " ", "\u0085", "  \n", "é"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    kept = rows.select(X.has_text("text").alias("now"), (X.strip(X.text_or_empty("text")) != "").alias("stripped"))
    assert all(r.now == r.stripped for r in kept.collect()) and kept.where("now").count() >= 4


def test_the_source_is_the_first_note_in_parentheses(spark):
    odd = [None, "", "()", "(a) (b)", "x (a(b) c)", "((deep))", "(open", "() (n 2001 KP)", "(two\nlines)"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    first = F.coalesce(F.get(X.parentheses("text"), 0), F.lit(""))
    assert all(r.now == r.first for r in rows.select(X.source("text").alias("now"), first.alias("first")).collect())
    assert "regexp_extract_all" not in rows.select(X.source("text"))._jdf.queryExecution().analyzed().toString()
