"""Graph, threshold, document and question views over the driver's tables.

Each view is given once as SQL expressions that Spark and DuckDB both read. On
Spark they become one pass over the base table, for the reference SQL they
become common table expressions. Value conditions such as ``bal >= 500`` give
the rows different shapes; no row is left out by them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.operators.postings import KeywordIndex, add_batch
from thicket.operators.triples import concept_rows
from thicket.schemas import TRIPLE_COLS
from thicket.session import materialise, shared_folder
from thicket.sources.tables import read_triples, write_triples


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the scan has fewer splits than there are cores.

    A table kept as one small file would otherwise run its expressions in one
    task; a table of many files is left where it lies.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# -- concepts ---------------------------------------------------------------

CONTINENT = (
    "CASE r_name WHEN 'AFRICA' THEN 'Africa' WHEN 'AMERICA' THEN 'SouthAmerica' "
    "WHEN 'ASIA' THEN 'Asia' WHEN 'EUROPE' THEN 'Europe' ELSE 'Oceania' END"
)
BASE_SQL = f"""
kgn AS (SELECT n_nationkey AS nkey, n_name AS nat, {CONTINENT} AS continent
        FROM nation JOIN region ON n_regionkey = r_regionkey),
kgc AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_acctbal AS bal,
               nkey, nat, continent
        FROM customer JOIN kgn ON c_nationkey = nkey),
kgs AS (SELECT DISTINCT c_mktsegment AS seg FROM customer)"""


def nations(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "nation").join(
        load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return rows.select(
        F.col("n_nationkey").alias("nkey"), F.col("n_name").alias("nat"),
        F.expr(CONTINENT).alias("continent"),
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    # the nations travel: customers dealt out to all cores must not be gathered again as the small side
    rows = spread(load(spark, d, "customer")).join(
        F.broadcast(nations(spark, d)), F.col("c_nationkey") == F.col("nkey")
    )
    return rows.select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"), "nkey", "nat",
        "continent",
    )


def _lit(text: str) -> str:
    return "'" + text + "'"


_URI = f"'{V.EX}C_' || k"
_LAND = f"'{V.EX}Country_' || nkey"
_TOP = f"'{V.EX}' || seg"


def _whole(expr: str) -> str:
    return f"cast(floor({expr}) as bigint)"


# (subject, predicate, object, kind, lang, dtype, condition) of each triple a row gives
Spec = tuple[str, str, str, str, str | None, str | None, str]
_CONCEPT_SPEC: list[Spec] = [
    (_URI, V.TYPE, _lit(V.CONCEPT), "iri", None, None, "true"),
    (_URI, V.IN_SCHEME, _lit(V.SCHEME), "iri", None, None, "true"),
    (_URI, V.BROAD_MATCH, _TOP, "iri", None, None, "true"),
    (_URI, V.PREF_LABEL, "name", "literal", "en", None, "bal >= 0"),
    (_URI, V.PREF_LABEL, "'Client ' || k", "literal", "fr", None, "bal >= 4000"),
    (_URI, V.ALT_LABEL, "'alt ' || lower(name)", "literal", "en", None, "bal < 1000"),
    (_URI, V.DEFINITION,
     "'Land of ' || lower(seg) || ' type in ' || nat || ' (held by ' || name || ') with canopy'",
     "literal", "en", None, "bal >= 500"),
    (_URI, V.DEFINITION, "'Terre de ' || nat || ' (' || lower(seg) || ' et forest and'",
     "literal", "fr", None, "bal >= 8000"),
    (_URI, V.SPATIAL, _LAND, "iri", None, None, "true"),
    (_URI, V.DATE, "1990 + nkey", "literal", None, V.GYEAR, "bal >= 2000"),
    (_URI, V.CREATOR, "'FAO ' || seg", "literal", None, None, "bal >= 6000"),
    (_URI, V.CREATOR, "'KP'", "literal", None, None, "bal >= 2000 and bal < 3000"),
    (_URI, V.SCOPE_NOTE, "'Land use'", "literal", "en", None, "bal >= 3000"),
    (_URI, V.SCOPE_NOTE, "'Land cover'", "literal", "en", None, "bal >= 7000"),
    (_URI, V.EX + "minAreaHa", _whole("bal / 1000") + " || '.5'", "literal", None, V.DECIMAL,
     "bal >= 1000"),
    (_URI, V.EX + "maxAreaHa", _whole("bal / 100") + " || '.0'", "literal", None, V.DECIMAL,
     "bal >= 9500"),
    (_URI, V.EX + "minCrownCoverPct", _whole("bal / 250") + " || '.0'", "literal", None, V.DECIMAL,
     "bal >= 2500"),
    (_URI, V.EX + "minTreeHeightM", _whole("bal / 2000") + " || '.0'", "literal", None, V.DECIMAL,
     "bal >= 4500"),
    (_URI, V.EX + "minStripWidthM", "'20.0'", "literal", None, V.DECIMAL, "bal >= 8500"),
    (_URI, V.RELATED, f"'{V.EX}C_' || {_whole('k / 10')}", "iri", None, None, "bal >= 9000"),
    (_URI, V.EXACT_MATCH, f"'{V.ALIGN}c_' || k", "iri", None, None, "bal >= 9800"),
    (f"'{V.EX}Scope_National'", V.MEMBER, _URI, "iri", None, None, "bal < 3000"),
    (f"'{V.EX}Scope_International'", V.MEMBER, _URI, "iri", None, None, "bal >= 7500"),
    (f"'{V.EX}Org_FAO'", V.MEMBER, _URI, "iri", None, None, "bal >= 6500"),
    (f"'{V.EX}Org_KP'", V.MEMBER, _URI, "iri", None, None, "bal >= 2000 and bal < 2500"),
    (f"'{V.EX}Org_UNFCCC'", V.MEMBER, _URI, "iri", None, None, "bal >= 1000 and bal < 2000"),
    (f"'{V.EX}Type_Land_use'", V.MEMBER, _URI, "iri", None, None, "bal >= 3000"),
]
_COUNTRY_SPEC: list[Spec] = [
    (_LAND, V.TYPE, _lit(V.CONCEPT), "iri", None, None, "true"),
    (_LAND, V.PREF_LABEL, "nat", "literal", "en", None, "true"),
    (_LAND, V.NOTATION, "'N' || nkey", "literal", None, None, "true"),
    (_LAND, V.IN_SCHEME, _lit(V.SCHEME), "iri", None, None, "true"),
    (_lit(V.COUNTRIES), V.MEMBER, _LAND, "iri", None, None, "true"),
    (f"'{V.EX}Continent_' || continent", V.MEMBER, _LAND, "iri", None, None, "true"),
]
_TOP_SPEC: list[Spec] = [
    (_TOP, V.TYPE, _lit(V.CONCEPT), "iri", None, None, "true"),
    (_TOP, V.IN_SCHEME, _lit(V.SCHEME), "iri", None, None, "true"),
    (_TOP, V.TOP_OF, _lit(V.SCHEME), "iri", None, None, "true"),
    (_TOP, V.PREF_LABEL, "seg", "literal", "en", None, "true"),
    (_TOP, V.EXACT_MATCH, f"'{V.ALIGN}c_' || length(seg)", "iri", None, None, "true"),
    (_lit(V.SCHEME), V.HAS_TOP, _TOP, "iri", None, None, "true"),
    (_TOP, V.RELATED, f"'{V.EX}MACHINERY'", "iri", None, None, "seg <> 'MACHINERY'"),
    (f"'{V.EX}MACHINERY'", V.RELATED, _TOP, "iri", None, None, "seg <> 'MACHINERY'"),
    (_lit(V.SCHEME), V.TYPE, _lit(V.SCHEME_CLASS), "iri", None, None, "seg = 'MACHINERY'"),
    (_lit(V.SCHEME), V.PREF_LABEL, "'Vocabulary'", "literal", "en", None, "seg = 'MACHINERY'"),
]


def _spec_sql(spec: list[Spec], table: str) -> str:
    def text(value: str | None) -> str:
        return "cast(NULL as varchar)" if value is None else _lit(value)

    return " UNION ALL ".join(
        f"SELECT {s} AS s, '{p}' AS p, cast({o} as varchar) AS o, '{kind}' AS o_kind, "
        f"{text(lang)} AS lang, {text(dtype)} AS dtype FROM {table} WHERE {cond}"
        for s, p, o, kind, lang, dtype, cond in spec
    )


KG_SQL = f"""{BASE_SQL},
kg0 AS ({_spec_sql(_CONCEPT_SPEC, "kgc")} UNION ALL {_spec_sql(_COUNTRY_SPEC, "kgn")}
        UNION ALL {_spec_sql(_TOP_SPEC, "kgs")}),
colls AS (SELECT DISTINCT s FROM kg0 WHERE p = '{V.MEMBER}'),
kg AS MATERIALIZED (SELECT * FROM kg0
       UNION ALL SELECT s, '{V.TYPE}', '{V.COLLECTION}', 'iri', NULL, NULL FROM colls
       UNION ALL SELECT s, '{V.PREF_LABEL}', 'Members of ' || replace(s, '{V.EX}', ''),
                        'literal', 'en', NULL FROM colls)"""


def _spec_rows(df: DataFrame, spec: list[Spec]) -> DataFrame:
    structs = [
        F.expr(
            f"IF({cond}, named_struct('s', {s}, 'p', '{p}', 'o', cast({o} as string), "
            f"'o_kind', '{kind}', 'lang', cast({'NULL' if lang is None else _lit(lang)} as string), "
            f"'dtype', cast({'NULL' if dtype is None else _lit(dtype)} as string)), NULL)"
        )
        for s, p, o, kind, lang, dtype, cond in spec
    ]
    return df.select(F.explode(F.array(*structs)).alias("t")).where("t IS NOT NULL").select("t.*")


def _member_spec(spec: list[Spec]) -> list[Spec]:
    return [t for t in spec if t[1] == V.MEMBER]


def kg_rows(spark: SparkSession, d: str) -> DataFrame:
    owners, places = customers(spark, d), nations(spark, d)
    segments = load(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")).distinct()
    rows = (
        _spec_rows(owners, _CONCEPT_SPEC)
        .unionByName(_spec_rows(places, _COUNTRY_SPEC))
        .unionByName(_spec_rows(segments, _TOP_SPEC))
    )
    # collections come from the members alone, so the other triples are not made a second time
    colls = _spec_rows(owners, _member_spec(_CONCEPT_SPEC)).unionByName(
        _spec_rows(places, _member_spec(_COUNTRY_SPEC))
    ).select("s").distinct()
    named = F.array(
        F.struct(
            F.lit(V.TYPE).alias("p"), F.lit(V.COLLECTION).alias("o"), F.lit("iri").alias("o_kind"),
            F.lit(None).cast("string").alias("lang"),
        ),
        F.struct(
            F.lit(V.PREF_LABEL).alias("p"),
            F.concat(F.lit("Members of "), F.replace("s", F.lit(V.EX), F.lit(""))).alias("o"),
            F.lit("literal").alias("o_kind"), F.lit("en").alias("lang"),
        ),
    )
    described = colls.select("s", F.explode(named).alias("t")).select(
        "s", "t.*", F.lit(None).cast("string").alias("dtype")
    )
    return rows.select(*TRIPLE_COLS).unionByName(described.select(*TRIPLE_COLS))


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, d: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of a table or index that is made from the tables in ``d`` on first use."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _STORED:
        path = f"{shared_folder(spark)}/{name}-{len(_STORED)}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


def _storable(rows: DataFrame) -> DataFrame:
    """Distinct triples that have a line of their own: no part is null, and no IRI ends early or breaks the line."""
    broken = "[>\n\r\u001f]"
    whole = ~F.col("s").rlike(broken) & F.col("p").isNotNull() & F.col("o").isNotNull()
    return rows.where(whole & ((F.col("o_kind") == "literal") | ~F.col("o").rlike(broken))).dropDuplicates()


def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    """The graph as a stored table split by predicate, written on first use."""
    write = lambda path: write_triples(_storable(kg_rows(spark, d)), f"{path}/triples.parquet")
    return read_triples(spark, f"{stored_once(spark, d, 'graph', write)}/triples.parquet")


def concept_postings(spark: SparkSession, d: str) -> KeywordIndex:
    """The stored keyword index of the graph's concepts."""
    write = lambda path: add_batch(KeywordIndex(path), materialise(concept_rows(kg_triples(spark, d))))
    return KeywordIndex(stored_once(spark, d, "concept-postings", write))


def document_postings(spark: SparkSession, d: str) -> KeywordIndex:
    """The stored keyword index of the documents."""
    return KeywordIndex(stored_once(spark, d, "document-postings", lambda path: add_batch(KeywordIndex(path), documents(spark, d))))


# -- reference countries ----------------------------------------------------

COUNTRY_EXPRS = {
    "iso3": "'N' || nkey", "name": "nat", "alpha2": "cast(NULL as {text})",
    "continent": "continent", "ord": "cast(nkey as bigint)",
}


def countries(spark: SparkSession, d: str) -> DataFrame:
    return nations(spark, d).select(
        *[F.expr(e.format(text="string")).alias(n) for n, e in COUNTRY_EXPRS.items()]
    )


COUNTRY_SQL = "dim AS (SELECT " + ", ".join(
    f"{e.format(text='varchar')} AS {n}" for n, e in COUNTRY_EXPRS.items()
) + " FROM kgn)"

# -- threshold table --------------------------------------------------------

_T3 = {
    "pos": "k",
    "countries": "nat || CASE WHEN bal > 5000 THEN ' UNFCCC' WHEN bal > 3000 THEN ' 2015 KP' "
                 "ELSE '' END",
    "definition_type": "CASE seg WHEN 'AUTOMOBILE' THEN 'Topography and cover' "
                       "WHEN 'BUILDING' THEN 'Use' WHEN 'FURNITURE' THEN 'Admin' "
                       "WHEN 'HOUSEHOLD' THEN 'Potential' ELSE 'nan' END",
    "area_ha": "CASE WHEN bal < 0 THEN 'nan' WHEN bal < 4000 THEN "
               + _whole("bal / 1000") + " || '.5' ELSE " + _whole("bal / 1000") + " || '-' || "
               + _whole("bal / 500") + " END",
    "crown_cover_percent": "CASE WHEN bal < 1000 THEN 'NS' WHEN bal < 7000 THEN "
                           + _whole("bal / 200") + " || '/' || " + _whole("bal / 100")
                           + " ELSE '<' || " + _whole("bal / 300") + " END",
    "tree_height_m": "CASE WHEN bal < 2000 THEN 'nan' ELSE '' || " + _whole("bal / 900") + " END",
    "strip_width_m": "CASE WHEN bal < 6000 THEN 'none' ELSE '20' END",
    "notes": "CASE WHEN bal > 8000 THEN 'See http://t.example.org/' || k || '.pdf, and ' || seg "
             "WHEN bal > 4000 THEN 'Note on ' || name ELSE 'nan' END",
    "country_clean": "nat",
    "definition_type_clean": "CASE seg WHEN 'AUTOMOBILE' THEN 'Land cover' "
                             "WHEN 'BUILDING' THEN 'Land use' WHEN 'FURNITURE' THEN 'Declared' "
                             "ELSE 'nan' END",
    "is_unfccc": "CASE WHEN bal > 5000 THEN 'True' ELSE 'False' END",
}
T3_SQL = "t3 AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _T3.items()) + " FROM kgc)"


def thresholds_raw(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).select(*[F.expr(e).alias(n) for n, e in _T3.items()])


def _bound_sql(col: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(trim(split_part(split_part({col}, '/', 1), '-', 1)), "
        rf"'(\d+(\.\d*)?|\.\d+)') THEN "
        f"try_cast(trim(split_part(split_part({col}, '/', 1), '-', 1)) AS double) END"
    )


# typed threshold rows, as the scan gives them
TS_SQL = f"""ts AS (SELECT country_clean AS country,
    CASE WHEN definition_type_clean = 'nan' THEN '' ELSE definition_type_clean END AS type,
    is_unfccc = 'True' AS is_unfccc, {_bound_sql('area_ha')} AS area_ha,
    {_bound_sql('crown_cover_percent')} AS crown_cover, {_bound_sql('tree_height_m')} AS height_m,
    {_bound_sql('strip_width_m')} AS width_m, CASE WHEN notes = 'nan' THEN '' ELSE notes END AS notes,
    countries AS source_row, pos FROM t3)"""

NAMES_SQL = """names AS (SELECT nat AS name FROM kgn
    UNION SELECT 'Republic of ' || nat FROM kgn UNION SELECT DISTINCT continent FROM kgn
    UNION SELECT left(nat, 6) FROM kgn)"""


def names(spark: SparkSession, d: str) -> DataFrame:
    """Country names asked for: exact, wrapped, cut short, and unknown ones."""
    spellings = F.expr("explode(array(nat, 'Republic of ' || nat, continent, left(nat, 6)))")
    return nations(spark, d).select(spellings.alias("name")).distinct()


# -- definition lines -------------------------------------------------------

_LINE = {
    "a": "l_orderkey", "b": "l_linenumber", "c": "l_partkey", "d": "l_suppkey",
    "note": "n_name || ' ' || year(o_orderdate) || ' ' || p_brand || ' KP'",
    "text": "'(' || n_name || ' ' || year(o_orderdate) || ' ' || p_brand || ' KP) ' || "
            "upper(p_type) || ' - ' || p_name || ' land http://d.example.org/' || l_partkey || "
            "'. Ref. ' || l_orderkey",
    "title_1": "CASE WHEN l_quantity < 25 THEN 'Basic terms' ELSE 'Action terms' END",
    "title_2": "CASE WHEN p_size < 10 THEN 'FOREST/FOREST LAND' WHEN p_size < 20 THEN 'Tree' "
               "WHEN p_size < 30 THEN 'Land use' ELSE 'Other' END",
    "title_3": "CASE l_returnflag WHEN 'A' THEN 'National definitions' "
               "WHEN 'N' THEN 'International definitions' ELSE 'General' END",
    "title_4": "CASE l_linestatus WHEN 'O' THEN 'As a land use type' ELSE '' END",
    "p_type": "p_type", "p_name": "p_name", "p_brand": "p_brand", "nat": "n_name",
}
_LINE_FROM = """lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey"""
LINES_SQL = "lines AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _LINE.items()) + (
    f" FROM {_LINE_FROM})"
)
#: Lines that still tie agree in every column that records are made of.
LINE_ORDER = ["a", "b", "c", "d", "title_1", "title_2", "title_3", "title_4"]


_LINE_ITEM = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
    "l_linestatus",
]
_LINE_PARTS = [*_LINE_ITEM, "o_orderdate", "n_name", "p_type", "p_name", "p_brand", "p_size"]


def line_parts(spark: SparkSession, d: str) -> DataFrame:
    """What a definition line is made of: no text yet, so a row that has to travel is a short one.

    Orders meet their customers first, so that the lines are not shuffled once more for them.
    """
    owners = (
        load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(load(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
        .join(load(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
        .select("o_orderkey", "o_orderdate", "n_name")
    )
    return (
        spread(load(spark, d, "lineitem").select(*_LINE_ITEM))
        .join(owners, F.expr("l_orderkey = o_orderkey"))
        .join(load(spark, d, "part"), F.expr("l_partkey = p_partkey"))
        .select(*_LINE_PARTS)
    )


def line_texts(parts: DataFrame, *more: str) -> DataFrame:
    """The definition lines of their parts; columns named in ``more`` are kept."""
    return parts.select(*more, *[F.expr(e).alias(n) for n, e in _LINE.items()])


def line_order(*names: str) -> list[Column]:
    """Columns of a line as expressions of its parts, to order by."""
    return [F.expr(_LINE[n]) for n in names]


def def_lines(spark: SparkSession, d: str) -> DataFrame:
    return line_texts(line_parts(spark, d))


# -- paragraphs -------------------------------------------------------------

_PARA = {
    "doc_id": "'' || l_orderkey", "b": "l_linenumber", "c": "l_partkey", "e": "l_suppkey",
    "style": "CASE WHEN l_returnflag = 'A' THEN 'Heading 1' WHEN l_returnflag = 'R' THEN 'Normal' "
             "WHEN l_linestatus = 'O' THEN 'heading 2' ELSE 'Heading 3' END",
    "text": "CASE WHEN l_returnflag = 'R' THEN 'Body ' || l_partkey || ' of ' || l_suppkey "
            "ELSE l_linenumber || '.' || l_suppkey || ' Title ' || l_partkey END",
}
PARA_SQL = "para AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b, c, e) AS pos FROM (" + (
    "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _PARA.items()) + " FROM lineitem))"
)


def paragraph_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = spread(load(spark, d, "lineitem").select(*_LINE_ITEM))
    return lines.select(*[F.expr(e).alias(n) for n, e in _PARA.items()])


# -- documents and questions ------------------------------------------------

DOCS_SQL = "docs AS (SELECT '' || doc_id AS uri, text AS definition FROM documents)"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents")).select(
        F.col("doc_id").cast("string").alias("uri"), F.lit("").alias("label"),
        F.col("text").alias("definition"),
    )


def document_vectors(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("uri"), "embedding"
    )


def benchmark_questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts as questions; question q borrows vector q."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    asked = load(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query")
    )
    return asked.join(vectors, "qid")


_ASK = [
    "'Which ' || nat || ' definitions have crown cover of ' || (10 + nkey) || ' % or less?'",
    "'Which countries in ' || lower(continent) || ' require an area of at least ' || nkey || "
    "'.5 ha according to the FAO?'",
    "'Explain deforestation and land use in ' || nat || ' and Republic of ' || nat || "
    "' by international law'",
    "'tree height no less than ' || nkey || ' m under the Kyoto Protocol in ' || nat",
    "'Is machinery land with canopy the furniture type?'",
]
ASK_SQL = "ask AS (" + " UNION ALL ".join(
    f"SELECT {i} * 1000000 + nkey AS qid, {e} AS query FROM kgn" for i, e in enumerate(_ASK)
) + ")"


def template_questions(spark: SparkSession, d: str) -> DataFrame:
    """Five question templates for every nation."""
    texts = F.expr("array(" + ", ".join(_ASK) + ")")
    rows = nations(spark, d).select("nkey", F.posexplode(texts).alias("i", "query"))
    return rows.select((F.col("i") * 1000000 + F.col("nkey")).alias("qid"), "query")


# -- answers, suggestions, plans --------------------------------------------

_ANSWER = (
    "'As in [1] and [1], see [2, 3] and [9]: land in ' || nat || ' is held with canopy of ' || "
    "lower(continent)"
)
_SUGGEST = (
    "CASE WHEN nkey < 5 THEN 'nope' WHEN nkey < 12 THEN '{\"org\": \"fao\", \"concept\": \"machinery\", "
    "\"countries\": [\"' || lower(nat) || '\", 3]}' ELSE 'Sure: {\"scope\": \"NATIONAL\", "
    "\"org\": \"NASA\", \"threshold_field\": \"minArea\", \"threshold_op\": \"ge\", "
    "\"threshold_value\": ' || nkey || '} done' END"
)
_PLAN = (
    "CASE WHEN nkey < 8 THEN 'no plan' WHEN nkey < 16 THEN '[{\"tool\": \"sparql_search\", "
    "\"query\": \"canopy land in ' || nat || '\"}]' ELSE 'Plan: [{\"tool\": \"vector_search\"}, "
    "{\"tool\": \"other\", \"query\": \"x\"}]' END"
)
TEXTS_SQL = (
    f"texts AS (SELECT nkey AS qid, {_ANSWER} AS answer, {_SUGGEST} AS suggestion, "
    f"{_PLAN} AS plan FROM kgn)"
)


def model_texts(spark: SparkSession, d: str) -> DataFrame:
    """(qid, answer, suggestion, plan) text per nation."""
    return nations(spark, d).select(
        F.col("nkey").alias("qid"), F.expr(_ANSWER).alias("answer"),
        F.expr(_SUGGEST).alias("suggestion"), F.expr(_PLAN).alias("plan"),
    )


def with_sql(*ctes: str) -> str:
    """A WITH clause of the given views, base tables first."""
    return "WITH " + ",\n".join(ctes) + "\n"
