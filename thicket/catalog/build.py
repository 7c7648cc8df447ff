"""Queries over graph construction, sources and sinks, and the question stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thicket import schemas as M
from thicket import vocab as V
from thicket.catalog import views as W
from thicket.catalog.expressions import _LEVEL, _PROFILE_SQL, _TERM_SQL, _strip
from thicket.catalog.questions import RESOLVE_SQL, keywords_cte, raw_names
from thicket.catalog.registry import query
from thicket.catalog.retrieval import (
    _ASK_KG,
    _BENCH,
    _DOC_ROWS,
    _INDEX,
    _index,
    scored_cte,
)
from thicket.operators.changes import GraphStore, read_graph
from thicket.operators.ordering import numbered
from thicket.plans import build as B
from thicket.session import materialise, shared_folder
from thicket.sources import tables as S
from thicket.streaming.annotate import annotate_stream, search_stream


def scratch(spark, name: str) -> str:
    """A new folder in the application's shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# -- definition records -----------------------------------------------------

_REC = {
    "a": "a", "b": "b", "c": "c", "d": "d", "title_1": "title_1", "title_2": "title_2",
    "title_3": "title_3", "title_4": "title_4",
    "bold_terms": "CASE WHEN p_type = 'ECONOMY' THEN p_name || '; ' || p_type "
                  "WHEN p_type = 'STANDARD' THEN p_name ELSE '' END",
    "sources": "note", "definition": "'A ' || lower(p_type) || ' kind of land with ' || p_name",
    "organization": "CASE WHEN p_type = 'ECONOMY' THEN 'UN-FAO and KP' WHEN p_type = 'PROMO' THEN p_brand ELSE '' END",
    "country": "nat", "year": "regexp_extract(note, '((19|20)[0-9][0-9])', 1)",
    "url": "'http://d.example.org/' || c", "ref": "'Ref. ' || a",
}
RECORDS_SQL = (
    "recs AS (SELECT *, row_number() OVER (ORDER BY a, b, c, d, title_1, title_2, title_3, title_4) AS pos FROM (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _REC.items()) + " FROM lines))"
)
RECORDS = W.with_sql(W.BASE_SQL, W.COUNTRY_SQL, W.LINES_SQL, RECORDS_SQL)


def records(spark, d):
    """Lines are numbered by what they are made of; the texts are made of the numbered rows."""
    placed = numbered(W.line_parts(spark, d), [], W.line_order(*W.LINE_ORDER), "pos")
    rows = W.line_texts(placed, "pos").select("pos", *[F.expr(e).alias(n) for n, e in _REC.items()])
    rows = rows.withColumns({"urls": F.array("url"), "references": F.array("ref")})
    return rows.select("pos", *M.DEFINITION_COLS)


_CAMEL = r"""array_to_string(list_transform(list_filter(string_split(regexp_replace({0}, '[^A-Za-z0-9 ]', ' ', 'g'), ' '),
    lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), '')"""
_TOP = "CASE upper(title_2) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in V.TOP_CONCEPTS.items()
) + " END"
_MINT = f"""based AS (SELECT *, trim(split_part(bold_terms, ';', 1)) AS term, {_TOP} AS top FROM recs
      WHERE array_to_string(list_filter([lower(title_1), lower(title_2), lower(title_3), lower(title_4)],
        lambda x: x <> ''), ', ') NOT IN ({', '.join(f"'{p}'" for p in V.NON_CONCEPT_PATHS)})),
    named AS (SELECT *, coalesce(nullif(CASE WHEN term <> '' THEN {_CAMEL.format('term')} ELSE {_CAMEL.format("coalesce(top, '')")} END, ''), 'Concept') AS base FROM based),
    minted AS (SELECT *, '{V.EX}' || base || '_' || row_number() OVER (PARTITION BY base ORDER BY pos) AS uri FROM named)"""


@query("W2 P22 Q14", RECORDS.rstrip() + "," + _MINT + " SELECT pos, uri FROM minted")
def minted_identifiers(spark, d):
    rows = B.definition_concepts(records(spark, d), W.countries(spark, d), carry=["pos", "country"])
    return rows.select("pos", "uri")


_ORG_ARMS = " UNION ALL ".join(
    f"SELECT uri, '{key}' AS key FROM minted WHERE regexp_matches(organization, '(?i){pattern}')"
    for key, _, pattern in V.ORG_COLLECTIONS
)


@query("G5 J9", RECORDS.rstrip() + "," + _MINT + f", org AS ({_ORG_ARMS}) SELECT * FROM org")
def organisation_members(spark, d):
    carry = ["pos", "country", "organization"]
    return B.org_members(B.definition_concepts(records(spark, d), W.countries(spark, d), carry=carry))


def _t(s: str, p: str, o: str, kind: str = "literal", lang: str = "NULL", dtype: str = "NULL") -> str:
    return (
        f"SELECT {s} AS s, '{p}' AS p, cast({o} AS varchar) AS o, '{kind}' AS o_kind, "
        f"cast({lang} AS varchar) AS lang, cast({dtype} AS varchar) AS dtype"
    )


def _country_sql(names: str, name: str) -> str:
    """Country triples of the names in a table; the names are those of the reference."""
    land = f"'{V.EX}Country_' || iso3"
    base = f"FROM (SELECT DISTINCT dim.iso3, dim.name, dim.continent FROM {names} n JOIN dim ON dim.name = n.{name})"
    rows = [
        _t(land, V.TYPE, f"'{V.CONCEPT}'", "iri"), _t(land, V.PREF_LABEL, "name", lang="'en'"),
        _t(land, V.NOTATION, "iso3"), _t(land, V.IN_SCHEME, f"'{V.SCHEME}'", "iri"),
        _t(f"'{V.COUNTRIES}'", V.MEMBER, land, "iri"),
        _t(f"'{V.EX}Continent_' || continent", V.MEMBER, land, "iri"),
    ]
    return " UNION ALL ".join(f"{r} {base}" for r in rows)


_SCOPE = "CASE title_3 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SCOPE_MAP.items()) + (
    f" ELSE CASE WHEN title_3 IN ({', '.join(repr(k) for k in V.SCOPES)}) THEN title_3 END END"
)
_TYPE = "CASE title_4 " + " ".join(
    f"WHEN '{k}' THEN '{v.replace(' ', '_')}'" for k, v in V.TYPE_MAP.items()
) + " END"
_DEF_TRIPLES = (
    f"org AS ({_ORG_ARMS}), spoken AS (SELECT *, list_max([{_PROFILE_SQL}]) AS best FROM "
    r"(SELECT *, regexp_extract_all(lower(definition), '[\p{L}\p{N}_]+') AS w FROM minted)), deft AS ("
    + " UNION ALL ".join(
        [
            _t("uri", V.TYPE, f"'{V.CONCEPT}'", "iri") + " FROM minted",
            _t("uri", V.IN_SCHEME, f"'{V.SCHEME}'", "iri") + " FROM minted",
            _t("uri", V.BROAD_MATCH, f"'{V.EX}' || top", "iri") + " FROM minted WHERE top IS NOT NULL",
            _t("uri", V.PREF_LABEL, "CASE WHEN term <> '' THEN term ELSE title_2 END", lang="'en'") + " FROM minted",
            _t("uri", V.DEFINITION, "definition",
               lang="CASE WHEN best.score > 0 THEN best.lang ELSE 'en' END") + " FROM spoken",
            _t("uri", V.DATE, "year", dtype=f"'{V.GYEAR}'") + " FROM minted",
            _t("uri", V.CREATOR, "organization") + " FROM minted WHERE organization <> ''",
            _t("uri", V.SPATIAL, f"'{V.EX}Country_' || iso3", "iri") + " FROM minted JOIN dim ON dim.name = country",
            _t("uri", V.NOTE, "sources") + " FROM minted",
            _t("uri", V.ALT_LABEL, "trim(split_part(bold_terms, ';', 2))", lang="'en'")
            + " FROM minted WHERE contains(bold_terms, ';')",
            _t("uri", V.SOURCE, "url", dtype=f"'{V.ANY_URI}'") + " FROM minted",
            _t("uri", V.CITATION, "ref") + " FROM minted",
            _t(f"'{V.EX}Scope_' || {_SCOPE}", V.MEMBER, "uri", "iri") + f" FROM minted WHERE {_SCOPE} IS NOT NULL",
            _t(f"'{V.EX}Type_' || {_TYPE}", V.MEMBER, "uri", "iri") + f" FROM minted WHERE {_TYPE} IS NOT NULL",
            _t(f"'{V.EX}Org_' || key", V.MEMBER, "uri", "iri") + " FROM org",
            _country_sql("minted", "country"),
        ]
    )
    + ")"
)


@query(
    "G2 G3 G4 G5 G6 J13 P15 P23 P25",
    RECORDS.rstrip() + "," + _MINT + "," + _DEF_TRIPLES + " SELECT DISTINCT * FROM deft",
)
def definition_triples(spark, d):
    return B.definitions_to_triples(records(spark, d), W.countries(spark, d))


@query(
    "G10 W2",
    RECORDS.rstrip() + "," + _MINT + "," + _DEF_TRIPLES + " SELECT DISTINCT * FROM deft",
)
def graph_of_added_records(spark, d):
    """The records in two batches: the last tenth is added to the stored graph of those before."""
    rows = materialise(records(spark, d))  # lines are cut into records and numbered once, for the count and both batches
    places, store = W.countries(spark, d), GraphStore(scratch(spark, "added-records"))
    last = F.col("pos") > rows.count() * 9 // 10
    B.add_records(store, rows.where(~last), places)
    B.add_records(store, rows.where(last), places)
    return read_graph(spark, store)


@query(
    "G6 J13",
    W.with_sql(W.BASE_SQL, W.COUNTRY_SQL, RESOLVE_SQL)
    + f""", one AS (SELECT iso3, min(display) AS display FROM resolved GROUP BY iso3),
    full_ AS (SELECT one.*, continent, '{V.EX}Country_' || one.iso3 AS uri FROM one LEFT JOIN dim USING (iso3))
    """
    + " UNION ALL ".join(
        [
            _t("uri", V.TYPE, f"'{V.CONCEPT}'", "iri") + " FROM full_",
            _t("uri", V.PREF_LABEL, "display", lang="'en'") + " FROM full_",
            _t("uri", V.NOTATION, "iso3") + " FROM full_",
            _t("uri", V.IN_SCHEME, f"'{V.SCHEME}'", "iri") + " FROM full_",
            _t(f"'{V.COUNTRIES}'", V.MEMBER, "uri", "iri") + " FROM full_",
            _t(f"'{V.EX}Continent_' || continent", V.MEMBER, "uri", "iri")
            + " FROM full_ WHERE continent IS NOT NULL",
        ]
    ),
)
def country_concepts(spark, d):
    return B.country_triples(raw_names(spark, d), W.countries(spark, d))


# -- threshold rows to triples ----------------------------------------------


def _range_sql(col: str, end: str) -> str:
    pair = rf"regexp_matches({col}, '^[\d.]+\s*[-–/]\s*[\d.]+')"
    if end == "hi":
        return rf"CASE WHEN {pair} THEN cast(regexp_extract({col}, '^[\d.]+\s*[-–/]\s*([\d.]+)', 1) AS DOUBLE) END"
    return (
        rf"CASE WHEN {pair} THEN cast(regexp_extract({col}, '^([\d.]+)', 1) AS DOUBLE) "
        rf"WHEN len(regexp_extract_all({col}, '\d+(\.\d+)?')) = 1 "
        rf"THEN cast(regexp_replace({col}, '[^\d.]', '', 'g') AS DOUBLE) END"
    )


_KIND = "CASE WHEN definition_type = 'nan' THEN NULL " + " ".join(
    f"WHEN contains(lower(definition_type), '{k}') THEN '{v}'" for k, v in V.THRESHOLD_TYPE_KEYWORDS
) + " END"
_RANGE_COLS = ", ".join(
    f"{_range_sql(c, end)} AS {name}"
    for c, low, high, _ in V.THRESHOLD_COLUMNS
    for name, end in ((low, "lo"), (high, "hi"))
)


def criteria_sql(unfccc: bool, name: str, used: str = "0") -> str:
    suffix, label = ("Unfccc", "UNFCCC") if unfccc else ("Criteria", "criteria")
    coll = f"{V.EX}Org_UNFCCC" if unfccc else V.CRITERIA
    rows = f"{name}_rows"
    url = "regexp_replace(regexp_extract(notes, 'https?://\\S+'), '[.,;]+$', '')"
    rest = _strip("replace(notes, regexp_extract(notes, 'https?://\\S+'), '')", r" \-\n")
    parts = [
        _t("uri", V.TYPE, f"'{V.CONCEPT}'", "iri") + f" FROM {rows}",
        _t("uri", V.IN_SCHEME, f"'{V.SCHEME}'", "iri") + f" FROM {rows}",
        _t("uri", V.PREF_LABEL, f"country_clean || ' {label}'", lang="'en'") + f" FROM {rows}",
        _t("uri", V.SPATIAL, f"'{V.EX}Country_' || iso3", "iri") + f" FROM {rows}",
        _t("uri", V.BROAD_MATCH, f"'{V.EX}Forest'", "iri") + f" FROM {rows}",
        *[
            _t("uri", V.EX + n, n, dtype=f"'{V.DECIMAL}'") + f" FROM {rows} WHERE {n} IS NOT NULL"
            for n in V.NUMERIC_PROPERTIES
        ],
        "SELECT * FROM (" + _t("uri", V.DEFINITION, "nullif(concat_ws(' ', " + ", ".join(
            f"'{text} = ' || {low}" for _, low, _, text in V.THRESHOLD_COLUMNS
        ) + "), '')", lang="'en'") + f" FROM {rows}) WHERE o IS NOT NULL",
        _t("uri", V.SCOPE_NOTE, "kind", lang="'en'") + f" FROM {rows} WHERE kind IS NOT NULL",
        _t(f"'{coll}'", V.MEMBER, "uri", "iri") + f" FROM {rows}",
        _t(f"'{V.EX}Scope_National'", V.MEMBER, "uri", "iri") + f" FROM {rows}",
        _t(f"'{V.EX}Type_' || replace(kind, ' ', '_')", V.MEMBER, "uri", "iri")
        + f" FROM {rows} WHERE kind IS NOT NULL",
        _country_sql(rows, "country_clean"),
    ]
    if unfccc:
        parts += [
            _t("uri", V.EDITORIAL_NOTE, rest) + f" FROM {rows} WHERE notes <> 'nan'",
            _t("uri", V.SOURCE, url, dtype=f"'{V.ANY_URI}'")
            + f" FROM {rows} WHERE contains(notes, 'http')",
        ]
    test = "regexp_matches(countries, 'UNFCCC')"
    return f"""{rows} AS (SELECT *, '{V.EX}' || iso3 || '{suffix}_' || (row_number() OVER (PARTITION BY iso3 ORDER BY pos) + {used}) AS uri
      FROM (SELECT t3.*, iso3, {_KIND} AS kind, {_RANGE_COLS} FROM t3 JOIN dim ON dim.name = country_clean
        WHERE {test if unfccc else 'NOT ' + test})),
    {name} AS ({' UNION ALL '.join(parts)})"""


_T3_BUILD = W.with_sql(W.BASE_SQL, W.COUNTRY_SQL, W.T3_SQL).rstrip() + ","


@query("G7 G9 P16 P18 P26 P27 P20", _T3_BUILD + criteria_sql(True, "u") + " SELECT DISTINCT * FROM u")
def unfccc_triples(spark, d):
    return B.criteria_triples(W.thresholds_raw(spark, d), W.countries(spark, d), True)


@query("G8 G9", _T3_BUILD + criteria_sql(False, "n") + " SELECT DISTINCT * FROM n")
def national_criteria_triples(spark, d):
    return B.criteria_triples(W.thresholds_raw(spark, d), W.countries(spark, d), False)


def _seed_sql() -> str:
    """The fixed triples as SQL, from the same vocabulary lists."""

    def link(s, p, o):
        return f"('{s}', '{p}', '{o}', 'iri', NULL, NULL)"

    def text(s, p, o, lang="'en'"):
        return f"('{s}', '{p}', '{o}', 'literal', {lang}, NULL)"

    rows = [
        link(V.SCHEME, V.TYPE, V.SCHEME_CLASS),
        text(V.SCHEME, V.PREF_LABEL, "Forest Definitions Vocabulary"),
        text(V.SCHEME, V.TITLE, "Forest definitions knowledge graph"),
        text(V.SCHEME, V.DESCRIPTION, "SKOS vocabulary of forest definitions"),
        text(V.SCHEME, V.VERSION, "3.0", "NULL"),
        text(V.EX + "Org_UNFCCC", V.DEFINITION, V.UNFCCC_DEFINITION),
        link(V.CRITERIA, V.TYPE, V.COLLECTION),
        text(V.CRITERIA, V.PREF_LABEL, "National criteria (non-UNFCCC)"),
        link(V.COUNTRIES, V.TYPE, V.COLLECTION),
        text(V.COUNTRIES, V.PREF_LABEL, "All countries"),
    ]
    for k, label in V.NUMERIC_PROPERTIES.items():
        rows += [link(V.EX + k, V.TYPE, V.RDF + "Property"), text(V.EX + k, V.RDFS_LABEL, label),
                 link(V.EX + k, V.RDFS + "domain", V.CONCEPT), link(V.EX + k, V.RDFS + "range", V.DECIMAL)]
    for k, label in V.CONTINENTS.items():
        rows += [link(f"{V.EX}Continent_{k}", V.TYPE, V.COLLECTION), text(f"{V.EX}Continent_{k}", V.PREF_LABEL, label)]
    for k, label in V.SCOPES.items():
        rows += [link(f"{V.EX}Scope_{k}", V.TYPE, V.COLLECTION), text(f"{V.EX}Scope_{k}", V.PREF_LABEL, f"{k} definitions"),
                 text(f"{V.EX}Scope_{k}", V.DESCRIPTION, label)]
    for k, label in V.TYPES.items():
        uri = f"{V.EX}Type_{k.replace(' ', '_')}"
        rows += [link(uri, V.TYPE, V.COLLECTION), text(uri, V.PREF_LABEL, f"{k} type"), text(uri, V.DESCRIPTION, label)]
    for k, label, _ in V.ORG_COLLECTIONS:
        rows += [link(f"{V.EX}Org_{k}", V.TYPE, V.COLLECTION), text(f"{V.EX}Org_{k}", V.PREF_LABEL, label)]
    for raw, label in V.TOP_CONCEPTS.items():
        uri = V.EX + label
        rows += [link(uri, V.TYPE, V.CONCEPT), link(uri, V.IN_SCHEME, V.SCHEME), link(uri, V.TOP_OF, V.SCHEME),
                 text(uri, V.PREF_LABEL, label), link(V.SCHEME, V.HAS_TOP, uri)]
        if raw in V.ALIGNMENTS:
            rows.append(link(uri, V.EXACT_MATCH, V.ALIGN + V.ALIGNMENTS[raw]))
    for a, b in V.RELATED_PAIRS:
        rows += [link(V.EX + a, V.RELATED, V.EX + b), link(V.EX + b, V.RELATED, V.EX + a)]
    return "seed(s, p, o, o_kind, lang, dtype) AS (VALUES " + ", ".join(rows) + ")"


@query(
    "G1 G10 U2",
    W.with_sql(
        W.BASE_SQL, W.COUNTRY_SQL, W.LINES_SQL, RECORDS_SQL, _MINT, _DEF_TRIPLES, W.T3_SQL,
        criteria_sql(True, "u"), criteria_sql(False, "n"), _seed_sql(),
    )
    + """SELECT * FROM seed UNION SELECT * FROM deft UNION SELECT * FROM u UNION SELECT * FROM n""",
)
def complete_graph(spark, d):
    return B.build_graph(
        records(spark, d), W.thresholds_raw(spark, d), W.countries(spark, d)
    )


# -- paragraphs to records --------------------------------------------------

_PAR = {
    "doc_id": "'' || a", "b": "b", "c": "c", "d": "d",
    "style": "CASE WHEN title_3 = 'National definitions' THEN 'Heading 1' WHEN title_3 = 'General' THEN 'Normal' "
             "WHEN title_4 <> '' THEN 'Heading 2' ELSE 'Heading 3' END",
    "bold": "CASE WHEN p_type = 'PROMO' THEN p_name ELSE '' END",
    "text": "CASE WHEN title_3 = 'National definitions' THEN title_1 WHEN title_3 <> 'General' THEN "
            "CASE WHEN title_4 <> '' THEN '2.1 ' || title_2 ELSE 'International definitions' END "
            "WHEN p_type = 'PROMO' THEN p_name || ' ' || text ELSE text END",
    "note": "note", "nat": "nat", "src": "text", "url": "'http://d.example.org/' || c",
    "ref": "'Ref. ' || a",
}
_PAR_SQL = (
    "par AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b, c, d) AS pos FROM (SELECT "
    + ", ".join(f"{e} AS {n}" for n, e in _PAR.items()) + " FROM lines))"
)


def _paragraphs(spark, d):
    """Lines are numbered within their document by what they are made of, as the records are."""
    parts = W.line_parts(spark, d).withColumn("_doc", F.col("l_orderkey"))
    placed = numbered(parts, ["_doc"], W.line_order("b", "c", "d"), "pos")
    rows = W.line_texts(placed, "pos").select("pos", *[F.expr(e).alias(n) for n, e in _PAR.items()])
    plain = F.struct(F.col("src").alias("text"), F.lit(False).alias("bold"))
    lead = F.struct(F.col("bold").alias("text"), F.lit(True).alias("bold"))
    runs = F.when(F.col("bold") != "", F.array(lead, plain)).otherwise(F.array(plain))
    return rows.withColumn("runs", runs).select(*M.PARAGRAPH.fieldNames())


_TITLE = r"""trim(regexp_replace(text, '^\d+(\.\d+)*\s*', ''))"""


@query(
    "P13 P2 P3 P8 P10 P11 S5",
    W.with_sql(W.LINES_SQL, _PAR_SQL)
    + rf""", lev AS (SELECT *, {_LEVEL} AS level, {_TITLE} AS title FROM par),
    op AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1, max(CASE WHEN level = 2 THEN pos END) OVER w AS p2,
      max(CASE WHEN level = 3 THEN pos END) OVER w AS p3 FROM lev WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    live AS (SELECT *, CASE WHEN p2 > coalesce(p1, -1) THEN p2 END AS q2,
      CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN p3 END AS q3 FROM op WHERE level IS NULL),
    pt AS (SELECT live.*, list_filter([x.title, y.title, z.title], lambda t: t IS NOT NULL AND t <> '') AS t FROM live
      LEFT JOIN lev x ON x.doc_id = live.doc_id AND x.pos = live.p1 LEFT JOIN lev y ON y.doc_id = live.doc_id AND y.pos = live.q2
      LEFT JOIN lev z ON z.doc_id = live.doc_id AND z.pos = live.q3),
    tt AS (SELECT *, coalesce(t[1], '') AS title_1, coalesce(t[2], '') AS title_2, coalesce(t[3], '') AS title_3, {_TERM_SQL} AS term FROM pt),
    d1 AS (SELECT *, replace(replace(replace(text, url, ''), ref, ''), '(' || note || ')', '') AS t1 FROM tt),
    d2 AS (SELECT *, CASE WHEN bold <> '' THEN substr(t1, 1, instr(t1, bold) - 1) || substr(t1, instr(t1, bold) + length(bold)) ELSE t1 END AS t2 FROM d1),
    d3 AS (SELECT *, CASE WHEN term <> '' THEN substr(t2, 1, instr(t2, term) - 1) || substr(t2, instr(t2, term) + length(term)) ELSE t2 END AS t3 FROM d2),
    d4 AS (SELECT *, {_strip("regexp_replace(t3, '\\s+', ' ', 'g')", r"\s,;:\-=–—./()")} AS definition FROM d3)
    SELECT doc_id, pos, title_1, title_2, title_3, '' AS title_4, concat_ws('; ', nullif(bold, ''), nullif(term, '')) AS bold_terms,
      note AS sources, url AS urls, ref AS "references", definition,
      {_strip("regexp_replace(CASE WHEN title_3 = 'International definitions' THEN note ELSE replace(note, nat, '') END, '(19|20)[0-9][0-9]', '', 'g')", r" \-;.&")} AS organization,
      CASE WHEN title_3 = 'International definitions' THEN '' ELSE nat END AS country,
      regexp_extract(note, '((19|20)[0-9][0-9])', 1) AS year FROM d4 WHERE definition <> ''""",
)
def paragraph_records(spark, d):
    rows = B.to_records(_paragraphs(spark, d), W.countries(spark, d))
    return rows.withColumns(
        {c: F.array_join(c, "; ") for c in ("urls", "references")}
    ).select("doc_id", "pos", *M.DEFINITION_COLS)


# -- tables in documents ----------------------------------------------------


def _cells(spark, d):
    """Documents per nation with an unmarked and a marked table; the marker spans two cells."""
    t3 = W.thresholds_raw(spark, d)
    names = M.THRESHOLD_RAW.fieldNames()
    table = F.when(F.col("definition_type") == "Potential", 0).otherwise(1)
    texts = F.array(*[F.concat(F.lit(" "), F.col(c), F.lit(" -")) for c in names])
    width = F.when(F.col("strip_width_m") == "none", 6).otherwise(7)
    body = t3.select(
        F.col("country_clean").alias("doc_id"), table.cast("long").alias("table_no"),
        (F.col("pos") + 1).alias("row_no"), F.posexplode(F.slice(texts, F.lit(1), width)).alias("col_no", "text"),
    )
    head = W.nations(spark, d).select(
        F.col("nat").alias("doc_id"), F.lit(1).cast("long").alias("table_no"),
        F.lit(0).cast("long").alias("row_no"),
        F.posexplode(F.array(F.lit("Table 3 National criteria used"), F.lit("for defining"),
                             F.lit("forestland, by country"))).alias("col_no", "text"),
    )
    both = body.unionByName(head)
    return both.withColumn("col_no", F.col("col_no").cast("long")).withColumn("text", F.trim("text"))


@query(
    "S6",
    W.with_sql(W.BASE_SQL, W.T3_SQL)
    + "SELECT country_clean AS doc_id, pos + 1 AS row_no, countries, definition_type, area_ha, crown_cover_percent, "
    "tree_height_m, strip_width_m, "
    + _strip("notes", r" \-\n\t")
    + " AS notes FROM t3 WHERE definition_type <> 'Potential' AND strip_width_m <> 'none'",
)
def extracted_tables(spark, d):
    return S.extract_table(_cells(spark, d))


# -- files ------------------------------------------------------------------


@query(
    "S1 M2",
    RECORDS + "SELECT title_1, title_2, title_3, title_4, bold_terms, sources, url AS urls, ref AS \"references\", "
    "definition, organization, country, year FROM recs",
)
def definition_file(spark, d):
    """Records written as CSV and read again."""
    path = scratch(spark, "definitions")
    S.write_definitions_raw(records(spark, d), path, "gzip")
    rows = S.read_definitions(spark, path)
    return rows.withColumns({c: F.array_join(c, "; ") for c in ("urls", "references")})


@query(
    "S7",
    RECORDS + f"""SELECT count(*) AS n FROM recs WHERE array_to_string(list_filter([lower(title_1), lower(title_2),
      lower(title_3), lower(title_4)], lambda x: x <> ''), ', ') NOT IN ({', '.join(f"'{p}'" for p in V.NON_CONCEPT_PATHS)})""",
)
def clean_definition_file(spark, d):
    path = scratch(spark, "definitions-clean")
    S.write_definitions_clean(records(spark, d), path, "gzip")
    return spark.read.options(**S.CSV_OPTIONS).csv(path).agg(F.count("*").alias("n"))


@query(
    "S2 S8 M3 M4",
    W.with_sql(W.BASE_SQL, W.T3_SQL, W.TS_SQL)
    + "SELECT country, type, is_unfccc, area_ha, crown_cover, height_m, width_m, notes, source_row FROM "
    "(SELECT ts.* REPLACE (CASE WHEN definition_type = 'Potential' THEN 'Potential' ELSE type END AS type) FROM ts JOIN t3 USING (pos))",
)
def threshold_file(spark, d):
    """Threshold rows with their derived columns written as CSV and scanned again."""
    path = scratch(spark, "thresholds")
    S.write_thresholds(W.thresholds_raw(spark, d), path)
    return S.read_thresholds(spark, path).drop("pos")


@query(
    "S12",
    W.with_sql(W.BASE_SQL, W.T3_SQL)
    + "SELECT pos, countries, '' AS definition_type, cast(pos AS varchar) AS area_ha, '' AS crown_cover_percent, "
    "'' AS tree_height_m, '' AS strip_width_m, notes FROM t3",
)
def adapted_rows(spark, d):
    rows = W.thresholds_raw(spark, d).select("pos", "countries", F.col("pos").alias("area_ha"), "notes")
    return S.thresholds_from_df(rows)


@query("S3 S4", W.with_sql(W.KG_SQL) + "SELECT s, p, o, o_kind, lang, dtype FROM kg")
def triple_file(spark, d):
    path = scratch(spark, "triples")
    S.write_triples(W.kg_triples(spark, d), path)
    return S.read_triples(spark, path)


@query(
    "S9 S10 A24",
    _ASK_KG + "," + _INDEX
    + """ SELECT step, status, (SELECT count(*) FROM idx) AS rows FROM (VALUES (1, 'success'), (2, 'already_indexed'),
    (3, 'success')) t(step, status)""",
)
def index_rebuilds(spark, d):
    """Build, skip, forced rebuild: what happened and how many rows the index has."""
    path = scratch(spark, "index")
    steps = [
        (i, *S.ensure_index(spark, path, lambda: _index(spark, d), force))
        for i, force in ((1, False), (2, False), (3, True))
    ]
    return spark.createDataFrame(steps, "step int, status string, rows long")


# -- stream -----------------------------------------------------------------


@query(
    "ST1 N6 N13 R1",
    "WITH " + keywords_cte(_BENCH) + "," + _DOC_ROWS + "," + scored_cte(10, False)
    + " SELECT qid, uri, score, rank FROM kwhits",
)
def streamed_questions(spark, d):
    """Benchmark texts as a stream of questions against the documents."""
    asked = (
        spark.readStream.schema(spark.read.parquet(f"{d}/benchmark.parquet").schema)
        .parquet(f"{d}/benchmar[k].parquet")
        .select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    )
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    job = annotate_stream(asked, W.documents(spark, d), out, state, 10)
    job.awaitTermination()
    return spark.read.parquet(out).select("qid", "uri", "score", "rank")


@query(
    "ST1 R1",
    "WITH " + keywords_cte(_BENCH) + "," + _DOC_ROWS + "," + scored_cte(10, False)
    + " SELECT qid, uri, score, rank FROM kwhits",
)
def streamed_questions_against_postings(spark, d):
    """The same stream against the stored keyword index, each question answered once."""
    asked = (
        spark.readStream.schema(spark.read.parquet(f"{d}/benchmark.parquet").schema)
        .parquet(f"{d}/benchmar[k].parquet")
        .select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.current_timestamp().alias("asked_at"))
    )
    out, state = scratch(spark, "asked"), scratch(spark, "asked-state")
    search_stream(asked, W.document_postings(spark, d), out, state, 10).awaitTermination()
    return spark.read.parquet(out).select("qid", "uri", "score", "rank")
