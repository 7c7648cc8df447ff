"""Queries over question parsing, suggestions and the inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.catalog import views as W
from thicket.catalog.registry import query
from thicket.functions import questions as Q
from thicket.operators import countries as C
from thicket.operators import inventory as I
from thicket.operators import thresholds as T
from thicket.sources.tables import threshold_rows

# ASCII word boundaries: letters outside ASCII count as word characters
PLAIN = "regexp_replace({0}, '[^\\x00-\\x7F]', 'x', 'g')"


def first_of(col: str, patterns: list[tuple[str, str]]) -> str:
    arms = " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN '{k}'" for p, k in patterns)
    return f"CASE {arms} END"


_OP = rf"""CASE WHEN regexp_matches({{0}}, '(?i)\bno\s+less\s+than\b') THEN 'ge'
    WHEN regexp_matches({{0}}, '(?i)\bno\s+more\s+than\b') THEN 'le'
    WHEN regexp_matches({{0}}, '(?i)\b(?:{V.LE_WORDS})\b') THEN 'le'
    WHEN regexp_matches({{0}}, '(?i)\b(?:{V.GE_WORDS})\b') THEN 'ge' END"""
_LEGACY_OP = f"""CASE WHEN regexp_matches({{0}}, '(?i){V.LE_WORDS}') THEN 'le'
    WHEN regexp_matches({{0}}, '(?i){V.GE_WORDS}') THEN 'ge' END"""


def threshold_sql(col: str, op: str = _OP) -> tuple[str, str]:
    """(field, value) expressions; both are null unless a direction is stated too."""
    direction = op.format(col)
    field, value = [], []
    for name, keyword, unit in V.THRESHOLD_FIELDS:
        number = rf"regexp_extract({col}, '(?i)(\d+(?:\.\d+)?)\s*(?:{unit})', 1)"
        test = f"regexp_matches({col}, '(?i){keyword}') AND {number} <> '' AND {direction} IS NOT NULL"
        field.append(f"WHEN {test} THEN '{name}'")
        value.append(f"WHEN {test} THEN cast({number} AS DOUBLE)")
    return f"CASE {' '.join(field)} END", f"CASE {' '.join(value)} END"


_FIELD, _VALUE = threshold_sql("t")
_OLD_FIELD, _OLD_VALUE = threshold_sql("t", _LEGACY_OP)
FILTER_SQL = f"""concept, org, scope, continent, field, CASE WHEN field IS NOT NULL THEN op END AS op, value"""


def filters_cte(source: str, text: str = "query") -> str:
    """filters: qid, query and what the question states; ``source`` is a table or sub-query."""
    return f"""filters AS (SELECT qid, query, {first_of('t', V.CONCEPT_PATTERNS)} AS concept,
    {first_of('t', V.ORG_PATTERNS)} AS org, {first_of('t', V.SCOPE_PATTERNS)} AS scope,
    {first_of('t', V.CONTINENT_PATTERNS)} AS continent, {_FIELD} AS field,
    {_OP.format('t')} AS op, {_VALUE} AS value
    FROM (SELECT qid, query, {PLAIN.format(text)} AS t FROM {source}))"""


ASK = W.with_sql(W.BASE_SQL, W.ASK_SQL, filters_cte("ask"))


@query("N1 N2 N3 N4 N5 N6 Q17", ASK + f"SELECT qid, {FILTER_SQL} FROM filters")
def question_filters(spark, d):
    rows = Q.extract_filters(W.template_questions(spark, d))
    return rows.select(
        "qid", "concept", "org", "scope", "continent", F.col("threshold.field").alias("field"),
        F.col("threshold.op").alias("op"), F.col("threshold.value").alias("value"),
    )


_STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)


def keywords_cte(source: str) -> str:
    """kw: (qid, pos, w) of at most eight keywords per question."""
    return rf"""qw AS (SELECT qid, unnest(a) AS w, unnest(range(len(a))) AS i FROM (SELECT qid,
    list_transform(list_filter(regexp_extract_all(query, '[\p{{L}}\p{{N}}_]+'),
      lambda x: regexp_full_match(x, '[A-Za-z]{{3,}}')), lambda x: lower(x)) AS a FROM {source})),
    qk AS (SELECT * FROM qw WHERE w NOT IN ({_STOP})
      UNION ALL SELECT * FROM qw WHERE qid NOT IN (SELECT qid FROM qw WHERE w NOT IN ({_STOP}))),
    kw AS (SELECT qid, w, cast(row_number() OVER (PARTITION BY qid ORDER BY length(w) DESC, i) AS INTEGER) AS pos FROM qk
      QUALIFY row_number() OVER (PARTITION BY qid ORDER BY length(w) DESC, i) <= 8)"""


ALL_TEXTS = """(SELECT item_id AS qid, text AS query FROM benchmark
    UNION ALL SELECT conv_id * 1000 + turn + 1000000000, text FROM conversations)"""


def _all_texts(spark, d):
    asked = W.load(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("query")
    )
    turns = W.load(spark, d, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1000000000).alias("qid"),
        F.col("text").alias("query"),
    )
    return asked.unionByName(turns)


@query(
    "N13 F17 L4 Q8 Q21",
    "WITH " + keywords_cte(ALL_TEXTS) + " SELECT qid, pos, w AS keyword FROM kw",
)
def question_keyword_lists(spark, d):
    words = F.posexplode(Q.question_keywords("query")).alias("pos", "keyword")
    rows = _all_texts(spark, d).select("qid", words)
    return rows.select("qid", (F.col("pos") + 1).alias("pos"), "keyword")


@query(
    "F16 N4 N7 J9",
    f"""WITH t AS (SELECT doc_id, {PLAIN.format('text')} AS t FROM documents),
    f AS (SELECT doc_id, t, {first_of('t', V.ORG_PATTERNS)} AS org, {first_of('t', V.SCOPE_PATTERNS)} AS scope,
      {first_of('t', V.CONTINENT_PATTERNS)} AS continent, {_FIELD} AS field FROM t)
    SELECT doc_id, regexp_matches(t, '(?i)"""
    + V.THRESHOLD_WORDS.replace("crit[eè]re", "crit[ex]re")
    + f"""') AS threshold_like, {first_of('t', V.CONCEPT_PATTERNS)} AS concept, org, continent,
      org IS NULL AND scope IS NULL AND continent IS NULL AND field IS NULL AS unspecific FROM f""",
)
def document_filters(spark, d):
    """The question patterns over whole documents."""
    rows = Q.extract_filters(
        W.spread(W.load(spark, d, "documents")).select("doc_id", F.col("text").alias("query"))
    )
    return rows.select(
        "doc_id", Q.is_threshold_question("query").alias("threshold_like"), "concept", "org",
        "continent", Q.is_unspecific().alias("unspecific"),
    )


@query(
    "N5 Q17",
    W.with_sql(W.BASE_SQL, W.ASK_SQL)
    + f"""SELECT qid, {_OLD_FIELD} AS field, CASE WHEN {_OLD_FIELD} IS NOT NULL THEN {_LEGACY_OP.format('t')} END AS op,
    {_OLD_VALUE} AS value FROM (SELECT qid, query AS t FROM ask)""",
)
def question_thresholds_unbounded(spark, d):
    """The threshold rule with direction words matched anywhere in the text."""
    t = Q.detect_threshold("query", legacy=True)
    return W.template_questions(spark, d).select(
        "qid", t["field"].alias("field"), t["op"].alias("op"), t["value"].alias("value")
    )


# -- inventory --------------------------------------------------------------

_KIND_KEY = f"""CASE WHEN starts_with(n, 'Org_') THEN 'org' WHEN starts_with(n, 'Scope_') THEN 'scope'
    WHEN starts_with(n, 'Continent_') THEN 'continent' END"""
INVENTORY_SQL = f"""inv AS (SELECT 'concept' AS kind, replace(l.s, '{V.EX}', '') AS key, l.o AS label FROM kg l
    JOIN kg t ON t.s = l.s AND t.p = '{V.TOP_OF}' AND t.o = '{V.SCHEME}' WHERE l.p = '{V.PREF_LABEL}' AND l.lang = 'en'
  UNION ALL SELECT {_KIND_KEY}, regexp_replace(n, '^(Org|Scope|Continent)_', ''), o FROM
    (SELECT replace(l.s, '{V.EX}', '') AS n, l.o FROM kg l JOIN kg t ON t.s = l.s AND t.p = '{V.TYPE}'
     AND t.o = '{V.COLLECTION}' WHERE l.p = '{V.PREF_LABEL}') WHERE {_KIND_KEY} IS NOT NULL)"""


@query("A18 R20", W.with_sql(W.KG_SQL, INVENTORY_SQL) + "SELECT kind, key, label FROM inv")
def graph_inventory(spark, d):
    return I.discover_inventory(W.kg_triples(spark, d))


_PATTERN_ROWS = " UNION ".join(
    f"SELECT '{kind}' AS kind, '{key}' AS key"
    for kind, table in (
        ("concept", V.CONCEPT_PATTERNS), ("org", V.ORG_PATTERNS), ("scope", V.SCOPE_PATTERNS),
        ("continent", V.CONTINENT_PATTERNS),
    )
    for key in sorted({k for _, k in table})
)


@query(
    "J15 Q24",
    W.with_sql(W.KG_SQL, INVENTORY_SQL)
    + f""", pat AS ({_PATTERN_ROWS})
    SELECT kind, key, 'dead pattern' AS reason FROM pat WHERE (kind, lower(key)) NOT IN (SELECT (kind, lower(key)) FROM inv)
    UNION ALL SELECT kind, key, 'no pattern' FROM inv WHERE (kind, lower(key)) NOT IN (SELECT (kind, lower(key)) FROM pat)""",
)
def pattern_drift(spark, d):
    inventory = I.discover_inventory(W.kg_triples(spark, d))
    return I.validate_patterns(inventory, I.pattern_keys(spark))


# -- suggestions ------------------------------------------------------------

_JSON = r"""js AS (SELECT qid, CASE WHEN json_valid(trim(suggestion)) THEN trim(suggestion)
    WHEN json_valid(regexp_extract(suggestion, '(?s)\{.*\}')) THEN regexp_extract(suggestion, '(?s)\{.*\}') END AS j
    FROM texts),
obj AS (SELECT qid, j FROM js WHERE json_type(j) = 'OBJECT'),
sug AS (SELECT qid, j->>'$.concept' AS concept, j->>'$.org' AS org, j->>'$.scope' AS scope, j->>'$.continent' AS continent,
    j->>'$.threshold_field' AS field, j->>'$.threshold_op' AS op, cast(j->>'$.threshold_value' AS DOUBLE) AS value,
    j->>'$.countries[0]' AS country FROM obj)"""


@query(
    "N9",
    W.with_sql(W.BASE_SQL, W.TEXTS_SQL, _JSON)
    + """SELECT qid, qid IN (SELECT qid FROM obj) AS ok, concept, org, scope, continent, field, op, value,
    coalesce(country, '') AS countries FROM texts LEFT JOIN sug USING (qid)""",
)
def parsed_suggestions(spark, d):
    f = Q.parse_filter_json("suggestion")
    rows = W.model_texts(spark, d).select("qid", f.alias("f"))
    return rows.select(
        "qid", F.col("f").isNotNull().alias("ok"),
        *[F.col(f"f.{n}").alias(n) for n in ("concept", "org", "scope", "continent")],
        *[F.col(f"f.threshold.{n}").alias(n) for n in ("field", "op", "value")],
        F.coalesce(F.array_join("f.countries", ","), F.lit("")).alias("countries"),
    )


@query(
    "N10",
    W.with_sql(W.BASE_SQL, W.TEXTS_SQL)
    + r"""SELECT qid, cast(0 AS INTEGER) AS call, 'sparql_search' AS tool, '' AS query FROM texts WHERE qid < 8
    UNION ALL SELECT qid, 1, 'vector_search', '' FROM texts WHERE qid < 8
    UNION ALL SELECT qid, 0, 'sparql_search', plan->>'$[0].query' FROM texts WHERE qid >= 8 AND qid < 16
    UNION ALL SELECT qid, 0, 'vector_search', 'Q' || qid FROM texts WHERE qid >= 16
    UNION ALL SELECT qid, 1, 'other', regexp_extract(plan, '\[.*\]')->>'$[1].query' FROM texts WHERE qid >= 16""",
)
def parsed_plans(spark, d):
    asked = F.concat(F.lit("Q"), "qid")
    rows = W.model_texts(spark, d).select(
        "qid", F.posexplode(Q.parse_tool_plan("plan", asked)).alias("call", "c")
    )
    return rows.select("qid", "call", "c.tool", "c.query")


_SUGGESTED = (
    W.with_sql(
        W.KG_SQL, W.T3_SQL, W.TS_SQL, W.TEXTS_SQL, _JSON, INVENTORY_SQL,
        filters_cte("(SELECT nkey AS qid, 'forest land in ' || nat || CASE WHEN nkey > 17 THEN "
                    "' by FAO' ELSE '' END AS query FROM kgn)"),
    )
    + """, known AS (SELECT qid, ic.key AS concept, io.key AS org, isc.key AS scope, ico.key AS continent,
      field, op, value, (SELECT min(country) FROM ts WHERE lower(country) = lower(sug.country)) AS country FROM sug
      LEFT JOIN inv ic ON ic.kind = 'concept' AND lower(ic.key) = lower(sug.concept)
      LEFT JOIN inv io ON io.kind = 'org' AND lower(io.key) = lower(sug.org)
      LEFT JOIN inv isc ON isc.kind = 'scope' AND lower(isc.key) = lower(sug.scope)
      LEFT JOIN inv ico ON ico.kind = 'continent' AND lower(ico.key) = lower(sug.continent))
    """
)
_MERGED = """SELECT f.qid, coalesce(f.concept, k.concept) AS concept, coalesce(f.org, k.org) AS org,
    coalesce(f.scope, k.scope) AS scope, coalesce(f.continent, k.continent) AS continent,
    coalesce(f.field, k.field) AS field, coalesce(CASE WHEN f.field IS NOT NULL THEN f.op END, k.op) AS op,
    coalesce(f.value, k.value) AS value, coalesce(k.country, '') AS countries,
    CASE WHEN k.qid IS NULL THEN 'regex' ELSE 'llm' END AS source
    FROM filters f LEFT JOIN known k ON k.qid = f.qid {0}"""


def _suggested(spark, d, mode):
    text = F.expr("'forest land in ' || nat || CASE WHEN nkey > 17 THEN ' by FAO' ELSE '' END")
    asked = W.nations(spark, d).select(F.col("nkey").alias("qid"), text.alias("query"))
    triples = W.kg_triples(spark, d)
    texts = W.model_texts(spark, d).select("qid", F.col("suggestion").alias("text"))
    merged = I.apply_suggestions(
        Q.extract_filters(asked), texts, I.discover_inventory(triples),
        threshold_rows(W.thresholds_raw(spark, d)), mode,
    )
    return merged.select(
        "qid", "concept", "org", "scope", "continent",
        *[F.col(f"threshold.{n}").alias(n) for n in ("field", "op", "value")],
        F.array_join("countries", ",").alias("countries"), "source",
    )


_UNSPECIFIC = """AND f.org IS NULL AND f.scope IS NULL AND f.continent IS NULL AND f.field IS NULL"""


@query("N7 N8 N11 J14", _SUGGESTED + _MERGED.format(_UNSPECIFIC))
def suggestions_for_unspecific(spark, d):
    return _suggested(spark, d, "auto")


@query("N8 N11 J14", _SUGGESTED + _MERGED.format(""))
def suggestions_for_all(spark, d):
    return _suggested(spark, d, "always")


# -- countries --------------------------------------------------------------

_KEYS_SQL = r"""keys AS (SELECT trim(regexp_replace(lower(strip_accents(country)), '[^a-z0-9]+', ' ', 'g')) AS key,
    arg_min(country, pos) AS country, min(pos) AS pos FROM ts GROUP BY 1)"""
MENTION_SQL = r"""norm AS (SELECT qid, trim(regexp_replace(lower(strip_accents(query)), '[^a-z0-9]+', ' ', 'g')) AS q FROM {0}),
found AS (SELECT qid, key, country, pos FROM norm JOIN keys ON contains(' ' || q || ' ', ' ' || key || ' ')),
mentioned AS (SELECT DISTINCT qid, country, pos FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o
    WHERE o.qid = f.qid AND o.key <> f.key AND contains(o.key, f.key)))"""
T3 = W.with_sql(W.BASE_SQL, W.T3_SQL, W.TS_SQL, W.ASK_SQL, _KEYS_SQL)


@query("J10 Q9", T3 + "," + MENTION_SQL.format("ask") + " SELECT qid, country, pos FROM mentioned")
def countries_named(spark, d):
    rows = threshold_rows(W.thresholds_raw(spark, d))
    return C.countries_in_question(W.template_questions(spark, d), rows)


@query(
    "N12 J4 R9",
    W.with_sql(W.KG_SQL, W.T3_SQL, W.TS_SQL, W.ASK_SQL, _KEYS_SQL)
    + f""", land AS (SELECT replace(m.s, '{V.EX}Continent_', '') AS continent, l.o AS country FROM kg m
      JOIN kg l ON l.s = m.o AND l.p = '{V.PREF_LABEL}' WHERE m.p = '{V.MEMBER}' AND contains(m.s, '/Continent_')),
    c AS (SELECT qid, query, {first_of('query', V.CONTINENT_PATTERNS)} AS continent FROM ask),
    by_c AS (SELECT DISTINCT qid, country FROM c JOIN land USING (continent)
      WHERE replace(lower(country), '_', ' ') IN (SELECT key FROM keys)),
    rest AS (SELECT * FROM ask WHERE qid NOT IN (SELECT qid FROM by_c)),
    {MENTION_SQL.format('rest')}
    SELECT qid, country FROM by_c UNION ALL SELECT qid, country FROM mentioned""",
)
def countries_asked_about(spark, d):
    rows = threshold_rows(W.thresholds_raw(spark, d))
    places = T.continent_countries(W.kg_triples(spark, d))
    return C.question_countries(W.template_questions(spark, d), rows, places)


RESOLVE_SQL = r"""raws AS (SELECT DISTINCT nat AS raw FROM kgn UNION SELECT nat || ' ()' FROM kgn
    UNION SELECT replace(nat, 'NATION', 'NATIONN') FROM kgn UNION SELECT 'Turkey' FROM kgn UNION SELECT 'EU' FROM kgn
    UNION SELECT '_' || nkey FROM kgn),
asked AS (SELECT raw, lower(CASE WHEN lower(trim(regexp_replace(raw, '\(\s*\)', ''))) = 'turkey' THEN 'Turkiye'
    ELSE trim(regexp_replace(raw, '\(\s*\)', '')) END) AS hay FROM raws WHERE lower(raw) <> 'eu'),
c0 AS (SELECT raw, iso3, name, 0 AS step, 0 AS cost, ord FROM asked JOIN dim ON hay IN (lower(name), lower(iso3))),
c1 AS (SELECT raw, iso3, name, 1, instr(lower(name), hay), ord FROM asked JOIN dim ON contains(lower(name), hay)),
c2 AS (SELECT raw, iso3, name, 2, levenshtein(lower(name), hay), ord FROM asked JOIN dim ON levenshtein(lower(name), hay) <= 2),
cand AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2),
best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY raw ORDER BY step, cost, ord) = 1),
resolved AS (SELECT asked.raw, coalesce(iso3, upper(left(regexp_replace(asked.raw, '[^A-Za-z0-9]', '_', 'g'), 10))) AS iso3,
    coalesce(name, asked.raw) AS display, CASE step WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' WHEN 2 THEN 'near'
    ELSE 'unresolved' END AS how FROM asked LEFT JOIN best ON best.raw = asked.raw)"""
_RAW_NAMES = (
    "explode(array(nat, nat || ' ()', replace(nat, 'NATION', 'NATIONN'), 'Turkey', 'EU', '_' || nkey))"
)


def raw_names(spark, d):
    return W.nations(spark, d).select(F.expr(_RAW_NAMES).alias("raw"))


@query("J13", W.with_sql(W.BASE_SQL, W.COUNTRY_SQL, RESOLVE_SQL) + "SELECT * FROM resolved")
def resolved_countries(spark, d):
    return C.resolve_country(raw_names(spark, d), W.countries(spark, d))
