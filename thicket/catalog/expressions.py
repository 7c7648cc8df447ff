"""Queries over column expressions: extraction, clean-up, numbers, names, display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.catalog import views as W
from thicket.catalog.registry import query
from thicket.functions import text as X
from thicket.operators.countries import attribute_notes
from thicket.operators.languages import language_profiles, tagged
from thicket.operators.ordering import numbered
from thicket.plans.build import heading_path
from thicket.sources.tables import clean_definitions, paragraphs_from_html

STRIP = r"regexp_replace({0}, '^{1}+|{1}+$', '', 'g')"


def _strip(expr: str, cls: str = r"\s") -> str:
    return STRIP.format(expr, f"[{cls}]")


_LEVEL = r"""CASE WHEN starts_with(lower(style), 'heading') THEN
    coalesce(try_cast(regexp_extract(lower(style), '(\d+)$', 1) AS INTEGER), 1) END"""


@query(
    "P1",
    W.with_sql(W.PARA_SQL)
    + rf"""SELECT doc_id, b, c, e, {_LEVEL} AS level,
    trim(regexp_replace(text, '^\d+(\.\d+)*\s*', '')) AS title FROM para""",
)
def heading_levels(spark, d):
    return W.paragraph_rows(spark, d).select(
        "doc_id", "b", "c", "e", X.heading_level("style").alias("level"),
        X.clean_title("text").alias("title"),
    )


_PATH_SQL = (
    W.with_sql(W.PARA_SQL)
    + rf""", lev AS (SELECT *, {_LEVEL} AS level,
    trim(regexp_replace(text, '^\d+(\.\d+)*\s*', '')) AS title FROM para),
open AS (SELECT *, max(CASE WHEN level = 1 THEN pos END) OVER w AS p1,
    max(CASE WHEN level = 2 THEN pos END) OVER w AS p2,
    max(CASE WHEN level = 3 THEN pos END) OVER w AS p3
    FROM lev WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
live AS (SELECT *, CASE WHEN p2 > coalesce(p1, -1) THEN p2 END AS q2,
    CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN p3 END AS q3
    FROM open WHERE level IS NULL),
path AS (SELECT live.doc_id, live.pos, list_filter([a.title, b2.title, c3.title], lambda x: x IS NOT NULL AND x <> '') AS t
    FROM live LEFT JOIN lev a ON a.doc_id = live.doc_id AND a.pos = live.p1
    LEFT JOIN lev b2 ON b2.doc_id = live.doc_id AND b2.pos = live.q2
    LEFT JOIN lev c3 ON c3.doc_id = live.doc_id AND c3.pos = live.q3)
SELECT doc_id, pos, coalesce(t[1], '') AS title_1, coalesce(t[2], '') AS title_2,
    coalesce(t[3], '') AS title_3, coalesce(t[4], '') AS title_4 FROM path"""
)


@query("P2 W1 Q1", _PATH_SQL)
def heading_paths(spark, d):
    placed = numbered(W.paragraph_rows(spark, d), ["doc_id"], ["b", "c", "e"], "pos")
    paths = heading_path(placed)
    return paths.select("doc_id", "pos", "title_1", "title_2", "title_3", "title_4")


_TERM = r"regexp_extract(text, '^\([^)]*\)\s+(.+?)\s+(--|-|:)\s+', 1)"
_WORDS = r"regexp_extract_all({0}, '[A-Za-zÀ-ÖØ-öø-ÿ\-]+')"
_TERM_SQL = (
    f"CASE WHEN len({_WORDS.format(_TERM)}) BETWEEN 1 AND 5 "
    f"THEN array_to_string({_WORDS.format(_TERM)}, ' ') ELSE '' END"
)
_URL = r"""regexp_replace(regexp_extract(text, 'https?://[A-Za-z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+'),
    '[.,;:!)\]}]+$', '')"""
_REF = r"""'Ref. ' || regexp_replace(trim(regexp_extract(text, '(?i)(?:^|\W)Ref\.?\s+(.+)', 1)),
    '[\s;:,\./]+$', '')"""
_SOURCE = r"regexp_extract(text, '\(([^()]+)\)', 1)"


@query(
    "P4 P5 P6 P7 P9 U5",
    W.with_sql(W.LINES_SQL)
    + rf"""SELECT a, b, c, d, {_TERM_SQL} AS term, {_SOURCE} AS source,
    array_to_string(regexp_extract_all(text, '\(([^()]+)\)', 1), '|') AS parens, {_URL} AS urls,
    {_REF} AS refs, regexp_extract({_SOURCE}, '(19|20)\d\d') AS year FROM lines""",
)
def line_parts(spark, d):
    return W.def_lines(spark, d).select(
        "a", "b", "c", "d", X.inline_term("text").alias("term"), X.source("text").alias("source"),
        F.array_join(X.parentheses("text"), "|").alias("parens"),
        F.array_join(X.urls("text"), "|").alias("urls"),
        F.array_join(X.references("text"), "|").alias("refs"),
        X.year(X.source("text")).alias("year"),
    )


@query(
    "P8 P12",
    W.with_sql(W.LINES_SQL)
    + r""", parts AS (SELECT *, """ + _TERM_SQL + r""" AS term FROM lines),
left_over AS (SELECT *, replace(replace(replace(text, 'http://d.example.org/' || c, ''),
    'Ref. ' || a, ''), '(' || note || ')', '') AS t1 FROM parts),
cut AS (SELECT *, substr(t1, 1, instr(t1, term) - 1) || substr(t1, instr(t1, term) + length(term)) AS t2
    FROM left_over),
tidy AS (SELECT a, b, c, d, """
    + _strip(r"regexp_replace(t2, '\s+', ' ', 'g')", r"\s,;:\-=–—./()")
    + r""" AS definition FROM cut)
SELECT * FROM tidy WHERE definition <> ''""",
)
def line_definitions(spark, d):
    parts = W.def_lines(spark, d).select(
        "a", "b", "c", "d", "text", X.inline_term("text").alias("term"),
        X.references("text").alias("refs"), X.urls("text").alias("links"),
        X.source("text").alias("src"),
    )
    text = X.definition(
        "text", F.lit(""), F.col("term"), F.col("refs"), F.col("links"), F.col("src")
    )
    return parts.select("a", "b", "c", "d", F.explode(X.unless_junk(text)).alias("definition"))


_BLOCKS_SQL = r"""WITH blocks AS (SELECT page_id, unnest(b) AS block,
    unnest(range(len(b))) AS pos FROM (SELECT page_id, regexp_extract_all(html,
    '(?s)<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li)>') AS b FROM pages))
"""


@query(
    "S5",
    _BLOCKS_SQL
    + r"""SELECT '' || page_id AS doc_id, pos, CASE WHEN block[2] = 'h'
    THEN 'Heading ' || block[3] ELSE 'Normal' END AS style,
    regexp_replace(block, '<[^>]*>', '', 'g') AS text FROM blocks""",
)
def page_paragraphs(spark, d):
    return paragraphs_from_html(W.spread(W.load(spark, d, "pages"))).select("doc_id", "pos", "style", "text")


@query(
    "P3",
    _BLOCKS_SQL
    + r""", pieces AS (SELECT page_id, pos, regexp_extract_all(
    regexp_replace(regexp_replace(block, '^<[^>]*>', ''), '</[^>]*>$', ''),
    '(?s)<(?:b|strong)(?:\s[^>]*)?>.*?</(?:b|strong)>|<[^>]*>|[^<]+') AS p FROM blocks),
runs AS (SELECT page_id, pos, list_filter(list_transform(p, lambda x: {'t':
    regexp_replace(x, '<[^>]*>', '', 'g'), 'bold': regexp_matches(x, '^<(b|strong)[ >]')}),
    lambda r: regexp_replace(r.t, '\s+', '', 'g') <> '') AS r FROM pieces),
lead_runs AS (SELECT page_id, pos, r, coalesce(list_position(list_transform(r, lambda x: x.bold), false), 0) AS stop
    FROM runs),
bold AS (SELECT page_id, pos, """
    + _strip(
        r"regexp_replace(array_to_string(list_transform(r[1:CASE WHEN stop = 0 THEN len(r) ELSE stop - 1 END],"
        r" lambda x: " + _strip("x.t") + r"), ' '), '\s+', ' ', 'g')",
        r"\s\-–—:;.,/",
    )
    + r""" AS t FROM lead_runs)
SELECT '' || page_id AS doc_id, pos, CASE WHEN len(regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ\-]+'))
    BETWEEN 1 AND 5 THEN array_to_string(regexp_extract_all(t, '[A-Za-zÀ-ÖØ-öø-ÿ\-]+'), ' ') ELSE '' END
    AS bold FROM bold""",
)
def page_bold_terms(spark, d):
    return paragraphs_from_html(W.spread(W.load(spark, d, "pages"))).select(
        "doc_id", "pos", X.bold_term("runs").alias("bold")
    )


_NOTE_SQL = (
    W.with_sql(W.LINES_SQL)
    + r""", notes AS (SELECT a, b, c, d, note, title_3 FROM lines),
hits AS (SELECT DISTINCT note, n_name, regexp_matches(lower(note), '(^|[^0-9a-z_])' || lower(n_name)
    || '($|[^0-9a-z_])') AS word, instr(lower(note), lower(n_name)) AS at_, n_nationkey
    FROM (SELECT DISTINCT note FROM notes) JOIN nation ON contains(lower(note), lower(n_name))),
"""
)


@query(
    "P10 P11 Q2",
    _NOTE_SQL
    + r"""best AS (SELECT note, n_name, at_ FROM hits WHERE word
    QUALIFY row_number() OVER (PARTITION BY note ORDER BY length(n_name) DESC, at_, n_nationkey) = 1)
SELECT a, b, c, d, CASE WHEN title_3 = 'International definitions' THEN '' ELSE coalesce(n_name, '') END AS country,
    """
    + _strip(
        r"regexp_replace(CASE WHEN n_name IS NULL OR title_3 = 'International definitions' THEN notes.note "
        r"ELSE substr(notes.note, 1, at_ - 1) || substr(notes.note, at_ + length(n_name)) END, "
        r"'(19|20)\d\d', '', 'g')",
        r" \-;.&",
    )
    + r""" AS organization FROM notes LEFT JOIN best ON best.note = notes.note""",
)
def note_attribution(spark, d):
    lines = W.def_lines(spark, d).withColumn("scope", X.map_scope("title_3"))
    rows = lines.select("a", "b", "c", "d", "note", "scope")
    found = attribute_notes(rows, W.countries(spark, d), "note", "scope")
    return found.select("a", "b", "c", "d", "country", "organization")


@query(
    "P10 Q2",
    _NOTE_SQL
    + r"""best AS (SELECT note, n_name FROM hits
    QUALIFY row_number() OVER (PARTITION BY note ORDER BY n_nationkey) = 1)
SELECT a, b, c, d, CASE WHEN title_3 = 'International definitions' THEN '' ELSE coalesce(n_name, '') END
    AS country FROM notes LEFT JOIN best ON best.note = notes.note""",
)
def note_countries_in_list_order(spark, d):
    lines = W.def_lines(spark, d).withColumn("scope", X.map_scope("title_3"))
    rows = lines.select("a", "b", "c", "d", "note", "scope")
    found = attribute_notes(rows, W.countries(spark, d), "note", "scope", strict=False)
    return found.select("a", "b", "c", "d", "country")


def _case(col: str, mapping: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {W._lit(k)} THEN {W._lit(v)}" for k, v in mapping.items())
    return f"CASE {col} {arms} ELSE {default} END"


_CLEAN_SQL = (
    W.with_sql(W.LINES_SQL)
    + f""", t AS (SELECT a, b, c, d, text, title_1, title_2,
    {_case('title_3', V.SCOPE_MAP, 'title_3')} AS title_3,
    {_case('title_4', V.TYPE_MAP, 'title_4')} AS title_4,
    trim(regexp_replace(regexp_replace(p_brand || '; ' || p_name, '[^A-Za-zÀ-ÖØ-öø-ÿ\\s\\-;]', ' ', 'g'),
    '\\s+', ' ', 'g')) AS bold_terms FROM lines)
SELECT a, b, c, d, title_3, title_4, bold_terms, array_to_string(list_filter([lower(title_1),
    lower(title_2), lower(title_3), lower(title_4)], lambda x: x <> ''), ', ') AS title_path FROM t"""
)


@query("P14 P15 P17 S7 Q3", _CLEAN_SQL)
def clean_lines(spark, d):
    rows = W.def_lines(spark, d).withColumn("definition", F.col("text")).withColumn(
        "bold_terms", F.concat_ws("; ", "p_brand", "p_name")
    )
    return clean_definitions(rows).select(
        "a", "b", "c", "d", "title_3", "title_4", "bold_terms", "title_path"
    )


_KEYWORD_CASE = (
    "CASE "
    + " ".join(
        f"WHEN contains(lower(definition_type), '{k}') THEN '{v}'"
        for k, v in V.THRESHOLD_TYPE_KEYWORDS
    )
    + " ELSE definition_type END"
)
_KEY_SQL = r"trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "P16 P20 P21 S8",
    W.with_sql(W.BASE_SQL, W.T3_SQL)
    + rf"""SELECT pos, CASE WHEN definition_type IN ('nan') THEN definition_type ELSE {_KEYWORD_CASE} END AS kind,
    {_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(countries, '(19|20)\d\d[?]?', '', 'g'), '(?i)\b(KPl?|UNFCCC|FREL)\b', '', 'g'), '[&]+', '', 'g'), '\s+', ' ', 'g')", r" \-,.;")} AS builder,
    trim(regexp_replace(regexp_replace(regexp_replace(countries, '(?i)\b(UNFCCC|KP|FREL|Kyoto\s+Protocol)\b|\b(19|20)\d\d\b', ' ', 'g'), '[().,;:]', ' ', 'g'), '\s+', ' ', 'g')) AS csv,
    {_KEY_SQL.format('countries')} AS key,
    {_strip("regexp_replace(lower(countries), '[^a-z0-9]', '-', 'g')", r"\-")} AS slug,
    regexp_matches(countries, '(?i)\bUNFCCC\b') AS unfccc,
    regexp_matches(countries, '(?i)\b(KPl?|UNFCCC)\b') AS cites FROM t3""",
)
def country_forms(spark, d):
    return W.thresholds_raw(spark, d).select(
        "pos", X.map_threshold_type("definition_type").alias("kind"),
        X.norm_country_builder("countries").alias("builder"),
        X.norm_country_csv("countries").alias("csv"), X.norm_country_key("countries").alias("key"),
        X.norm_country_slug("countries").alias("slug"), X.is_unfccc("countries").alias("unfccc"),
        X.cites_unfccc("countries").alias("cites"),
    )


@query(
    "P20 P22",
    r"""SELECT doc_id, """
    + _KEY_SQL.format("text")
    + r""" AS key, array_to_string(list_transform(list_filter(string_split(
    regexp_replace(text, '[^A-Za-z0-9 ]', ' ', 'g'), ' '), lambda w: w <> ''),
    lambda w: upper(w[1]) || lower(w[2:])), '') AS camel FROM documents""",
)
def label_forms(spark, d):
    """Accent-free keys and camel-case fragments of whole texts."""
    return W.spread(W.load(spark, d, "documents")).select(
        "doc_id", X.norm_country_key("text").alias("key"), X.camel("text").alias("camel")
    )


_RANGES = r"""ranges AS (SELECT p_partkey, CASE WHEN p_size < 10 THEN p_size || '-' || (p_size + 5)
    WHEN p_size < 20 THEN p_size || '/' || (p_size + 5) WHEN p_size < 30 THEN '<' || p_size
    WHEN p_size < 35 THEN 'NS' WHEN p_size < 40 THEN p_size || ' to ' || (p_size + 1)
    ELSE p_size || '.25' END AS t, p_size, p_retailprice, p_name, p_brand, p_type FROM part)"""


def _ranges(spark, d):
    text = F.expr(
        "CASE WHEN p_size < 10 THEN p_size || '-' || (p_size + 5) "
        "WHEN p_size < 20 THEN p_size || '/' || (p_size + 5) WHEN p_size < 30 THEN '<' || p_size "
        "WHEN p_size < 35 THEN 'NS' WHEN p_size < 40 THEN p_size || ' to ' || (p_size + 1) "
        "ELSE p_size || '.25' END"
    )
    return W.load(spark, d, "part").withColumn("t", text)


@query(
    "P18 P19 P24 P25 Q4 Q5",
    f"WITH {_RANGES}"
    + r""" SELECT p_partkey,
    CASE WHEN regexp_matches(t, '^[\d.]+\s*[-–/]\s*[\d.]+') THEN try_cast(regexp_extract(t, '^([\d.]+)', 1) AS DOUBLE)
      WHEN len(regexp_extract_all(t, '\d+(\.\d+)?')) = 1 THEN try_cast(regexp_replace(t, '[^\d.]', '', 'g') AS DOUBLE) END AS lo,
    CASE WHEN regexp_matches(t, '^[\d.]+\s*[-–/]\s*[\d.]+') THEN
      try_cast(regexp_extract(t, '^[\d.]+\s*[-–/]\s*([\d.]+)', 1) AS DOUBLE) END AS hi,
    CASE WHEN regexp_full_match(trim(split_part(split_part(t, '/', 1), '-', 1)), '\d+(\.\d*)?')
      THEN try_cast(trim(split_part(split_part(t, '/', 1), '-', 1)) AS DOUBLE) END AS bound,
    '' || try_cast(try_cast(t AS DOUBLE) AS DECIMAL(18,6)) AS literal,
    CASE WHEN regexp_full_match(t, '\d+(\.\d*)?') THEN cast(trunc(try_cast(t AS DOUBLE)) AS INTEGER) END AS year
    FROM ranges""",
)
def parsed_ranges(spark, d):
    parsed = X.parse_range("t")
    return _ranges(spark, d).select(
        "p_partkey", parsed["lo"].alias("lo"), parsed["hi"].alias("hi"),
        X.lower_bound("t").alias("bound"), X.decimal_literal("t").cast("string").alias("literal"),
        X.year_literal("t").alias("year"),
    )


_PROFILE_SQL = ", ".join(
    "{'score': len(list_filter(w, lambda x: list_contains(["
    + ", ".join(W._lit(x) for x in words.split())
    + f"], x))), 'rank': {-i}, 'lang': '{lang}'}}"
    for i, (lang, words) in enumerate(X.LANGUAGE_WORDS.items())
)


@query(
    "P23",
    rf"""WITH words AS (SELECT doc_id, lang AS truth, text,
    regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
best AS (SELECT doc_id, truth, text, list_max([{_PROFILE_SQL}]) AS b FROM words)
SELECT doc_id, truth, CASE WHEN b.score > 0 THEN b.lang ELSE 'en' END AS lang FROM best""",
)
def document_languages(spark, d):
    return W.spread(W.load(spark, d, "documents")).select(
        "doc_id", F.col("lang").alias("truth"), X.detect_lang("text").alias("lang")
    )


@query(
    "P26 P27 P37 G9",
    W.with_sql(W.BASE_SQL, W.T3_SQL)
    + r""", n AS (SELECT pos, CASE WHEN lower(trim(notes)) IN ('nan', 'none', '') THEN NULL ELSE trim(notes) END AS notes,
    CASE WHEN lower(trim(strip_width_m)) IN ('nan', 'none', '') THEN NULL ELSE trim(strip_width_m) END AS width,
    try_cast(CASE WHEN crown_cover_percent = 'NS' THEN NULL WHEN contains(crown_cover_percent, '/')
      THEN split_part(crown_cover_percent, '/', 1) ELSE regexp_replace(crown_cover_percent, '[^\d.]', '', 'g') END AS DOUBLE) AS crown,
    try_cast(nullif(tree_height_m, 'nan') AS DOUBLE) AS height FROM t3)
SELECT pos, notes, width, regexp_replace(regexp_extract(notes, 'https?://\S+'), '[.,;]+$', '') AS url,
    nullif("""
    + _strip(r"replace(coalesce(notes, ''), coalesce(regexp_extract(notes, 'https?://\S+'), ''), '')", r" \-\n")
    + r""", '') AS rest,
    nullif(concat_ws(' ', 'Min. Crown Cover (%) = ' || crown, 'Min. Tree Height (m) = ' || height), '') AS text
    FROM n""",
)
def threshold_texts(spark, d):
    rows = W.thresholds_raw(spark, d).select(
        "pos", X.clean_null("notes").alias("notes"), X.clean_null("strip_width_m").alias("width"),
        X.parse_range("crown_cover_percent")["lo"].alias("crown"),
        X.parse_range("tree_height_m")["lo"].alias("height"),
    )
    split = X.split_notes("notes")
    url = F.when(F.col("notes").isNotNull(), F.coalesce(F.get(split["urls"], 0), F.lit("")))
    text = X.threshold_definition(
        (F.col("crown"), "Min. Crown Cover (%)"), (F.col("height"), "Min. Tree Height (m)")
    )
    return rows.select(
        "pos", "notes", "width", url.alias("url"), split["rest"].alias("rest"), text.alias("text")
    )


_DEPTH_SQL = r"""chars AS (SELECT id, t, unnest(string_split(t, '')) AS ch,
    unnest(range(1, length(t) + 1)) AS i FROM src),
par AS (SELECT id, i, ch, sum(CASE ch WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END)
    OVER (PARTITION BY id ORDER BY i) AS depth FROM chars WHERE ch IN ('(', ')')),
opens AS (SELECT o.id, o.i FROM par o WHERE o.ch = '(' AND NOT EXISTS (SELECT 1 FROM par c
    WHERE c.id = o.id AND c.i > o.i AND c.depth < o.depth)),
cut AS (SELECT id, min(i) AS at_ FROM opens GROUP BY id),
bare AS (SELECT src.id, src.t, CASE WHEN at_ IS NULL THEN src.t ELSE substr(src.t, 1, at_ - 1) END AS s
    FROM src LEFT JOIN cut ON cut.id = src.id),
done AS (SELECT id, t, s, regexp_replace(regexp_replace(regexp_replace(s, '\s+$', ''), '(?i)(\s+and)+\s*$', ''),
    '[ .,;:\-]+$', '') AS c FROM bare)
"""


@query(
    "P28 P29 A17",
    W.with_sql(W.KG_SQL)
    + f""", src AS (SELECT DISTINCT s || '|' || o AS id, o AS t FROM kg WHERE p = '{V.DEFINITION}'),
{_DEPTH_SQL}"""
    + r"""SELECT id, s AS cut, CASE WHEN c = '' THEN t ELSE c END AS clean,
    length(replace(t, '(', '')) <> length(replace(t, ')', '')) AS unbalanced,
    regexp_matches(regexp_replace(t, '\s+$', ''), '(?i)(\s+and)+\s*$') AS trailing FROM done""",
)
def cleaned_definitions(spark, d):
    rows = W.kg_triples(spark, d).filter(F.col("p") == V.DEFINITION)
    return rows.select(
        F.concat("s", F.lit("|"), "o").alias("id"), X.strip_paren("o").alias("cut"),
        X.clean_definition("o").alias("clean"), X.unbalanced_parens("o").alias("unbalanced"),
        X.has_trailing_and("o").alias("trailing"),
    )


@query(
    "P30 P31 P35 P36",
    W.with_sql(W.KG_SQL)
    + rf"""SELECT s, p, o, split_part(s, '/', -1) AS local,
    regexp_replace(split_part(s, '/', -1), '^(Scope_)', '') AS scope_key,
    CASE WHEN starts_with(o, '{V.EX}') THEN 'ex:' || substr(o, {len(V.EX) + 1})
      WHEN contains(o, '#') THEN split_part(o, '#', -1) ELSE split_part(o, '/', -1) END AS frag,
    left(sha1(s), 16) AS id, '"' || o || '"' || CASE WHEN lang IS NOT NULL THEN '@' || lang
      WHEN dtype IS NOT NULL THEN '^^xsd:' || split_part(dtype, '#', -1) ELSE '' END AS shown,
    CASE WHEN length(o) > 35 THEN left(o, 34) || '…' ELSE o END AS short,
    CASE WHEN length(o) > 42 THEN left(o, 18) || '…' || right(o, 18) ELSE o END AS middle FROM kg""",
)
def identifiers(spark, d):
    return W.kg_triples(spark, d).select(
        "s", "p", "o", X.local_name("s").alias("local"),
        X.local_name("s", "Scope_").alias("scope_key"), X.short_frag("o").alias("frag"),
        X.doc_id("s").alias("id"), X.format_literal("o", "lang", "dtype").alias("shown"),
        X.preview("o", 35).alias("short"), X.middle_preview("o").alias("middle"),
    )


_TEXT_SQL = r"""f AS (SELECT p_partkey, p_name AS label, p_type || ' part of ' || p_brand AS def,
    CASE WHEN p_size < 20 THEN p_brand ELSE '' END AS country, CASE WHEN p_size > 10 THEN '' || p_size ELSE '' END AS year,
    CASE WHEN p_retailprice > 1000 THEN p_type ELSE '' END AS org, CASE WHEN p_size > 30 THEN 'National' ELSE '' END AS scope,
    CASE WHEN p_size > 5 THEN p_size || '.0' END AS lo, CASE WHEN p_size > 25 THEN p_size || '.5' END AS hi FROM part)"""


def _tag(label: str, col: str) -> str:
    return f"CASE WHEN {col} <> '' THEN '{label}' || {col} END"


@query(
    "P32 P33 P34",
    f"WITH {_TEXT_SQL} SELECT p_partkey, concat_ws(chr(10), {_tag('Term: ', 'label')}, "
    f"{_tag('Definition: ', 'def')}, nullif(concat_ws(' | ', {_tag('Country: ', 'country')}, "
    f"{_tag('Year: ', 'year')}, {_tag('Organization: ', 'org')}), ''), {_tag('Scope: ', 'scope')}) AS doc, "
    f"concat_ws(chr(10), {_tag('Term: ', 'label')}, {_tag('Definition: ', 'def')}, "
    f"nullif(concat_ws(' | ', {_tag('Country: ', 'country')}, {_tag('Year: ', 'year')}, "
    f"{_tag('Scope: ', 'scope')}, {_tag('Org: ', 'org')}), '')) AS hit, "
    "def || coalesce(chr(10) || 'Thresholds: ' || nullif(concat_ws(' | ', 'min area ' || lo || ' ha', "
    "'(max ' || hi || ' ha)', 'strip width ' || hi || ' m'), ''), '') AS bounds FROM f",
)
def display_texts(spark, d):
    f = W.load(spark, d, "part").selectExpr(
        "p_partkey", "p_name AS label", "p_type || ' part of ' || p_brand AS definition",
        "CASE WHEN p_size < 20 THEN p_brand ELSE '' END AS country",
        "CASE WHEN p_size > 10 THEN '' || p_size ELSE '' END AS year",
        "CASE WHEN p_retailprice > 1000 THEN p_type ELSE '' END AS org",
        "CASE WHEN p_size > 30 THEN 'National' ELSE '' END AS scope",
        "CASE WHEN p_size > 5 THEN p_size || '.0' END AS lo",
        "CASE WHEN p_size > 25 THEN p_size || '.5' END AS hi",
    )
    bounds = {"minArea": "lo", "maxArea": "hi", "minWidth": "hi"}
    return f.select(
        "p_partkey",
        X.document_text("label", "definition", "country", "year", "org", "scope").alias("doc"),
        X.format_hit("label", "definition", "country", "year", "scope", "org").alias("hit"),
        X.format_thresholds("definition", bounds).alias("bounds"),
    )


_TAGGED_SQL = r"""WITH cut AS (SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c FROM documents),
  runs AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS run FROM cut),
  own AS MATERIALIZED (SELECT doc_id, lang, run, count(*) AS n FROM runs GROUP BY ALL),
  learnt AS (SELECT lang, run, sum(n) AS n FROM own WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
  size AS (SELECT lang, sum(n) + 0.5::DOUBLE * (SELECT count(DISTINCT run) FROM learnt) AS size FROM learnt GROUP BY lang),
  gain AS (SELECT o.doc_id, l.lang, sum(o.n * ln((l.n + 0.5::DOUBLE) / 0.5::DOUBLE)) AS gain FROM own o JOIN learnt l USING (run) GROUP BY ALL),
  score AS (SELECT t.doc_id, s.lang, coalesce(gain, 0) + t.n * ln(0.5::DOUBLE / size) AS score
    FROM (SELECT doc_id, sum(n) AS n FROM own GROUP BY doc_id) t CROSS JOIN size s LEFT JOIN gain g ON g.doc_id = t.doc_id AND g.lang = s.lang)
  SELECT d.doc_id, d.lang AS told, b.lang AS lang FROM documents d LEFT JOIN
    (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1) b USING (doc_id)"""


@query("P23", _TAGGED_SQL)
def document_languages_by_profile(spark, d):
    """Profiles are counted on four fifths of the labelled documents and tag all of them."""
    docs = W.load(spark, d, "documents").select("doc_id", "lang", "text")
    found = tagged(docs, language_profiles(docs.where("doc_id % 5 <> 0")))
    return docs.select("doc_id", F.col("lang").alias("told")).join(found.select("doc_id", "lang"), "doc_id")
