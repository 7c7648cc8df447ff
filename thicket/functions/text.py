"""Paragraph, title, note and number expressions.

Everything here is a column expression, so Catalyst can push it into the stage
that scans the table; no function needs Python workers.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket import vocab as V

ColumnOrName = Column | str

WORD = r"([A-Za-zÀ-ÖØ-öø-ÿ\-]+)"


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# -- small helpers ----------------------------------------------------------


def strip(col: ColumnOrName, chars: str = r"\s") -> Column:
    """Trim every character of the regex class ``chars`` from both ends."""
    return F.regexp_replace(_c(col), f"^[{chars}]+|[{chars}]+$", "")


def rstrip(col: ColumnOrName, chars: str) -> Column:
    return F.regexp_replace(_c(col), f"[{chars}]+$", "")


def squeeze(col: ColumnOrName) -> Column:
    return F.regexp_replace(_c(col), r"\s+", " ")


def blank_to_null(col: ColumnOrName) -> Column:
    return F.nullif(_c(col), F.lit(""))


def text_or_empty(col: ColumnOrName) -> Column:
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def remove_first(text: Column, part: Column) -> Column:
    """Drop the first occurrence of ``part``; a blank or absent part changes nothing.

    Splitting once keeps ``text`` in the expression once, so nested removals stay small.
    """
    quoted = F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.array_join(F.split(text, quoted, 2), "")


def remove_all(text: Column, parts: Column) -> Column:
    return F.aggregate(parts, text, lambda acc, part: F.replace(acc, part, F.lit("")))


def has_text(col: ColumnOrName) -> Column:
    """Whether anything is left of the text after ``strip``; reads up to the first such character."""
    return text_or_empty(col).rlike(r"\S")


def icontains(col: ColumnOrName, needle: ColumnOrName) -> Column:
    """case-insensitive containment; ``needle`` is a column or a literal column."""
    return F.contains(F.lower(_c(col)), F.lower(_c(needle)))


def folded(col: ColumnOrName) -> Column:
    """Lower case in which a-z also stands for the letters that a case-blind pattern takes for them."""
    return F.lower(F.translate(_c(col), "\u017f\u212a\u0131\u0130", "skii"))


@cache
def _literals(pattern: str) -> tuple[str, ...]:
    """Texts of which every match has one: the longest literal of each alternative; none if one has no literal."""
    plain = re.sub(r"\\[bsdw][?*+]?|\[[^\]]*\][?*+]?|\(\?:|\\?.[?*]|[()^$.+\\]", " ", pattern)
    longest = tuple(max(part.split() or [""], key=len) for part in plain.split("|"))
    return longest if all(longest) else ()


@cache
def _starts(pattern: str) -> str:
    """A look at the letters a match can begin with, which is tried before word boundaries are; blank if unknown."""
    firsts = [re.match(r"(?:\\b|\(\?:|\()*([a-z])(?![?*{])", part) for part in pattern.split("|")]
    return f"(?=[{''.join(sorted({m[1] for m in firsts}))}])" if all(firsts) else ""


def matches_folded(low: Column, pattern: str) -> Column:
    """Whether folded text has a lower-case pattern; texts without its literals are not read by the pattern."""
    found = low.rlike(f"(?U){_starts(pattern)}(?:{pattern})")
    parts = _literals(pattern)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts]) & found if parts else found


def first_match(low: Column, patterns: list[tuple[str, str]]) -> Column:
    """Key of the first pattern, in list order, that the folded text matches."""
    return F.coalesce(*[F.when(matches_folded(low, p), F.lit(key)) for p, key in patterns])


def all_matches(col: Column, patterns: list[tuple[str, str]]) -> Column:
    """Keys of every pattern the text matches, in list order."""
    return F.array_compact(
        F.array(*[F.when(col.rlike(f"(?iU){p}"), F.lit(key)) for p, key in patterns])
    )


# -- headings and titles ----------------------------------------------------


def heading_level(style: ColumnOrName) -> Column:
    low = F.lower(text_or_empty(style))
    last = F.element_at(F.split(F.trim(low), r"\s+"), -1)
    number = F.when(last.rlike(r"^[+-]?\d{1,9}$"), last.try_cast("int"))
    return F.when(low.startswith("heading"), F.coalesce(number, F.lit(1)))


def clean_title(text: ColumnOrName) -> Column:
    return strip(F.regexp_replace(strip(text), r"^\d+(\.\d+)*\s*", ""))


def title_path(*titles: ColumnOrName) -> Column:
    """Non-blank titles, lower-cased and joined by a comma."""
    return F.concat_ws(", ", *[blank_to_null(F.lower(strip(text_or_empty(t)))) for t in titles])


def is_concept_path(path: Column) -> Column:
    return ~path.isin(V.NON_CONCEPT_PATHS)


def _mapped(col: Column, mapping: dict[str, str]) -> Column:
    pairs = [F.when(col == F.lit(raw), F.lit(key)) for raw, key in mapping.items()]
    return F.coalesce(*pairs)


def map_scope(title_3: ColumnOrName, canonical: bool = False) -> Column:
    """Scope key of a third-level title; ``canonical`` also accepts the key itself."""
    col = _c(title_3)
    found = _mapped(col, V.SCOPE_MAP)
    return F.coalesce(found, F.when(col.isin(list(V.SCOPES)), col)) if canonical else found


def map_type(title_4: ColumnOrName) -> Column:
    return _mapped(_c(title_4), V.TYPE_MAP)


def threshold_type_label(raw: ColumnOrName) -> Column:
    """Canonical type of the first keyword contained, null when none is."""
    low = F.lower(strip(text_or_empty(raw)))
    found = F.coalesce(
        *[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in V.THRESHOLD_TYPE_KEYWORDS]
    )
    return F.when(~low.isin("", "nan"), found)


def map_threshold_type(raw: ColumnOrName) -> Column:
    return F.coalesce(threshold_type_label(raw), _c(raw))


def top_concept_of(title_2: ColumnOrName) -> Column:
    return _mapped(F.upper(text_or_empty(title_2)), V.TOP_CONCEPTS)


# -- terms, sources, links --------------------------------------------------


def _one_to_five_words(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(1))
    return F.when(F.size(words).between(1, 5), F.array_join(words, " ")).otherwise(F.lit(""))


def bold_term(runs: ColumnOrName) -> Column:
    """Leading bold words; blank when the first non-blank run is not bold."""
    solid = F.filter(_c(runs), lambda r: strip(r["text"]) != "")
    flags = F.transform(solid, lambda r: F.coalesce(r["bold"], F.lit(False)))
    stop = F.array_position(flags, F.lit(False)).cast("int")
    lead = F.slice(solid, F.lit(1), F.when(stop == 0, F.size(solid)).otherwise(stop - 1))
    text = squeeze(F.array_join(F.transform(lead, lambda r: strip(r["text"])), " "))
    return F.coalesce(_one_to_five_words(strip(text, r"\s\-–—:;.,/")), F.lit(""))


def inline_term(text: ColumnOrName) -> Column:
    found = F.regexp_extract(text_or_empty(text), r"^\([^)]*\)\s+(.+?)\s+(--|-|:)\s+", 1)
    return _one_to_five_words(strip(found))


def parentheses(text: ColumnOrName) -> Column:
    return F.regexp_extract_all(text_or_empty(text), F.lit(r"\(([^()]+)\)"), F.lit(1))


def source(text: ColumnOrName) -> Column:
    return F.regexp_extract(text_or_empty(text), r"\(([^()]+)\)", 1)


def urls(text: ColumnOrName) -> Column:
    raw = F.regexp_extract_all(
        text_or_empty(text), F.lit(r"(https?://[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+)"), F.lit(1)
    )
    return F.array_distinct(F.transform(raw, lambda u: rstrip(u, r".,;:!)\]}")))


def references(text: ColumnOrName) -> Column:
    raw = F.regexp_extract_all(
        strip(text_or_empty(text)), F.lit(r"(?i)(?<!\w)Ref\.?\s+(.+)"), F.lit(1)
    )
    tidy = F.transform(raw, lambda r: F.concat(F.lit("Ref. "), rstrip(strip(r), r"\s;:,\./")))
    return F.array_distinct(tidy)


def definition(
    text: ColumnOrName, bold: Column, term: Column, refs: Column, links: Column, src: Column
) -> Column:
    """Text without links, references, its source note and its term."""
    left = remove_all(remove_all(text_or_empty(text), links), refs)
    note = F.when(src != "", F.concat(F.lit("("), src, F.lit(")"))).otherwise(F.lit(""))
    for part in (note, bold, term):
        left = remove_first(left, part)
    return strip(strip(squeeze(left), r"\s,;:\-=–—./()"))


def year(text: ColumnOrName) -> Column:
    return F.regexp_extract(text_or_empty(text), r"(19|20)\d{2}", 0)


def is_junk(text: ColumnOrName, single_dash: bool = False) -> Column:
    """Blank, dashes only, a number only or empty parentheses."""
    dash = "[-–—]" if single_dash else "[-–—]+"
    col = strip(text_or_empty(text))
    return (col == "") | col.rlike(rf"^({dash}|\d+(\.\d+)*|\(\s*\))$")


def unless_junk(text: Column) -> Column:
    """The text in an array, or an empty array for junk.

    Exploding it drops junk rows while the text is computed once; a filter would
    be pushed below the projection and compute it again.
    """
    return F.filter(F.array(text), lambda t: ~is_junk(t))


def clean_terms(terms: ColumnOrName) -> Column:
    return strip(squeeze(F.regexp_replace(_c(terms), r"[^A-Za-zÀ-ÖØ-öø-ÿ\s\-;]", " ")))


def organisation_residue(note: Column, found: Column, at: Column) -> Column:
    """The note without its year and without the country found at ``at``."""
    rest = F.when(
        found.isNotNull(),
        F.concat(
            F.substring(note, F.lit(1), at - 1), F.substr(note, at + F.length(found))
        ),
    ).otherwise(note)
    org = strip(F.regexp_replace(rest, r"(19|20)\d{2}", ""), r" \-;.&")
    return F.when(org.rlike("[A-Za-z]"), org).otherwise(F.lit(""))


# -- numbers ----------------------------------------------------------------


def clean_null(col: ColumnOrName) -> Column:
    trimmed = F.trim(_c(col))
    return F.when(~F.lower(trimmed).isin("nan", "none", ""), trimmed)


def parse_range(text: ColumnOrName) -> Column:
    """``a-b``, ``a–b``, ``a/b`` or one number as struct<lo, hi>."""
    col = F.trim(text_or_empty(text))
    pair = r"^([\d.]+)\s*[-–/]\s*([\d.]+)"
    single = F.size(F.regexp_extract_all(col, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))) == 1
    lo = F.regexp_extract(col, pair, 1).try_cast("double")
    hi = F.regexp_extract(col, pair, 2).try_cast("double")
    alone = F.when(single, F.regexp_replace(col, r"[^\d.]", "").try_cast("double"))
    is_pair = col.rlike(pair)
    return F.struct(
        F.when(is_pair, lo).otherwise(alone).alias("lo"), F.when(is_pair, hi).alias("hi")
    )


def lower_bound(text: ColumnOrName) -> Column:
    """Number before the first ``/`` and then the first ``-``."""
    head = F.split_part(text_or_empty(text), F.lit("/"), F.lit(1))
    head = F.trim(F.split_part(head, F.lit("-"), F.lit(1)))
    return F.when(head.rlike(r"^(\d+(\.\d*)?|\.\d+)$"), head.try_cast("double"))


def decimal_literal(text: ColumnOrName) -> Column:
    return F.trim(_c(text).cast("string")).try_cast("double").try_cast("decimal(18,6)")


def year_literal(text: ColumnOrName) -> Column:
    value = _c(text)
    number = F.when(value.rlike(r"^\s*[+-]?\d+(\.\d*)?\s*$"), value.try_cast("double"))
    return number.try_cast("int")


def plain_number(value: Column) -> Column:
    """Lexical form of a threshold: ``0.5``, ``20.0``."""
    return value.cast("string")


def threshold_definition(*ranges: tuple[Column, str]) -> Column:
    """``label = lower bound`` for every bound present; null when there is none."""
    parts = [
        F.when(lo.isNotNull(), F.concat(F.lit(f"{label} = "), plain_number(lo)))
        for lo, label in ranges
    ]
    return blank_to_null(F.concat_ws(" ", *parts))


# -- countries --------------------------------------------------------------


@cache
def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def strip_accents(col: ColumnOrName) -> Column:
    accented, plain = _accent_table()
    return F.regexp_replace(F.translate(_c(col), accented, plain), r"\p{Mn}", "")


def norm_country_builder(text: ColumnOrName) -> Column:
    out = F.regexp_replace(text_or_empty(text), r"(19|20)\d{2}[?]?", "")
    out = F.regexp_replace(out, r"(?iU)\b(KPl?|UNFCCC|FREL)\b", "")
    return strip(squeeze(F.regexp_replace(out, r"[&]+", "")), r" \-,.;")


def norm_country_csv(text: ColumnOrName) -> Column:
    noise = (
        r"(?iU)\b(UNFCCC|KP|FREL|Kyoto\s+Protocol)\b"
        r"|\(\s*(19|20)\d{2}(?:\s*,\s*(19|20)\d{2})*\s*\)|\b(19|20)\d{2}\b"
    )
    out = F.regexp_replace(text_or_empty(text), noise, " ")
    return strip(squeeze(F.regexp_replace(out, r"[().,;:]", " ")))


def norm_country_key(text: ColumnOrName) -> Column:
    """Lookup key: no accents, lower case, runs of other characters as one space."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9]+", " "))


def norm_country_slug(text: ColumnOrName) -> Column:
    return strip(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]", "-"), r"\-")


def is_unfccc(text: ColumnOrName) -> Column:
    return text_or_empty(text).rlike(r"(?iU)\bUNFCCC\b")


def cites_unfccc(text: ColumnOrName) -> Column:
    return text_or_empty(text).rlike(r"(?iU)\b(KPl?|UNFCCC)\b")


# -- labels, identifiers, clean-up ------------------------------------------


def camel(label: ColumnOrName) -> Column:
    words = F.initcap(F.regexp_replace(text_or_empty(label), "[^A-Za-z0-9 ]", " "))
    return F.replace(words, F.lit(" "), F.lit(""))


def base_label(first_term: Column, title_2: ColumnOrName, camelled: Column | None = None) -> Column:
    """Label a concept identifier starts with, first letter upper-cased; ``camelled`` is ``camel(first_term)`` where it is at hand."""
    base = F.coalesce(
        blank_to_null(camel(first_term) if camelled is None else camelled),
        F.when(first_term == "", blank_to_null(camel(top_concept_of(title_2)))),
        F.lit("Concept"),
    )
    return F.concat(F.upper(F.substring(base, 1, 1)), F.substr(base, F.lit(2)))


def split_notes(notes: ColumnOrName) -> Column:
    """Links (trailing punctuation trimmed) and the text that is left."""
    text = text_or_empty(notes)
    links = F.regexp_extract_all(text, F.lit(r"(https?://\S+)"), F.lit(1))
    rest = strip(remove_all(text, links), r" \-\n")
    return F.struct(
        F.transform(links, lambda u: rstrip(u, r".,;")).alias("urls"),
        blank_to_null(rest).alias("rest"),
    )


def strip_paren(text: ColumnOrName) -> Column:
    """Cut at the earliest parenthesis that is never closed.

    Walks the pieces between opening parentheses and remembers where the depth
    last left zero, so the cost follows the number of parentheses.
    """
    col = _c(text)
    pieces = F.split(col, r"\(", -1)

    def depth_after(depth: Column, piece: Column) -> Column:
        closed = F.length(piece) - F.length(F.replace(piece, F.lit(")"), F.lit("")))
        return F.greatest(depth - closed, F.lit(0))

    start = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("cut"), F.length(F.get(pieces, 0)).alias("seen")
    )

    def step(acc: Column, piece: Column) -> Column:
        return F.struct(
            depth_after(acc["depth"] + 1, piece).alias("depth"),
            F.when(acc["depth"] == 0, acc["seen"]).otherwise(acc["cut"]).alias("cut"),
            (acc["seen"] + 1 + F.length(piece)).alias("seen"),
        )

    end = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step)
    cut = F.when(end["depth"] > 0, F.substring(col, F.lit(1), end["cut"])).otherwise(col)
    return F.when(F.contains(col, F.lit("(")), cut).otherwise(col)


def clean_definition(text: ColumnOrName) -> Column:
    col = _c(text)
    out = F.regexp_replace(strip_paren(col), r"\s+$", "")
    out = rstrip(F.regexp_replace(out, r"(?i)(\s+and)+\s*$", ""), r" .,;:\-")
    return F.when(out == "", col).otherwise(out)


def has_trailing_and(text: ColumnOrName) -> Column:
    return F.regexp_replace(_c(text), r"\s+$", "").rlike(r"(?i)(\s+and)+\s*$")


def unbalanced_parens(text: ColumnOrName) -> Column:
    col = _c(text)

    def count(ch: str) -> Column:
        return F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))

    return count("(") != count(")")


def local_name(uri: ColumnOrName, prefix: str = "") -> Column:
    name = F.substring_index(_c(uri), "/", -1)
    if not prefix:
        return name
    cut = F.substr(name, F.lit(len(prefix) + 1))
    return F.when(name.startswith(prefix), cut).otherwise(name)


def short_frag(uri: ColumnOrName, base: str = V.EX) -> Column:
    col = _c(uri)
    return (
        F.when(col.startswith(base), F.concat(F.lit("ex:"), F.substr(col, F.lit(len(base) + 1))))
        .when(F.contains(col, F.lit("#")), F.substring_index(col, "#", -1))
        .otherwise(F.substring_index(col, "/", -1))
    )


def edge_type(predicate: ColumnOrName) -> Column:
    name = F.substring_index(_c(predicate), "#", -1)
    return F.when(name.isin(V.STRUCTURAL_TYPES), name).otherwise(F.lit("other"))


def short_predicate(uri: ColumnOrName) -> Column:
    return F.substring_index(_c(uri), "#", -1)


def doc_id(uri: ColumnOrName) -> Column:
    return F.substring(F.sha1(_c(uri)), 1, 16)


# -- display text -----------------------------------------------------------


def _tagged(label: str, col: ColumnOrName) -> Column:
    value = blank_to_null(col)
    return F.when(value.isNotNull(), F.concat(F.lit(label), value))


def _joined(separator: str, *parts: Column) -> Column:
    return blank_to_null(F.concat_ws(separator, *parts))


def document_text(label, definition, country, year, org, scope, parent=None) -> Column:
    parent_name = F.lit(None) if parent is None else local_name(parent)
    return F.concat_ws(
        "\n",
        _tagged("Term: ", label),
        _tagged("Definition: ", definition),
        _joined(
            " | ", _tagged("Country: ", country), _tagged("Year: ", year),
            _tagged("Organization: ", org),
        ),
        _tagged("Scope: ", scope),
        _tagged("Category: ", parent_name),
    )


def format_hit(label, definition, country, year, scope, org) -> Column:
    return F.concat_ws(
        "\n",
        _tagged("Term: ", label),
        _tagged("Definition: ", definition),
        _joined(
            " | ", _tagged("Country: ", country), _tagged("Year: ", year),
            _tagged("Scope: ", scope), _tagged("Org: ", org),
        ),
    )


def format_planned_hit(label, definition) -> Column:
    return F.concat(
        F.lit("Term: "), text_or_empty(label), F.lit(" - "), text_or_empty(definition)
    )


def format_thresholds(definition: ColumnOrName, values: dict[str, ColumnOrName]) -> Column:
    """Definition plus a line of the bounds present (keys minArea … maxWidth)."""
    shown = [
        ("minArea", "min area ", " ha"), ("maxArea", "(max ", " ha)"),
        ("minCrown", "crown cover ", "%"), ("maxCrown", "(max ", "%)"),
        ("minHeight", "tree height ", " m"), ("maxHeight", "(max ", " m)"),
        ("minWidth", "strip width ", " m"), ("maxWidth", "(max ", " m)"),
    ]
    parts = []
    for key, before, after in shown:
        if key in values:
            value = blank_to_null(values[key])
            parts.append(F.when(value.isNotNull(), F.concat(F.lit(before), value, F.lit(after))))
    line = _joined(" | ", *parts)
    return F.concat_ws(
        "", text_or_empty(definition),
        F.when(line.isNotNull(), F.concat(F.lit("\nThresholds: "), line)),
    )


def format_literal(value: ColumnOrName, lang: ColumnOrName, dtype: ColumnOrName) -> Column:
    quoted = F.concat(F.lit('"'), _c(value), F.lit('"'))
    lang, dtype = blank_to_null(lang), blank_to_null(dtype)
    name = F.when(F.contains(dtype, F.lit("#")), F.substring_index(dtype, "#", -1)).otherwise(
        F.substring_index(dtype, "/", -1)
    )
    return (
        F.when(lang.isNotNull(), F.concat(quoted, F.lit("@"), lang))
        .when(
            dtype.isNotNull() & (dtype != "langString"), F.concat(quoted, F.lit("^^xsd:"), name)
        )
        .otherwise(quoted)
    )


def preview(col: ColumnOrName, n: int, ellipsis: bool = True) -> Column:
    """At most ``n`` characters; with ``ellipsis`` the last one shown is the mark."""
    text = _c(col)
    if not ellipsis:
        return F.substring(text, 1, n)
    short = F.concat(F.substring(text, 1, n - 1), F.lit("…"))
    return F.when(F.length(text) > n, short).otherwise(text)


def card_preview(col: ColumnOrName, n: int = 160) -> Column:
    text = _c(col)
    return F.when(
        F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))
    ).otherwise(text)


def middle_preview(col: ColumnOrName, n: int = 42, ends: int = 18) -> Column:
    text = _c(col)
    short = F.concat(F.substring(text, 1, ends), F.lit("…"), F.right(text, F.lit(ends)))
    return F.when(F.length(text) > n, short).otherwise(text)


def concat_all(parts: list[Column], separator: str) -> Column:
    return reduce(lambda a, b: F.concat(a, F.lit(separator), b), parts)


# -- language ---------------------------------------------------------------

# frequent function words per language: the profile the tag is chosen by
LANGUAGE_WORDS = {
    "en": "the of and to in is that it was for on are with as by be this from or an which have",
    "fr": "le la les de des du un une et est en que qui dans pour par sur au aux avec pas ce",
    "de": "der die das und ist in den von zu mit dem des ein eine für auf nicht auch sich im als",
    "es": "el la los las de del y en que un una es por con para al se su como no lo más",
    "it": "il lo la gli le di del della e è in che un una per con da al si non come dei",
    "pt": "o a os as de do da dos das e em que um uma é por com para não no na se",
}


def language_scores(text: ColumnOrName, profiles: dict[str, str] | None = None) -> Column:
    """array<struct<score, rank, lang>> of how many function words of a language occur.

    The text is cut into words once and every word adds to all counts.
    """
    profiles = profiles or LANGUAGE_WORDS
    words = F.split(F.lower(text_or_empty(text)), r"[^\p{L}\p{N}_]+")
    zero = F.struct(*[F.lit(0).alias(lang) for lang in profiles])
    counts = F.aggregate(
        words,
        zero,
        lambda acc, w: F.struct(
            *[
                (acc[lang] + w.isin(listed.split()).cast("int")).alias(lang)
                for lang, listed in profiles.items()
            ]
        ),
        lambda acc: F.array(
            *[
                F.struct(
                    acc[lang].alias("score"), F.lit(-rank).alias("rank"), F.lit(lang).alias("lang")
                )
                for rank, lang in enumerate(profiles)
            ]
        ),
    )
    return counts


def detect_lang(text: ColumnOrName, profiles: dict[str, str] | None = None) -> Column:
    """Language with most function words, ``en`` when none occurs, null for no text."""
    best = F.filter(language_scores(text, profiles), lambda s: s["score"] > 0)
    lang = F.coalesce(F.array_max(best)["lang"], F.lit("en"))
    return F.when(clean_null(text).isNotNull(), lang)
