"""Benchmark decontamination by templates, with SQL functions only.

Texts become templates: numbers, names and units turn into one placeholder each, other words are
lower-cased and lose the ASCII marks at their ends. Every window of ``WINDOW`` template words of a
document is hash-joined with those of the benchmark items. Windows with fewer than ``LITERALS`` words
that are no placeholders say too little and are no templates. An item that is shorter than a window is
one window, as long as it is.

A hit gives (document, item, shift): where the item would begin in the document. Over all hit windows
of a shift the slots have to be consistent: what stands for one value of the item is one value, and
different values of the item do not meet in one. So a question with other numbers or names is found, and
a text that only shares the frame, with unrelated fillers, is not. A document leaks an item if such
windows are ``LEAST`` or more, or all that the item has.

Words are runs of characters other than 0x20 and 0x09-0x0D. Less its marks, a word is a number if it
has digits with ``.,:/`` between them, perhaps with a unit right after; a unit if it is in ``UNITS`` and
the word before it is a number; a name if it begins with an upper-case and then a lower-case letter, is
not the first word, and the word before it does not end in one of ``.!?:'")]``.

Windows are matched by 64-bit hashes. The two sides are joined without a hint: a small benchmark is sent
to the documents by the planner's own limit, a large one is shuffled. A window carries the values of its own
slots, so documents are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._store import shared_folder, stored

WINDOW = 8
LITERALS = 4
LEAST = 2
#: Units of measure.
UNITS = [
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l", "s", "sec", "min", "h",
    "hr", "hrs", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "kv", "j", "kj", "pa", "kpa", "usd", "eur",
    "gbp", "dollars", "euros", "cents", "percent", "meters", "metres", "miles", "hours", "minutes", "seconds", "days", "weeks",
    "months", "years", "grams", "kilograms", "liters", "litres", "degrees",
]

BETWEEN, NUM, NAME, UNIT, LAST = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
SPACE = r"[\x20\x09-\x0D]+"
MARKS = r"!-/:-@\[-`{-~"
_UNIT = "|".join(UNITS)
_NUMBER = rf"[0-9](?<![^\x20].)(?:[0-9.,:/]*[0-9])?(?:{_UNIT})?"


def _spaced(text: Column) -> Column:
    """The words with one space between them."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def template(text: Column) -> Column:
    """The template words with one space between them, as many as the text has; a placeholder is one of
    ``NUM``, ``NAME`` and ``UNIT``, with the value that it stands for behind it."""
    # every pattern begins with the character it replaces, and looks back from there
    out = F.regexp_replace(_spaced(text), rf"\x20(?<=[^.!?:'\")\]\x20]\x20)[{MARKS}]*(\p{{Lu}}\p{{Ll}}[^\x20]*)", f" {NAME}$1")
    out = F.regexp_replace(F.lower(out), rf"[{MARKS}](?:(?<![^\x20].)[{MARKS}]*+(?=[^\x20])|(?<=[^\x20{MARKS}].)[{MARKS}]*+(?![^\x20]))", "")
    with_numbers = F.regexp_replace(out, rf"({_NUMBER})(?![^\x20])", f"{NUM}$1")
    with_units = F.regexp_replace(with_numbers, rf"({NUM}[^\x20]+\x20)({_UNIT})(?![^\x20])", f"$1{UNIT}$2")
    return F.when(F.coalesce(text, F.lit("")).rlike("[0-9]"), with_units).otherwise(out)


def _kind(word: Column) -> Column:
    """The placeholder of a template word; the word itself where it is a literal."""
    return F.when(word < LAST, F.substring(word, 1, 1)).otherwise(word)


def _value(word: Column) -> Column:
    return F.when(word < LAST, F.substring(word, 2, 1 << 30)).otherwise("")


def _words(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, w, h, v): template words, their hashes and their values; Generates keep them from being
    computed again for each use."""
    rows = df.select(*keys, F.explode(F.array(F.split(template(F.col(text)), " "))).alias("w"))
    both = F.struct(F.transform("w", lambda w: F.xxhash64(_kind(w))).alias("h"), F.transform("w", _value).alias("v"))
    return rows.select(*keys, "w", F.explode(F.array(both)).alias("hv")).select(*keys, "w", "hv.h", "hv.v")


def _windows(words: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys, pos, length, key, values) of all runs of so many words; values of literals are empty."""
    h, runs = F.col("h"), []
    for n in lengths:
        every = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct(
            i.alias("pos"), F.lit(n).alias("length"), F.xxhash64(F.lit(n), *(F.get(h, i + k) for k in range(n))).alias("key"),
            F.concat_ws(BETWEEN, F.slice("v", i + 1, n)).alias("values"),
        ))
        runs.append(F.when(F.size(h) >= n, every))
    rows = words.select(*keys, F.explode(runs[0] if len(runs) == 1 else F.flatten(F.array_compact(F.array(*runs)))).alias("run"))
    return rows.select(*keys, "run.*")


def leaking_texts(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, th, item_id, windows, item_windows, changed) of every text and item that hit at some shift; th is the text's ``xxhash64``.

    Rows are told apart by id and text, so a null id, or one that is on several texts, keeps its hits apart.
    """
    folder = folder or shared_folder(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"), F.xxhash64(doc_text).alias("th"))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), F.xxhash64(item_text).alias("ih"))
    items = stored(items.distinct(), f"{folder}/items")
    names = ["item", "ih"]

    known = _words(items, names, "text").withColumn("own", F.least(F.size("w"), F.lit(WINDOW)))
    known = stored(known, f"{folder}/known")
    lengths = [r.own for r in known.select("own").where(F.col("own") >= LITERALS).distinct().collect()]  # at most WINDOW values
    if not lengths:
        nothing = (F.lit(0).cast("long").alias(c) for c in ("windows", "item_windows", "changed"))
        return docs.where(F.lit(False)).select("doc_id", "th", F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id"), *nothing)
    wanted = _windows(known, [*names, "w", "own"], lengths).where("length = own").withColumn("w", F.slice("w", F.col("pos") + 1, F.col("length")))
    literal = F.size(F.filter("w", lambda w: w >= LAST))
    wanted = stored(wanted.where(literal >= LITERALS).select(*names, F.col("pos").alias("at"), "w", "key"), f"{folder}/wanted")
    found = _windows(_words(docs, ["doc_id", "th"], "text"), ["doc_id", "th"], lengths).drop("length")
    hits = found.join(wanted, "key").select("doc_id", "th", *names, (F.col("pos") - F.col("at")).alias("shift"), "at", "w", "values")
    hits = stored(hits.dropDuplicates(["doc_id", "th", *names, "shift", "at"]), f"{folder}/hits")

    place = ["doc_id", "th", *names, "shift"]
    slot = F.arrays_zip(F.col("w"), F.split("values", BETWEEN, -1).alias("value"))
    pairs = hits.select(*place, "at", F.posexplode(slot).alias("p", "slot")).where(F.col("slot.w") < LAST)
    pairs = pairs.select(*place, (F.col("at") + F.col("p")).alias("p"), F.substring("slot.w", 1, 1).alias("kind"), F.substring("slot.w", 2, 1 << 30).alias("asked"), "slot.value").distinct()
    pairs = pairs.groupBy(*place, "kind", "asked", "value").agg(F.count("*").alias("n"))
    # one value on the other side, each way
    there = pairs.groupBy(*place, "kind", "asked").agg((F.min("value") == F.max("value")).alias("ok"), F.sum(F.when(F.col("value") != F.col("asked"), F.col("n")).otherwise(0)).alias("changed"))
    back = pairs.groupBy(*place, "kind", "value").agg((F.min("asked") == F.max("asked")).alias("ok"), F.lit(0).cast("long").alias("changed"))
    both = there.select(*place, "ok", "changed").union(back.select(*place, "ok", "changed"))
    both = both.groupBy(*place).agg(F.min("ok").alias("ok"), F.sum("changed").alias("changed"))

    counted = hits.groupBy(*place).agg(F.count("*").alias("windows"))
    total = wanted.groupBy(*names).agg(F.count("*").alias("item_windows"))
    a, b = counted.alias("a"), both.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    for c in place[1:]:
        same &= F.col(f"a.{c}") == F.col(f"b.{c}")
    kept = a.join(b, same, "left").where(F.coalesce("b.ok", F.lit(True))).select(*(f"a.{c}" for c in place), "a.windows", F.coalesce("b.changed", F.lit(0)).alias("changed"))
    kept = kept.join(total, names).where(F.col("windows") >= F.least(F.lit(LEAST), F.col("item_windows")))
    return kept.join(items.select(*names, "item_id"), names).select("doc_id", "th", "item_id", "windows", "item_windows", "changed")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", folder: str | None = None) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, changed): the items that each document leaks.

    windows: the item's windows that the document has, at the shift with most; changed: slots there whose
    value is another one in the document. Null and empty texts on either side leak nothing. Ids that are on
    several texts are one here, with the best match. Items that share a null id count as one item.
    """
    kept = leaking_texts(docs, benchmark, doc_id, doc_text, item_id, item_text, folder)
    best = F.max(F.struct("windows", (-F.col("changed")).alias("unchanged"), "item_windows"))
    out = kept.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "item_id", "best.windows", "best.item_windows", (-F.col("best.unchanged")).alias("changed"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; other texts of the same id, or of a null id, stay."""
    found = leaking_texts(docs, benchmark).select("doc_id", "th").distinct().alias("found")
    same = F.col("docs.doc_id").eqNullSafe(F.col("found.doc_id")) & (F.xxhash64("docs.text") == F.col("found.th"))
    return docs.alias("docs").join(found, same, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SQL_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def words_sql(table: str, key: str, where: str = "TRUE") -> str:
    """Reference: (key, pos, t, v) of every word, worked out word by word."""
    return f"""
SELECT {key}, pos, v,
  CASE WHEN is_name THEN '<name>' WHEN is_number THEN '<num>'
       WHEN is_unit AND coalesce(lag(is_number) OVER (PARTITION BY {key} ORDER BY pos), FALSE) THEN '<unit>'
       ELSE v END AS t
FROM (
  SELECT {key}, pos, lower(core) AS v,
    coalesce(prev IS NOT NULL AND prev[-1] NOT IN ('.', '!', '?', ':', '''', '"', ')', ']')
      AND regexp_full_match(regexp_replace(w, '^[!-/:-@\\[-`{{-~]+', ''), '(?s)\\p{{Lu}}\\p{{Ll}}.*'), FALSE) AS is_name,
    regexp_full_match(lower(core), '[0-9]([0-9.,:/]*[0-9])?({_UNIT})?') AS is_number,
    lower(core) IN ({_SQL_UNITS}) AS is_unit
  FROM (
    SELECT {key}, pos, w, lag(w) OVER (PARTITION BY {key} ORDER BY pos) AS prev,
      CASE WHEN regexp_full_match(w, '[!-/:-@\\[-`{{-~]*') THEN w
           ELSE regexp_replace(regexp_replace(w, '^[!-/:-@\\[-`{{-~]+', ''), '[!-/:-@\\[-`{{-~]+$', '') END AS core
    FROM (
      SELECT {key}, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w
      FROM (SELECT {key}, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {table} WHERE {where})
    )
  )
)"""


def leaks_sql(table: str = "documents") -> str:
    """Reference for whole texts with unique ids, by windows as lists of words."""
    windows = """
SELECT {key}, pos, list(t) OVER w AS ts FROM {source}
WINDOW w AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)"""
    return f"""
WITH dw AS MATERIALIZED ({words_sql(table, 'doc_id')}),
iw AS MATERIALIZED ({words_sql('benchmark', 'item_id')}),
iwin AS MATERIALIZED (
  SELECT item_id, pos, ts FROM ({windows.format(key='item_id', source='iw')}) x
  JOIN (SELECT item_id, least(count(*), {WINDOW}) AS n FROM iw GROUP BY item_id) y USING (item_id)
  WHERE len(ts) = n AND len(list_filter(ts, lambda t: t NOT IN ('<num>', '<name>', '<unit>'))) >= {LITERALS}),
dwin AS (SELECT doc_id, pos, ts FROM ({windows.format(key='doc_id', source='dw')}) x WHERE len(ts) = {WINDOW}),
hits AS MATERIALIZED (
  SELECT DISTINCT d.doc_id, i.item_id, d.pos - i.pos AS shift, i.pos AS at_ FROM dwin d JOIN iwin i USING (ts)),
pairs AS MATERIALIZED (
  SELECT DISTINCT h.doc_id, h.item_id, h.shift, i.pos, i.t, i.v AS asked, d.v AS value
  FROM hits h JOIN iw i ON i.item_id = h.item_id AND i.pos BETWEEN h.at_ AND h.at_ + {WINDOW - 1}
  JOIN dw d ON d.doc_id = h.doc_id AND d.pos = i.pos + h.shift WHERE i.t IN ('<num>', '<name>', '<unit>')),
bad AS (
  SELECT doc_id, item_id, shift FROM pairs GROUP BY doc_id, item_id, shift, t, asked HAVING count(DISTINCT value) > 1
  UNION SELECT doc_id, item_id, shift FROM pairs GROUP BY doc_id, item_id, shift, t, value HAVING count(DISTINCT asked) > 1),
changes AS (SELECT doc_id, item_id, shift, count(*) FILTER (asked <> value) AS changed FROM pairs GROUP BY ALL),
best AS (
  SELECT h.doc_id, h.item_id, h.shift, count(*) AS windows, any_value(coalesce(c.changed, 0)) AS changed
  FROM hits h LEFT JOIN changes c USING (doc_id, item_id, shift) ANTI JOIN bad b USING (doc_id, item_id, shift)
  GROUP BY h.doc_id, h.item_id, h.shift)
SELECT doc_id, item_id, max(windows) AS windows, any_value(n) AS item_windows,
  CAST(arg_min(changed, -1000000 * windows + changed) AS BIGINT) AS changed
FROM best JOIN (SELECT item_id, count(*) AS n FROM iwin GROUP BY item_id) USING (item_id)
WHERE windows >= least({LEAST}, n) GROUP BY doc_id, item_id"""


SQL = leaks_sql()
