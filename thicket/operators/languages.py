"""Languages of texts by character profiles counted from labelled texts.

A profile holds how often a language has each run of three characters (letters, and one blank between words).
A text is given the language under whose profile its own runs are likeliest, among the languages that are written
in the text's script. A text in a script that no labelled text uses, or without any letters, has no language: nothing
falls back to a default.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.text import text_or_empty
from thicket.session import materialise

# task code travels with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 3
POINT_BITS = 21  # of a code point; a run is one number
CHUNK_BYTES = 1 << 20  # of texts that are cut at once; a text is never parted
HELD = 1 << 20  # runs that a task counts before it hands them on
SMOOTHING = 0.5
#: Scripts by their Unicode names, in the order that ties are decided in.
SCRIPTS = ["Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Thai", "Georgian", "Armenian", "Hangul", "Han", "Hiragana", "Katakana"]


def script(text: Column) -> Column:
    """The script that most letters are in, null without letters of these scripts; kana make a text Japanese, not Han."""
    whole = text_or_empty(text)

    def letters(name: str) -> Column:
        return F.length(whole) - F.length(F.regexp_replace(whole, rf"\p{{Is{name}}}", ""))

    plain = ~whole.rlike(r"[^\x00-\x{024F}\x{2000}-\x{206F}]")  # nothing but Latin letters: no need to count
    counts = F.array(*[F.struct(letters(name).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, name in enumerate(SCRIPTS)])
    most = F.array_max(F.filter(counts, lambda c: c["n"] > 0))["name"]
    some = F.when(whole.rlike(r"\p{IsLatin}"), F.lit("Latin"))
    return F.when(plain, some).otherwise(F.when(most.isin("Hiragana", "Katakana"), "Kana").otherwise(most))


def _words(text: Column) -> Column:
    """The lower-cased letters of the text with one blank around each word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text_or_empty(text)), r"[^\p{L}]+", " ")), F.lit(" "))


def _cut_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, script, words) of the rows that have a script."""
    cut = rows.select(*keys, script(F.col("text")).alias("script"), F.explode(F.array(_words(F.col("text")))).alias("words"))  # once, not for each use
    return cut.where("script IS NOT NULL")


def _runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The row and the number of each run of ``SIZE`` characters, for about ``CHUNK_BYTES`` of texts at a time."""
    texts = texts.cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_BYTES, "right")))
        some = [t.decode() for t in texts[low:high].to_pylist()]
        points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(low, high), [len(t) for t in some])
        if len(points) >= SIZE:
            run = points[: len(points) - SIZE + 1].copy()
            for k in range(1, SIZE):
                run = run << POINT_BITS | points[k : len(points) - SIZE + 1 + k]
            inside = row[: len(run)] == row[SIZE - 1 :]
            yield row[: len(run)][inside], run[inside]
        low = high


def _totals(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different runs and the sum of the counts of each."""
    run, back = np.unique(np.concatenate([r for r, _ in held]), return_inverse=True)
    return run, np.bincount(back, np.concatenate([n for _, n in held]), len(run)).astype(np.int64)


def _counted_by_text(rows: DataFrame, key: str) -> DataFrame:
    """(key, script, run, n): how often each text has each of its runs, one row for each."""
    cut = _cut_rows(rows, [key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in _runs(batch.column(2)):
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                first = np.flatnonzero(np.concatenate([[True] * min(1, len(row)), (row[1:] != row[:-1]) | (found[1:] != found[:-1])]))
                n = np.diff(np.append(first, len(row)))
                own = pa.array(row[first])
                yield pa.record_batch([batch.column(0).take(own), batch.column(1).take(own), pa.array(found[first]), pa.array(n)], names=[key, "script", "run", "n"])

    return cut.mapInArrow(run, f"{key} {cut.schema[key].dataType.simpleString()}, script string, run long, n long")


def _counted_by_language(rows: DataFrame) -> DataFrame:
    """(lang, script, run, n): a task counts the runs of its own rows before anything is shuffled."""

    def handed(held: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (lang, name), (found, n) in held.items():
            yield pa.record_batch([pa.array([lang] * len(n), pa.string()), pa.array([name] * len(n), pa.string()), pa.array(found), pa.array(n)], names=["lang", "script", "run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            kinds = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            number = {kind: i for i, kind in enumerate(dict.fromkeys(kinds))}
            numbers = np.array([number[kind] for kind in kinds], np.int64)
            for row, found in _runs(batch.column(2)):
                own = numbers[row]
                for kind, i in number.items():
                    some = found[own == i]
                    if len(some):
                        held[kind] = _totals([*([held[kind]] if kind in held else []), (some, np.ones(len(some), np.int64))])
                if sum(len(n) for _, n in held.values()) > HELD:
                    yield from handed(held)
                    held = {}
        yield from handed(held)

    counted = _cut_rows(rows, ["lang"]).mapInArrow(run, "lang string, script string, run long, n long")
    return counted.groupBy("lang", "script", "run").agg(F.sum("n").alias("n"))


def language_profiles(labelled: DataFrame) -> DataFrame:
    """(script, lang, run, gain, unseen) from ``labelled`` (lang, text), rows without a language left out.

    A run is the number that its code points make, ``POINT_BITS`` each. ``unseen`` is the log probability of a run that the language never has, ``gain`` what a known run has more.
    A script is a language's own if a tenth of its runs is in it.
    """
    counts = materialise(_counted_by_language(labelled.where("lang IS NOT NULL").select("lang", "text")))  # read three times
    own = counts.groupBy("lang", "script").agg(F.sum("n").alias("total"))
    whole = own.groupBy("lang").agg(F.sum("total").alias("whole"))
    own = own.join(whole, "lang").where(F.col("total") * 10 >= F.col("whole")).drop("whole")
    kinds = counts.groupBy("script").agg(F.count_distinct("run").alias("kinds"))
    rows = counts.join(own, ["lang", "script"]).join(kinds, "script")
    size = F.col("total") + SMOOTHING * F.col("kinds")
    gain = F.log((F.col("n") + SMOOTHING) / F.lit(SMOOTHING))
    return rows.select("script", "lang", "run", gain.alias("gain"), F.log(F.lit(SMOOTHING) / size).alias("unseen"))


def tagged(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, script, lang, margin) of each distinct id; margin is the lead over the next language, for each run.

    A language's score is the sum over the text's runs; runs it does not know count alike, so only known ones are
    joined. A task counts the runs of its own texts, so each different run of a text is joined once. Ties go to the first language by name. Null, empty and letterless texts, and those in a script without
    a profile, have no language. Rows that share an id are one text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    profiles = materialise(profiles)  # read twice; its size is known to the planner
    cut = _cut_rows(rows, ["id"])
    langs = profiles.select("script", "lang", "unseen").distinct()
    known = _counted_by_text(rows, "id").join(profiles.select("script", "lang", "run", "gain"), ["script", "run"])
    gains = known.groupBy("id", "script", "lang").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    totals = cut.where(F.length("words") >= SIZE).groupBy("id", "script").agg(F.sum(F.length("words") - SIZE + 1).alias("runs"))
    scores = totals.join(langs, "script").join(gains, ["id", "script", "lang"], "left")
    score = F.coalesce("gain", F.lit(0.0)) + F.col("runs") * F.col("unseen")
    ranked = scores.groupBy("id", "script", "runs").agg(F.sort_array(F.collect_list(F.struct((-score).alias("cost"), "lang"))).alias("best"))
    lead = F.when(F.size("best") > 1, (F.get("best", F.lit(1))["cost"] - F.get("best", F.lit(0))["cost"]) / F.col("runs"))
    best = ranked.select("id", "script", F.get("best", F.lit(0))["lang"].alias("lang"), lead.alias("margin"), F.col("runs"))
    one = best.groupBy("id").agg(F.max(F.struct("runs", "script", "lang", "margin")).alias("b"))
    every = rows.select("id").distinct()
    same = F.col("every.id").eqNullSafe(F.col("one.id"))
    return every.alias("every").join(one.alias("one"), same, "left").select(F.col("every.id").alias(id_col), "one.b.script", "one.b.lang", "one.b.margin")
