"""Substring containment as an equality join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.session import materialise


def contained_in(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """(hay, needle) pairs where ``needle`` is a substring of ``hay``.

    Every hay string is cut into its substrings of the lengths that occur among
    the needles, and those join the needles on equality: no nested loop, and
    the work per hay string follows its length, not the number of needles.
    """
    needles = needles.select("needle").filter(F.col("needle") != "").distinct()
    lengths = needles.agg(F.collect_set(F.length("needle")).alias("lengths"))
    hay = hay.select("hay").distinct()
    cut = (
        hay.select("hay", F.explode(lengths.scalar()).alias("n"))
        .filter(F.length("hay") >= F.col("n"))
        .select(
            "hay", "n", F.explode(F.sequence(F.lit(1), F.length("hay") - F.col("n") + 1)).alias("i")
        )
        .select("hay", F.substring(F.col("hay"), F.col("i"), F.col("n")).alias("needle"))
    )
    return cut.join(needles, "needle").select("hay", "needle").distinct()


def letter_runs(text):
    """Distinct maximal runs of a-z in the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)))


def run_needles(docs: DataFrame, needles: DataFrame, text: str = "text") -> DataFrame:
    """(run, needle): which a-z needles occur in which letter runs of the texts.

    A needle made of a-z only lies inside one maximal run of letters, so the
    match is decided once per distinct run instead of once per text.
    """
    runs = docs.select(F.explode(letter_runs(F.col(text))).alias("hay"))
    return contained_in(runs, needles).withColumnRenamed("hay", "run")


def found_needles(needles: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs(uri, rid, text, …)`` grouped by ``keys``, with the needles its texts contain.

    ``found`` is an array of (rid, needle); groups without a hit are left out.
    Every text is read where it lies and joined to the run table in the same
    task, so only the needles found are shuffled, and the result is
    hash-partitioned by ``keys`` for whatever is computed from it.
    """
    rest = [c for c in docs.columns if c != "text"]
    matches = materialise(run_needles(docs, needles))
    tokens = docs.select(*rest, F.explode(letter_runs(F.col("text"))).alias("run"))
    others = [F.first(c).alias(c) for c in rest if c not in ("uri", "rid")]
    return (
        tokens.join(matches, "run")
        .groupBy(*keys)
        .agg(F.collect_set(F.struct("rid", "needle")).alias("found"), *others)
    )


def keyword_hits(keywords: DataFrame, docs: DataFrame) -> DataFrame:
    """(uri, keyword) for every a-z keyword contained in a document's text."""
    needles = keywords.select(F.col("keyword").alias("needle"))
    texts = docs.select("uri", F.lit(0).alias("rid"), "text")
    found = found_needles(needles, texts, ["uri"])
    return found.select("uri", F.explode("found.needle").alias("keyword"))


def _segment(length: Column, i: Column, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a string cut into k + 1 nearly equal ones."""
    base, longer = F.floor(length / (k + 1)), length % (k + 1)
    first_longer = F.lit(k + 1) - longer
    return i * base + F.greatest(i - first_longer, F.lit(0)), base + (i >= first_longer).cast("int")


def _stored_segments(text: Column, k: int) -> Column:
    """(length, segment, part) of a string's k + 1 segments."""
    length = F.length(text)

    def part(i: Column) -> Column:
        start, size = _segment(length, i, k)
        return F.struct(length.alias("length"), i.alias("segment"), F.substring(text, start + 1, size).alias("part"))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), part)


def _asked_segments(text: Column, k: int) -> Column:
    """(length, segment, part) that a string within ``k`` edits of ``text`` may have stored.

    Of k + 1 segments one stays whole with at most ``i`` edits left and ``k - i`` right of it, so it lies at most that
    far from its place: about (k + 1) ** 3 / 2 parts at most, whatever the length of the text.
    """
    own = F.length(text)

    def parts(length: Column, i: Column) -> Column:
        start, size = _segment(length, i, k)
        more = own - length
        low = F.greatest(start - i, start + more - (k - i), F.lit(0))
        high = F.least(start + i, start + more + (k - i), own - size)
        cut = F.transform(
            F.sequence(low, F.greatest(low, high)),
            lambda at: F.struct(length.alias("length"), i.alias("segment"), F.substring(text, at + 1, size).alias("part")),
        )
        return F.when(low <= high, cut)

    lengths = F.sequence(F.greatest(own - k, F.lit(0)), own + k)
    every = F.transform(lengths, lambda n: F.flatten(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: parts(n, i)))))
    return F.array_distinct(F.flatten(every))


def near_names(names: DataFrame, dim: DataFrame, k: int = 2) -> DataFrame:
    """(hay, near, distance) pairs of names within ``k`` edits.

    A name of ``dim`` is cut into k + 1 segments, one of which ``k`` edits must leave whole; ``names`` look for it
    near its place. So candidates come from an equality join on (length, segment, part) with k + 1 rows for a stored
    name and, for two edits, at most 19 for an asked one, however long they are; only candidates are measured.
    Nulls are near nothing.
    """
    left = names.select("hay").where("hay IS NOT NULL").distinct()
    right = dim.select("near").where("near IS NOT NULL").distinct()
    left = left.select("hay", F.explode(_asked_segments(F.col("hay"), k)).alias("s")).select("hay", "s.*")
    right = right.select("near", F.explode(_stored_segments(F.col("near"), k)).alias("s")).select("near", "s.*")
    pairs = left.join(right, ["length", "segment", "part"]).select("hay", "near").distinct()
    measured = pairs.withColumn("distance", F.levenshtein("hay", "near", k))
    return measured.filter(F.col("distance") >= 0)
