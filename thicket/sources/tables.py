"""CSV, N-Triples, paragraph and index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket import schemas as M
from thicket import vocab as V
from thicket.functions import text as X
from thicket.operators.ordering import dedupe_best, numbered
from thicket.operators.triples import lang_matches, match, term, unpivot_terms

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
LISTS = ("urls", "references")

# -- definition records -----------------------------------------------------


def write_definitions_raw(df: DataFrame, path: str, compression: str = "none") -> None:
    """All records, lists joined by ``"; "``; ``compression`` is the codec of the files."""
    flat = {c: F.concat_ws("; ", c) for c in LISTS}
    df.select(*M.DEFINITION_COLS).withColumns(flat).write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", compression=compression
    ).csv(path)


def read_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Records with their lists restored and null-like texts cleaned."""
    schema = ", ".join(f"`{c}` string" for c in M.DEFINITION_COLS)
    df = spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)
    empty = F.array().cast("array<string>")
    return df.select(
        *[
            (
                F.coalesce(F.split(X.clean_null(c), "; "), empty)
                if c in LISTS
                else F.coalesce(X.clean_null(c), F.lit(""))
            ).alias(c)
            for c in M.DEFINITION_COLS
        ]
    )


def clean_definitions(df: DataFrame) -> DataFrame:
    """Records without junk and navigation, canonical scope and type, title path."""
    titles = [f"title_{i}" for i in range(1, 5)]
    kept = df.filter(~X.is_junk("definition", single_dash=True)).filter(
        X.is_concept_path(X.title_path(*titles))
    )
    return kept.withColumns(
        {
            "title_3": F.coalesce(X.map_scope("title_3"), F.col("title_3")),
            "title_4": F.coalesce(X.map_type("title_4"), F.col("title_4")),
            "bold_terms": X.clean_terms("bold_terms"),
        }
    ).withColumn("title_path", X.title_path(*titles))


def write_definitions_clean(df: DataFrame, path: str, compression: str = "none") -> None:
    flat = {c: F.concat_ws("; ", c) for c in LISTS}
    clean_definitions(df).withColumns(flat).write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", compression=compression
    ).csv(path)


# -- threshold table --------------------------------------------------------


def threshold_rows(raw: DataFrame) -> DataFrame:
    """S2 after the scan: typed rows without blank countries and caption rows."""
    named = raw.withColumn("country", F.coalesce(X.clean_null("country_clean"), F.lit("")))
    kept = named.filter((F.col("country") != "") & ~F.contains("country", F.lit("Table 3")))
    return kept.select(
        "country",
        F.coalesce(X.clean_null("definition_type_clean"), F.lit("")).alias("type"),
        (F.trim(F.coalesce("is_unfccc", F.lit(""))) == "True").alias("is_unfccc"),
        X.lower_bound("area_ha").alias("area_ha"),
        X.lower_bound("crown_cover_percent").alias("crown_cover"),
        X.lower_bound("tree_height_m").alias("height_m"),
        X.lower_bound("strip_width_m").alias("width_m"),
        F.coalesce(X.clean_null("notes"), F.lit("")).alias("notes"),
        F.trim(F.coalesce("countries", F.lit(""))).alias("source_row"),
        "pos",
    )


def read_thresholds_raw(spark: SparkSession, path: str) -> DataFrame:
    """Text rows of the threshold file, or of a folder of files, with their place from 0 up.

    Places follow the name of the file, the block and the row in it, whichever way Spark deals files to
    tasks: a block is read by one task in order, so the rows' running id is their order within it.
    """
    raw = spark.read.options(nullValue="nan", **CSV_OPTIONS).schema(M.THRESHOLD_FILE).csv(path)
    placed = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = numbered(placed, [], ["_file", "_start", "_row"], "pos")
    return rows.withColumn("pos", F.col("pos") - 1).drop("_file", "_start", "_row")


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return threshold_rows(read_thresholds_raw(spark, path))


def threshold_columns(df: DataFrame) -> DataFrame:
    """The three derived columns of the threshold sink."""
    return df.withColumns(
        {
            "country_clean": X.norm_country_csv("countries"),
            "definition_type_clean": X.map_threshold_type("definition_type"),
            "is_unfccc": F.when(X.is_unfccc("countries"), F.lit("True")).otherwise(F.lit("False")),
        }
    )


def write_thresholds(df: DataFrame, path: str) -> None:
    threshold_columns(df).select(*M.THRESHOLD_FILE.fieldNames()).write.mode("overwrite").options(
        header=True, quote='"', escape='"', nullValue="nan"
    ).csv(path)


def thresholds_from_df(df: DataFrame) -> DataFrame:
    """Any frame with some of the seven columns as all-text records."""
    return df.select(
        *[
            X.text_or_empty(c if c in df.columns else F.lit("")).alias(c)
            for c in M.THRESHOLD_RAW.fieldNames()
        ],
        *[c for c in df.columns if c == "pos"],
    )


# -- triples ----------------------------------------------------------------

NODE = r"<([^>]*)>|(_:\S+?)"
LINE = (
    rf'^\s*(?:{NODE})\s+<([^>]*)>\s+'
    rf'(?:<([^>]*)>|(_:\S+?)|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9\-]+)|\^\^<([^>]*)>)?)\s*\.\s*$'
)


def _unescape(col: Column) -> Column:
    """Escapes of a literal are those of JSON strings, but for the single quote."""
    quoted = F.concat(F.lit('["'), F.replace(col, F.lit("\\'"), F.lit("'")), F.lit('"]'))
    plain = F.get(F.from_json(quoted, "array<string>"), 0)
    return F.when(F.contains(col, F.lit("\\")), F.coalesce(plain, col)).otherwise(col)


SEP = "\u001f"
FIELDS = SEP + SEP.join(f"${i}" for i in (1, 2, 3, 4, 5, 7, 8, 6))


def parse_triples(lines: DataFrame) -> DataFrame:
    """S3 after the scan: ``value`` lines to triples; comments and blanks are left out.

    The pattern runs once per line, which it rewrites into separated fields with
    the literal's text last. Lines that are no triples are in ``rejected_lines``.
    """
    value = F.col("value")
    cut = F.split(F.regexp_replace(value, LINE, FIELDS), SEP, 9)
    rows = lines.filter(~value.startswith(SEP)).select(cut.alias("f")).filter(
        (F.size("f") == 9) & (F.get("f", 0) == "")
    )

    def field(i: int) -> Column:
        return X.blank_to_null(F.get("f", i))

    is_literal = field(4).isNull() & field(5).isNull()
    return rows.select(
        F.coalesce(field(1), field(2)).alias("s"),
        field(3).alias("p"),
        F.when(is_literal, _unescape(F.get("f", 8)))
        .otherwise(F.coalesce(field(4), field(5))).alias("o"),
        F.when(is_literal, F.lit("literal")).otherwise(F.lit("iri")).alias("o_kind"),
        F.when(is_literal, field(6)).alias("lang"),
        F.when(is_literal, field(7)).alias("dtype"),
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """S3: (value, reason) of the lines that are neither triples nor comments nor blank."""
    value = F.col("value")
    reason = (
        F.when(~value.rlike(r"\.\s*$"), F.lit("no closing dot"))
        .when(~value.rlike(rf"^\s*(?:{NODE})\s"), F.lit("subject is no IRI or blank node"))
        .when(~value.rlike(rf"^\s*(?:{NODE})\s+<[^>]*>\s"), F.lit("predicate is no IRI"))
        .otherwise(F.lit("object does not parse"))
    )
    solid = lines.filter(~value.rlike(r"^\s*(#.*)?$") & ~value.rlike(LINE))
    return solid.select("value", reason.alias("reason"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """S3: one triple per line, or a Parquet table written by ``write_triples``."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path).select(*M.TRIPLE_COLS)
    return parse_triples(spark.read.text(path)).dropDuplicates()


def triple_lines(triples: DataFrame) -> DataFrame:
    def node(col: str) -> Column:
        blank = F.col(col).startswith("_:")
        return F.when(blank, F.col(col)).otherwise(F.concat(F.lit("<"), F.col(col), F.lit(">")))

    text = F.col("o")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    literal = F.concat(
        F.lit('"'), text, F.lit('"'),
        F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), F.col("lang")))
        .when(F.col("dtype").isNotNull(), F.concat(F.lit("^^<"), F.col("dtype"), F.lit(">")))
        .otherwise(F.lit("")),
    )
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o"))
    return triples.select(F.concat_ws(" ", node("s"), node("p"), obj, F.lit(".")).alias("value"))


def write_triples(triples: DataFrame, path: str) -> None:
    """Text lines, or Parquet split by predicate so that readers prune on it.

    Rebalancing gives each predicate files of a sensible size: small ones are
    merged and large ones spread over several tasks.
    """
    if path.rstrip("/").endswith((".parquet", ".pq")):
        rows = triples.select(*M.TRIPLE_COLS).hint("rebalance", "p")
        rows.write.mode("overwrite").partitionBy("p").parquet(path)
    else:
        triple_lines(triples).write.mode("overwrite").text(path)


# -- paragraphs and table cells ---------------------------------------------


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Headed paragraphs stored as Parquet or as JSON lines."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return spark.read.schema(M.PARAGRAPH).json(path)
    return spark.read.parquet(path).select(*M.PARAGRAPH.fieldNames())


BLOCK = r"(?s)(<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li)>)"
PIECE = r"(?s)(<(?:b|strong)(?:\s[^>]*)?>.*?</(?:b|strong)>|<[^>]*>|[^<]+)"


def _no_tags(col: Column) -> Column:
    return F.regexp_replace(col, r"<[^>]*>", "")


def paragraphs_from_html(pages: DataFrame, doc_id: str = "page_id", html: str = "html"):
    """Heading, paragraph and list blocks of web pages as headed paragraphs."""
    blocks = pages.select(
        F.col(doc_id).cast("string").alias("doc_id"),
        F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BLOCK), F.lit(1))).alias("pos", "b"),
    )
    level = F.regexp_extract("b", r"^<h([1-6])", 1)
    pieces = F.regexp_extract_all(
        F.regexp_replace("b", r"^<[^>]*>|</[^>]*>$", ""), F.lit(PIECE), F.lit(1)
    )
    is_bold = "^<(b|strong)[ >]"
    runs = F.filter(
        F.transform(
            pieces,
            lambda p: F.struct(_no_tags(p).alias("text"), p.rlike(is_bold).alias("bold")),
        ),
        lambda r: r["text"] != "",
    )
    return blocks.select(
        "doc_id", F.col("pos").cast("long").alias("pos"),
        F.when(level != "", F.concat(F.lit("Heading "), level)).otherwise(F.lit("Normal")).alias(
            "style"
        ),
        _no_tags(F.col("b")).alias("text"), runs.alias("runs"),
    )


def marked_tables(cells: DataFrame, marker: str) -> DataFrame:
    """(doc_id, table_no) of the tables whose cell texts, joined by spaces, hold the marker.

    A phrase of w words lies in at most w cells in a row, each with a word of it,
    so each such cell is joined with its neighbours only; ``seq`` is a cell's
    place in its table.
    """
    words = marker.split(" ")
    low = F.lower("text")
    touches = F.lit(False)
    for word in words:
        touches = touches | F.contains(low, F.lit(word))
    near = cells.filter(touches).select(
        "doc_id", "table_no", low.alias("low"), "seq",
        F.explode(F.sequence(F.col("seq") - (len(words) - 1), F.col("seq"))).alias("start"),
    )
    joined = near.groupBy("doc_id", "table_no", "start").agg(
        F.count("*").alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        F.array_join(F.sort_array(F.collect_list(F.struct("seq", "low")))["low"], " ").alias("t"),
    )
    whole = F.col("hi") - F.col("lo") + 1 == F.col("n")
    return joined.filter(whole & F.contains("t", F.lit(marker))).select(
        "doc_id", "table_no"
    ).unionByName(
        cells.filter(F.contains(low, F.lit(marker))).select("doc_id", "table_no")
    ).distinct()


def extract_table(
    cells: DataFrame, marker: str = V.TABLE_MARKER, columns: list[str] | None = None,
    headers: list[str] | None = None,
) -> DataFrame:
    """Rows of the first marked table of each document.

    ``cells`` is (doc_id, table_no, row_no, col_no, text) with trimmed texts.
    Rows of another width and header-like rows are left out.
    """
    columns = columns or M.THRESHOLD_RAW.fieldNames()
    headers = headers or V.TABLE_HEADERS
    width = len(columns)
    wide = cells.agg(F.max("col_no").alias("w")).scalar() + 1
    placed = cells.withColumn("seq", F.col("row_no") * wide + F.col("col_no"))
    target = dedupe_best(marked_tables(placed, marker), ["doc_id"], ["table_no"])
    text = X.strip(X.squeeze("text"), r" \-\n\t")
    rows = (
        cells.join(target, ["doc_id", "table_no"], "left_semi")
        .groupBy("doc_id", "table_no", "row_no")
        .agg(
            F.count("*").alias("n"),
            *[F.max(F.when(F.col("col_no") == i, text)).alias(c) for i, c in enumerate(columns)],
        )
        .filter(F.col("n") == width)
    )
    first = F.lower(columns[0])
    header_like = F.lit(False)
    for h in headers:
        header_like = header_like | F.contains(first, F.lit(h))
    return rows.filter((F.col(columns[0]) != "") & ~header_like).select(
        "doc_id", "row_no", *columns
    )


# -- search index -----------------------------------------------------------


def index_rows(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Documents with their vector and its norm; ``embeddings`` is (uri, embedding).

    A document without a vector stays with nulls: keyword search finds it.
    """
    norm = F.sqrt(
        F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    )
    return documents.join(embeddings.select("uri", "embedding"), "uri", "left").withColumn("norm", norm)


def write_index(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).parquet(path)


def index_count(spark: SparkSession, path: str) -> int:
    """Rows of a stored index, 0 when there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(path).count() if files.exists(target) else 0


def ensure_index(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> tuple[str, int]:
    """Build the index unless it has rows; returns what happened and the row count."""
    rows = index_count(spark, path)
    if rows and not force:
        return "already_indexed", rows
    write_index(build(), path)
    return "success", index_count(spark, path)


def enrich_from_vocab(triples: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """English definitions of the external concepts that top concepts align to.

    The vocabulary keeps a definition's text on a node of its own.
    """
    tops = match(triples, p=V.TOP_OF).select("s").distinct()
    aligned = (
        match(triples, p=V.EXACT_MATCH)
        .filter(F.col("o").startswith(V.ALIGN_PREFIX))
        .join(tops, "s", "left_semi")
        .select("s", F.col("o").alias("ext"))
    )
    nodes = match(vocabulary, p=V.DEFINITION).select(F.col("s").alias("ext"), F.col("o").alias("node"))
    texts = match(vocabulary, p=V.RDF + "value").filter(lang_matches("lang", "en")).select(
        F.col("s").alias("node"), F.col("o").alias("text")
    )
    found = aligned.join(nodes, "ext").join(texts, "node").groupBy("s", "ext").agg(
        F.min("text").alias("text")
    )
    first = found.groupBy("s").agg(F.min_by("text", "ext").alias("text"))
    return unpivot_terms(first, "s", term(V.DEFINITION, F.col("text"), lang="en"))
