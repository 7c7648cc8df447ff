"""Context text, citations and answer scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import text as X


def context_lines(hits: DataFrame) -> DataFrame:
    """(qid, n, block): the numbered passage of each hit."""

    def tagged(label: str, col: str):
        value = X.blank_to_null(col)
        return F.when(value.isNotNull(), F.concat(F.lit(label), value))

    meta = X.blank_to_null(
        F.concat_ws(
            " | ", tagged("Country: ", "country"), tagged("Year: ", "year"),
            tagged("Scope: ", "scope"), tagged("Organization: ", "org"),
        )
    )
    context = X.blank_to_null("graph_context")
    listed = F.coalesce(F.array_join("sources", ", "), F.lit("?"))
    block = F.concat_ws(
        "\n",
        F.format_string("[%d]", F.col("n").cast("long")),
        tagged("  Term: ", "label"),
        F.when(
            X.blank_to_null("definition").isNotNull(),
            F.concat(F.lit("  Definition: "), X.preview("definition", 600, ellipsis=False)),
        ),
        F.when(meta.isNotNull(), F.concat(F.lit("  "), meta)),
        F.when(
            context.isNotNull(),
            F.concat(
                F.lit("  [Graph context: "), X.preview(context, 250, ellipsis=False), F.lit("]")
            ),
        ),
        F.format_string(
            "  [Sources: %s | RRF: %.4f]", listed, F.coalesce("rrf_score", F.lit(0.0))
        ),
    )
    return hits.select("qid", "n", block.alias("block"))


def context_block(hits: DataFrame) -> DataFrame:
    """(qid, docs, context): the passages of a question in one text."""
    blocks = F.sort_array(F.collect_list(F.struct("n", "block")))["block"]
    return context_lines(hits).groupBy("qid").agg(
        F.count("*").alias("docs"), F.array_join(blocks, "\n\n").alias("context")
    )


def user_prompt(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(qid, prompt) with the passages and the question."""
    return questions.join(blocks, "qid").select(
        "qid",
        F.concat(
            F.format_string("Context passages (%d documents retrieved):\n", "docs"),
            F.col("context"), F.lit("\n\nQuestion: "), F.col("query"),
            F.lit("\n\nAnswer (with citations [N]):"),
        ).alias("prompt"),
    )


def _doc_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("qid").agg(F.count("*").alias("docs"))


def context_utilization(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct ``[n]`` marks over documents; 0 without documents."""
    cited = F.size(
        F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)))
    )
    share = F.when(F.col("docs") > 0, F.round(cited / F.col("docs"), 3)).otherwise(F.lit(0.0))
    return answers.join(_doc_counts(docs), "qid", "left").select(
        "qid", share.alias("context_utilization")
    )


def definition_keywords(docs: DataFrame, n: int = 20) -> DataFrame:
    """(qid, word): first ``n`` words of five or more letters of each definition."""
    words = F.regexp_extract_all(F.lower("definition"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    long_words = F.filter(words, lambda w: w.rlike("^[a-z]{5,}$"))
    usable = docs.filter(~F.array_contains("sources", "threshold"))
    return usable.select("qid", F.explode(F.slice(long_words, 1, n)).alias("word")).distinct()


def answer_coverage(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of the definitions' keywords that the answer contains."""
    low = answers.select("qid", F.lower("text").alias("low"))
    hit = F.contains(F.col("low"), F.col("word")).cast("double")
    share = (
        definition_keywords(docs).join(low, "qid").groupBy("qid").agg(F.avg(hit).alias("share"))
    )
    return answers.join(share, "qid", "left").select(
        "qid", F.round(F.coalesce("share", F.lit(0.0)), 3).alias("answer_coverage")
    )


def evaluate(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Both scores, the number of documents and the countries they come from."""
    used = docs.groupBy("qid").agg(
        F.count("*").alias("n_docs_retrieved"),
        F.sort_array(F.collect_set(X.blank_to_null("country"))).alias("sources_used"),
    )
    return (
        context_utilization(answers, docs)
        .join(answer_coverage(answers, docs), "qid")
        .join(used, "qid", "left")
        .select(
            "qid", "context_utilization", "answer_coverage",
            F.coalesce("n_docs_retrieved", F.lit(0)).alias("n_docs_retrieved"),
            F.coalesce("sources_used", F.array().cast("array<string>")).alias("sources_used"),
        )
    )


def resolve_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, n, uri, label) of the hits an answer cites, alone or in groups."""
    groups = F.regexp_extract_all("text", F.lit(r"\[([\d,\s]+)\]"), F.lit(1))
    numbers = (
        answers.select("qid", F.explode(groups).alias("g"))
        .select("qid", F.explode(F.split("g", ",")).alias("x"))
        .select("qid", F.trim("x").try_cast("long").alias("n"))
        .distinct()
    )
    return numbers.join(hits.select("qid", "n", "uri", "label"), ["qid", "n"])


def threshold_sources(hits: DataFrame) -> DataFrame:
    """Hits that came from thresholds, with the text they are listed by."""
    name = F.coalesce(X.blank_to_null("label"), X.blank_to_null("country"), F.lit("?"))
    return hits.filter(F.array_contains("sources", "threshold")).select(
        "qid", "n", "uri", name.alias("shown")
    )


def to_sources(hits: DataFrame) -> DataFrame:
    """The response fields of a hit, blanks and zeros for what is missing."""
    texts = [X.text_or_empty(c).alias(c) for c in
             ("uri", "label", "definition", "country", "year", "scope")]
    return hits.select(
        "qid", "n", *texts, F.coalesce("rrf_score", F.lit(0.0)).alias("rrf_score"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "graph_context",
    )


def source_cards(hits: DataFrame) -> DataFrame:
    """The card text of each source."""
    return hits.select(
        "qid", "n",
        F.coalesce(X.blank_to_null("label"), X.local_name("uri")).alias("title"),
        X.card_preview("definition").alias("preview"),
    )
