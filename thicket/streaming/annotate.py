"""Questions as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from thicket.functions import questions as Q
from thicket.operators import postings as P
from thicket.operators import search as S


def annotate(questions: DataFrame) -> DataFrame:
    """Filters and keywords of each question; works on static and streaming frames."""
    return Q.extract_filters(questions).withColumn("keywords", Q.question_keywords("query"))


def annotate_stream(
    questions: DataFrame, concepts: DataFrame, out: str, checkpoint: str, k: int = 10
) -> StreamingQuery:
    """ST1: keyword hits of every question of the stream against the static concepts.

    Stateless. Each micro-batch replaces its own ``batch`` folder, so a batch
    that is run again after a failure leaves the same rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        hits = S.filtered_search(annotate(batch), concepts, k)
        target = f"{out}/batch={batch_id}"
        hits.select("qid", "uri", "rank", F.col("score")).write.mode("overwrite").parquet(target)

    return (
        questions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def search_stream(
    questions: DataFrame, index: P.KeywordIndex, out: str, checkpoint: str, k: int = 10,
    asked_at: str = "asked_at", delay: str = "1 hour",
) -> StreamingQuery:
    """ST1 against a stored index: hits of every question (qid, query, asked_at) of the stream.

    A qid that was asked before is answered once, as long as the repetition comes within ``delay`` of the
    first; that memory is the query's only state and lies in the checkpoint. A micro-batch reads the postings
    of its own keywords and the rows' filter columns, no text; a batch that is run again replaces its folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        hits = P.question_hits(batch.select("qid", "query"), index, k)
        hits.select("qid", "uri", "rank", "score").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    once = questions.withWatermark(asked_at, delay).dropDuplicatesWithinWatermark(["qid"])
    return (
        once.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
