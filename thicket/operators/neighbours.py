"""Approximate nearest vectors: a stored index of cells, probed nearest first, with exact scores.

Vectors are dealt to the cell of their nearest centre and stored as a table partitioned by cell. A question
reads the cells of its nearest centres only, and the rows found are scored exactly, so nothing but recall is
approximate; with as many probes as cells the result is that of the exact search. How many cells to probe is
measured when the index is built, against an exact search, for the recall that is asked for.

Centres are fitted on a bounded sample (``SAMPLE`` rows by hash); every row is indexed. Their number grows with the
square root of the rows up to ``MOST_CELLS``, so they always fit a task; beyond that, cells grow and are read in
blocks of ``BLOCK`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.operators.ordering import top_k
from thicket.operators.search import BLOCK, _best_pairs, _unit, vector_candidates
from thicket.session import materialise

SAMPLE = 65_536
MOST_CELLS = 16_384
CELLS_PER_ROOT = 4  # cells for each unit of the square root of the rows
ASKED = 256  # rows that the number of probes is measured with
ROWS = 1024  # rows that meet all centres at once, fewer where that makes more than
PAIRS = 1 << 20  # distances
PROBED = 1 << 16  # rows of questions and cells that are made at once


@dataclass(frozen=True)
class CellIndex:
    """A stored index: ``path`` has ``rows`` (cell, uri, embedding), ``sizes`` (cell, n) and ``centres`` (cell, centre, probes)."""

    path: str
    centres: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.centres)


def _present(docs: DataFrame) -> DataFrame:
    return docs.select("uri", "embedding").where("embedding IS NOT NULL")


def _normalised(vector: str) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return F.transform(vector, lambda v: v.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def fit_centres(docs: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Centres of at most ``cells`` clusters of the unit vectors of a bounded sample."""
    some = docs.orderBy(F.xxhash64("uri"), "uri").limit(sample).select(array_to_vector(_normalised("embedding")).alias("features"))
    some = materialise(some)
    few = some.distinct().limit(max(2, cells) + 1).collect()
    if len(few) <= max(2, cells):  # no more different vectors than cells: each is a centre
        return np.stack([r.features.toArray() for r in few]) if few else np.zeros((0, 0))
    return np.stack(KMeans(k=max(2, cells), maxIter=12, seed=17).fit(some).clusterCenters())


def _distances(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres * centres).sum(axis=1) - 2 * units @ centres.T


def _at_once(centres: np.ndarray) -> int:
    return max(1, min(ROWS, PAIRS // len(centres)))


def _assigned(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS rows

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _at_once(shared.value)):
                some = batch.iloc[at : at + _at_once(shared.value)]
                yield some.assign(cell=_distances(_unit(some["embedding"]), shared.value).argmin(axis=1).astype("int32"))

    kind = docs.schema["embedding"].dataType.simpleString()
    return docs.mapInPandas(nearest, f"uri string, embedding {kind}, cell int")


def build_index(docs: DataFrame, path: str, recall: float = 0.95, k: int = V.TOP_K, cells: int | None = None) -> CellIndex:
    """Stores an index of ``docs`` (uri, embedding) below ``path`` whose probes reach ``recall`` for the ``k`` nearest.

    Rows without a vector are left out; the others have one length. A vector of zeros is near nothing and
    lies in some cell. An empty table makes an index without cells, where every search is empty.
    """
    spark = docs.sparkSession
    docs = _present(docs)
    rows = docs.count()
    cells = cells or min(MOST_CELLS, max(2, round(CELLS_PER_ROOT * math.sqrt(rows))))
    centres = fit_centres(docs, cells)
    if len(centres):
        _assigned(docs, centres).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        stored = _rows(spark, path, docs)
        stored.groupBy("cell").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
        probes = needed_probes(stored, centres, recall, k)
    else:
        probes = 0
    about = [(i, [float(x) for x in c], probes) for i, c in enumerate(centres)]
    spark.createDataFrame(about, "cell int, centre array<double>, probes int").write.mode("overwrite").parquet(f"{path}/centres")
    return CellIndex(path, centres, probes)


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """An index that was built before."""
    about = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return CellIndex(path, np.array([r.centre for r in about]), about[0].probes if about else 0)


def _rows(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    if like is None:
        return spark.read.parquet(f"{path}/rows")
    kind = like.schema["embedding"].dataType.simpleString()
    return spark.read.schema(f"uri string, embedding {kind}, cell int").parquet(f"{path}/rows")


def needed_probes(rows: DataFrame, centres: np.ndarray, recall: float, k: int) -> int:
    """The least number of cells, nearest first, that hold the share ``recall`` of the ``k`` nearest rows of ``ASKED`` rows.

    A row is no neighbour of its own here, or recall would look better than it is.
    """
    asked = rows.orderBy(F.xxhash64(F.lit(3), "uri"), "uri").limit(ASKED).toPandas()
    queries = rows.sparkSession.createDataFrame([(u, [float(x) for x in v]) for u, v in zip(asked["uri"], asked["embedding"], strict=True)], "qid string, embedding array<double>")
    exact = top_k(vector_candidates(queries, rows, k + 1).where("qid <> uri"), k, "cosine").select("qid", "uri")
    found = exact.join(rows.select("uri", "cell"), "uri").select("qid", "cell").toPandas()  # at most ASKED * k rows, but for repeated uris
    order = np.argsort(_distances(_unit(asked["embedding"]), centres), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = {u: i for i, u in enumerate(asked["uri"])}
    ranks = np.sort([place[at[q], c] for q, c in zip(found["qid"], found["cell"], strict=True)])
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1 if len(ranks) else len(centres)


def _probed(batch: pd.DataFrame, centres: np.ndarray, probes: int) -> Iterator[pd.DataFrame]:
    """The rows of a batch with each of their nearest cells, about ``PROBED`` at a time however many cells are read."""
    for at in range(0, len(batch), _at_once(centres)):
        some = batch.iloc[at : at + _at_once(centres)]
        order = np.argsort(_distances(_unit(some["embedding"]), centres), axis=1, kind="stable")[:, :probes].astype("int32")
        step = max(1, PROBED // max(1, order.shape[1]))
        for i in range(0, len(some), step):
            part = order[i : i + step]
            yield some.iloc[np.repeat(np.arange(i, i + len(part)), part.shape[1])].assign(cell=part.ravel())


def _probing(questions: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(qid, embedding, cell) of the cells that each question reads."""
    shared = questions.sparkSession.sparkContext.broadcast(centres)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _probed(batch, shared.value, probes)

    kinds = ", ".join(f"{c} {questions.schema[c].dataType.simpleString()}" for c in ("qid", "embedding"))
    return questions.mapInPandas(cells, f"{kinds}, cell int")


def cell_candidates(index: CellIndex, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(qid, uri, cosine) with the ``k`` nearest rows of each block of each probed cell.

    A cell of many rows and a cell that many questions probe are both cut into blocks of at most about ``BLOCK`` rows, and
    each pair of blocks is one group, so neither a hot cell nor a popular one is held whole.
    """
    spark = questions.sparkSession
    kind = questions.schema["qid"].dataType.simpleString()
    schema = f"qid {kind}, uri string, cosine double"
    questions = questions.select("qid", "embedding").where("embedding IS NOT NULL")
    probes = min(index.probes if probes is None else probes, index.cells)
    if not probes:
        return spark.createDataFrame([], schema)
    asked = materialise(_probing(questions, index.centres, probes))
    popular = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("q_blocks"))
    blocks = spark.read.parquet(f"{index.path}/sizes").select("cell", F.ceil(F.col("n") / BLOCK).alias("d_blocks"))
    blocks = materialise(blocks.join(popular, "cell"))  # one row for each probed cell

    def spread(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.col(f"{own}_blocks")).alias(own)
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1)).alias(other)
        return df.join(blocks, "cell").select(*df.columns, mine, each)

    docs = spread(_rows(spark, index.path), "uri", "d", "q")
    queries = spread(asked, "qid", "q", "d")

    def nearest(doc_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        if doc_rows.empty or query_rows.empty:
            return pd.DataFrame({"qid": [], "uri": [], "cosine": []})
        return _best_pairs(query_rows["qid"].to_numpy(), _unit(query_rows["embedding"]), doc_rows, k)

    keys = ["cell", "d", "q"]
    return docs.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(nearest, schema)


def approximate_search(index: CellIndex, questions: DataFrame, k: int = V.TOP_K, probes: int | None = None) -> DataFrame:
    """R2/R3 by cells: (qid, uri, score, rank) as ``search.vector_search`` gives them, of the rows in the probed cells.

    Scores are exact, ties go to the smaller uri. ``probes`` overrides the number measured for the index.
    """
    nearest = top_k(cell_candidates(index, questions, k, probes), k, "cosine")
    return nearest.select("qid", "uri", F.round((1 + F.col("cosine")) / 2, 4).alias("score"), "rank")


def scored_share(index: CellIndex, questions: DataFrame, probes: int | None = None) -> DataFrame:
    """(qid, scored, rows): how many of the index's rows a question is compared with."""
    spark = questions.sparkSession
    sizes = spark.read.parquet(f"{index.path}/sizes")
    asked = _probing(questions.select("qid", "embedding"), index.centres, min(index.probes if probes is None else probes, index.cells))
    total = sizes.agg(F.sum("n").alias("rows"))
    return asked.join(sizes, "cell", "left").groupBy("qid").agg(F.sum(F.coalesce("n", F.lit(0))).alias("scored")).select("qid", "scored", total.scalar().alias("rows"))
