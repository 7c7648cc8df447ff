import tracemalloc

import numpy as np
import pandas as pd
import pytest

from thicket.operators import neighbours as N
from thicket.operators import search as S
from thicket.session import shared_folder

SCHEMA = "uri string, embedding array<float>"


def table(spark, vectors, name="uri"):
    rows = [(f"u{i:05d}" if name == "uri" else i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA if name == "uri" else "qid long, embedding array<float>")


def pairs(df):
    return {(r.qid, r.uri) for r in df.collect()}


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}"


def test_recall_and_share_on_the_benchmark_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    docs = rows.select(N.F.col("vec_id").cast("string").alias("uri"), "embedding")
    asked = rows.where("vec_id % 20 = 0").select(N.F.col("vec_id").alias("qid"), "embedding")
    index = N.build_index(docs, folder(spark, "cells-sf01"))
    exact, found = pairs(S.vector_search(asked, docs, 12)), pairs(N.approximate_search(index, asked, 12))
    assert len(exact & found) >= 0.9 * len(exact)
    share = N.scored_share(index, asked).agg(N.F.avg(N.F.col("scored") / N.F.col("rows"))).first()[0]
    print("recall", len(exact & found) / len(exact), "share", share, "cells", index.cells, "probes", index.probes)
    assert share < 0.75  # these vectors have no clusters at all
    again = N.open_index(spark, index.path)
    assert again.probes == index.probes and pairs(N.approximate_search(again, asked.limit(3), 12)) <= found


def test_clustered_vectors_need_few_probes(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(60, 16))
    shares = {}
    for n in (1500, 6000):
        vectors = middles[rng.integers(0, 60, n)] + 0.15 * rng.normal(size=(n, 16))
        docs = table(spark, vectors)
        index = N.build_index(docs, folder(spark, f"cells-{n}"))
        asked = table(spark, vectors[:50], "qid")
        exact, found = pairs(S.vector_search(asked, docs, 12)), pairs(N.approximate_search(index, asked, 12))
        assert len(exact & found) >= 0.9 * len(exact)
        shares[n] = N.scored_share(index, asked).agg(N.F.avg("scored")).first()[0]
    assert shares[6000] < 4 * shares[1500] and shares[6000] < 0.15 * 6000  # the cost of a question grows more slowly than the table


@pytest.mark.parametrize("block", [7, 4096])
def test_all_probes_are_the_exact_search(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)  # hot cells and popular cells in many blocks
    rng = np.random.default_rng(1)
    vectors = [*rng.normal(size=(150, 8)), *[np.ones(8)] * 60, np.zeros(8), None]
    docs, asked = table(spark, vectors), table(spark, [*vectors[:20], np.ones(8), np.zeros(8)], "qid")
    index = N.build_index(docs, folder(spark, f"cells-all-{block}"), cells=9)
    got = sorted(map(tuple, N.approximate_search(index, asked, 12, probes=index.cells).collect()))
    assert got == sorted(map(tuple, S.vector_search(asked, docs, 12).collect()))


def test_every_row_is_indexed_once(spark):
    rng = np.random.default_rng(2)
    vectors = [*rng.normal(size=(80, 4)), *[np.ones(4)] * 40, None, np.zeros(4)]
    index = N.build_index(table(spark, vectors), folder(spark, "cells-once"))
    stored = [r.uri for r in spark.read.parquet(f"{index.path}/rows").collect()]
    assert sorted(stored) == [f"u{i:05d}" for i, v in enumerate(vectors) if v is not None]
    few = N.approximate_search(index, table(spark, [np.ones(4)], "qid"), 12, probes=1).collect()
    assert [r.score for r in few] == [1.0] * 12 and [r.uri for r in few] == sorted(r.uri for r in few)


def test_empty_tables(spark):
    index = N.build_index(table(spark, [None, None]), folder(spark, "cells-none"))
    assert index.cells == 0 and N.approximate_search(index, table(spark, [np.ones(3)], "qid")).count() == 0
    assert N.open_index(spark, index.path).probes == 0
    full = N.build_index(table(spark, [np.ones(3), -np.ones(3)]), folder(spark, "cells-two"))
    assert N.approximate_search(full, table(spark, [], "qid")).count() == 0
    assert [r.uri for r in N.approximate_search(full, table(spark, [np.ones(3)], "qid"), 12, probes=9).collect()] == ["u00000", "u00001"]


def test_a_block_of_questions_is_compared_in_bounded_parts():
    rng = np.random.default_rng(5)
    docs = pd.DataFrame({"uri": [f"u{i:04d}" for i in range(2000)], "embedding": list(rng.normal(size=(2000, 8)))})
    queries = rng.normal(size=(2000, 8))
    tracemalloc.start()
    got = S._best_pairs(np.arange(2000), queries, docs, 3)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    want = np.argsort(-np.round(queries @ S._unit(docs["embedding"]).T, 12), axis=1, kind="stable")[:, :3]
    assert [f"u{i:04d}" for i in want.ravel()] == got["uri"].tolist()


def test_probed_cells_come_in_bounded_parts(monkeypatch):
    """However many cells are read, a task makes few rows at once."""
    rng = np.random.default_rng(3)
    centres, batch = rng.normal(size=(300, 8)), pd.DataFrame({"qid": range(40), "embedding": list(rng.normal(size=(40, 8)))}, index=[0] * 40)
    whole = pd.concat(N._probed(batch, centres, 120))
    assert len(whole) == 40 * 120
    monkeypatch.setattr(N, "PAIRS", 2000)
    for bound, most in ((500, 480), (100, 120)):
        monkeypatch.setattr(N, "PROBED", bound)
        parts = list(N._probed(batch, centres, 120))
        assert max(map(len, parts)) == most and pd.concat(parts)[["qid", "cell"]].equals(whole[["qid", "cell"]])
    order = np.argsort(N._distances(N._unit(batch["embedding"]), centres), axis=1, kind="stable")[:, :120]
    assert whole["cell"].tolist() == order.ravel().tolist()
