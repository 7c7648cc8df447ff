import importlib

import duckdb
import test_jaccard_join
import test_token_files
from compare import differences

from thicket.llm import decontaminate, mixing, quality
from thicket.llm._store import shared_folder, stored


def first_of_each_group(rows):
    """Least id of each group of texts whose sets of five words are alike by 0.8, by all pairs."""
    sets = test_jaccard_join.sets_of(rows, 5)
    least = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and test_jaccard_join.linked(sets[a], sets[b], 80)]
    for _ in sets:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return sorted(d for d in least if least[d] == d)


def test_each_stage_against_brute_force(spark, sf_dir):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps, folder = [docs], shared_folder(spark, "t")
    for k, (_, stage) in enumerate(pipeline.STAGES):
        steps.append(stored(stage(spark, steps[-1], sf_dir), f"{folder}/{k}"))
    start, good, one, clean, mix, tokens = steps
    assert all(x.columns == docs.columns for x in steps[:-1])
    text = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    keep = quality.judge(start, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("keep")
    assert ids(good) == ids(keep) and 0 < good.count() < start.count()
    assert ids(one) == first_of_each_group(text(good))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS FROM '{sf_dir}/benchmark.parquet'")
    con.register("one", one.toPandas())
    con.register("clean", clean.toPandas())
    leaking = {r[0] for r in con.execute(decontaminate.leaks_sql("one")).fetchall()}
    assert leaking and ids(clean) == [d for d in ids(one) if d not in leaking]
    assert not differences(mixing.mix(clean).drop("th", "source"), con, mixing.mix_sql("clean"))
    times = {r[0]: r for r in con.execute(mixing.mix_sql("clean")).fetchall()}
    assert ids(mix) == sorted(d for d, size, _, _, taken in times.values() if size for _ in range((2 * taken + size) // (2 * size)))
    assert test_token_files.got(tokens) == test_token_files.brute(text(mix))
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, tokens.collect()))
