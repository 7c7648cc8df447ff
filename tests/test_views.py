from pyspark.sql import functions as F

from thicket import vocab as V
from thicket.catalog import views as W
from thicket.schemas import TRIPLE_COLS

SCHEMA = "s string, p string, o string, o_kind string, lang string, dtype string"


def test_the_graph_is_stored_by_predicate_and_read_without_parsing(spark, sf_dir):
    labels = W.kg_triples(spark, sf_dir).where(F.col("p") == V.PREF_LABEL)
    files = labels.inputFiles()
    assert files and all(f.endswith(".parquet") and "/p=" in f for f in files)
    plan = labels._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Exchange" not in plan and "Scan text" not in plan


def test_triples_are_stored_once_and_only_whole(spark):
    kept = [("http://a", "p", "x > y\n", "literal", "en", None), ("http://a", "p", "http://b", "iri", None, None)]
    broken = [
        (None, "p", "o", "literal", None, None), ("http://a", "p", None, "literal", None, None),
        ("http://a", "p", "http://b>", "iri", None, None), ("http://a\n", "p", "o", "literal", None, None),
    ]
    rows = spark.createDataFrame(kept * 2 + broken, SCHEMA)
    assert sorted(map(tuple, W._storable(rows).select(*TRIPLE_COLS).collect())) == sorted(kept)


def test_a_small_customer_file_is_dealt_out_to_all_cores(spark, sf_dir):
    dealt = W.customers(spark, sf_dir).groupBy(F.spark_partition_id().alias("part")).count()
    assert dealt.count() == spark.sparkContext.defaultParallelism


def test_collections_are_those_of_the_members(spark, sf_dir):
    rows = W.kg_rows(spark, sf_dir)
    typed = rows.where((F.col("p") == V.TYPE) & (F.col("o") == V.COLLECTION)).select("s")
    members = rows.where(F.col("p") == V.MEMBER).select("s").distinct()
    assert sorted(typed.collect()) == sorted(members.collect()) and typed.count() > 5
