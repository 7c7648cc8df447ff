"""Numbering definition lines and minting identifiers without moving the texts."""

from pathlib import Path

from pyspark.sql import functions as F

from thicket import schemas as M
from thicket.operators.ordering import numbered, numbered_by_place
from thicket.plans.build import definition_concepts, mint_uri, with_country
from thicket.sources import tables as S


def _planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered_rows_stay_where_they_lie(spark):
    rows = spark.range(20_000).selectExpr("id % 3 AS k", "id", "repeat(cast(id AS string), 50) AS text")
    done = numbered(rows, ["k"], ["id"], "n")
    assert "BroadcastHashJoin" in _planned(done) and "SortMergeJoin" not in _planned(done)
    assert done.where("n <> id div 3 + 1").count() == 0 and done.count() == 20_000


def test_numbered_orders_by_expressions(spark):
    rows = spark.range(1_000).selectExpr("id", "cast(id AS string) AS t")
    done = numbered(rows, [], [-F.col("id")], "n")
    assert done.where("n <> 1000 - id").count() == 0


def test_country_names_are_joined_in_place(spark):
    places = spark.createDataFrame([("FRA", "France", "FR", "Europe", 1)], M.COUNTRY)
    rows = spark.range(10).selectExpr("id", "if(id < 5, 'France', cast(NULL AS string)) AS country")
    done = with_country(rows, places, "country")
    assert "SortMergeJoin" not in _planned(done)
    assert done.where(F.col("iso3") == "FRA").count() == 5 and done.count() == 10


def test_definition_files_are_compressed_on_request(spark, tmp_path):
    record = ("a, b", "", 'say "x"', "", "t", "FAO 2001", ["http://a"], ["Ref. 1"], "two\nlines", "FAO", "", "2001")
    df = spark.createDataFrame([record], M.DEFINITION_RECORD)
    S.write_definitions_raw(df, str(tmp_path / "z"), "gzip")
    S.write_definitions_raw(df, str(tmp_path / "p"))
    assert {f.suffix for f in Path(tmp_path / "z").glob("part*")} == {".gz"}
    assert S.read_definitions(spark, str(tmp_path / "z")).collect() == S.read_definitions(spark, str(tmp_path / "p")).collect()


def test_places_are_numbered_as_ranges_are(spark):
    """Hot, null and repeated keys and places; buckets of few places, so that keys span several."""
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", None if i % 31 == 0 else (i * 7919) % 401 - 50, f"t{i % 90}") for i in range(900)]
    df = spark.createDataFrame(rows, "k string, pos long, t string")
    want = sorted(map(str, numbered(df, ["k"], ["pos"], "n").collect()))
    for places in (1, 64, 1 << 18):
        done = numbered_by_place(df.repartition(5), ["k"], "pos", "n", places)
        assert done.dtypes == numbered(df, ["k"], ["pos"], "n").dtypes and sorted(map(str, done.collect())) == want


def test_bases_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def base(i):
        made.add(1)
        return f"Base{i % 10}"

    rows = spark.range(500).select(F.col("id").alias("pos"), F.udf(base, "string")("id").alias("base"))
    done = mint_uri(rows)
    assert done.count() == 500 and made.value == 500
    assert done.where(~F.endswith("uri", F.concat(F.lit("_"), (F.col("pos").cast("long") / 10).cast("long") + 1))).count() == 0


def test_carried_columns_have_the_same_uris(spark):
    one = {"title_1": "a", "title_2": "FOREST/FOREST LAND", "title_3": "General", "title_4": "", "sources": "", "definition": "text", "organization": "FAO", "country": "Peru", "year": "", "urls": [], "references": []}
    terms = ["open  forest; x", "", "*", "Open forest", " ", None]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(terms * 4)], "pos long, bold_terms string")
    records = made.select("pos", "bold_terms", *[F.lit(v).alias(k) if isinstance(v, str) else F.array().cast("array<string>").alias(k) for k, v in one.items()])
    records = records.withColumn("definition", F.when(F.col("pos") == 3, " \n").otherwise(F.col("definition"))).select("pos", *M.DEFINITION_COLS)
    places = spark.createDataFrame([("PER", "Peru", "PE", "SouthAmerica", 0)], "iso3 string, name string, alpha2 string, continent string, ord int")
    whole, few = definition_concepts(records, places), definition_concepts(records, places, carry=["pos", "country", "organization"])
    assert "definition" not in few.columns
    got = {(r.pos, r.uri, r.country_uri) for r in whole.collect()}
    assert len(got) == 23 and got == {(r.pos, r.uri, r.country_uri) for r in few.collect()}
    assert {u.rsplit("#")[-1].rsplit("/")[-1].rsplit("_")[0] for _, u, _ in got} == {"OpenForest", "Forest", "Concept"}
