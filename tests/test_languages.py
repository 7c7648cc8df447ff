from collections import Counter

from pyspark.sql import functions as F

from thicket.operators import languages as L

TEXTS = {
    "en": "The forest is land with trees and the canopy that covers it, which was measured in the years before.",
    "fr": "La forêt est une terre avec des arbres et le couvert qui la recouvre, mesuré pendant les années passées.",
    "ru": "Лес это земля с деревьями и полог который её покрывает, измеренный в прошлые годы.",
    "uk": "Ліс це земля з деревами та полог який її вкриває, виміряний у минулі роки.",
    "zh": "森林是有树木的土地，树冠覆盖着它，在过去的几年里测量过。",
    "ja": "森林は木のある土地であり、それを覆う樹冠は過去数年間に測定されました。",
}


def test_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = L.tagged(docs.where(held), L.language_profiles(docs.where(~held)))
    rows = found.join(docs.withColumnRenamed("lang", "told"), "doc_id").groupBy("told").agg(F.count("*").alias("n"), F.sum((F.col("lang") == F.col("told")).cast("int")).alias("right")).collect()
    print({r.told: (r.right, r.n) for r in rows})
    assert len(rows) >= 4 and all(r.right >= 0.95 * r.n for r in rows)


def test_scripts_and_languages_without_default(spark):
    labelled = spark.createDataFrame([(lang, t) for lang, t in TEXTS.items()] + [(None, "no label"), ("en", None)], "lang string, text string")
    asked = [
        (1, "Trees cover the land"), (2, "les arbres couvrent la terre"), (3, "деревья на земле"), (4, "дерева вкриває її"), (5, "树木覆盖土地"), (6, "木のある土地は"),
        (7, "Το δάσος"), (8, ""), (9, None), (10, "123 ... 456"), (None, "with the trees"), (11, "The land Лес"), (12, "a" * 50_000 + " the land"), (1, "Trees cover the land"),
    ]
    docs = spark.createDataFrame([(i, t, "xx", 0) for i, t in asked], "doc_id long, text string, lang string, run int")
    got = {r.doc_id: (r.script, r.lang) for r in L.tagged(docs, L.language_profiles(labelled)).collect()}
    assert len(got) == 13
    assert {i: got[i][1] for i in (1, 2, 3, 4, 5, 6, None, 11, 12)} == {1: "en", 2: "fr", 3: "ru", 4: "uk", 5: "zh", 6: "ja", None: "en", 11: "en", 12: "en"}
    assert got[3][0] == "Cyrillic" and got[5][0] == "Han" and all(got[i][1] is None for i in (7, 8, 9, 10))
    none = L.language_profiles(labelled.limit(0))
    assert {r.lang for r in L.tagged(docs, none).collect()} == {None} and L.tagged(docs.limit(0), none).count() == 0


def test_runs_are_counted_before_they_are_joined(spark, monkeypatch):
    """One row for each different run of a text, whatever batches and chunks its texts lie in."""
    monkeypatch.setattr(L, "CHUNK_BYTES", 40)
    monkeypatch.setattr(L, "HELD", 10)
    rows = [(i, lang, text) for i, (lang, text) in enumerate(TEXTS.items())] + [(50, "en", "aaaa 𐐨𐐨𐐨 a"), (51, "en", "x"), (None, "en", "The the")]
    df = spark.createDataFrame(rows, "id long, lang string, text string").repartition(3)
    words = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    runs = lambda t: Counter(words(t)[i : i + 3] for i in range(len(words(t)) - 2))
    number = lambda run: ord(run[0]) << 42 | ord(run[1]) << 21 | ord(run[2])
    got = L._counted_by_text(df.select("id", "text"), "id").collect()
    assert sorted(((r.id, r.run, r.n) for r in got), key=str) == sorted(((i, number(run), n) for i, _, t in rows for run, n in runs(t).items()), key=str)
    want = Counter()
    for _, lang, text in rows:
        for run, n in runs(text).items():
            want[lang, number(run)] += n
    assert Counter({(r.lang, r.run): r.n for r in L._counted_by_language(df).collect()}) == want
