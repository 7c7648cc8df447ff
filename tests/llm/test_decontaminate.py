import pytest
from compare import differences

from thicket.llm import decontaminate as dc

ITEM = "Please tell me how many apples Mary has if Mary buys 12 kg of apples and gives 3 kg to Tom in the end."


def test_against_sql(spark, sf_dir, duck):
    found = differences(dc.op2_decontaminate(spark, sf_dir), duck, dc.SQL)
    assert not found, "\n".join(found)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in dc.leaks(d, b).select("doc_id", "item_id", "windows", "changed").collect()), key=str)


def test_slots(spark):
    filler = "some other words stand here before and then it goes on: "
    docs = [
        (1, filler + ITEM),
        (2, filler + ITEM.replace("Mary", "Anna").replace("12", "7").replace("Tom", "Bob")),
        (3, filler + ITEM.replace("Mary has", "Anna has")),  # one name became two
        (4, filler + ITEM.replace("Mary", "Tom")),  # two names became one
        (5, filler + "nothing of the kind is asked here at all, it is a clean text with 12 kg of something"),
        (6, (filler + ITEM).upper().replace("MARY", "Mary")),
        (7, filler + ITEM.replace("12 kg", "40 lbs").replace("3 kg", "5 lbs")),
    ]
    got = {r[0]: r[3] for r in run(spark, docs, [(10, ITEM)])}
    assert got[1] == 0 and got[2] == 4 and got[7] == 4 and 5 not in got and 3 not in got and 4 not in got


@pytest.mark.parametrize("text, want", [
    ("In May John saw 3 km, Then. Then he ran 5.5km (Bob)", "in Nmay Njohn saw #3 %km Nthen then he ran #5.5km Nbob"),
    ("| -- 'quoted' km 3rd", "| -- quoted km 3rd"),
    (None, ""),
    (" \t\n", ""),
])
def test_template(spark, text, want):
    got = spark.createDataFrame([(text,)], "text string").select(dc.template(dc.F.col("text"))).first()[0]
    assert got.replace(dc.NAME, "N").replace(dc.NUM, "#").replace(dc.UNIT, "%") == want


def test_edge_rows(spark):
    short = "what is the answer to it"
    long = "word " * 100_000 + ITEM
    docs = [(1, None), (2, ""), (None, ITEM), (3, ITEM), (3, ITEM), (3, "clean words"), (4, long), (5, f"well, {short}, then")]
    got = run(spark, docs, [(1, ITEM), (1, ITEM), (2, short), (3, None), (4, ""), (None, "a lonely item that has no id but has words"), (5, "too short")])
    assert {(r[0], r[1]) for r in got} == {(None, 1), (3, 1), (4, 1), (5, 2)}


def test_empty_tables(spark):
    assert run(spark, [], [(1, ITEM)]) == [] == run(spark, [(1, ITEM)], [])


def test_filter_keeps_other_rows(spark):
    d = spark.createDataFrame([(1, ITEM), (2, "clean"), (2, "clean"), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted((r.doc_id for r in dc.without_leaks(d, b).collect()), key=str) == [2, 2, None]


def test_filter_goes_by_id_and_text(spark):
    rows = [(None, ITEM, 1, "a"), (None, "a clean text without an id", 2, "b"), (5, "another clean text", 3, "c"), (5, ITEM + " And so on.", 4, "d"), (None, None, 5, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, leaking int, th string")
    b = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = dc.without_leaks(d, b)
    assert kept.columns == d.columns and sorted(r.leaking for r in kept.collect()) == [2, 3, 5]
