import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from thicket.llm import quality as q
from thicket.llm._store import shared_folder

TRUSTED = ["The cat sat on the mat.", "A dog ran to the cat, and sat.", "Où est le chat? Là.", "the end\nof 12 cats", "caté", "x"]


def symbols(text):
    import unicodedata

    out = []
    for c in text:
        base = unicodedata.normalize("NFD", c)[:1] if ord(c) >= 128 else c
        if ord(c) >= 1 << 16:
            out.append(q.OTHER)
        elif "a" <= base <= "z":
            out.append(1 + ord(base) - 97)
        elif "A" <= base <= "Z":
            out.append(q.UPPER)
        elif "0" <= c <= "9":
            out.append(q.DIGIT)
        elif c in "\n\r\x0b\x0c":
            out.append(q.LINE)
        elif c.isspace():
            out.append(q.BLANK)
        elif 33 <= ord(c) < 127:
            marks = [chr(m) for m in range(33, 127) if not chr(m).isalnum()]
            out.append(min(q.MARK + marks.index(c), q.OTHER - 1))
        else:
            out.append(q.OTHER)
    return out


def grams(text):
    s = [0, 0, *symbols(text)]
    return [tuple(s[i : i + 3]) for i in range(len(s) - 2)]


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 for k in (1, 2, 3)]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(out)]


def brute(texts):
    """log10 probability of a gram by the recursion, in plain dictionaries."""
    tables = [Counter(g for t in texts for g in grams(t))]
    for _ in range(2):
        tables.append(Counter(g[1:] for g in tables[-1]))
    ds = [discounts(t.values()) for t in tables]
    total, left = [defaultdict(float) for _ in tables], [defaultdict(float) for _ in tables]
    for t, d, n, rest in zip(tables, ds, total, left, strict=True):
        for g, c in t.items():
            n[g[:-1]] += c
            rest[g[:-1]] += d[min(c, 3) - 1]

    def p(g, k=0):
        if k == 3:
            return 1 / q.SYMBOLS
        low = p(g[1:], k + 1)
        if g[:-1] not in total[k]:
            return low
        c = tables[k][g]
        own = c - ds[k][min(c, 3) - 1] if c else 0
        return own / total[k][g[:-1]] + left[k][g[:-1]] / total[k][g[:-1]] * low

    return lambda text: sum(math.log10(p(g)) for g in grams(text))


def test_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(q, "LEAST_TRUSTED", 5)
    monkeypatch.setattr(q, "BLOCK_ROWS", 2)
    trusted = spark.createDataFrame([("en", t) for t in TRUSTED] + [("fr", "trop peu")], "lang string, text string")
    model = q.train(trusted, shared_folder(spark, "t"))
    assert {r.lang for r in model.collect()} == {"en", ""}
    texts = [*TRUSTED, "NEVER!!! seen ### 漢字 😀 y", "", "a" * 70_000]
    docs = spark.createDataFrame([(i, i * 7, lang, t) for i, t in enumerate(texts) for lang in ("en",)] + [(100, 1, "fr", "the chat"), (101, 1, None, "the cat")], "doc_id long, th long, lang string, text string")
    got = {r.doc_id: (r.chars, r.logp) for r in q.perplexity(docs.repartition(3), model).collect()}
    own, all_ = brute(TRUSTED), brute([*TRUSTED, "trop peu"])
    for i, t in enumerate(texts):
        assert got[i][0] == len(t)
        assert got[i][1] == pytest.approx(own(t), rel=1e-5, abs=1e-5)
    assert got[100][1] == pytest.approx(all_("the chat"), rel=1e-5)
    assert got[101][1] == pytest.approx(all_("the cat"), rel=1e-5)


def test_model_sums_to_one(spark, monkeypatch):
    monkeypatch.setattr(q, "LEAST_TRUSTED", 1)
    model = q.train(spark.createDataFrame([("en", t) for t in TRUSTED], "lang string, text string"), shared_folder(spark, "t"))
    logs = np.zeros(q.GRAMS)
    for r in model.where("lang = 'en'").collect():
        logs[r.shard :: q.SHARDS] = np.frombuffer(r.model, np.float32)
    assert np.allclose((10**logs).reshape(-1, q.SYMBOLS).sum(axis=1), 1, atol=1e-4)


def test_labelled_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = q.judge(docs, labels).join(labels, "doc_id").select("quality", "keep").collect()
    good, bad = [r.keep for r in got if r.quality == 1], [r.keep for r in got if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.1 * len(bad)
    assert q.judge(docs, labels).count() == docs.count()


def test_edge_rows(spark):
    good = [(i, re.sub("cat", f"cat{'s' * (i % 3)}", TRUSTED[i % 2]), "en", 1) for i in range(80)]
    docs = spark.createDataFrame([*good, (None, None, None, 0), (200, "", "xx", 0), (201, "$$%%^^&&**" * 30, "en", 0), (201, "$$%%^^&&**" * 30, "en", 0), (201, "The cat sat.", "en", 0)], "doc_id long, text string, lang string, quality int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(None, 1, 0), (3, None, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = q.kept(docs, labels)
    assert out.columns == docs.columns
    left = Counter((r.doc_id, r.text) for r in out.collect())
    assert left[201, "The cat sat."] == 1 and left[None, None] == 1 and left[200, ""] == 1 and sum(left.values()) == 83
    none = spark.createDataFrame([], labels.schema)
    assert q.kept(docs, none).count() == docs.count()
    assert q.judge(docs.limit(0), labels).count() == 0


def test_expected_repetition(spark):
    counts = {1: 5, 2: 3, 3: 1, 4: 1}
    rows = q.expected_repetition(spark.createDataFrame([("en", g, n) for g, n in counts.items()], "lang string, gram int, n long")).collect()
    want = {k: 2**k / sum(1 - (1 - n / 10) ** 2**k for n in counts.values()) for k in range(q.LONGEST_CLASS + 2)}
    assert {(r.lang, r.size) for r in rows} == {("en", k) for k in range(q.LONGEST_CLASS + 1)}
    assert all(r.low == pytest.approx(want[r.size]) and r.high == pytest.approx(want[r.size + 1]) for r in rows)


def test_classes_without_trusted_texts_have_both_limits(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("etaoinshrdlucmfw", range(16, 0, -1), k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    doubled = text(10)
    docs = [(i, text(40), "en") for i in range(100)] + [(i, text(40), "fr") for i in range(100, 105)]
    docs += [(200, text(4000), "en"), (201, " ".join([doubled] * 400), "en"), (202, text(12), "en"), (203, " ".join(["to to"] * 12), "en"), (204, " ".join([doubled] * 400), "fr"), (205, text(4000), "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(105)], "doc_id long, quality int")
    rows = q.judge(df, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(docs)
    assert all(r.threshold is not None and r.most_repetition is not None for r in got.values())
    assert {i: got[i].keep for i in range(200, 206)} == {200: True, 201: False, 202: True, 203: False, 204: False, 205: True}


SCRIPTS = {
    "ru": "Мы вышли из дома рано утром и долго шли по берегу реки, пока не встало солнце. ",
    "zh": "我们清晨离开家，沿着河岸走了很久，直到太阳升起来。",
    "ar": "خرجنا من البيت في الصباح الباكر ومشينا طويلا على ضفة النهر حتى أشرقت الشمس. ",
}


def test_languages_without_trusted_texts_are_kept(spark):
    good = [(i, re.sub("cat", f"cat{'s' * (i % 3)}", TRUSTED[i % 2]) * 2, "en") for i in range(80)]
    rows = [(200 + k, text * 4, lang) for k, (lang, text) in enumerate(SCRIPTS.items())]
    rows += [(300 + k, text * 4, None) for k, text in enumerate(SCRIPTS.values())]
    docs = spark.createDataFrame([*good, *rows, (400, "$$%%^^&&**" * 30, None), (401, "$$%%^^&&**" * 30, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in q.judge(docs, spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")).collect()}
    assert all(got[d].keep and got[d].threshold is None and got[d].reason is None for d, _, _ in rows)
    assert got[400].reason == got[401].reason == "perplexity" and all(got[i].keep for i in range(80))


def test_repeated_rows_count_once(spark):
    good = [(i, re.sub("cat", f"cat{'s' * (i % 3)}", TRUSTED[i % 2]) * 2, "en") for i in range(80)]
    other = [(500, "The cat sat on the mat. " * 9, "en"), (500, "The cat sat on the mat. " * 9, "fr"), (None, "A dog. " * 30, "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    schema = "doc_id long, text string, lang string"
    once = q.judge(spark.createDataFrame(good + other, schema), labels).drop("th").collect()
    often = q.judge(spark.createDataFrame((good + other) * 4, schema), labels).drop("th").collect()
    known = {(r.doc_id, r.lang): r for r in once}
    assert len(once) == len(often) == 83 and known[500, "en"].chars == 216
    for r in often:
        for name, value in r.asDict().items():
            want = known[r.doc_id, r.lang][name]
            assert value == (pytest.approx(want, rel=1e-9) if isinstance(want, float) else want), (r, name)


def test_filter_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", 1, "x", 2.0, True)], "doc_id long, text string, lang string, th int, bad_id string, chars double, keep boolean")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert q.kept(docs, labels).collect() == docs.collect()


def test_model_is_fitted_on_all_trusted_texts(spark, tmp_path):
    docs = spark.range(6200).selectExpr("id as doc_id", "concat('a text ', id) as text", "concat('l', id % 11) as lang").repartition(3)
    docs = docs.union(docs.limit(50))
    labels = docs.selectExpr("doc_id", "1 as quality")
    q.judge(docs, labels, str(tmp_path / "m"))
    got = {r.lang: r.n for r in spark.read.parquet(str(tmp_path / f"m/grams-{q.ORDER}")).groupBy("lang").sum("n").toDF("lang", "n").collect()}
    want = Counter()
    for i in range(6200):
        for lang in ("", f"l{i % 11}"):
            want[lang] += len(f"a text {i}")
    assert got == want


def test_model_is_never_broadcast_in_copies(spark):
    """Copies of the model are more than the planner takes them for."""
    model = q.train(spark.createDataFrame([("en", t) for t in TRUSTED], "lang string, text string"), shared_folder(spark, "t"))
    docs = spark.createDataFrame([(1, 7, "en", "the cat")], "doc_id long, th long, lang string, text string")
    plan = q.perplexity(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"(\w+Join) \[lang#\d+, shard#\d+, salt", plan) == ["SortMergeJoin"]


RU = SCRIPTS["ru"]
RU_WORDS = RU.replace(",", "").replace(".", "").lower().split()


def points(text):
    """Grams that end in a character without a symbol of its own; other characters are their symbols."""
    s = [0, 0, *((1, c) if x == q.OTHER else x for x, c in zip(symbols(text), text, strict=True))]
    return [tuple(s[i : i + 3]) for i in range(len(s) - 2) if isinstance(s[i + 2], tuple)]


def brute_members(texts):
    """log10 probability of those characters among all such, by the recursion; one that was never seen has the share of one."""
    tables = [Counter(g for t in texts for g in points(t))]
    for _ in range(2):
        tables.append(Counter(g[1:] for g in tables[-1]))
    ds = [discounts(t.values()) for t in tables]

    def p(g, k=0):
        if k == 3:
            return 1 / (len(tables[2]) + 1)
        low, same = p(g[1:], k + 1), {h: c for h, c in tables[k].items() if h[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return low
        own = max(same.get(g, 0) - ds[k][min(same[g], 3) - 1], 0) if g in same else 0
        return own / total + sum(ds[k][min(c, 3) - 1] for c in same.values()) / total * low

    return lambda text: sum(math.log10(p(g)) for g in points(text))


def test_characters_of_other_scripts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(q, "LEAST_TRUSTED", 2)
    monkeypatch.setattr(q, "BLOCK_ROWS", 2)
    monkeypatch.setattr(q, "HELD", 5)
    trusted = [("ru", RU[i : i + 25] + "ß 😀") for i in range(0, 60, 20)] + [("zh", SCRIPTS["zh"]), ("zh", SCRIPTS["zh"][::-1])]
    model = q.train(spark.createDataFrame(trusted, "lang string, text string").repartition(3), shared_folder(spark, "t"))
    texts = [RU, RU[::-1], "Щ漢a" * 300, "😀ßß", "plain", ""]
    docs = [(i, i, "ru", t) for i, t in enumerate(texts)] + [(9, 9, "xx", SCRIPTS["zh"] + RU)]
    got = {r.doc_id: r for r in q.perplexity(spark.createDataFrame(docs, "doc_id long, th long, lang string, text string").repartition(2), model).collect()}
    for i, lang, text in [(d[0], d[2], d[3]) for d in docs]:
        known = [t for name, t in trusted if name == lang or lang == "xx"]
        assert got[i].logp == pytest.approx(brute(known)(text) + brute_members(known)(text), rel=1e-5, abs=1e-5)
        assert got[i].strange == sum(x == q.OTHER and all(c not in t for t in known) for x, c in zip(symbols(text), text, strict=True))
        assert got[i].grams == len({g for g in grams(text) if g[-1] != q.OTHER}) + len(set(points(text)))


def test_texts_in_other_scripts_are_judged(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choices(RU_WORDS, k=40))
    garbled = lambda: " ".join("".join(rng.choices("".join(RU_WORDS), k=6)) for _ in range(35))
    good = [(i, text(), "ru") for i in range(100)]
    zh = [(100 + i, SCRIPTS["zh"] * 3, "zh") for i in range(40)]
    asked = [(200, text(), "ru"), (201, garbled(), "ru"), (202, "Щ" * 200, "ru"), (203, text(), None), (204, garbled(), None), (205, SCRIPTS["ar"] * 3, None), (206, SCRIPTS["zh"][::-1] * 3, "zh")]
    docs = spark.createDataFrame([*good, *zh, *asked], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(140)], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.judge(docs, labels).collect()}
    assert {i: got[i].keep for i, _, _ in asked} == {200: True, 201: False, 202: False, 203: True, 204: False, 205: True, 206: False}
    assert got[205].threshold is None and got[203].threshold is not None and sum(got[i].keep for i in range(140)) >= 138
