import random

import numpy as np
from contourflow.llm import langid
from contourflow.llm.common import id_remainder
from pyspark.sql import functions as F


def text(rng, lang, n=40):
    bits = {"aa": ["the", "ing", "tion", "wh", "ed"], "bb": ["ung", "sch", "ein", "für", "ß"], "cc": ["eau", "çon", "é", "tre", "aux"]}[lang]
    return " ".join("".join(rng.choice(bits) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, g), g) for i in range(600) for g in [rng.choice(["aa", "bb", "cc"])]]
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "123 --- 4", "bb"), (1003, text(rng, "bb", 20_000), None), (1003, text(rng, "bb"), None), (None, text(rng, "cc"), None), (1004, "𝔞𝔟𝔠", None)]
    docs = spark.createDataFrame([(*r, 7.0) for r in rows + extra], "doc_id bigint, text string, lang string, score double")
    held = id_remainder("doc_id", 4) == 2
    model = langid.fit(docs, ~held)
    got = langid.predict(docs, model, held).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    want = {i: g for i, _, g in rows}
    own = [want[r.doc_id] == r.lang_pred for r in got if r.held_out and r.doc_id in want]
    assert sum(own) / len(own) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    assert [r.lang_pred for r in got if r.doc_id == 1003] == ["bb", "bb"] and [r.lang_pred for r in got if r.doc_id is None] == ["cc"]
    kept = langid.predict(docs, model, keep_all=True)
    assert set(kept.columns) == {"doc_id", "text", "lang", "lang_pred", "score"} and kept.count() == len(got)


def test_presence_against_loops():
    for t in ["Hello, World", "a", "x1y", "ab  ab", "éÉ 12 ß", "𝔞b"]:
        clean = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        clean = " ".join(clean.split(" "))
        while "  " in clean:
            clean = clean.replace("  ", " ")
        grams = {clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1)}
        assert len(langid.presence(t)) == len(grams)
    assert langid.presence("12 3!") is None


def test_kernel_is_the_share_of_common_grams(spark):
    docs = spark.createDataFrame([(i, text(random.Random(i), g), g) for i, g in enumerate(["aa", "bb"] * 10)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    a, b = langid.presence("the wheing"), langid.presence(docs.first().text)
    marks = [np.flatnonzero(np.isin(model.column, np.flatnonzero(model.landmarks[:, j]))) for j in range(model.landmarks.shape[1])]
    want = [[len(np.intersect1d(x, m)) / np.sqrt(len(x) * len(m)) for m in marks] for x in (a, b)]
    assert np.allclose(model.kernel([a, b]), want, atol=1e-5)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, model, F.lit(False)).collect()] == [("und", 0.0)]
    assert langid.predict(docs.limit(0), model, F.lit(False)).count() == 0


def test_repeated_rows_do_not_fill_the_sample_and_rare_languages_stay(spark):
    rng = random.Random(9)
    rows = [(i, text(rng, "bb"), "bb") for i in range(100)] + [(200, text(rng, "aa"), "aa")] * 4_000 + [(300, text(rng, "cc", 30_000), "cc")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    some = langid.chosen(docs, 30).collect()
    assert sorted({r.lang for r in some}) == ["aa", "bb", "cc"] and len(some) == 12
    assert abs(sum(r.weight for r in some if r.lang == "bb") - 100) < 10
    model = langid.fit(docs, F.lit(True))
    assert model.classes == ["aa", "bb", "cc"]
    assert [langid.Classifier.predict(model, [text(rng, g)])[0] for g in ("aa", "bb", "cc")] == [["aa"], ["bb"], ["cc"]]


def test_fit_equals_plain_kernel_ridge_regression(spark):
    docs = spark.createDataFrame([(i, text(random.Random(i), g), g) for i, g in enumerate(["aa", "bb", "bb"] * 12)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    rows = docs.withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect()
    sets = [set(langid.presence(r.text).tolist()) for r in rows]
    by = {g: [s for s, r in zip(sets, rows, strict=True) if r.lang == g] for g in ("aa", "bb")}
    marks = [by[g][i] for i in range(langid.LANDMARKS) for g in ("aa", "bb") if i < len(by[g])][: langid.LANDMARKS]
    k = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    y = np.array([[1.0 if r.lang == g else -1.0 for g in ("aa", "bb")] for r in rows])
    k_nm, k_mm = k(sets, marks), k(marks, marks)
    alpha = np.linalg.solve(k_nm.T @ k_nm + langid.RIDGE * len(rows) / 10 * k_mm + 1e-6 * np.eye(len(marks)), k_nm.T @ y)
    test = [text(random.Random(1000 + i), g) for i, g in enumerate(["aa", "bb"] * 5)]
    f = k([set(langid.presence(t).tolist()) for t in test], marks) @ alpha
    p = np.exp(4 * f) / np.exp(4 * f).sum(axis=1, keepdims=True)
    names, scores = model.predict(test)
    assert names == [["aa", "bb"][j] for j in f.argmax(axis=1)] and np.allclose(scores, p.max(axis=1), atol=2e-3)
