import hashlib
import random

import corpus_pipeline
import tiktoken
from contourflow.llm.queries import vocabulary


def test_planted_cases(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    rows = [(i, words(120), "en", "s", 5) for i in range(40)]
    item = words(30)
    passage = "\n".join(words(20) for _ in range(3))
    near = rows[3][1].split()
    near[60] = "changed"
    rows += [(100, rows[2][1], "en", "s", 5), (101, " ".join(near), "en", "s", 5), (102, f"{words(50)} {item} {words(50)}", "en", "s", 5), (103, f"{words(40)}\n{passage}\n{words(40)}", "en", "s", 5), (104, f"{words(40)}\n{passage}", "en", "s", 5), (105, None, "en", "s", 0), (106, "123", None, "s", 3), (107, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [*range(40), 103, 104]
    ranks, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    text = {i: t for i, t, *_ in rows} | {104: rows[44][1].split("\n")[0]}
    for i, r in got.items():
        assert r.ids == own.encode_ordinary(text[i]) and r.decoded_sha256 == hashlib.sha256(text[i].encode()).hexdigest()


EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, k string, _n int, gone string, _id int, score double, lang_pred string, `a b` int"


def stored(spark, path, rows):
    spark.createDataFrame(rows, EXTRA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_on_long_repeated_and_null_rows_with_clashing_columns(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    more = (1, "k", 2, "g", 3, 0.5, "xx", 4)
    long = words(100_000)
    rows = [(i, words(60), ["en", "de"][i % 2], "s", 5) for i in range(20)] + [(50, long, "en", None, 1), (51, long, None, "s", 1), (None, words(50), "en", "s", None), (60, None, None, None, None), (61, "", "en", "s", 0)]
    rows += [rows[3]] * 5
    docs = stored(spark, tmp_path, [(*r, *more) for r in rows])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-1] == "a b" and len(docs.columns) == 13, name
        assert {tuple(r)[5:] for r in docs.collect()} == {more}, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [*[(False, i) for i in range(20)], (False, 50), (True, 0)]
    assert hashlib.sha256(long.encode()).hexdigest() in {r.decoded_sha256 for r in out}


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = stored(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-1] == "a b" and docs.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
