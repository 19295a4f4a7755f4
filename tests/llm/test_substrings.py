import hashlib
import os

import duckdb
import numpy as np
import pytest
from contourflow.llm import sql, substrings
from contourflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow(docs, window):
    """{(doc_id, text): (n_words, n_removed, kept)}."""
    rows = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, words in rows:
        if i is not None:
            for s in range(len(words) - window + 1):
                w = tuple(words[s : s + window])
                least[w] = min(i, least.get(w, i))
    out = []
    for i, words in rows:
        gone = set()
        for s in range(len(words) - window + 1):
            if i is not None and least[tuple(words[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(words), len(gone), " ".join(w.decode() for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def run(spark, docs, **more):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, whole string, n_words int")
    texts = {hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest(): " ".join(x.decode() for x in (t or "").encode().split()) for _, t in docs}
    got = substrings.dedup_substrings(df, **more).collect()
    for r in got:
        assert r.n_removed == sum(s.n for s in r.spans) and (r.kept is None) == (r.n_removed == 0)
    return sorted([(r.doc_id, r.n_words, r.n_removed, texts[r.whole] if r.kept is None else r.kept) for r in got], key=repr)


def corpus(seed, n, vocabulary, passages):
    draw = np.random.default_rng(seed)
    words = [f"w{k}" if k % 5 else f"é{k}" for k in range(vocabulary)]
    pool = [[words[k] for k in draw.integers(0, vocabulary, draw.integers(5, 60))] for _ in range(passages)]
    docs = []
    for i in range(n):
        own = [[words[k] for k in draw.integers(0, vocabulary, draw.integers(0, 30))] for _ in range(3)]
        own[1:1] = [pool[k] for k in draw.integers(0, passages, draw.integers(0, 3))]
        docs.append((i, " ".join(w for part in own for w in part)))
    return docs


CASES = [(100, None), (101, ""), (102, " \t\n "), (None, "a b c d e f g h i j k l"), (None, "a b c d e f g h i j k l"), (103, "a b c d e f g h i j k l"), (103, "a b c d e f g h i j k l"), (103, "z a b c d e f g h i j k l z"), (104, "x a b c d e f g h i j k l y"),
         (105, "r " * 3000), (106, "s " + "r " * 200), (107, "a b c d e f g"), (108, "a b c d e f g"), (90, "q r s " * 40), (91, "t q r s q r s q r s q r s q")]


@pytest.mark.parametrize(("window", "group", "hot"), [(10, 4, 2048), (10, 4, 0), (8, 8, 3), (2, 1, 1), (17, 5, 10)])
def test_equals_brute_force(spark, window, group, hot):
    docs = corpus(window, 80, 400, 12) + CASES
    assert run(spark, docs, window=window, group=group, hot=hot, shard_bytes=2_000) == slow(docs, window)


def test_few_words_have_many_ties(spark):
    docs = corpus(3, 60, 3, 4)
    assert run(spark, docs, window=6, group=3, shard_bytes=500) == slow(docs, 6)


def test_large_group_of_copies_and_near_copies(spark):
    draw = np.random.default_rng(5)
    form = [f"f{k}" for k in range(120)]
    docs = [(i, " ".join(w if draw.random() > 0.02 else f"n{draw.integers(0, 10**6)}" for w in form)) for i in range(150)] + [(200 + i, " ".join(form)) for i in range(50)]
    want = slow(docs, 50)
    assert run(spark, docs, hot=5) == want and run(spark, docs) == want
    assert sum(r[2] for r in want) > 0.5 * sum(r[1] for r in want)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(1, "a b")]) == [(1, 2, 0, "a b")]


def test_very_long_text(spark):
    draw = np.random.default_rng(6)
    long = " ".join(f"v{k}" for k in draw.integers(0, 5000, 60_000))
    docs = [(1, long), (2, "head " + long[1000:9000] + " tail"), (3, "u " * 100_000)]
    assert run(spark, docs) == slow(docs, 50)


def test_text_that_is_not_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(X'FF2061206220632064' as string) as text union all select 2L, cast(X'FE2061206220632064' as string)")
    got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.dedup_substrings(df, window=3, group=2).collect()}
    assert got == {1: (0, None), 2: (5, "")}


def test_index_counts_as_a_plain_search():
    draw = np.random.default_rng(7)
    texts = [draw.integers(1, 6, draw.integers(1, 40)) for _ in range(50)]
    index = substrings.Index(texts, np.arange(50), 4)
    joined = ["".join(map(str, t)) for t in texts]
    for _ in range(300):
        pattern = draw.integers(1, 6, draw.integers(1, 4))
        low, high = np.zeros(1, np.int64), np.full(1, index.matrix.n, np.int64)
        for symbol in pattern[::-1]:
            low, high = index.extended(np.array([symbol]), low, high)
        plain = "".join(map(str, pattern))
        assert high[0] - low[0] == sum(t.startswith(plain, k) for t in joined for k in range(len(t)))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op12_substrings"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(sql.REPEATED_WINDOWS).fetchall())
