import os
from zlib import crc32

import duckdb
import numpy as np
import pytest
from contourflow.llm import sql, variants
from contourflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def close(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def slow_groups(counts):
    near = {a: [b for b in counts if close(a, b)] for a in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = top if top is not None and counts[top] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def slow_counts(docs):
    counts = {}
    for i, text in docs:
        run = ""
        for c in (text or "") + "\0":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
            elif run:
                h = crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    counts[run] = counts.get(run, 0) + 1
                run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def grouped(spark, counts, **more):
    out = variants.group_variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), **more)
    return sorted(tuple(r) for r in out.collect())


def ordered(rows):
    return sorted(rows, key=repr)


def test_groups_equal_brute_force(spark):
    draw = np.random.default_rng(1)
    counts = {}
    for base in ("aabbaab", "colours", "zzzzzzz", "étéàçèù", "abababab"):
        words = {base}
        for _ in range(60):
            w = list(sorted(words)[draw.integers(0, len(words))])
            at, kind, letter = draw.integers(0, len(w)), draw.integers(0, 3), "abzé"[draw.integers(0, 4)]
            w[at : at + (kind > 0)] = [] if kind == 2 else [letter]
            words.add("".join(w))
        counts |= {w: int(10 ** draw.uniform(0, 5)) for w in words if w}
    want = slow_groups(counts)
    for bucket_keys in (1 << 20, 50):
        assert ordered(grouped(spark, counts, bucket_keys=bucket_keys)) == ordered(want)
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 5 for r in want)


def test_ties_chains_and_long_words(spark):
    long = "ab" * 3000
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaaac": 10, "aaaaaabb": 100, "aaaaaabbb": 1000, long: 50, long[:-1]: 5, long[:10] + "c" + long[11:]: 5, "a" * 5000: 30, "a" * 4999: 3, "x": 1, "xy": 10}
    got = grouped(spark, counts)
    assert got == ordered(slow_groups(counts)) or ordered(got) == ordered(slow_groups(counts))
    by = {r[0]: r for r in got}
    assert by["aaaaaaa"][1:3] == ("aaaaaab", "aaaaaabbb") and by["a" * 4999][1] == "a" * 5000


def test_words_of_documents(spark):
    draw = np.random.default_rng(2)
    pool = ["Éclatant", "éclatant", "MAISONS", "maisons-maisons", "naïveté!", "x7letters", "÷×ßäöüÿÀ", "short", "Straßenbahn", "日本語テキスト", "weatherly", "whether" * 40]
    docs = [(i, " ".join(pool[k] for k in draw.integers(0, len(pool), 300))) for i in range(40)] + [(50, None), (51, ""), (None, "weatherly " * 50), (None, "weatherly"), (3, "repeated row repeated"), (3, "repeated row repeated"), (60, "elephant" * 5000), (61, "elephant" * 5000), (62, "giraffes " * 40_000)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, word string, n int")
    want = slow_counts(docs)
    assert {r.word: r.n for r in variants.words_of_documents(frame).where("n >= 2").collect()} == want
    got = [tuple(r) for r in variants.corpus_variants(frame).collect()]
    assert ordered(got) == ordered(slow_groups({w: n for w, n in want.items() if len(w) < 1000}) + [r for r in got if len(r[0]) >= 1000])
    assert {r[0] for r in got} == set(want)
    assert variants.corpus_variants(frame.limit(0)).count() == 0


def test_deletion_keys_agree_with_strings():
    words = ["aabbcc", "aabbcd", "aabccd", "zabbcc"]
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(4, 6)
    row, at, key = variants.deletion_keys(letters)
    seen = {}
    for r, a, k in zip(row.tolist(), at.tolist(), key.tolist(), strict=True):
        w = words[r]
        text = w if a == variants.WHOLE else (w[:a] + w[a + 1 :] if a >= 0 else w[: -2 - a] + w[-1 - a :])
        seen.setdefault((max(a, -1), text), set()).add(k)
    assert all(len(k) == 1 for k in seen.values()) and len(set.union(*seen.values())) == len(seen)


def test_text_that_is_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(X'FF616263646566676861FF616263646566676861' as string) as text")
    assert [(r.word, r.n) for r in variants.words_of_documents(docs, delete_one_in=1 << 40).collect()] == [("abcdefgha", 2)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(sql.SPELLING_VARIANTS).fetchall()
    got = QUERIES["op13_variants"](spark, SF).collect()
    assert len(got) > 100 and ordered(map(tuple, got)) == ordered(want)
