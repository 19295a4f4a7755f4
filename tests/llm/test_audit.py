import itertools
import os

import duckdb
import numpy as np
import pytest
from contourflow.llm import audit, sql
from contourflow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def slow(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in t).split(" ")
        words = [w for w in words if w]
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        rows.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shares = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shares[part, f] = shares.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id bigint, text string, source string, part string, digest string")
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    flags = audit.labelled(audit.text_filters(docs), labels, {"good": "quality", "toxic": "toxic"})
    out = audit.audit(flags, list("ABCDE"), ["good", "toxic"])
    return sorted(tuple(r) for r in out.select(*COLUMNS).collect())


def test_equals_brute_force(spark):
    draw = np.random.default_rng(1)
    pool = ["word", "Word", "WORD", "a", "b#", "cä", "\x0b", "x|y", " "]
    docs = []
    for i in range(120):
        n = int(draw.integers(0, 400))
        words = [f"w{draw.integers(0, 500)}" for _ in range(n)] if i % 3 else [pool[k] for k in draw.integers(0, len(pool), n)]
        docs.append((i, " ".join(words), ["s", "t", "", None][i % 4]))
    docs += [(200 + i, docs[i][1], "s") for i in range(0, 40, 2)] + [(300, None, "t"), (301, "", "t"), (301, "", "t"), (302, None, None), (None, "", "s"), (None, None, "u"), (5, docs[0][1], "s"), (400, "LONG " * 60_000, "s")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 400, 3)] + [(3, None, 1), (6, 1, None), (None, 1, 1)]
    got = run(spark, docs, labels)
    assert got == slow(docs, labels) and len(got) == 600 * 4


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", "s")], []) == slow([(1, "a", "s")], [])


def test_bitsets_of_many_parts():
    draw = np.random.default_rng(2)
    codes = draw.permutation(np.concatenate([np.arange(300), np.zeros(1000, np.int64), draw.integers(0, 300, 500)]))
    filters, labels = [draw.random(len(codes)) < p for p in (0.1, 0.5, 0.9)], [draw.random(len(codes)) < 0.3]
    got = audit.packed_counts(codes, filters, labels)
    for done in range(8):
        left = ~np.any([f for i, f in enumerate(filters) if done >> i & 1] or [np.zeros(len(codes), bool)], axis=0)
        assert (got[:, done, 0] == np.bincount(codes[left], minlength=300)).all()
        assert (got[:, done, 1] == np.bincount(codes[left & labels[0]], minlength=300)).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sql.FILTER_AUDIT})").fetchall()
    got = QUERIES["op11_audit"](spark, SF)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == sorted(want)


def test_text_that_is_not_utf8(spark):
    docs = spark.sql("select 1L as doc_id, cast(X'FF4142' as string) as text, 's' as source union all select 2L, cast(X'FE4142' as string), 's' union all select 3L, cast(X'FF4142' as string), 's'")
    assert sorted((r.doc_id, r.E) for r in audit.text_filters(docs).collect()) == [(1, False), (2, False), (3, True)]
