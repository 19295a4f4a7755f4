import random

import pytest
from contourflow.llm import linededup
from pyspark.sql import functions as F


def long(tag, n=30):
    return " ".join(f"{tag}{i}" for i in range(n))


def brute(rows, lone=None):
    """(doc_id, hash) -> (text, lines removed); rows of (doc_id, hash, text)."""
    out, seen = {}, set()
    for i, h, text in sorted({r for r in rows if r[0] is not None and r[2] is not None}):
        lines = text.split("\n")
        filled = [p for p, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for a, p in enumerate(filled):
            for key, own in [((lines[p], *[lines[q] for q in filled[a + 1 : a + 2]]), {a, a + 1}), ((lines[p],), {a})]:
                if len(key) == 2 or len(own) == 1 and lone is not None and len(lines[p].split()) >= lone:
                    gone |= own if key in seen else set()
                    seen.add(key)
        drop = {filled[a] for a in gone} | {p for a in gone if a + 1 in gone for p in range(filled[a], filled[a + 1])}
        out[i, h] = "\n".join(x for p, x in enumerate(lines) if p not in drop), len(drop)
    return out


def same_as_brute(spark, rows, lone=None):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "k", 3, 4) for r in rows], "doc_id bigint, text string, gone string, _id int, _th int, k string, row int, id int").withColumn("h", F.xxhash64("text"))
    want = brute([(r.doc_id, r.h, r.text) for r in docs.collect()], lone)
    got = linededup.dedup_lines(docs, lone)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.gone, r._id, r._th, r.k, r.row, r.id) == ("x", 1, 2, "k", 3, 4)
        if r.doc_id is not None and (r.doc_id, r.h) in want:
            assert (r.text, r.n_removed) == want[r.doc_id, r.h]
    return got


@pytest.mark.parametrize(("n", "lone"), [(1, 40), (2, None), (8, None), (8, 40)])
def test_equals_brute_force(spark, n, lone):
    rng = random.Random(n)
    line = lambda k: " ".join(f"w{rng.randrange(300)}" for _ in range(k))
    common, passages = [line(3) for _ in range(30)], ["\n".join(line(rng.choice([5, 8, 50])) for _ in range(n)) for _ in range(30)]
    pick = [lambda: rng.choice(passages), lambda: rng.choice(common), lambda: line(6), lambda: "", lambda: " \r"]
    rows = [(d, "\n".join(rng.choice(pick)() for _ in range(rng.randint(1, 6)))) for d in range(200)]
    rows += [*rows[:5], (7, "another"), (None, passages[0]), (900, None), (901, ""), (902, "\n\n"), (903, "a\na\na\nb\na\na")]
    same_as_brute(spark, rows, lone)


def test_chunks_leave_less_to_pairs(spark):
    rng = random.Random(1)
    passages = ["\n".join(long(f"p{k}x{j}y", 3) for j in range(24)) for k in range(20)]
    rows = [(d, f"{long(f'a{d}q')}\n{passages[d % 20]}\n{long(f'b{d}q')}\n{long(f'c{rng.randrange(9)}q')}") for d in range(300)]
    docs = spark.createDataFrame(rows, "id bigint, text string").withColumn("th", F.xxhash64("text"))
    counts = [dict(linededup.candidates(docs, chunked=c).groupBy("kind").count().collect()) for c in (True, False)]
    chunks, pairs, alone = counts[0][linededup.CHUNK], counts[0][linededup.PAIR], counts[1][linededup.PAIR]
    assert linededup.CHUNK not in counts[1] and chunks > 300 and pairs < 0.6 * alone, (chunks, pairs, alone)


@pytest.mark.parametrize("n", [2, 4, 16])
def test_passages_after_a_common_line_go_whole(spark, n):
    rows = []
    for k in range(20):
        passage = "\n".join(long(f"p{k}x{j}y", 3) for j in range(n))
        rows += [(3 * k, f"{long(f'a{k}q')}\n{passage}\n{long(f'b{k}q')}"), (3 * k + 1, f"common line\n{passage}\nanother common line"), (3 * k + 2, f"{long(f'c{k}q')}\ncommon line\n{long(f'd{k}q')}")]
    got = {r.doc_id: r for r in same_as_brute(spark, rows)}
    assert all(got[3 * k + 1].text == "common line\nanother common line" and got[3 * k].n_removed == 0 for k in range(20))


def test_long_texts(spark):
    block = "\n".join(f"line {i} of the block" for i in range(5_000))
    rows = [(1, block), (2, f"before\n{block}\nafter"), (3, "\n".join(f"line {i} of the block\nnew {i}" for i in range(5_000))), (4, "word " * 300_000), (5, "word " * 300_000)]
    got = {r.doc_id: r for r in same_as_brute(spark, rows, 40)}
    assert got[2].text == "before\nafter" and got[3].n_removed == 0 and got[5].text == ""


def test_passages_go_wherever_they_stand(spark):
    passage = "\n".join(long(f"p{k}x", 15) for k in range(4))
    lone = long("lone", 55)
    rows = [(i, f"{long(f'a{i}q')}\n{passage}\n{long(f'b{i}q')}", "x") for i in range(5)]
    rows += [(10, f"{long('c')}\n{lone}"), (11, f"{lone}\n{long('d')}"), (12, "short line\nshort too"), (13, "short line\nother"), (14, None), (15, ""), (16, "\n\n\n")]
    rows += [(20, f"{long('e')}\n{passage}"), (20, f"{long('e')}\n{passage}"), (None, passage), (21, passage), (21, "same id, other text")]
    rows = [(*r, "x")[:3] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, h string")
    got = linededup.dedup_lines(docs, lone_words=40).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[0][0].text == rows[0][1] and by[0][0].n_removed == 0
    for i in range(1, 5):
        assert by[i][0].text == f"{long(f'a{i}q')}\n{long(f'b{i}q')}" and by[i][0].n_removed == 4 and by[i][0].n_lines == 6
    assert by[10][0].text == f"{long('c')}\n{lone}" and by[11][0].text == long("d")
    assert by[12][0].text == "short line\nshort too" and by[13][0].text == "short line\nother"
    assert by[14][0].text is None and by[14][0].n_lines == 0 and by[15][0].text == "" and by[16][0].text == "\n\n\n"
    assert [r.text for r in by[20]] == [long("e")] * 2 and by[None][0].text == passage
    assert sorted(r.text for r in by[21]) == ["", "same id, other text"]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    assert linededup.dedup_lines(docs).where("doc_id = 11").first().text == f"{lone}\n{long('d')}"


def test_repeats_within_a_document(spark):
    block = "\n".join(long(f"r{k}x", 15) for k in range(3))
    docs = spark.createDataFrame([(1, f"{block}\n{long('m')}\n{block}")], "doc_id bigint, text string")
    assert linededup.dedup_lines(docs).first().text == f"{block}\n{long('m')}"


def test_empty_lines_part_no_passage(spark):
    parts = [long("p", 27), long("q", 27)]
    rows = [(i, f"{long(f'a{i}q')}\n\n{(chr(10) * (2 + i % 2)).join(parts)}\n\n{long(f'b{i}q')}") for i in range(5)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for i in range(1, 5):
        assert got[i].text == f"{long(f'a{i}q')}\n\n\n{long(f'b{i}q')}" and got[i].n_removed == 3 + i % 2


def test_query_and_pipeline_drop_single_long_lines(spark, tmp_path):
    import corpus_pipeline
    import duckdb
    from contourflow.llm import queries

    rows = [(1, f"{long('a')}\n{long('lone', 40)}"), (2, f"{long('lone', 40)}\n{long('b')}"), (3, f"{long('c')}\n{long('short', 39)}"), (4, f"{long('short', 39)}\n{long('d')}")]
    spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(1, rows[0][1], 2, 0), (2, long("b"), 2, 1), (3, rows[2][1], 2, 0), (4, rows[3][1], 2, 0)]
    assert sorted(map(tuple, queries.QUERIES["op5_linededup"](spark, str(tmp_path)).select("doc_id", "text", "n_lines", "n_removed").collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(queries.ORACLES["op5_linededup"]).project("doc_id, text, n_lines, n_removed").fetchall()) == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == {i: t for i, t, *_ in want}
