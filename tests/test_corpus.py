"""Corpora: layout against loops, records, shards on disk, and what reads them again."""

import math
import random
import re
import struct
import time
import unicodedata

import numpy as np
import pytest
from contourflow.operators import analyze, buckets, decode, generate, geometry, graph, metrics, split, store
from contourflow.plans import catalog, engine
from contourflow.sources import msgpack, readers, shards
from pyspark.sql import functions as F


def font(spark):
    box = [(0.0, 0.0), (400.0, 0.0), (400.0, 500.0), (0.0, 500.0)]
    glyphs = [("f", c, 1000.0, a, 5.0, 2.0) for c, a in (("a", 500.0), ("b", 300.0), (" ", 250.0))] + [("g", "a", 2000.0, 900.0, 0.0, 0.0)]
    outlines = [(f, c, k, i, x * s * (1 - 0.5 * k) + 100 * k, y * s) for f, c, s in (("f", "a", 1), ("f", "b", 0.5), ("g", "a", 2)) for k in range(2 if c == "a" else 1) for i, (x, y) in enumerate(box)]
    return spark.createDataFrame(glyphs, "font string, char string, upem double, advance double, dx double, dy double"), spark.createDataFrame(outlines, "font string, char string, k int, i int, x double, y double")


LINE = "g bigint, text string, font string, tracking double, aspect double, jitter double, noise double"


def test_layout_against_loops(spark):
    glyphs, outlines = font(spark)
    options = engine.CorpusOptions(em_scale=1.1, baseline=0.05)
    lines = [(0, "ab a", "f", 0.1, 1.2, 0.0, 0.0), (1, "aa", "g", -0.05, 1.0, 0.0, 0.0), (2, "a?b", "f", 0.0, 1.0, 0.0, 0.0)]
    got = {(r.g, r.c, r.i): (r.ch, r.x, r.y) for r in engine.laid_out(spark.createDataFrame(lines, LINE), glyphs, outlines, options).collect()}
    sets, shapes = {(r.font, r.char): r for r in glyphs.collect()}, {}
    for r in outlines.collect():
        shapes.setdefault((r.font, r.char), []).append(r)
    want = {}
    for g, text, name, tracking, aspect, *_ in lines:
        pen, c, base = 0.0, 0, {}
        for at, char in enumerate(text):
            r = sets.get((name, char))
            if r is None:
                continue
            for p in shapes.get((name, char), []):
                key = base.setdefault((at, p.k), len(base))
                em = r.upem * 1.1
                want[g, key, p.i] = (at, (p.x + pen + r.dx) * aspect / em, (p.y + r.dy + 0.05 * r.upem) / em)
            pen += r.advance + tracking * r.upem
    assert {k: v[0] for k, v in got.items()} == {k: v[0] - (1 if k[0] == 2 and v[0] == 2 else 0) * 0 for k, v in want.items()}
    for k, v in want.items():
        assert got[k][1:] == pytest.approx(v[1:])


def test_jitter_moves_glyphs_and_noise_points(spark):
    glyphs, outlines = font(spark)
    lines = spark.createDataFrame([(g, "aaa", "f", 0.0, 1.0, 0.1 * (g % 2), 0.02 * (g // 2)) for g in range(4)], LINE)
    rows = engine.laid_out(lines, glyphs, outlines).collect()
    low = lambda g: {r.ch: min(x.y for x in rows if x.g == g and x.ch == r.ch) for r in rows if r.g == g}
    assert len(set(low(0).values())) == 1 and len(set(low(1).values())) == 3 and all(abs(v - 0.002) <= 0.1 for v in low(1).values())
    assert len({r.y for r in rows if r.g == 0}) == 2 and len({r.y for r in rows if r.g == 2}) == 24


def test_corpus_to_shards_and_back(spark, tmp_path):
    glyphs, outlines = font(spark)
    options = engine.CorpusOptions(count=25, shard_size=10, tracking=(0.0, 0.2), text_length=(2, 4), decorative=0.3)
    lines = engine.lines(spark, options, ["f"], ["g", "lost"], ["a", "b", " "])
    kept, rejects = engine.generate_corpus(lines, glyphs, outlines, options)
    reasons = {r.g: r.reason for r in rejects.collect()}
    assert set(reasons.values()) <= {"no font", "no glyphs", "small"} and "no font" in reasons.values()
    written = engine.write_corpus(lines, glyphs, outlines, str(tmp_path / "out"), options).collect()
    assert sorted(r.shard for r in written) == [0, 1, 2] and sum(r.n for r in written) == 25 - len(reasons)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"shard_{k:05}.msgpack" for k in range(3)]
    columns = [c.split()[0] for c in shards.SCHEMA.split(", ")]
    back = shards.read(spark, str(tmp_path / "out")).select(columns)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, kept.select(columns).collect()))
    assert set(store.record_violations(back).first()) == {0} and store.check_widths(back) == 13
    r = kept.first()
    assert r.num_nodes * 13 == len(r.node_features) and len(r.edge_index) == 2 * r.num_edges and set(r.text) <= set("ab ")
    with pytest.raises(ValueError):
        store.check_widths(back.union(back.withColumn("node_dim", F.lit(2))))


def test_records_of_dealt_lines_equal_those_of_tables(spark):
    glyphs, outlines = font(spark)
    odd = [("f", c, 0, i, x, y) for c, shape in (("2", [(0.0, 0.0), (9.0, 0.0)]), ("0", [(5.0, 5.0)] * 4), ("3", [(0.0, 0.0), (0.0, 0.0), (30.0, 0.0), (0.0, 30.0)])) for i, (x, y) in enumerate(shape)]
    glyphs = glyphs.union(spark.createDataFrame([("f", c, 1000.0, 100.0, 0.0, 0.0) for c in "203"], glyphs.schema))
    outlines = outlines.union(spark.createDataFrame(odd, outlines.schema))
    texts = ["ab a", "a20b3", "", None, "2", " ", "3", "b\u0301a", "??", "0a" * 20, "ab"]
    lines = spark.createDataFrame([(7 * g - 3, t, "lost" if g == 10 else "f", 0.05, 1.1, 0.02, 0.005) for g, t in enumerate(texts)] + [(500, "a", None, 0.0, 1.0, 0.0, 0.0)], LINE)
    got, rejects = engine.generate_corpus(lines, glyphs, outlines)
    contours, nodes, edges = engine.build(engine.laid_out(lines, glyphs, outlines))
    kept = store.reject_small(store.graph_sizes(nodes, edges)).select("g")
    want = readers.records(nodes, edges, graph.contour_features(contours), lines.join(kept, "g", "left_semi").select("g", "text", "font"))
    assert got.dtypes == want.dtypes and got.count() == 4
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert {(r.g + 3) // 7: r.reason for r in rejects.collect()} == {2: "no glyphs", 3: "no glyphs", 4: "no glyphs", 5: "no glyphs", 6: "small", 8: "no glyphs", 10: "no font", 71: "no font"}


def test_corpora_write_and_shuffle_lines_alone(spark, monkeypatch):
    kept, write = [], engine.written
    monkeypatch.setattr(engine, "written", lambda df, *by: kept.append(set(df.columns)) or write(df, *by))
    glyphs, outlines = font(spark)
    options = engine.CorpusOptions(count=25)
    for rows in engine.generate_corpus(engine.lines(spark, options, ["f"], [], ["a", "b"]), glyphs, outlines, options):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(re.findall(r"Exchange hashpartitioning\((\w+)#", plan)) == ["bucket", "bucket", "font"], plan
    assert {"g", "text"} <= kept[0] and all(not c & {"g", "n", "e", "src"} for c in kept[1:]) and len(kept) == 3


def test_texts_in_turn_and_mixed(spark):
    texts = spark.createDataFrame([(0, "ab"), (1, "ba"), (2, "bb")], "pos bigint, text string")
    rows = engine.lines(spark, engine.CorpusOptions(count=7), ["f"], [], ["x"], texts, 3).orderBy("g").collect()
    assert [r.text for r in rows] == ["ab", "ba", "bb", "ab", "ba", "bb", "ab"]
    rows = engine.lines(spark, engine.CorpusOptions(count=400, text_ratio=0.25), ["f"], [], ["x"], texts, 3).collect()
    share = sum(["ab", "ba", "bb"][r.g % 3] in r.text for r in rows) / 400
    assert 0.17 < share < 0.33 and all(2 <= len(r.text) <= 12 for r in rows)
    with pytest.raises(ValueError):
        generate.fixed_texts(spark.createDataFrame([(0, "# no text")], "at int, value string"), "at")


def test_messagepack_round_trip():
    x = {"a": [1, -5, 2**40, 1.5, None, True], "b": "é" * 300, "c": b"\0" * 70_000, "d": {str(i): i for i in range(20)}, "e": list(range(70_000))}
    assert msgpack.unpack(msgpack.pack(x)) == x
    assert msgpack.unpack(msgpack.pack([np.array([0.5, 2], "f4"), np.array([7, 2**32 - 1], "u4"), np.array([1, 0], "u1")])) == [[0.5, 2.0], [7, 2**32 - 1], [1, 0]]


def test_packed_store_subsets(spark, tmp_path):
    store.write({"nodes": spark.range(50).select((F.col("id") * 10).alias("g"), F.col("id").alias("n"))}, str(tmp_path), 100)
    read = lambda ids, shards=0: sorted(r.g for r in readers.packed(spark, str(tmp_path), "nodes", ids, shards).collect())
    assert read([30, 490, 31]) == [30, 490] and read(spark.createDataFrame([(480,), (20,)], "g bigint")) == [20, 480]
    assert len(read(None)) == 50 and len(read(None, 2)) == 20 and read([30, 490], 2) == [30]


def test_narrowing_fails_beyond_16_bits(spark):
    rows = spark.createDataFrame([(0, 1, 2), (65535, 0, None)], "n bigint, c bigint, ch bigint")
    assert [tuple(r) for r in store.narrowed(rows).collect()] == [(0, 1, 2), (65535, 0, None)]
    with pytest.raises(Exception, match="beyond 16 bits"):
        store.narrowed(rows.withColumn("c", F.lit(65536))).collect()
    assert store.warmed(rows).count() == 2


def test_numbering_counts_on_over_ranges(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.hash("id") % 97).alias("k"), "id")
    got = generate.numbered(rows, ["k", "id"]).collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.pos)] == sorted((r.k, r.id) for r in got) and sorted(r.pos for r in got) == list(range(1000))
    assert [r.id for r in split.even_sample(spark.range(10), "id", 4).orderBy("pos").collect()] == [0, 3, 6, 9] and split.even_sample(spark.range(0), "id", 4).count() == 0


def test_batches_of_an_epoch_are_shuffled(spark):
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    one, two = (split.epoch_batches(rows, "k", "w", 100, 8, 1, e, lanes=2).collect() for e in (0, 1))
    assert sorted(r.k for r in one) == list(range(200))
    batches = {(r.lane, r.batch): r.turn for r in one}
    assert sorted(batches.values()) == list(range(len(batches))) and [batches[k] for k in sorted(batches)] != list(range(len(batches)))
    assert {(r.k, r.turn) for r in one} != {(r.k, r.turn) for r in two}


def test_labels_pass_along_chains_longer_than_any_fixed_number_of_rounds(spark):
    n = 300
    links = spark.createDataFrame([(0, i, i + 1) for i in range(n - 1)] + [(1, 5, 2)], "g bigint, ca bigint, cb bigint")
    contours = spark.createDataFrame([(0, i) for i in range(n)] + [(1, 2), (1, 5), (1, 9)], "g bigint, c bigint")
    got = {(r.g, r.c): r.grp for r in decode.char_groups_by_labels(links, contours).collect()}
    assert got == {(0, i): 0 for i in range(n)} | {(1, 2): 2, (1, 5): 2, (1, 9): 9}


def test_reach_against_a_plain_search(spark):
    edges = [(g, s, d) for g in range(2) for s, d in [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 4), (2, 6)]]
    nodes = [(g, n, math.sin(3 * n + g)) for g in range(2) for n in range(8)]
    e, n = spark.createDataFrame(edges, "g bigint, src bigint, dst bigint"), spark.createDataFrame(nodes, "g bigint, n bigint, x double")
    for hops in (1, 2, 8):
        got = {(r.g, r.start): r.reach for r in analyze.hop_reach(e, n, n.where("n % 2 = 1 or n = 4"), hops).collect()}
        for (g, start), reach in got.items():
            seen = {start}
            for _ in range(hops):
                seen |= {d for h, s, d in edges if h == g and s in seen}
            x = {k: v for h, k, v in nodes if h == g}
            assert reach == pytest.approx(max(abs(x[k] - x[start]) for k in seen))
        assert len(got) == 10


def test_reports(spark):
    rows = spark.createDataFrame([(0.3, 0.5, 0.1, 0.2), (0.5, 0.5, 0.0, 0.25)], "margin double, grouping_acc double, char_split_rate double, char_merge_rate double")
    lines = {r.margin: r.line for r in metrics.group_report(rows).collect()}
    assert lines[0.5] == "   0.50   0.5000   0.0000   0.2500  <- best" and lines[0.3] == "   0.30   0.5000   0.1000   0.2000"
    assert metrics.group_report(rows, ties_high=False).where("line like '%best'").first().margin == 0.3
    correct = spark.createDataFrame([("二", False), ("Ag", True), ("x", True), ("x", True)], "text string, correct boolean")
    shown = [r.line for r in metrics.breakdown_report(metrics.breakdown(correct, "text", 2)).orderBy("pos").collect()]
    assert shown == ["二        1        0   0.0000", "x         2        2   1.0000", "... 1 more"]


def test_stage_times_come_from_the_tasks(spark):
    nodes = spark.range(600).selectExpr("id % 30 as g", "id as n", "id % 4 as c", "cast(id % 17 as double) as x", "cast(id % 13 as double) as y")
    with buckets.Watch(spark) as watch:
        graph.neighbours(nodes).count()
        graph.closest_pairs(nodes).count()
    rows = {r[0]: r for r in watch.rows()}
    assert set(rows) == {"neighbours", "closest_pairs"} and all(n >= 1 and 0 < mean <= most for _, n, mean, most in rows.values())
    graph.neighbours(nodes).count()
    assert {r[0]: r[1] for r in watch.rows()} == {k: r[1] for k, r in rows.items()}
    with buckets.Watch(spark, skip=10**6) as watch:
        graph.neighbours(nodes).count()
    assert watch.rows() == []


def test_quantiles_equal_numpy(spark):
    draw = np.random.default_rng(4)
    for values in (draw.integers(0, 9, 400).astype(float), draw.lognormal(0, 8, 333), np.array([2.5]), np.array([-1e300, 0.0, 5e-324, 1e300]), np.repeat(7.0, 50)):
        rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        shares = [0.0, 0.3, 0.5, 0.95, 1.0]
        assert np.allclose(analyze.quantiles(rows, "v", shares), np.quantile(values, shares), rtol=1e-12)
        assert analyze.ranked(rows.where("v is not null"), "v", list(range(len(values)))[:40], cells=5) == sorted(values.tolist())[:40]
    assert analyze.quantiles(rows.limit(0), "v", [0.5]) == [None]


def test_shards_appear_only_when_all_are_written(spark, tmp_path):
    row = {"text": "Ag", "font": "f", "num_nodes": 1, "node_dim": 1, "num_edges": 1, "num_contours": 1, "node_features": [0.5], "edge_index": [0, 0], "edge_features": [0.0], "contour_features": [1.0], "edge_labels": [1], "node_char_ids": [0], "node_contour_ids": [0]}
    rows = spark.createDataFrame([row | {"g": g} for g in range(40) if g // 10 != 2], shards.SCHEMA + ", g bigint")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    assert {r.shard: r.n for r in shards.write(rows, good, 10, 50).collect()} == {0: 10, 1: 10, 2: 0, 3: 10, 4: 0}
    assert sorted(p.name for p in (tmp_path / "good").iterdir()) == [f"shard_{k:05}.msgpack" for k in range(5)]
    back = shards.read(spark, good)
    assert back.count() == 30 and back.rdd.getNumPartitions() == 5 and shards.read(spark, good, 2).count() == 20 and shards.read(spark, good, 2).rdd.getNumPartitions() == 2
    fails = rows.withColumn("text", F.when(F.col("g") == 35, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        shards.write(fails, bad, 10, 40)
    assert not (tmp_path / "bad").exists() or not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]
    shards.write(rows.limit(7), good, 10, 10)
    assert shards.read(spark, good, 1).count() == 7


def test_unusable_files_are_skipped_with_a_warning(spark, tmp_path):
    for name, head in {"b.ttf": b"\0\1\0\0", "a.otf": b"OTTO", "c.ttc": b"junk", "e.ttf": b""}.items():
        (tmp_path / name).write_bytes(head)
    with pytest.warns(UserWarning, match="skipped 1 unknown"):
        assert [r.name for r in readers.usable_pool(spark, str(tmp_path)).orderBy("name").collect()] == ["a.otf", "b.ttf"]
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        readers.usable_pool(spark, str(tmp_path), kinds=("ttc",))


def slow_shape(text, ligatures):
    out, at = [], 0
    while at < len(text):
        fits = [p for p in ligatures if text.startswith(p, at)]
        part = max(fits, key=len, default=text[at])
        mark = unicodedata.category(text[at]).startswith("M") and bool(out)
        out.append((out[-1][0] if mark else at, ligatures.get(part, part)))
        at += len(part)
    return out


def test_ligatures_take_the_longest_and_make_one_cluster(spark):
    table = {"fi": "FI", "ffi": "FFI", "ff": "FF", "f.": "DOT", "🙂a": "SMILE", "\\E": "ESC"}
    texts = ["office fluffi fig", "ffffi", "f.i\\Ex", "e\u0301fi\u0302", "🙂a🙂b", "", None, "\u0301fi", "a\nfi"]
    lines = spark.createDataFrame([(i, "serif", t) for i, t in enumerate(texts)] + [(50, "other", "fi")], "g bigint, font string, text string")
    rows = geometry.shaped(lines, spark.createDataFrame([("serif", k, v) for k, v in table.items()] + [("third", "of", "x")], "font string, parts string, char string"))
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.g, r.k)):
        got.setdefault(r.g, []).append((r.at, r.char))
    assert got.pop(50) == [(0, "f"), (1, "i")]
    assert got == {i: slow_shape(t, table) for i, t in enumerate(texts) if t}
    plain = geometry.shaped(lines)
    assert plain.where("g = 0").count() == len(texts[0]) and plain.where("g = 4").count() == 4
    kern = spark.createDataFrame([("serif", "FFI", "c", -3.0), ("serif", "c", "e", 2.0)], "font string, char string, next string, kern double")
    assert [r.kern for r in geometry.kerned(rows.where("g = 0"), kern, "g").orderBy("k").collect()][:4] == [0.0, -3.0, 2.0, 0.0]


def test_a_ligature_is_one_character_of_a_line(spark):
    glyphs, outlines = font(spark)
    options = engine.CorpusOptions(count=1)
    lines = spark.createDataFrame([(0, "aab", "f", 0.0, 1.0, 0.0, 0.0)], "g bigint, text string, font string, tracking double, aspect double, jitter double, noise double")
    ligature = spark.createDataFrame([("f", "aa", "b")], "font string, parts string, char string")
    kern = spark.createDataFrame([("f", "b", "b", 100.0)], "font string, char string, next string, kern double")
    plain, joined, moved = (engine.laid_out(lines, glyphs, outlines, options, *more).collect() for more in ((), (ligature,), (ligature, kern)))
    assert len({r.ch for r in plain}) == 3 and len({r.ch for r in joined}) == 2
    assert max(r.x for r in moved) > max(r.x for r in joined)


def test_command_line(spark, tmp_path, capsys):
    points = [(g, c, c // 2, i, 0.3 * c + 0.1 * math.cos(i), 0.1 * math.sin(i)) for g in range(2) for c in range(4) for i in range(6)]
    spark.createDataFrame(points, "g bigint, c bigint, ch bigint, i int, x double, y double").write.parquet(str(tmp_path / "in"))
    engine.main(["segment", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--threshold", "1.1"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8
    engine.main(["merge", str(tmp_path / "in")])
    assert "best" in capsys.readouterr().out
    engine.main(["analyze", str(tmp_path / "in")])
    assert "decision_share" in capsys.readouterr().out
    engine.main(["pack", str(tmp_path / "in"), "--out", str(tmp_path / "store")])
    assert store.read(spark, str(tmp_path / "store"), "graphs").count() == 2
    engine.main(["train", str(tmp_path / "in"), "--out", str(tmp_path / "dump"), "--epochs", "1", "--hidden", "4"])
    assert "loss" in capsys.readouterr().out and engine.model_of((tmp_path / "dump").read_bytes())[0].hidden == 4


def test_weight_dump_without_options(spark):
    head = struct.pack("<II", 1, 2)
    assert readers.read_weights(b"GNNW" + struct.pack("<II", 1, 14) + b'{"tensors":[]}') == ({}, {}) and len(head) == 8


def test_long_texts_are_shaped_in_time_that_grows_with_them(spark):
    text = "theán😀́ " * 4_000
    lines = spark.createDataFrame([(1, "serif", text)], "g int, font string, text string")
    began = time.monotonic()
    rows = geometry.shaped(lines, spark.createDataFrame([("serif", "the", "T"), ("serif", "th", "t")], "font string, parts string, char string")).orderBy("k").collect()
    assert time.monotonic() - began < 60
    assert [(r.at, r.char) for r in rows] == [(9 * n + at, c) for n in range(4_000) for at, c in [(0, "T"), (3, "a"), (3, "́"), (5, "n"), (6, "😀"), (6, "́"), (8, " ")]]


def test_records_deal_edges_by_graph_alone(spark):
    nodes = spark.createDataFrame([(g, n, n // 20, 0) for g in (1, 2) for n in (10, 20, 40)], "g bigint, n bigint, c bigint, ch bigint")
    nodes = nodes.select("*", *[F.lit(0.0).alias(c) for c in readers.model.NODE])
    rows = [(1, 0, 10, 40), (1, 1, 40, 10), (1, 2, 10, 30), (1, 3, 5, 10), (1, 4, 20, 20), (2, 0, 40, 20), (2, 1, 50, 10)]
    edges = spark.createDataFrame(rows, "g bigint, e bigint, src bigint, dst bigint").select("*", F.lit(True).alias("label"), *[F.col("e").cast("double").alias(c) for c in readers.model.EDGE])
    contours = nodes.select("g", "c").distinct().select("*", *[F.lit(0.0).alias(c) for c in readers.model.CONTOUR])
    names = nodes.select("g").distinct().select("g", F.lit("t").alias("text"), F.lit("f").alias("font"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = readers.records(nodes, edges, contours, names)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(g#" in plan and not any("hashpartitioning" in x and ("src#" in x or "dst#" in x) for x in plan.splitlines())
        by = {r.g: r for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert by[1].edge_index == [0, 2, 1, 2, 0, 1] and by[2].edge_index == [2, 1] and by[1].num_edges == 3
    assert by[1].edge_features == [float(e) for e in (0, 1, 4) for _ in range(4)]


def test_edges_listed_in_buckets_are_those_of_built_edges(spark):
    rng = random.Random(6)
    # Graph 3 has no edge; numbers aren't in the order of contours; a character may be unknown.
    rows = [(g, n, (n * 7 + g) % 4, rng.choice([0, 1, None]), rng.random() * (1 if g != 3 else 0) + 50 * (g == 3) * n, rng.random()) for g in (1, 2, 3, 4) for n in rng.sample(range(100), 30 if g != 3 else 2)]
    nodes = spark.createDataFrame(rows, "g bigint, n bigint, c bigint, ch bigint, x double, y double")
    contours = nodes.groupBy("g", "c").agg(*[f(k).alias(f"{m}_{k}") for m, f in (("min", F.min), ("max", F.max)) for k in ("x", "y")])
    got, want = graph.built_lists(nodes, contours), readers._listed(nodes, graph.built_edges(nodes, contours))
    rows = lambda df: {r.g: tuple(r)[1:] for r in df.collect()}
    assert rows(got) == rows(want) and len(rows(got)) == 3
    assert graph.built_lists(nodes.limit(0), contours).count() == 0


def test_records_of_built_graphs_send_no_edge_alone(spark):
    plan = catalog.QUERIES["validate_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "edge_index#" in plan and "src#" not in plan and "dst#" not in plan
