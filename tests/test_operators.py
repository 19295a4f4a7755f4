"""Literal cases: squares in em units (coordinates of 1000 to the em), pooling limits, decoders against loops."""

import math
import random

import numpy as np
import pytest
from contourflow.operators import analyze, buckets, decode, generate, geometry, graph, metrics, model, score, split, store
from contourflow.plans import engine
from contourflow.sources import readers, shards
from contourflow.streaming import streamed_pairs, windowed
from pyspark.sql import functions as F


def square(cx, cy, half, reverse=False):
    p = [(cx - half, cy - half), (cx + half, cy - half), (cx + half, cy + half), (cx - half, cy + half)]
    return [(x / 1000, y / 1000) for x, y in (p[::-1] if reverse else p)]


def built(spark, squares, **options):
    """squares: (points, char) by contour."""
    rows = [(1, c, ch, i, float(x), float(y)) for c, (p, ch) in enumerate(squares) for i, (x, y) in enumerate(p)]
    points = spark.createDataFrame(rows, "g bigint, c bigint, ch bigint, i int, x double, y double")
    stats = geometry.contour_stats(points, ["g", "c"], carry=["ch"])
    samples = geometry.resample(points, ["g", "c"])
    nodes = graph.node_features(samples, stats).join(stats.select("g", "c", "ch"), ["g", "c"]).cache()
    edges = graph.edge_features(graph.directed(graph.graph_edges(nodes, stats, **options)), nodes).cache()
    return stats, nodes, edges


def test_overlapping_squares(spark):
    _, nodes, edges = built(spark, [(square(0, 0, 300), 0), (square(150, 0, 300), 1)])
    assert nodes.count() == 96
    assert {r.label for r in edges.select("label").distinct().collect()} == {True, False}
    pairs = {(r.src, r.dst) for r in edges.collect()}
    assert pairs == {(b, a) for a, b in pairs}
    assert min(r.x for r in nodes.collect()) == pytest.approx(0)


def test_counter_winds_the_other_way(spark):
    stats, nodes, _ = built(spark, [(square(0, 0, 300), 0), (square(0, 0, 150, True), 0)])
    a, b = stats.orderBy("c").collect()
    assert a.area * b.area < 0 and a.max_x - a.min_x == pytest.approx(0.6) and nodes.count() == 72
    assert graph.contour_relations(graph.contour_features(stats)).where("ca = 0 and cb = 1").first().winding == -1


def test_distant_squares_have_no_edge_between(spark):
    _, nodes, edges = built(spark, [(square(0, 0, 200), 0), (square(5000, 0, 200), 1)])
    assert nodes.count() == 64 and edges.where("not label").count() == 0 and edges.count() > 0


def test_bridge_adds_edges(spark):
    squares = [(square(0, 0, 50), 0), (square(360, 0, 50), 0), (square(450, 0, 50), 1)]
    without, with_ = (built(spark, squares, bridge=b, stack=0.0)[2] for b in (0.0, 0.35))
    count = lambda e: (e.count(), e.where("label").count(), e.where("not label").count())
    assert count(with_)[0] > count(without)[0] and count(with_)[1] > count(without)[1] and count(with_)[2] > 0


def test_unknown_characters_are_never_positive(spark):
    _, _, edges = built(spark, [(square(0, 0, 100), None), (square(50, 0, 100), None)])
    assert edges.where("label").count() == 0


def test_relations_of_a_contour_with_itself(spark):
    stats, _, _ = built(spark, [(square(0, 0, 300), 0)])
    r = graph.contour_relations(graph.contour_features(stats)).first()
    assert (r.dx, r.dy, r.dist, r.inside, r.holds) == (0, 0, 0, 0, 0) and r.over_x == pytest.approx(0.6) and abs(r.arc_ratio) < 1e-12 and r.winding == 1


def test_grid_and_plain_neighbours_agree(spark):
    rng = random.Random(1)
    nodes = spark.createDataFrame([(g, i, rng.random(), rng.random()) for g in range(3) for i in range(150)], "g bigint, n bigint, x double, y double")
    a, b = (sorted(map(tuple, f(nodes, 4, 0.1).collect())) for f in (graph.neighbours, graph.neighbours_all_pairs))
    assert a == b and a


def test_resampling_skips_degenerate_contours(spark):
    rows = [(1, 0, i, 0.5, 0.5) for i in range(5)] + [(1, 1, i, float(i), 0.0) for i in range(2)] + [(1, 2, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (0.0, 0.0), (0.3, 0.0), (0.3, 0.3)])]
    points = spark.createDataFrame(rows, "g bigint, c bigint, i int, x double, y double")
    got = geometry.resample(points, ["g", "c"]).orderBy("k").collect()
    assert {r.c for r in got} == {2} and [r.k for r in got] == list(range(len(got)))
    total = 0.3 + 0.3 + 0.3 * 2**0.5
    assert len(got) == round(total / 0.05) and (got[0].x, got[0].y) == (0.0, 0.0)


def test_incoming_edges(spark):
    e = spark.createDataFrame([(0, i, d) for i, d in enumerate([2, 1, 0, 1, 2])], "g bigint, e bigint, dst bigint")
    assert {r.dst: (r.start, r.ids) for r in analyze.incoming(e).collect()} == {0: (0, [2]), 1: (1, [1, 3]), 2: (3, [0, 4])}


def test_layer_norm(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0)], "r int, v double")
    assert sorted(round(r.norm, 3) for r in score.layer_norm(rows, ["r"], "v").collect()) == [-1, -1, 1, 1]


def test_pooling_limits(spark):
    x = [-3, -2.5, 4, -2, -3.5, 0.5]
    rows = spark.createDataFrame([(0, float(v)) for v in x], "p int, logit double")
    at = lambda t: score.softmax_pool(rows, ["p"], t).first().pooled
    assert at(0.01) == pytest.approx(4, abs=1e-3) and at(1000.0) == pytest.approx(np.mean(x), abs=1e-2) and np.mean(x) < at(1.0) < 4


def test_two_level_loss_without_pairs_is_plain(spark):
    rows = spark.createDataFrame([(0, 1, 1, 0.3, 1.0), (0, 2, 2, -0.4, 0.0)], "g bigint, ca bigint, cb bigint, logit double, y double")
    got = score.two_level_loss(rows, 0.5, inner_weight=1.0).first()
    plain = score.focal_loss(rows.withColumn("weight", F.lit(1.0))).first()
    assert got.loss == pytest.approx(plain["mean"]) and got.pair is None


def test_decoders_agree_on_random_scores(spark):
    rng = random.Random(9)
    contours = [(g, c, c // 2) for g in range(6) for c in range(8)]
    pairs = [(g, a, b, 1, rng.random(), a // 2 == b // 2) for g in range(6) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.3]
    cs = spark.createDataFrame(contours, "g bigint, c bigint, ch bigint")
    ps = spark.createDataFrame(pairs, "g bigint, ca bigint, cb bigint, n_edges bigint, prob double, label boolean")
    spark.sparkContext.setCheckpointDir("/tmp/contourflow-tests") if not spark.sparkContext.getCheckpointDir() else None
    for t in (0.3, 0.7):
        one = {(r.g, r.c): r.grp for r in decode.char_groups(ps, cs, [t]).collect()}
        two = {(r.g, r.c): r.grp for r in decode.char_groups_by_labels(ps.where(F.col("prob") >= t), cs).collect()}
        assert one == two
        exact = {r.g: r.correct for r in metrics.exact_graphs(metrics.cells(decode.char_groups(ps, cs, [t]), cs), cs.select("g").distinct(), [t]).collect()}
        equal = {r.g: r.equal for r in decode.partitions_equal(decode.char_groups(ps, cs, [t]), decode.truth_groups(cs)).collect()}
        assert exact == equal
    for parts in (1, 7):  # how rows are spread must not matter
        s = metrics.sweep(ps.repartition(parts), cs.repartition(parts), cs.select("g").distinct(), [0.3, 0.7]).orderBy("threshold").collect()
        assert s == metrics.sweep(ps, cs, cs.select("g").distinct(), [0.3, 0.7]).orderBy("threshold").collect()


def test_known_scores(spark):
    cs = spark.createDataFrame([(0, c, c // 2) for c in range(4)], "g bigint, c bigint, ch bigint")
    rows = [(0, a, b, a // 2 == b // 2) for a in range(4) for b in range(a + 1, 4)]
    ps = spark.createDataFrame(rows, "g bigint, ca bigint, cb bigint, label boolean").withColumn("n_edges", F.lit(1))
    at = lambda p: metrics.sweep(ps.withColumn("prob", p), cs, cs.select("g").distinct(), [0.5]).first()
    oracle, all_, none = at(F.col("label").cast("double")), at(F.lit(1.0)), at(F.lit(0.0))
    assert (oracle.pair_f1, oracle.char_merge_rate, oracle.grouping_acc) == (1, 0, 1) and all_.char_merge_rate == 1 and none.char_merge_rate == 0 and none.char_split_rate == 1


def test_greedy_merges_in_order_of_probability(spark):
    cs = spark.createDataFrame([(0, c) for c in range(4)], "g bigint, c bigint")
    ps = spark.createDataFrame([(0, 0, 1, 0.9), (0, 1, 2, 0.8), (0, 2, 3, 0.7), (0, 0, 3, 0.05)], "g bigint, ca bigint, cb bigint, prob double")
    got = decode.greedy_groups(ps, cs, lambda a, b, p: 1.0 if len(a) + len(b) <= 2 else 0.0)
    assert {r.c: r.grp for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2}


def slow_linear(w, name, x):
    return [sum(a * b for a, b in zip(row, x, strict=True)) + c for row, c in zip(w[f"{name}.weight"].tolist(), w[f"{name}.bias"].ravel().tolist(), strict=True)]


def slow_norm(w, name, x):
    mean = sum(x) / len(x)
    var = sum((v - mean) ** 2 for v in x) / len(x)
    return [(v - mean) / (var + 1e-5) ** 0.5 * a + b for v, a, b in zip(x, w[f"{name}.weight"].ravel().tolist(), w[f"{name}.bias"].ravel().tolist(), strict=True)]


def relu(x):
    return [max(v, 0.0) for v in x]


def add(*xs):
    return [sum(v) for v in zip(*xs, strict=True)]


def slow_relations(a, b):
    cx, cy, w, h, x0, y0, arc, area = range(8)
    over = [min(a[x0] + a[w], b[x0] + b[w]) - max(a[x0], b[x0]), min(a[y0] + a[h], b[y0] + b[h]) - max(a[y0], b[y0])]
    share = [min(max(over[0] / max(min(a[w], b[w]), 1e-6), -4), 1), min(max(over[1] / max(min(a[h], b[h]), 1e-6), -4), 1)]
    inside = lambda p, q: min(p[x0] - q[x0], p[y0] - q[y0], q[x0] + q[w] - p[x0] - p[w], q[y0] + q[h] - p[y0] - p[h])
    sign = lambda v: (v > 0) - (v < 0)
    dx, dy = b[cx] - a[cx], b[cy] - a[cy]
    return [dx, dy, (dx * dx + dy * dy) ** 0.5, *over, *share, inside(a, b), inside(b, a), math.log((a[arc] + 1e-6) / (b[arc] + 1e-6)), sign(a[area]) * sign(b[area])]


def slow_trunk(o, w, nodes, src, dst, edges, contour, contours):
    """Node states and the summary, one number after the other."""
    h = [slow_norm(w, "encoder.3", slow_linear(w, "encoder.2", relu(slow_linear(w, "encoder.0", x)))) for x in nodes]
    size = o.hidden // o.heads
    for i in range(o.layers):
        c, att = f"convs.{i}", w[f"convs.{i}.att"].reshape(o.heads, size).tolist()
        source = [slow_linear(w, f"{c}.lin_src", h[s]) for s in src]
        mixed = [add(s, slow_linear(w, f"{c}.lin_dst", h[d]), slow_linear(w, f"{c}.lin_edge", e)) for s, d, e in zip(source, dst, edges, strict=True)]
        logit = [[sum(a * (v if v >= 0 else 0.2 * v) for a, v in zip(att[k], z[k * size : (k + 1) * size], strict=True)) for k in range(o.heads)] for z in mixed]
        top = max(v for z in logit for v in z)
        new = []
        for n, own in enumerate(h):
            into = [j for j, d in enumerate(dst) if d == n]
            agg = []
            for k in range(o.heads):
                e = {j: math.exp(logit[j][k] - top) for j in into}
                total = sum(e.values()) + 1e-9
                agg += [sum(e[j] / total * source[j][k * size + x] for j in into) for x in range(size)]
            new.append(slow_norm(w, f"{c}.norm", add(own, slow_linear(w, f"{c}.out", agg))))
        h = new
        if o.contours:
            c = f"contour_layers.{i}"
            mean = [[sum(h[n][x] for n in range(len(h)) if contour[n] == k) / max(1, contour.count(k)) for x in range(o.hidden)] for k in range(len(contours))]
            z = [slow_norm(w, f"{c}.norm_contour", add(m, slow_linear(w, f"{c}.embed", row))) for m, row in zip(mean, contours, strict=True)]
            q, key, v = ([slow_linear(w, f"{c}.{name}", x) for x in z] for name in ("query", "key", "value"))
            out = []
            for a in range(len(z)):
                row = []
                for k in range(o.heads):
                    part = slice(k * size, (k + 1) * size)
                    score = [sum(x * y for x, y in zip(q[a][part], key[b][part], strict=True)) / size**0.5 + (slow_linear(w, f"{c}.rel_bias", slow_relations(contours[a], contours[b]))[k] if o.related else 0) for b in range(len(z))]
                    e = [math.exp(s - max(score)) for s in score]
                    row += [sum(p / sum(e) * v[b][part][x] for b, p in enumerate(e)) for x in range(size)]
                out.append(add(z[a], slow_linear(w, f"{c}.proj", row)))
            h = [slow_norm(w, f"{c}.norm", add(own, slow_linear(w, f"{c}.out", out[contour[n]]))) for n, own in enumerate(h)]
    pooled = [sum(x) / len(h) for x in zip(*h, strict=True)] + [max(x) for x in zip(*h, strict=True)]
    return h, relu(slow_linear(w, "context.0", pooled)) if o.context else []


def slow_head(w, name, x):
    return slow_linear(w, f"{name}.5", relu(slow_linear(w, f"{name}.3", relu(slow_linear(w, f"{name}.0", x)))))[0]


def a_graph(seed=0):
    rng = np.random.default_rng(seed)
    contour = [0, 0, 1, 1, 2]
    rows = np.abs(rng.standard_normal((3, 8)))
    rows[:, 7] *= [1, -1, 1]
    src, dst = [0, 1, 2, 3, 4, 0], [1, 0, 1, 2, 2, 2]
    edges = rng.standard_normal((6, 4))
    edges[:, 3] = [contour[a] == contour[b] for a, b in zip(src, dst, strict=True)]
    return model.Graph(rng.standard_normal((5, 13)), np.array(src), np.array(dst), edges, np.array(contour), rows)


@pytest.mark.parametrize("off", [{}, {"context": False}, {"relations": False}, {"contours": False, "group": False}])
def test_forward_of_a_weight_dump_against_loops(off):
    o = model.Options(hidden=4, heads=2, layers=2, **off)
    names = {k: getattr(o, k) for k in ("hidden", "layers", "heads", "context", "contours", "relations", "group") if getattr(o, k) is not False}
    options, weights = engine.model_of(readers.write_weights(names, model.seeded(o, 3)))
    assert options == o
    m, g = model.Model(options, weights), a_graph()
    h, summary = m.trunk(g)
    plain = [x.tolist() for x in (g.nodes, g.src, g.dst, g.edges, g.contour, g.contours)]
    want, line = slow_trunk(o, m.w, *plain)
    assert np.allclose(h, want) and np.allclose(summary, line)
    some = np.flatnonzero(g.edges[:, 3] == 0)
    logits = []
    for j in some.tolist():
        s, d = plain[1][j], plain[2][j]
        related = slow_relations(plain[5][plain[4][s]], plain[5][plain[4][d]]) if o.related else []
        logits.append(slow_head(m.w, "classifier", [*want[s], *want[d], *[abs(x - y) for x, y in zip(want[s], want[d], strict=True)], *plain[3][j], *related, *line]))
    assert np.allclose(m.logits(h, summary, g, some), logits)


def test_merge_scorer_against_loops_and_accumulators():
    o = model.Options(hidden=4, heads=2, layers=1)
    m, g = model.Model(o, model.seeded(o, 1)), a_graph(2)
    h, summary = m.trunk(g)
    states, rows = m.states(h, g), g.contours.tolist()

    def described(members):
        s = [states[c].tolist() for c in members]
        x0, y0 = (min(rows[c][k] for c in members) for k in (4, 5))
        w, t = max(rows[c][4] + rows[c][2] for c in members) - x0, max(rows[c][5] + rows[c][3] for c in members) - y0
        arc, area = sum(rows[c][6] for c in members), sum(abs(rows[c][7]) for c in members)
        return [*[sum(x) / len(s) for x in zip(*s, strict=True)], *[max(x) for x in zip(*s, strict=True)], w, t, len(members), arc, area, w / max(t, 1e-6), arc / max(w + t, 1e-6)]

    one = [model.Group.of(states[c], g.contours[c]) for c in range(3)]
    both = one[0] + one[2]
    assert np.allclose(both.described(), described([0, 2])) and np.allclose((both + one[1]).described(), (one[1] + one[2] + one[0]).described())
    want = slow_head(m.w, "group_head.net", [*described([0, 2]), *described([1]), *described([0, 1, 2]), *summary.tolist(), 0.25])
    assert m.merge_logit(both.described(), one[1].described(), (both + one[1]).described(), summary, 0.25) == pytest.approx(want)


def test_weights_of_another_shape_are_refused():
    o = model.Options(hidden=4, heads=2, layers=1)
    w = model.seeded(o)
    with pytest.raises(ValueError, match="encoder.0.weight"):
        model.checked(o, {**w, "encoder.0.weight": w["encoder.0.weight"][:2]})
    with pytest.raises(ValueError):
        model.Options(hidden=5, heads=2)
    assert not model.Options.of({"hidden": 4, "heads": 2, "relations": True}).related


def test_linear_case():
    m = model.Model.__new__(model.Model)
    m.w = {"l.weight": np.array([[1, 0, -1], [0.5, 0.5, 0.5]]), "l.bias": np.array([10.0, -1.0])}
    assert m.linear("l", np.array([[1.0, 2, 3], [4, 5, 6]])).ravel().tolist() == [8, 2, 8, 6.5]


def test_buckets_give_what_single_graphs_give(spark, monkeypatch):
    points = spark.createDataFrame([(g, c, c // 2, i, 0.3 * c + 0.1 * math.cos(i) + 0.01 * g, 0.1 * math.sin(i)) for g in range(6) for c in range(4) for i in range(6)], "g bigint, c bigint, ch bigint, i int, x double, y double")
    contours, nodes, edges = engine.build(points)
    rows = lambda: sorted((r.g, r.e, round(r.prob, 9)) for r in engine.seeded_scorer(nodes, edges, contours).collect())
    groups = lambda: sorted(map(tuple, model.merged_groups(nodes, edges, graph.contour_features(contours), [0.4, 0.6]).collect()))
    one = rows(), groups()
    monkeypatch.setattr(buckets, "ROWS", 100)
    assert (rows(), groups()) == one and one[0] and len(one[1]) == 2 * 6 * 4


def test_pool_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# header comment\n\nABC\n# more\n　123 \n")
    lines = readers.list_file(spark, str(tmp_path / "list.txt")).withColumn("order", F.monotonically_increasing_id())
    assert [r.ch for r in generate.charset(lines, "order").orderBy("pos").collect()] == list("ABC123")
    (tmp_path / "none.txt").write_text("# only\n")
    with pytest.raises(ValueError):
        generate.charset(readers.list_file(spark, str(tmp_path / "none.txt")).withColumn("order", F.lit(1)), "order")
    for name, head in {"b.TTF": b"\0\1\0\0", "a.otf": b"OTTO", "c.ttc": b"junk", "d.txt": b"\0\1\0\0"}.items():
        (tmp_path / name).write_bytes(head + b"rest")
    assert [(r.name, r.valid) for r in readers.binary_pool(spark, str(tmp_path)).collect()] == [("a.otf", True), ("b.TTF", True), ("c.ttc", False)]


def test_binary_pool_of_folders_and_of_a_store_that_only_spark_reads(spark, tmp_path):
    spark.range(9).repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    (tmp_path / "broken.parquet").mkdir()
    (tmp_path / "broken.parquet" / "part-0.parquet").write_bytes(b"PAR1....")
    (tmp_path / "broken.parquet" / "part-1.parquet").write_bytes(b"else")
    (tmp_path / "one.parquet").write_bytes(b"PAR1")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "inner.parquet").write_bytes(b"PAR1")
    want = [("broken.parquet", False, "unknown"), ("many.parquet", True, None), ("one.parquet", True, None)]
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.pools.link./in", f"file://{tmp_path}")
    for folder in (str(tmp_path), f"file://{tmp_path}/", "viewfs://pools/in"):
        assert [(r.name, r.valid, r.reason) for r in readers.binary_pool(spark, folder, ("parquet",), ("50415231",)).collect()] == want, folder


def packed(x):
    """A minimal MessagePack writer for the test."""
    import struct

    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        return struct.pack(">B", x) if 0 <= x < 128 else b"\xd3" + struct.pack(">q", x)
    if isinstance(x, float):
        return b"\xca" + struct.pack(">f", x)
    if isinstance(x, str):
        raw = x.encode()
        return b"\xd9" + bytes([len(raw)]) + raw
    if isinstance(x, list):
        return b"\xdc" + struct.pack(">H", len(x)) + b"".join(map(packed, x))
    return bytes([0x80 | len(x)]) + b"".join(packed(k) + packed(v) for k, v in x.items())


def test_shards(spark, tmp_path):
    record = {"text": "Ag", "num_nodes": 2, "node_dim": 1, "num_edges": 1, "num_contours": 1, "node_features": [0.5, 1.5], "edge_index": [0, 1], "edge_features": [0.0], "contour_features": [1.0], "edge_labels": [1], "node_char_ids": [4294967295, 0], "node_contour_ids": [0, 0]}
    for k in range(3):
        (tmp_path / f"shard_{k:05}.msgpack").write_bytes(packed([record, record | {"font": f"f{k}"}]))
    rows = shards.read(spark, str(tmp_path), limit=2).collect()
    assert len(rows) == 4 and rows[0].text == "Ag" and rows[0].font == "" and rows[0].node_features == [0.5, 1.5] and rows[0].node_char_ids[0] == 4294967295
    with pytest.raises(ValueError):
        (tmp_path / "none").mkdir()
        shards.read(spark, str(tmp_path / "none"))


def test_weights_round_trip():
    raw = readers.write_weights({"contours": True}, {"a": np.arange(6.0).reshape(2, 3), "b": np.arange(3.0), "c": np.ones((2, 2, 2))})
    options, tensors = readers.read_weights(raw)
    assert readers.option(options, "contours") and not readers.option(options, "absent")
    assert tensors["a"].shape == (2, 3) and tensors["b"].shape == (1, 3) and tensors["c"].shape == (1, 8)
    for bad in (b"XXXX" + raw[4:], raw[:4] + b"\2" + raw[5:], raw[:-8]):
        with pytest.raises(ValueError):
            readers.read_weights(bad)


def test_store(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 0, 0), (1500, 0, 0, 70000)], "g bigint, n bigint, c bigint, ch bigint")
    edges = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 5)], "g bigint, e bigint, src bigint, dst bigint")
    contours = spark.createDataFrame([(0, 0)], "g bigint, c bigint")
    assert store.validate(nodes, edges, contours).first().asDict() == {"wide_nodes": 0, "wide_contours": 0, "wide_chars": 1, "lost_ends": 1, "bare_contours": 1, "self_edges": 0}
    with pytest.raises(ValueError):
        store.checked(nodes, edges, contours)
    with pytest.raises(ValueError):
        store.check_version(3)
    store.write({"nodes": nodes}, str(tmp_path))
    assert store.read(spark, str(tmp_path), "nodes").count() == 3 and store.read(spark, str(tmp_path), "nodes", shards=1).count() == 2


def test_batches_and_splits(spark):
    rows = spark.createDataFrame([(i, w) for i, w in enumerate([5, 5, 30, 1, 1, 1, 1])], "id bigint, w bigint")
    got = split.edge_budget_batches(rows, "id", "w", 10, 3, lanes=1).orderBy("id").collect()
    assert [r.batch for r in got] == [0, 0, 1, 2, 2, 2, 3]
    one = spark.createDataFrame([("a",), ("a",)], "font string")
    assert {r.part for r in split.holdout_by_group(one, "font").collect()} == {"train"}
    two = spark.createDataFrame([("a",), ("b",)], "font string")
    assert sorted(r.part for r in split.holdout_by_group(two, "font", share=0.0).collect()) == ["train", "val"]
    many = spark.range(1000).withColumnRenamed("id", "k")
    assert split.random_split(many, "k", share=0.13).where("part = 'val'").count() == 130
    a, b = (split.epoch_order(many, "k", 1, e).orderBy("place").select("k").collect() for e in (0, 1))
    assert a != b and sorted(a) == sorted(b)


def test_generation(spark):
    rows = spark.range(600).withColumn("pattern", F.element_at(F.array(F.lit("ab"), F.lit("c"), F.lit("longer pattern here")), (F.col("id") % 3 + 1).cast("int")))
    for r in generate.embed_pattern(rows, "id", "pattern", list("xyz")).collect():
        assert r.pattern in r.text and (2 <= len(r.text) <= 12 or len(r.text) == len(r.pattern) > 12)
    texts = generate.random_text(spark.range(2000), "id", list("pq"))
    assert texts.repartition(7).orderBy("id").collect() == texts.orderBy("id").collect()
    sizes = [len(r.text) for r in texts.collect()]
    assert min(sizes) == 2 and max(sizes) == 12
    u = [r.u for r in spark.range(4000).select(generate.draw(1, F.col("id"), "t").alias("u")).collect()]
    assert all(0.2 < np.mean([q / 4 <= x < (q + 1) / 4 for x in u]) < 0.3 for q in range(4))
    fonts = generate.pool_choice(spark.range(2000), "id", ["a"], ["d"]).groupBy("font").count().collect()
    assert 0.25 < {r.font: r["count"] for r in fonts}["d"] / 2000 < 0.35
    assert generate.text_source(None, None, 0.3) == "charset" and generate.text_source("c", "t", 1.0) == "fixed" and generate.text_source("c", "t", 0.5) == "mixed"
    with pytest.raises(ValueError):
        generate.check_bounds(aspect=(1.0, 0.5))
    same = spark.createDataFrame([(0.3,)], "u double").select(generate.skewed(F.col("u"), F.lit(-0.1), F.lit(-0.1), 1.0).alias("t")).first().t
    assert same == -0.1


def test_streamed_pairs_equal_batch(spark, tmp_path):
    rows = [(g, i % 4, (i * 7) % 4, (i * 37 % 100) / 100, i % 3 == 0) for g in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, "g bigint, ca bigint, cb bigint, prob double, label boolean")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streamed_pairs(stream).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: tuple(r)
    assert sorted(map(key, spark.table("pairs").collect())) == sorted(map(key, decode.pair_max(df).collect()))


def test_windows_drop_what_is_late(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", True), ("2024-01-01 00:00:50", False), ("2024-01-01 00:02:30", True)]
    schema = "ts timestamp, label boolean"
    for k, part in enumerate([rows, [("2024-01-01 00:10:00", True)], [("2024-01-01 00:00:20", True), ("2024-01-01 00:10:30", False)]]):
        spark.createDataFrame(part, "ts string, label boolean").selectExpr("cast(ts as timestamp) ts", "label").coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    frame = spark.read.schema(schema).parquet(str(tmp_path / "in"))
    assert sorted((str(r.start), r.edges, r.positives) for r in windowed(frame, "ts", "1 minute", "1 minute").collect())[0] == ("2024-01-01 00:00:00", 3, 2)
    source = tmp_path / "stream"
    source.mkdir()
    stream = windowed(spark.readStream.schema(schema).parquet(str(source)), "ts", "1 minute", "1 minute").writeStream.outputMode("update").format("memory").queryName("windows").start()
    for k in range(3):
        for f in (tmp_path / "in" / f"k={k}").glob("*.parquet"):
            f.rename(source / f"{k}.parquet")
        stream.processAllAvailable()
    stream.stop()
    last = {str(r.start): (r.edges, r.positives) for r in spark.table("windows").collect()}
    assert last["2024-01-01 00:00:00"] == (2, 1) and last["2024-01-01 00:10:00"] == (2, 1)


def test_every_kind_of_curve(spark):
    rows = [(0, 0, "m", 0, 0, 0, 0), (0, 1, "l", 0, 0, 1, 0), (0, 2, "q", 1, 0, 1, 1), (0, 3, "m", 0, 0, 5, 5), (0, 4, "c", 5, 5, 6, 5)]
    curves = spark.createDataFrame([(g, i, k, float(a), float(b), float(c), float(d), 2.0, 2.0, 3.0, 3.0) for g, i, k, a, b, c, d in rows], "g int, i int, kind string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double")
    got = {}
    for r in geometry.flatten_curves(curves, ["g"]).orderBy("i", "s").collect():
        got.setdefault((r.contour, r.i), []).append((r.x, r.y))
    assert got[0, 0] == [(0, 0)] and got[0, 1] == [(1, 0)] and got[1, 3] == [(5, 5)] and len(got[0, 2]) == len(got[1, 4]) == 8
    assert got[0, 2][3] == pytest.approx((0.25 * 1 + 0.5 * 1 + 0.25 * 2, 0.5 * 1 + 0.25 * 2)) and got[0, 2][7] == (2, 2)
    assert got[1, 4][3] == pytest.approx((5 / 8 + 18 / 8 + 6 / 8 + 3 / 8, 5 / 8 + 15 / 8 + 6 / 8 + 3 / 8)) and got[1, 4][7] == (3, 3)
