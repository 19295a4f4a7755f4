"""Nearest points, closest pairs and spanning forests against plain searches."""

import numpy as np
import pytest
from contourflow.operators import decode, graph, near
from pyspark.sql import functions as F


def slow_nearest(g, x, y, k, radius):
    out = []
    for i in range(len(g)):
        d2 = [((x[i] - x[j]) * (x[i] - x[j]) + (y[i] - y[j]) * (y[i] - y[j]), j) for j in range(len(g)) if j != i and g[i] == g[j]]
        out += [(i, j, d) for d, j in sorted(t for t in d2 if t[0] <= radius * radius)[:k]]
    return sorted(out)


def crowds(seed, n=300):
    """Points of three graphs: spread, in a crowd far smaller than any radius, at one place, and on a lattice of ties."""
    draw = np.random.default_rng(seed)
    x, y = draw.uniform(-2, 2, (2, n))
    x[: n // 3], y[: n // 3] = 0.5 + draw.uniform(0, 1e-4, (2, n // 3))
    x[n // 3 : n // 2], y[n // 3 : n // 2] = 1.25, -0.5
    x[n // 2 : 2 * n // 3], y[n // 2 : 2 * n // 3] = np.arange(n // 6) % 8 * 0.125, np.arange(n // 6) // 8 * 0.125
    return np.sort(draw.integers(0, 3, n)), x, y


@pytest.mark.parametrize(("k", "radius"), [(8, 0.25), (1, 0.125), (3, 10.0), (60, 0.3), (4, 0.0), (0, 1.0)])
def test_nearest_equals_a_plain_search(k, radius):
    g, x, y = crowds(k)
    x[7], y[11], x[200] = np.nan, np.inf, 1e12
    with np.errstate(invalid="ignore"):
        want = slow_nearest(g, x, y, k, radius)
    i, j, d2 = near.nearest(g, x, y, k, radius)
    assert sorted(zip(i.tolist(), j.tolist(), d2.tolist(), strict=True)) == want
    assert [len(v) for v in near.nearest(g[:0], x[:0], y[:0], 4, 1.0)] == [0, 0, 0]


def test_a_crowd_is_searched_in_small_cells(monkeypatch):
    met = []
    around = near.Grid.around

    def counted(self, some, among):
        for i, j in around(self, some, among):
            met.append(len(i))
            yield i, j

    monkeypatch.setattr(near.Grid, "around", counted)
    draw = np.random.default_rng(1)
    n = 20_000
    x, y = draw.uniform(0, 0.2, (2, n))  # all within one cell of the radius
    i, j, _ = near.nearest(np.zeros(n, np.int64), x, y, 8, 0.25)
    assert len(i) == 8 * n and sum(met) < 200 * n
    met.clear()
    i, j, _ = near.nearest(np.zeros(n, np.int64), np.full(n, 0.5), y * 0, 8, 0.25)
    assert len(i) == 8 * n and sum(met) < 20 * n and set(j.tolist()) == set(range(9))


def test_closest_equals_the_matrix_and_measures_less():
    draw = np.random.default_rng(2)
    sizes = [1, 3, 8, 9, 64, 200, 64, 2]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    t = np.concatenate([np.linspace(0, 2 * np.pi, s) for s in sizes])
    who = np.repeat(np.arange(len(sizes)), sizes)
    x, y = np.round(np.cos(t) + 3 * who, 3), np.round(np.sin(t) + draw.normal(0, 0.01, len(t)), 2)
    x[5], y[20] = np.nan, np.inf
    one, two = np.triu_indices(len(sizes), 1)
    d2, i, j, measured = near.closest(x, y, starts, ends, one, two)
    for p, (a, b) in enumerate(zip(one, two, strict=True)):
        with np.errstate(invalid="ignore"):
            every = sorted((v, m, n) for m in range(starts[a], ends[a]) for n in range(starts[b], ends[b]) if np.isfinite(v := (x[m] - x[n]) * (x[m] - x[n]) + (y[m] - y[n]) * (y[m] - y[n])))
        assert (d2[p], i[p], j[p]) == every[0]
    assert measured < 0.3 * sum(sizes[a] * sizes[b] for a, b in zip(one, two, strict=True))
    assert len(near.closest(x, y, starts, ends, one[:0], two[:0])[0]) == 0


def test_boxes_that_are_near_or_stacked():
    draw = np.random.default_rng(3)
    low = draw.uniform(0, 6, (2, 80))
    high = low + draw.uniform(0, 0.5, (2, 80))
    for bridge, stack in ((0.35, 1.0), (0.0, 0.5), (0.2, 0.0)):
        got = set(zip(*(v.tolist() for v in near.box_pairs(*low, *high, bridge, stack, 1e-7)), strict=True))
        want = set()
        for a in range(80):
            for b in range(a + 1, 80):
                gap = [max(low[k][b] - high[k][a], low[k][a] - high[k][b], 0) for k in (0, 1)]
                stacked = stack > 0 and min(high[0][a], high[0][b]) - max(low[0][a], low[0][b]) >= 0.5 * max(min(high[0][a] - low[0][a], high[0][b] - low[0][b]), 1e-7) and gap[1] <= stack
                if stacked or (bridge > 0 and gap[0] ** 2 + gap[1] ** 2 <= bridge**2):
                    want.add((a, b, stacked))
        assert got == want and got


def test_edges_in_one_pass_equal_the_joins(spark):
    g, x, y = crowds(4, 240)
    rows = [(int(g[i]), int(i), int(i) // 12, None if i % 36 < 12 else int(i) // 24, float(x[i]), float(y[i])) for i in range(240)]
    nodes = spark.createDataFrame(rows, "g bigint, n bigint, c bigint, ch bigint, x double, y double").repartition(4)
    boxes = nodes.groupBy("g", "c").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
    for options in ({}, {"bridge": 0.0, "stack": 0.0}, {"k": 3, "radius": 0.05, "stack": 0.0}, {"bridge": 0.0}):
        edges = graph.graph_edges(nodes, boxes, **options)
        plain = graph.undirected(graph.neighbours_by_cells(nodes, options.get("k", graph.KNN), options.get("radius", graph.RADIUS)))
        pairs = graph.closest_pairs(nodes).join(graph.stacked_pairs(boxes, options.get("stack", graph.STACK_BRIDGE)).withColumn("stacked", F.lit(True)), ["g", "ca", "cb"], "left")
        bridge = options.get("bridge", graph.CONTOUR_BRIDGE)
        pairs = pairs.where(F.col("stacked") | (F.lit(bridge > 0) & (F.col("d2") <= bridge * bridge))).select("g", F.least("a", "b"), F.greatest("a", "b"))
        assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, plain.union(pairs).distinct().collect()))
        want = graph.edge_features(graph.directed(edges), nodes)
        assert sorted(map(tuple, graph.built_edges(nodes, boxes, **options).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    few = graph.closest_pairs(nodes, graph.stacked_pairs(boxes)).collect()
    every = {(r.g, r.ca, r.cb): r for r in graph.closest_pairs(nodes).collect()}
    assert few and all(every[r.g, r.ca, r.cb] == r for r in few)
    assert graph.built_edges(nodes.limit(0), boxes.limit(0)).count() == 0


def test_forest_groups_equal_those_of_all_pairs(spark):
    draw = np.random.default_rng(5)
    rows = []
    for g, n in ((0, 60), (1, 25), (2, 3)):
        for _ in range(4 * n):
            a, b = draw.integers(0, n, 2).tolist()
            rows.append((g, a, b, float(draw.integers(0, 21)) / 20))
    rows += [(3, i, i + 1, 0.5) for i in range(40)] + [(4, 0, 1, None), (4, 1, 1, 0.9)]
    pairs = spark.createDataFrame(rows, "g bigint, ca bigint, cb bigint, prob double").repartition(3)
    contours = spark.createDataFrame([(g, c) for g, n in ((0, 62), (1, 25), (2, 3), (3, 41), (4, 2)) for c in range(n)], "g bigint, c bigint")
    thresholds = [0.1, 0.35, 0.5, 0.7, 0.9, 1.0]
    forest = decode.spanning_forest(pairs).collect()
    whole = decode.char_groups(pairs.where("prob >= 0"), contours, [0.0])
    assert len(forest) == contours.count() - whole.select("g", "grp").distinct().count()
    got = decode.char_groups_by_forest(pairs, contours, thresholds)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, decode.char_groups(pairs.where("prob is not null"), contours, thresholds).collect()))
    assert decode.char_groups_by_forest(pairs, contours, []).count() == 0 and decode.spanning_forest(pairs.limit(0)).count() == 0
