"""Building a graph over the points of each line: neighbours, bridges between contours, edge and node features."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near
from .buckets import dealt, dealt_alone
from .geometry import EPSILON, FEWEST, LEAST_POINTS, MOST, SPACING, falls_within, sample_count, sample_range, sampled, with_next

KNN, RADIUS, CONTOUR_BRIDGE, STACK_BRIDGE = 8, 0.25, 0.35, 1.0


def _two(nodes: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    a = nodes.select("g", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = nodes.select("g", *[F.col(c).alias(f"{c}_b") for c in columns])
    return a, b


def _d2():
    return (F.col("x_a") - F.col("x_b")) ** 2 + (F.col("y_a") - F.col("y_b")) ** 2


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy(zero_copy_only=False) for c in names]


def neighbours(nodes: DataFrame, k: int = KNN, radius: float = RADIUS) -> DataFrame:
    """(g, a, b, d2): of each node a the k nearest others within radius, inclusive, ties to smaller b.

    Graphs are dealt whole, many to a task, and searched there by a grid that is finer where nodes are dense (near.nearest).
    """

    def run(table: pa.Table) -> pa.Table:
        g, n, x, y = _columns(table, "g", "n", "x", "y")
        order = np.lexsort([n, g])
        g, n = g[order], n[order]
        i, j, d2 = near.nearest(g, x[order], y[order], k, radius)
        return pa.table({"g": g[i], "a": n[i], "b": n[j], "d2": d2})

    own = nodes.select(F.col("g").cast("bigint").alias("g"), F.col("n").cast("bigint").alias("n"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return dealt_alone(own, run, "g bigint, a bigint, b bigint, d2 double")


def neighbours_by_cells(nodes: DataFrame, k: int = KNN, radius: float = RADIUS) -> DataFrame:
    """As neighbours, for graphs too large for a task.

    Nodes meet only those of their own and the eight surrounding cells of a grid of side radius: a join on graph and
    cell with the distance as residual, then a limited window.
    """
    side = F.lit(radius if radius > 0 else 1.0)
    cell = nodes.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    a = cell.select("g", F.col("n").alias("n_a"), F.col("x").alias("x_a"), F.col("y").alias("y_a"), "cx", "cy")
    b = cell.select("g", F.col("n").alias("n_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"), F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    b = b.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    rows = a.join(b, ["g", "cx", "cy"]).where(F.col("n_a") != F.col("n_b")).withColumn("d2", _d2()).where(F.col("d2") <= radius * radius)
    return _nearest(rows, k)


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("g", "n_a").orderBy("d2", "n_b")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("g", F.col("n_a").alias("a"), F.col("n_b").alias("b"), "d2")


def neighbours_all_pairs(nodes: DataFrame, k: int = KNN, radius: float = RADIUS) -> DataFrame:
    """As neighbours, by meeting all nodes of a graph: for small graphs whose nodes all lie within radius."""
    a, b = _two(nodes, ["n", "x", "y"])
    rows = a.join(b, "g").where(F.col("n_a") != F.col("n_b")).withColumn("d2", _d2()).where(F.col("d2") <= radius * radius)
    return _nearest(rows, k)


def undirected(pairs: DataFrame) -> DataFrame:
    """(g, a, b) with a < b, each once."""
    return pairs.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def closest_pairs(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(g, ca, cb, d2, a, b): the closest nodes of each two contours of a line, ties to smaller a, then b.

    wanted: (g, ca, cb) with ca < cb, the only pairs sought; without, all of each line. Boxes of blocks of nodes bound
    distances, so that most are never measured (near.closest).
    """

    def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
        g, n, c, x, y, lines, ids, starts, ends = _by_contour(left)
        if right is None:
            bounds = np.flatnonzero(np.concatenate([[True], lines[1:] != lines[:-1], [True]])) if len(lines) else np.zeros(1, np.int64)
            one, two = near.expanded(np.arange(len(lines)) + 1, np.repeat(bounds[1:], np.diff(bounds)))
        else:
            line, ca, cb = _columns(right, "g", "ca", "cb")
            one, two = (_place(lines, ids, line, v) for v in (ca, cb))
            known = (one >= 0) & (two >= 0)
            one, two = one[known], two[known]
        d2, i, j, _ = near.closest(x, y, starts, ends, one, two)
        some = np.flatnonzero(np.isfinite(d2))
        one, two, i, j = one[some], two[some], i[some], j[some]
        return pa.table({"g": lines[one], "ca": ids[one], "cb": ids[two], "d2": d2[some], "a": n[i], "b": n[j]})

    schema, own = "g bigint, ca bigint, cb bigint, d2 double, a bigint, b bigint", _points(nodes)
    if wanted is None:
        return dealt_alone(own, run, schema)
    return dealt(own, wanted.select(*[F.col(k).cast("bigint").alias(k) for k in ("g", "ca", "cb")]), run, schema, nodes.count())


def _points(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(k).cast("bigint").alias(k) for k in ("g", "n", "c")], *[F.col(k).cast("double").alias(k) for k in ("x", "y")])


def _by_contour(nodes: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes in order of graph, contour and number; then the graph and id of each contour, and where its nodes are."""
    g, n, c, x, y = _columns(nodes, "g", "n", "c", "x", "y")
    order = np.lexsort([n, c, g])
    g, n, c, x, y = (v[order] for v in (g, n, c, x, y))
    starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])) if len(g) else np.empty(0, np.int64)
    return g, n, c, x, y, g[starts], c[starts], starts, np.append(starts[1:], len(g)) if len(g) else starts


def _place(lines: np.ndarray, ids: np.ndarray, line: np.ndarray, contour: np.ndarray) -> np.ndarray:
    """Where each (line, contour) is among sorted (lines, ids); -1 where it isn't."""
    if not len(lines) or not len(line):
        return np.full(len(line), -1)
    known, at = np.unique(np.concatenate([np.stack([lines, ids], axis=1), np.stack([line, contour], axis=1)]), axis=0, return_inverse=True)
    places = np.full(len(known), -1)
    places[at.ravel()[: len(lines)]] = np.arange(len(lines))
    return places[at.ravel()[len(lines) :]]


def stacked_pairs(contours: DataFrame, limit: float = STACK_BRIDGE) -> DataFrame:
    """(g, ca, cb, overlap, gap): pairs whose boxes overlap in x by half the narrower and are at most limit apart in y."""
    a, b = _two(contours, ["c", "min_x", "min_y", "max_x", "max_y"])
    overlap = F.least("max_x_a", "max_x_b") - F.greatest("min_x_a", "min_x_b")
    narrow = F.greatest(F.least(F.col("max_x_a") - F.col("min_x_a"), F.col("max_x_b") - F.col("min_x_b")), F.lit(EPSILON))
    gap = F.greatest(F.col("min_y_b") - F.col("max_y_a"), F.col("min_y_a") - F.col("max_y_b"), F.lit(0.0))
    rows = a.join(b, "g").where(F.col("c_a") < F.col("c_b")).withColumn("overlap", overlap).withColumn("gap", gap).withColumn("narrow", narrow)
    rows = rows.where((F.col("overlap") >= 0.5 * F.col("narrow")) & (F.col("gap") <= limit) & F.lit(limit > 0))
    return rows.select("g", F.col("c_a").alias("ca"), F.col("c_b").alias("cb"), "overlap", "gap")


def _undirected(nodes: pa.Table, contours: pa.Table, k: int, radius: float, bridge: float, stack: float):
    """The nodes of a bucket by contour, and the places (i, j) of its edges, in order of graph and ends."""
    g, n, c, x, y, lines, ids, starts, ends = _by_contour(nodes)
    order = np.lexsort([n, g])
    i, j, _ = near.nearest(g[order], x[order], y[order], k, radius)
    sides = [(order[i], order[j])]
    if bridge > 0 or stack > 0:
        line, cid, *box = _columns(contours, "g", "c", "min_x", "min_y", "max_x", "max_y")
        at = _place(lines, ids, line, cid)
        for own in (np.flatnonzero((line == one) & (at >= 0)) for one in np.unique(line)):
            own = own[np.argsort(cid[own])]
            one, two, stacked = near.box_pairs(*[b[own] for b in box], bridge, stack, EPSILON)
            d2, i, j, _ = near.closest(x, y, starts, ends, at[own[one]], at[own[two]])
            kept = np.isfinite(d2) & (stacked | (d2 <= bridge * bridge if bridge > 0 else False))
            sides.append((i[kept], j[kept]))
    i, j = (np.concatenate([s[m] for s in sides]) for m in (0, 1))
    less = n[i] < n[j]
    i, j = np.where(less, i, j), np.where(less, j, i)
    order = np.lexsort([n[j], n[i], g[i]])
    i, j = i[order], j[order]
    once = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.empty(0, bool)
    return g, n, c, x, y, i[once], j[once]


def _boxes(contours: DataFrame) -> DataFrame:
    return contours.select(*[F.col(k).cast("bigint").alias(k) for k in ("g", "c")], "min_x", "min_y", "max_x", "max_y")


def graph_edges(nodes: DataFrame, contours: DataFrame, k: int = KNN, radius: float = RADIUS, bridge: float = CONTOUR_BRIDGE, stack: float = STACK_BRIDGE) -> DataFrame:
    """(g, a, b): neighbours, and one bridge for each two contours that are near or stacked; a set. Graphs are dealt once, and
    neighbours and bridges found together."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g, n, *_, i, j = _undirected(left, right, k, radius, bridge, stack)
        return pa.table({"g": g[i], "a": n[i], "b": n[j]})

    return dealt(_points(nodes), _boxes(contours), run, "g bigint, a bigint, b bigint", nodes.count())


def _known_points(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[F.col(m).cast("bigint").alias(m) for m in ("g", "n", "c", "ch")], *[F.col(m).cast("double").alias(m) for m in ("x", "y")])


def both_ways(left: pa.Table, right: pa.Table, k: int, radius: float, bridge: float, stack: float):
    """The nodes of a bucket, and of its edges both ways, in order, the places (i, j), where their graph's first one stands, dx,
    dy and label."""
    g, n, c, x, y, i, j = _undirected(left, right, k, radius, bridge, stack)
    ch = left.column("ch").to_numpy(zero_copy_only=False).astype(np.float64)[np.lexsort(_columns(left, "n", "c", "g"))]  # null is no number
    i, j = np.stack([i, j], axis=1).ravel(), np.stack([j, i], axis=1).ravel()
    line = g[i]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], line[1:] != line[:-1]]), np.arange(len(line)), 0)) if len(line) else line
    return g, n, c, i, j, first, x[j] - x[i], y[j] - y[i], ch[i] == ch[j]


def built_edges(nodes: DataFrame, contours: DataFrame, k: int = KNN, radius: float = RADIUS, bridge: float = CONTOUR_BRIDGE, stack: float = STACK_BRIDGE) -> DataFrame:
    """edge_features of directed of graph_edges, in the one pass that finds the edges: (g, e, src, dst, ca, cb, dx, dy, dist,
    same, label)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g, n, c, i, j, first, dx, dy, label = both_ways(left, right, k, radius, bridge, stack)
        return pa.table({"g": g[i], "e": np.arange(len(i)) - first, "src": n[i], "dst": n[j], "ca": c[i], "cb": c[j], "dx": dx, "dy": dy, "dist": np.sqrt(dx * dx + dy * dy), "same": c[i] == c[j], "label": label})

    return dealt(_known_points(nodes), _boxes(contours), run, "g bigint, e bigint, src bigint, dst bigint, ca bigint, cb bigint, dx double, dy double, dist double, same boolean, label boolean", nodes.count())


def built_lists(nodes: DataFrame, contours: DataFrame, k: int = KNN, radius: float = RADIUS, bridge: float = CONTOUR_BRIDGE, stack: float = STACK_BRIDGE) -> DataFrame:
    """built_edges as records list them, a row for each graph that has edges: (g, edge_index, edge_features, edge_labels).

    edge_index has all sources, then all ends, as places in the order of n; edge_features dx, dy, dist, same of each edge. A
    bucket has its graphs whole, so their edges needn't be sent on one by one to be listed. n is unique within a graph.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return edge_lists(left, right, k, radius, bridge, stack)

    return dealt(_known_points(nodes), _boxes(contours), run, "g bigint, edge_index array<int>, edge_features array<float>, edge_labels array<smallint>", nodes.count())


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """values as lists of so many each."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def edge_lists(nodes: pa.Table, contours: pa.Table, k: int, radius: float, bridge: float, stack: float) -> pa.Table:
    """built_lists of the graphs of a bucket, in order of g."""
    g, n, c, i, j, first, dx, dy, label = both_ways(nodes, contours, k, radius, bridge, stack)
    order, place = np.lexsort([n, g]), np.empty(len(g), np.int64)
    place[order] = np.arange(len(g)) - np.searchsorted(g, g)  # g is in order
    starts = np.unique(first)
    sizes = np.diff(np.append(starts, len(i)))
    at = np.arange(len(i)) + first
    ends = np.empty(2 * len(i), np.int32)
    ends[at], ends[at + np.repeat(sizes, sizes)] = place[i], place[j]
    f = np.stack([dx, dy, np.sqrt(dx * dx + dy * dy), c[i] == c[j]], axis=1).astype(np.float32)
    return pa.table({"g": g[i[starts]], "edge_index": lists(ends, 2 * sizes), "edge_features": lists(f.ravel(), 4 * sizes), "edge_labels": lists(label.astype(np.int16), sizes)})


def directed(edges: DataFrame) -> DataFrame:
    """(g, e, src, dst): each edge both ways, numbered in order of the undirected edge, the way from a first."""
    both = edges.select("g", "a", "b", F.explode(F.array(F.lit(0), F.lit(1))).alias("way"))
    w = Window.partitionBy("g").orderBy("a", "b", "way")
    return both.select("g", (F.row_number().over(w) - 1).cast("bigint").alias("e"), F.when(F.col("way") == 0, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(F.col("way") == 0, F.col("b")).otherwise(F.col("a")).alias("dst"))


def edge_features(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ca, cb, dx, dy, dist, same (one contour) and label (one known character)."""
    s = nodes.select("g", F.col("n").alias("src"), F.col("c").alias("ca"), F.col("ch").alias("ch_a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    d = nodes.select("g", F.col("n").alias("dst"), F.col("c").alias("cb"), F.col("ch").alias("ch_b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    rows = edges.join(s, ["g", "src"]).join(d, ["g", "dst"])
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    return rows.select("g", "e", "src", "dst", "ca", "cb", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("dist"), (F.col("ca") == F.col("cb")).alias("same"), F.coalesce(F.col("ch_a") == F.col("ch_b"), F.lit(False)).alias("label"))


def normalized(contours: DataFrame) -> DataFrame:
    """Boxes and centres moved so that the leftmost of each line is at 0; y stays."""
    left = F.coalesce(F.min("min_x").over(Window.partitionBy("g")), F.lit(0.0))
    return contours.withColumn("left", left).withColumn("cx", F.col("cx") - F.col("left")).withColumn("min_x", F.col("min_x") - F.col("left")).withColumn("max_x", F.col("max_x") - F.col("left"))


def dense_contours(contours: DataFrame) -> DataFrame:
    """Contours of three points and some length, with new ids from 0 in the order of the old ones."""
    kept = contours.where((F.col("n") >= 3) & (F.col("arc") > EPSILON))
    return kept.withColumn("new_c", (F.row_number().over(Window.partitionBy("g").orderBy("c")) - 1).cast("bigint"))


def node_features(samples: DataFrame, contours: DataFrame) -> DataFrame:
    """The 13 features of each sampled point, x counted from the leftmost contour of its line."""
    moved = normalized(contours).select("g", "c", "left", "cx", "cy", (F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h"), "arc")
    rows = samples.join(moved, ["g", "c"]).withColumn("x", F.col("x") - F.col("left"))
    number = F.row_number().over(Window.partitionBy("g").orderBy("c", "k")) - 1
    return rows.select("g", number.cast("bigint").alias("n"), "c", "x", "y", F.col("tx").alias("tan_x"), F.col("ty").alias("tan_y"), (F.col("x") - F.col("cx")).alias("off_x"), (F.col("y") - F.col("cy")).alias("off_y"), "cx", "cy", "w", "h", "arc", F.cos(2 * math.pi * F.col("t")).alias("cos_phase"), F.sin(2 * math.pi * F.col("t")).alias("sin_phase"))


def outline_samples(points: DataFrame, line: list[str], spacing: float = SPACING, fewest: int = FEWEST, most: int = MOST) -> DataFrame:
    """What dense_contours, resample, node_features and contour_features give of outlines (line, c, ch, i, x, y), in one table: a
    row for each contour, whose k is null, and one for each of its nodes, in order of c and k. Beside line, c, ch and k there are the
    features of nodes, and min_x, min_y, max_x, max_y and area of the contour, counted from the leftmost one.

    There are windows by line alone, or by line and contour, and no joins: rows that are dealt by some of line stay where they are.
    """
    keys = [*line, "c"]
    w = Window.partitionBy(*keys).orderBy("i")
    whole, so_far = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
    step = F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2)
    rows = with_next(points, keys).withColumn("len", step).withColumn("cross", F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))
    rows = rows.select(
        *keys, "i", "x", "y", "nx", "ny", "len", F.min("ch").over(whole).alias("ch"), F.count("*").over(whole).alias("m"), F.sum("len").over(whole).alias("arc"), (F.sum("cross").over(whole) / 2).alias("area"),
        F.avg("x").over(whole).alias("cx"), F.avg("y").over(whole).alias("cy"), *[f("x" if c == "x" else "y").over(whole).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max)) for c in "xy"],
        F.sum("len").over(so_far).alias("hi"), F.row_number().over(w).alias("at"),
    )
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0))).where((F.col("m") >= LEAST_POINTS) & (F.col("arc") > EPSILON))
    left = F.coalesce(F.min("min_x").over(Window.partitionBy(*line)), F.lit(0.0))
    rows = rows.withColumn("left", left).withColumn("c", (F.dense_rank().over(Window.partitionBy(*line).orderBy("c")) - 1).cast("bigint"))
    rows = rows.withColumns({c: F.col(c) - F.col("left") for c in ("cx", "min_x", "max_x")})
    rows = rows.withColumn("count", sample_count(F.col("arc"), spacing, fewest, most)).withColumn("last", F.col("at") == F.col("m"))
    own = F.when(F.col("hi") > F.col("lo"), sample_range(F.col("arc"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("*", F.explode(F.when(F.col("at") == 1, F.concat(F.array(F.lit(None).cast("bigint")), own)).otherwise(own)).alias("k"))
    rows = rows.withColumn("target", F.col("k") * F.col("arc") / F.col("count")).where(F.col("k").isNull() | falls_within())
    x, y, tan_x, tan_y = sampled()
    x, t = x - F.col("left"), F.col("target") / F.col("arc")
    return rows.select(
        *keys, "ch", "k", x.alias("x"), y.alias("y"), tan_x.alias("tan_x"), tan_y.alias("tan_y"), (x - F.col("cx")).alias("off_x"), (y - F.col("cy")).alias("off_y"), "cx", "cy", (F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h"),
        "arc", F.cos(2 * math.pi * t).alias("cos_phase"), F.sin(2 * math.pi * t).alias("sin_phase"), "min_x", "min_y", "max_x", "max_y", "area",
    )


def numbered_nodes(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The nodes, with n, and contours of a bucket of outline_samples, in order of graph, contour and k."""
    rows = rows.sort_by([(c, "ascending") for c in ("g", "c", "k")])
    nodes = rows.filter(pc.is_valid(rows.column("k")))
    g = nodes.column("g").to_numpy()
    return nodes.append_column("n", pa.array(np.arange(len(g)) - np.searchsorted(g, g))), rows.filter(pc.is_null(rows.column("k")))


def contour_features(contours: DataFrame) -> DataFrame:
    """The 8 features of each contour."""
    return normalized(contours).select("g", "c", "cx", "cy", (F.col("max_x") - F.col("min_x")).alias("w"), (F.col("max_y") - F.col("min_y")).alias("h"), "min_x", "min_y", "arc", "area")


def contour_relations(features: DataFrame) -> DataFrame:
    """11 relations of each ordered two contours of a line, a contour with itself included."""
    a, b = _two(features, ["c", "cx", "cy", "w", "h", "min_x", "min_y", "arc", "area"])
    r = a.join(b, "g")
    v = {c: (F.col(f"{c}_a"), F.col(f"{c}_b")) for c in ("cx", "cy", "w", "h", "min_x", "min_y", "arc", "area")}
    dx, dy = v["cx"][1] - v["cx"][0], v["cy"][1] - v["cy"][0]
    ends = {k: (v[f"min_{k}"][0] + v[s][0], v[f"min_{k}"][1] + v[s][1]) for k, s in (("x", "w"), ("y", "h"))}
    over = {k: F.least(*ends[k]) - F.greatest(*v[f"min_{k}"]) for k in ("x", "y")}
    share = {k: F.least(F.greatest(over[k] / F.greatest(F.least(*v[s]), F.lit(1e-6)), F.lit(-4.0)), F.lit(1.0)) for k, s in (("x", "w"), ("y", "h"))}

    def depth(inner: int, outer: int):
        lows = [v[f"min_{k}"][inner] - v[f"min_{k}"][outer] for k in ("x", "y")]
        highs = [ends[k][outer] - ends[k][inner] for k in ("x", "y")]
        return F.least(*lows, *highs)

    return r.select(
        "g", F.col("c_a").alias("ca"), F.col("c_b").alias("cb"), dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("dist"), over["x"].alias("over_x"), over["y"].alias("over_y"),
        share["x"].alias("share_x"), share["y"].alias("share_y"), depth(0, 1).alias("inside"), depth(1, 0).alias("holds"),
        F.log((v["arc"][0] + 1e-6) / (v["arc"][1] + 1e-6)).alias("arc_ratio"), (F.signum(v["area"][0]) * F.signum(v["area"][1])).alias("winding"),
    )
