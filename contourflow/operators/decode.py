"""From edge probabilities to groups of contours."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import written
from .buckets import by_graph, dealt
from .model import agglomerated


def pair_max(edges: DataFrame) -> DataFrame:
    """(g, ca, cb, n_edges, prob, label): the highest probability between two contours, either way; edges within one go."""
    rows = edges.where("ca <> cb").select("g", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "prob", "label")
    return rows.groupBy("g", "ca", "cb").agg(F.count("*").alias("n_edges"), F.max("prob").alias("prob"), F.max("label").alias("label"))


def filled(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """edges with prob: that of scores by (g, e), 1 where there is none."""
    return edges.join(scores, ["g", "e"], "left").withColumn("prob", F.coalesce("prob", F.lit(1.0)))


def at_thresholds(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """pairs once for each threshold that their probability reaches; the list is part of the plan."""
    return pairs.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("prob >= threshold")


def falling(contours: list[int], pairs: list[tuple[float, int, int]], thresholds: list[float]):
    """(threshold, root of each contour) from the highest threshold down: each adds the links that it lets in, none is
    gone through twice. Roots are the smallest contour of a group."""
    root = {c: c for c in contours}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, at = sorted(pairs, key=lambda x: -x[0]), 0
    for threshold in sorted(thresholds, reverse=True):
        while at < len(links) and links[at][0] >= threshold:
            a, b = find(links[at][1]), find(links[at][2])
            root[max(a, b)] = min(a, b)
            at += 1
        yield threshold, {c: find(c) for c in contours}


def in_buckets(pairs: DataFrame, contours: DataFrame, run, names: list[str], schema: str) -> DataFrame:
    """run(contours, pairs) of each graph, lists of rows without g and in order, gives rows; contours has g, c and names."""
    columns, shape = [["c", *names], ["ca", "cb", "prob", "label"]], to_arrow_schema(StructType.fromDDL(schema))

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        own, links = ([t.column(c).to_pylist() for c in names_] for t, names_ in zip((left, right), columns, strict=True))
        rows = []
        for g, a, b in by_graph((left, ["c"]), (right, ["ca", "cb"])) if left.num_rows else ():
            rows += [(g, *r) for r in run([tuple(v[i] for v in own) for i in a.tolist()], [tuple(v[i] for v in links) for i in b.tolist()])]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(shape), shape.types, strict=True)], schema=shape)

    links = pairs.select("g", F.col("ca").cast("bigint").alias("ca"), F.col("cb").cast("bigint").alias("cb"), "prob", F.col("label") if "label" in pairs.columns else F.lit(False).alias("label"))
    return dealt(contours.select("g", F.col("c").cast("bigint").alias("c"), *names), links, whole, schema)


def char_groups(pairs: DataFrame, contours: DataFrame, thresholds: list[float]) -> DataFrame:
    """(g, threshold, c, grp): connected contours at each threshold, grp the smallest of the group; lone ones too.

    Graphs are small and independent: one union-find for each, over its links once, gives all thresholds.
    """

    def run(own, links):
        return [(t, c, r) for t, roots in falling([x[0] for x in own], [(p, a, b) for a, b, p, _ in links], thresholds) for c, r in roots.items()]

    return in_buckets(pairs, contours, run, [], "g bigint, threshold double, c bigint, grp bigint")


def char_groups_by_labels(links: DataFrame, contours: DataFrame, keys: tuple[str, ...] = ("g",)) -> DataFrame:
    """(keys, c, grp): the same at one threshold for graphs too large for a task; each value of keys is a graph of its own.

    Each round every contour takes the least label around it and then the label of its label, so that chains shorten by
    half; rounds go on until no label changes, and each is written.
    """
    both = written(links.select(*keys, "ca", "cb").union(links.select(*keys, F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct())
    labels = contours.select(*keys, "c", F.col("c").alias("grp"))
    while True:
        near = both.join(labels.withColumnRenamed("c", "cb"), [*keys, "cb"]).groupBy(*keys, F.col("ca").alias("c")).agg(F.min("grp").alias("least"))
        new = labels.join(near, [*keys, "c"], "left").select(*keys, "c", F.col("grp").alias("old"), F.least("grp", F.coalesce("least", "grp")).alias("grp"))
        # What a root has learned, its whole tree takes over: the tree's label may only fall.
        fallen = new.groupBy(*keys, F.col("old").alias("c")).agg(F.min("grp").alias("least"))
        new = new.join(fallen.select(*keys, F.col("c").alias("old"), "least"), [*keys, "old"]).select(*keys, "c", "old", F.least("grp", "least").alias("grp"))
        over = new.select(*keys, F.col("c").alias("grp"), F.col("grp").alias("over"))
        new = written(new.join(over, [*keys, "grp"]).select(*keys, "c", F.col("over").alias("grp"), (F.col("over") < F.col("old")).alias("moved")))
        labels = new.select(*keys, "c", "grp")
        if new.where("moved").isEmpty():
            return labels


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """(g, ca, cb, prob): a maximum spanning forest of each graph, whatever its size; pairs has g, ca, cb, prob.

    Each round every group of contours takes its most probable pair to another group, of equals the smallest by contours, so
    that no round closes a circle; groups that are joined become one, and of several pairs between two groups the best is
    kept. Groups at least halve in number each round, so rounds are logarithmic; each is written. Null probabilities and
    pairs of a contour with itself go.
    """
    own = F.struct((-F.col("prob")).alias("less"), F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"))
    left = written(pairs.where("ca <> cb and prob is not null").select("g", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), own.alias("x")).groupBy("g", "a", "b").agg(F.min("x").alias("x")))
    forest = left.where("false").select("g", "x")
    while not left.isEmpty():
        both = left.select("g", "a", "b", "x").union(left.select("g", F.col("b").alias("a"), F.col("a").alias("b"), "x"))
        taken = written(both.groupBy("g", F.col("a").alias("c")).agg(F.min(F.struct("x", "b")).alias("t")).select("g", "c", F.col("t.b").alias("up"), "t.x"))
        forest = written(forest.union(taken.select("g", "x").distinct()))
        # Pointers end in two groups that took each other; the smaller is the root of all that lead there.
        back = taken.select("g", F.col("c").alias("up"), F.col("up").alias("again"))
        up = taken.join(back, ["g", "up"]).select("g", "c", F.when((F.col("again") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("up"))
        up = written(up)
        moved = True
        while moved:
            over = up.select("g", F.col("c").alias("up"), F.col("up").alias("over"))
            new = written(up.join(over, ["g", "up"]).select("g", "c", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")))
            moved, up = not new.where("moved").isEmpty(), new.select("g", "c", "up")
        one, two = up.select("g", F.col("c").alias("a"), F.col("up").alias("ra")), up.select("g", F.col("c").alias("b"), F.col("up").alias("rb"))
        left = left.join(one, ["g", "a"]).join(two, ["g", "b"]).where("ra <> rb")
        left = written(left.groupBy("g", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("x").alias("x")))
    return forest.select("g", "x.ca", "x.cb", (-F.col("x.less")).alias("prob"))


def char_groups_by_forest(pairs: DataFrame, contours: DataFrame, thresholds: list[float]) -> DataFrame:
    """char_groups for graphs too large for a task: a spanning forest, which connects at each threshold what all pairs do and
    has fewer links than contours, cut at every threshold; the cuts are labelled in the same rounds."""
    if not thresholds:
        return contours.where("false").select("g", F.lit(0.0).alias("threshold"), "c", F.col("c").alias("grp"))
    forest = spanning_forest(pairs.where(F.col("prob") >= min(thresholds)))
    each = contours.select("g", "c").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return char_groups_by_labels(at_thresholds(forest, thresholds), each, ("g", "threshold")).select("g", "threshold", "c", "grp")


def ordered_groups(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(g, threshold, pos, grp, members): groups from left to right by their leftmost node, ties to the smaller contour."""
    left = nodes.groupBy("g", "c").agg(F.min("x").alias("x"))
    rows = groups.join(left, ["g", "c"]).groupBy("g", "threshold", "grp").agg(F.min("x").alias("x"), F.sort_array(F.collect_list("c")).alias("members"))
    w = Window.partitionBy("g", "threshold").orderBy("x", "grp")
    return rows.select("g", "threshold", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), "grp", "members")


def truth_groups(contours: DataFrame) -> DataFrame:
    """(g, ch, members): the contours of each character; unknown ones are one group."""
    return contours.groupBy("g", "ch").agg(F.sort_array(F.collect_set("c")).alias("members"))


def partitions_equal(groups: DataFrame, truth: DataFrame) -> DataFrame:
    """(g, threshold, equal): whether groups and characters are the same sets of contours, order aside."""
    mine = groups.groupBy("g", "threshold", "grp").agg(F.sort_array(F.collect_list("c")).alias("m")).groupBy("g", "threshold").agg(F.sort_array(F.collect_list("m")).alias("mine"))
    own = truth.groupBy("g").agg(F.sort_array(F.collect_list("members")).alias("own"))
    return mine.join(own, "g", "left").select("g", "threshold", F.coalesce(F.col("mine") == F.col("own"), F.lit(False)).alias("equal"))


def symmetric(pairs: DataFrame) -> DataFrame:
    """(g, ca, cb, prob): each pair both ways; what is missing is 0."""
    return pairs.select("g", "ca", "cb", "prob").union(pairs.select("g", F.col("cb").alias("ca"), F.col("ca").alias("cb"), "prob"))


def accumulators(states: DataFrame, members: DataFrame) -> DataFrame:
    """(g, grp, n, sum_s, max_s, min_x, min_y, max_x, max_y, arc, area): what groups of contours add up to.

    states has g, c, s (a state channel), a box, arc and area; members g, c, grp. A contour may be in several groups.
    """
    rows = members.join(states, ["g", "c"])
    return rows.groupBy("g", "grp").agg(F.count("*").alias("n"), F.sum("s").alias("sum_s"), F.max("s").alias("max_s"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.sum("arc").alias("arc"), F.sum(F.abs("area")).alias("area"))


def merged(parts: DataFrame) -> DataFrame:
    """Accumulators of the same group combined: the same as accumulating their union."""
    return parts.groupBy("g", "grp").agg(F.sum("n").alias("n"), F.sum("sum_s").alias("sum_s"), F.max("max_s").alias("max_s"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.sum("arc").alias("arc"), F.sum("area").alias("area"))


def group_scalars(acc: DataFrame) -> DataFrame:
    """Adds width, height, aspect and compactness; extents at least 0, denominators at least 1e-6."""
    w, h = F.greatest(F.col("max_x") - F.col("min_x"), F.lit(0.0)), F.greatest(F.col("max_y") - F.col("min_y"), F.lit(0.0))
    return acc.withColumn("width", w).withColumn("height", h).withColumn("aspect", w / F.greatest(h, F.lit(1e-6))).withColumn("compact", F.col("arc") / F.greatest(w + h, F.lit(1e-6)))


def greedy_groups(pairs: DataFrame, contours: DataFrame, scorer: Callable, threshold: float = 0.5, floor: float = 0.1) -> DataFrame:
    """(g, c, grp): pairs from floor up, in order of falling probability then contours, each scored on the groups as they
    are, merged from threshold up. scorer(left, right, link) takes two sorted tuples of contours and the highest
    probability between them. With the model's own scorer: model.merged_groups."""

    def run(own, links):
        ids = [x[0] for x in own]
        at = {c: i for i, c in enumerate(ids)}
        named = lambda members: tuple(ids[i] for i in members)
        merges = lambda left, right, link: scorer(named(left), named(right), link) >= threshold
        found = agglomerated(len(ids), [(at[a], at[b], p) for a, b, p, _ in links if a != b], merges, floor)
        return [(c, ids[r]) for c, r in zip(ids, found, strict=True)]

    return in_buckets(pairs, contours, run, [], "g bigint, c bigint, grp bigint")
