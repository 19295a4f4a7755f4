"""Closed polylines: length, area, box, resampling, flattening, layout along a line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A contour needs three points; lengths up to this count as none (the epsilon of single precision).
LEAST_POINTS, EPSILON = 3, 1.1920929e-07
SPACING, FEWEST, MOST = 0.05, 6, 64


def with_next(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds nx, ny: the next vertex, after the last one the first."""
    w = Window.partitionBy(*keys).orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumn("nx", F.coalesce(F.lead("x").over(w), F.first("x").over(whole))).withColumn("ny", F.coalesce(F.lead("y").over(w), F.first("y").over(whole)))


def contour_stats(points: DataFrame, keys: list[str], carry: list[str] = ()) -> DataFrame:
    """One row for each contour: n, arc (closed length; 0 for one point), area (signed; 0 for fewer than three), cx and
    cy (mean of vertices), min_x, min_y, max_x, max_y. One shuffle, by contour."""
    step = F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2)
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    rows = with_next(points, keys).withColumn("step", step).withColumn("cross", cross)
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("step").alias("arc"), (F.sum("cross") / 2).alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), *[F.min(c).alias(c) for c in carry],
    )
    return agg.withColumn("area", F.when(F.col("n") < 3, 0.0).otherwise(F.col("area"))).withColumn("arc", F.when(F.col("n") < 2, 0.0).otherwise(F.col("arc")))


def resample(points: DataFrame, keys: list[str], spacing: float = SPACING, fewest: int = FEWEST, most: int = MOST, scale: float = 1.0) -> DataFrame:
    """Points at equal distances along each contour: (keys, k, t, x, y, tx, ty).

    count = round(length * scale / spacing), halves away from zero, within fewest and most. Point k lies at k / count of
    the length, on the first segment that ends at or beyond it. Contours of fewer than three points or of no length go.
    t is the share of the length, (tx, ty) the unit tangent. Segments and targets meet by contour key, so that the range
    condition is a residual of a hash join, and both sides come from one shuffle.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    step = F.sqrt((F.col("nx") - F.col("x")) ** 2 + (F.col("ny") - F.col("y")) ** 2)
    whole = Window.partitionBy(*keys)
    segs = with_next(points, keys).withColumn("len", step).withColumn("hi", F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    segs = segs.withColumn("lo", F.coalesce(F.lag("hi").over(w), F.lit(0.0)))
    segs = segs.withColumn("total", F.max("hi").over(whole)).withColumn("m", F.count("*").over(whole)).where((F.col("m") >= LEAST_POINTS) & (F.col("total") > EPSILON))
    segs = segs.withColumn("count", sample_count(F.col("total"), spacing, fewest, most, scale)).withColumn("last", F.col("i") == F.max("i").over(whole))
    rows = segs.where(F.col("hi") > F.col("lo")).select("*", F.explode(sample_range(F.col("total"))).alias("k")).withColumn("target", F.col("k") * F.col("total") / F.col("count"))
    x, y, tx, ty = sampled()
    return rows.where(falls_within()).select(*keys, "k", (F.col("target") / F.col("total")).alias("t"), x.alias("x"), y.alias("y"), tx.alias("tx"), ty.alias("ty"))


def sample_count(total: Column, spacing: float, fewest: int, most: int, scale: float = 1.0) -> Column:
    return F.least(F.greatest(F.floor(total * scale / spacing + 0.5), F.lit(fewest)), F.lit(most)).cast("int")


def sample_range(total: Column) -> Column:
    """The targets of a segment (lo, hi) by arithmetic, and those beside them: k with lo < k * total / count <= hi, and k = 0 for
    the first. falls_within tells which are its own."""
    return F.sequence(F.greatest(F.floor(F.col("lo") * F.col("count") / total) - 1, F.lit(0)), F.least(F.ceil(F.col("hi") * F.col("count") / total) + 1, F.col("count") - 1))


def falls_within() -> Column:
    """Whether target k of count lies on its segment."""
    return (F.col("k") <= F.col("count") - 1) & (((F.col("target") > F.col("lo")) & ((F.col("target") <= F.col("hi")) | F.col("last"))) | ((F.col("lo") == 0) & (F.col("k") == 0)))


def sampled() -> tuple[Column, Column, Column, Column]:
    """x, y and the unit tangent where target lies on its segment from (x, y) to (nx, ny)."""
    floor_ = F.greatest(F.col("len"), F.lit(EPSILON))
    f = F.least(F.greatest((F.col("target") - F.col("lo")) / floor_, F.lit(0.0)), F.lit(1.0))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    return F.col("x") + dx * f, F.col("y") + dy * f, dx / floor_, dy / floor_


def moved_left(points: DataFrame) -> DataFrame:
    """Points moved so that the leftmost of each line is at 0; y stays."""
    return points.join(points.groupBy("g").agg(F.min("x").alias("_left")), "g").withColumn("x", F.col("x") - F.col("_left")).drop("_left")


def phase(t: Column) -> tuple[Column, Column]:
    """Cosine and sine of a share of the way round."""
    return F.cos(2 * math.pi * t), F.sin(2 * math.pi * t)


def flatten_curves(curves: DataFrame, keys: list[str], steps: int = 8) -> DataFrame:
    """Quadratic (kind 'q') and cubic ('c') curves as points at 1/steps .. 1, lines ('l') and moves ('m') as their end.

    curves has keys, i, kind, x0..x3, y0..y3: the current point, then controls and end. A move begins the next contour,
    so that contour is the running count of moves.
    """
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = curves.withColumn("contour", F.sum((F.col("kind") == "m").cast("bigint")).over(w) - 1)
    rows = rows.select("*", F.explode(F.when(F.col("kind").isin("q", "c"), F.sequence(F.lit(1), F.lit(steps))).otherwise(F.array(F.lit(steps)))).alias("s"))
    t = F.col("s") / F.lit(float(steps))
    u = 1 - t

    def at(p0, p1, p2, p3):
        quad = u * u * F.col(p0) + 2 * u * t * F.col(p1) + t * t * F.col(p2)
        cubic = u * u * u * F.col(p0) + 3 * u * u * t * F.col(p1) + 3 * u * t * t * F.col(p2) + t * t * t * F.col(p3)
        return F.when(F.col("kind") == "q", quad).when(F.col("kind") == "c", cubic).otherwise(F.col(p1))

    return rows.select(*keys, "contour", "i", "s", at("x0", "x1", "x2", "x3").alias("x"), at("y0", "y1", "y2", "y3").alias("y"))


def pen_positions(marks: DataFrame, line: str, order: list[str], advance: Column, tracking: Column) -> DataFrame:
    """Adds pen: the advances and trackings before each mark of its line. Filter empty marks afterwards, they advance too."""
    w = Window.partitionBy(line).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("pen", F.coalesce(F.sum(advance + tracking).over(w), F.lit(0.0)))


def shaped(lines: DataFrame, ligatures: DataFrame | None = None, text: str = "text") -> DataFrame:
    """lines without text, a row for each glyph: at (the code point that its cluster begins with), k (its place) and char.

    ligatures (font, parts, char): where parts stand in a text of that font, char is drawn instead; from left to right, at
    each place the longest. What is not part of one is drawn as itself. A combining mark is a glyph of its own in the cluster
    of what it follows, so clusters are what later counts as one character. Empty and null texts have no glyphs.
    """
    one, marks = r"(?s:.)", r"\p{M}*"
    if ligatures is None:
        lines = lines.withColumn("_any", F.lit(one)).withColumn("_of", F.lit(None).cast("map<string,string>"))
    else:
        # An alternation takes the first that fits, so longer ones stand first.
        known = ligatures.where("parts <> ''").groupBy("font", "parts").agg(F.min("char").alias("char"))
        longest = F.array_sort(F.collect_list(F.struct((-F.length("parts")).alias("less"), "parts", "char")))
        fonts = known.groupBy("font").agg(longest.alias("x")).select("font", F.concat(F.array_join(F.transform("x", lambda x: F.regexp_replace(x["parts"], r"([^\p{L}\p{N}])", r"\\$1")), "|"), F.lit(f"|{one}")).alias("_any"), F.map_from_arrays("x.parts", "x.char").alias("_of"))
        lines = lines.join(fonts, "font", "left").withColumn("_any", F.coalesce("_any", F.lit(one)))
    clusters = F.regexp_extract_all(text, F.concat(F.lit("(?:"), F.col("_any"), F.lit(f"){marks}")), F.lit(0))
    glyphs = F.transform(clusters, lambda c: F.regexp_extract_all(c, F.col("_any"), F.lit(0)))
    # A mark for each code point, true where a cluster begins: what a lambda refers to outside itself is computed anew for
    # each element, so the text before a cluster must not be measured there.
    begins = F.flatten(F.transform(clusters, lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: i == 1)))
    starts = F.filter(F.transform(begins, lambda first, at: F.when(first, at)), lambda at: at.isNotNull())
    placed = F.flatten(F.zip_with(starts, glyphs, lambda at, own: F.transform(own, lambda c: F.struct(at.alias("at"), F.coalesce(F.element_at("_of", c), c).alias("char")))))
    rows = lines.where(F.length(text) > 0).select(*[c for c in lines.columns if c not in (text, "_any", "_of")], F.posexplode(placed).alias("k", "x"))
    return rows.select("*", F.col("x.at").alias("at"), F.col("x.char").alias("char")).drop("x")


def kerned(marks: DataFrame, kerning: DataFrame, line: str) -> DataFrame:
    """Adds kern: what kerning (font, char, next, kern) has for a glyph and the one after it on its line, else 0."""
    pairs = kerning.groupBy("font", "char", "next").agg(F.min("kern").alias("kern"))
    return marks.withColumn("next", F.lead("char").over(Window.partitionBy(line).orderBy("k"))).join(pairs, ["font", "char", "next"], "left").na.fill(0.0, ["kern"]).drop("next")


def cluster_ids(marks: DataFrame, line: str, cluster: str) -> DataFrame:
    """Adds char_id: the rank of each cluster among the distinct ones of its line, from 0."""
    return marks.withColumn("char_id", (F.dense_rank().over(Window.partitionBy(line).orderBy(cluster)) - 1).cast("bigint"))


def affine(points: DataFrame, dx: Column, dy: Column, noise_x: Column, noise_y: Column, aspect: Column) -> DataFrame:
    """Moves, then adds noise, then scales x (the noise of x too) by aspect."""
    return points.withColumn("x", (F.col("x") + dx + noise_x) * aspect).withColumn("y", F.col("y") + dy + noise_y)


def scale_shift(points: DataFrame, em_scale: float = 1.0, baseline: float = 0.0) -> DataFrame:
    """Errors of the em scale and the baseline."""
    return points.withColumn("x", F.col("x") * em_scale).withColumn("y", F.col("y") * em_scale + baseline)
