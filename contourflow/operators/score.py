"""Scoring: the relational parts of the model and its losses. The model itself is in model.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bce_with_logits, focal, leaky_relu


def layer_norm(rows: DataFrame, keys: list[str], value: str, eps: float = 1e-5) -> DataFrame:
    """Adds norm: value less the mean of its row of keys, over the root of the population variance plus eps."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("norm", (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + eps))


def softmax(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds soft: the softmax over each row of keys, its maximum taken off first."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return rows.withColumn("_e", e).withColumn("soft", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def segment(bins: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds total and mean of value to each bin, 0 for empty ones."""
    agg = rows.groupBy(*keys).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return bins.join(agg, keys, "left").na.fill(0.0, ["total", "mean"])


def attention(edges: DataFrame, slope: float = 0.2) -> DataFrame:
    """(g, dst, out): for one scalar head, incoming edges weighed by a softmax of leaky logits.

    edges has g, dst, logit and h (the source's state). The softmax takes off the maximum of the whole graph and adds
    1e-9 to the denominator.
    """
    x = leaky_relu(F.col("logit"), slope)
    rows = edges.withColumn("x", x)
    top = rows.groupBy("g").agg(F.max("x").alias("top"))
    rows = rows.join(top, "g").withColumn("e", F.exp(F.col("x") - F.col("top")))
    return rows.groupBy("g", "dst").agg((F.sum(F.col("e") * F.col("h")) / (F.sum("e") + 1e-9)).alias("out"))


def graph_pool(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Mean and maximum of each channel by graph."""
    return nodes.groupBy("g").agg(*[f(c).alias(f"{n}_{c}") for c in values for n, f in (("mean", F.avg), ("max", F.max))])


def focal_loss(rows: DataFrame, alpha: float = 0.25, gamma: float = 2.0) -> DataFrame:
    """One row: mean and sum of the focal loss of logit against y, and the mean with weights (over n, not their sum)."""
    loss = focal(F.col("logit"), F.col("y"), alpha, gamma)
    return rows.agg(F.avg(loss).alias("mean"), F.sum(loss).alias("total"), (F.sum(loss * F.col("weight")) / F.count("*")).alias("weighted"))


def softmax_pool(rows: DataFrame, keys: list[str], temperature: float = 0.1) -> DataFrame:
    """(keys, pooled): logits weighed by their own softmax; toward 0 the maximum, toward infinity the mean."""
    top = F.max("logit").over(Window.partitionBy(*keys))
    w = rows.withColumn("w", F.exp((F.col("logit") - top) / temperature))
    return w.groupBy(*keys).agg((F.sum(F.col("w") * F.col("logit")) / (F.sum("w") + 1e-9)).alias("pooled"))


def balanced_bce(rows: DataFrame) -> DataFrame:
    """One row: cross entropy whose positives weigh negatives / max(positives, 1), within 1 and 20."""
    n = rows.agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    weight = F.least(F.greatest(F.col("neg") / F.greatest("pos", F.lit(1.0)), F.lit(1.0)), F.lit(20.0))
    loss = bce_with_logits(F.col("logit"), F.col("y"))
    # The positive part alone is weighed: cross entropy is additive in it.
    sums = rows.agg(F.sum(loss * F.col("y")).alias("lp"), F.sum(loss * (1 - F.col("y"))).alias("ln"), F.count("*").alias("n"))
    return n.join(sums).select(weight.alias("pos_weight"), ((F.col("lp") * weight + F.col("ln")) / F.col("n")).alias("loss"))


def two_level_loss(edges: DataFrame, pair_weight: float = 0.5, inner_weight: float = 0.05, temperature: float = 0.1) -> DataFrame:
    """One row: (1 - w) * mean focal loss of edges, those within a contour at inner_weight, + w * that of pooled pairs.

    edges has g, ca, cb, logit, y. Without pairs, or with w of 0, the first part alone, whole.
    """
    inner = F.when(F.col("ca") == F.col("cb"), inner_weight).otherwise(1.0)
    point = edges.agg((F.sum(focal(F.col("logit"), F.col("y")) * inner) / F.count("*")).alias("point"))
    cross = edges.where("ca <> cb").select("g", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "logit", "y")
    target = cross.groupBy("g", "a", "b").agg(F.max("y").alias("y"))
    pooled = softmax_pool(cross, ["g", "a", "b"], temperature).join(target, ["g", "a", "b"])
    pair = pooled.agg(F.avg(focal(F.col("pooled"), F.col("y"))).alias("pair"))
    w = F.when(F.col("pair").isNull() | F.lit(pair_weight <= 0), 0.0).otherwise(pair_weight)
    return point.join(pair).select("point", "pair", ((1 - w) * F.col("point") + w * F.coalesce("pair", F.lit(0.0))).alias("loss"))


def scored_edges(edges: DataFrame) -> DataFrame:
    """The edges that the classifier needs: those between contours."""
    return edges.where("ca <> cb")
