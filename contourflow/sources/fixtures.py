"""Contours, polylines, scores and corpora derived from plain tables, so that every operator has input to run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US, DAY_US = 1704067200000000, 8.64e10
POINTS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, c, ch, i, x, y): eight contours of 32 points to a line, two contours to a character."""
    e = table(spark, sf_dir, "embeddings")
    c = F.col("vec_id") % 8
    rows = e.select(F.expr("vec_id div 8").alias("g"), c.alias("c"), F.expr("(vec_id % 8) div 2").alias("ch"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))).alias("i"))
    return rows.select("g", "c", "ch", "i", (F.expr("cast(embedding[2 * i] as double)") + F.lit(0.3) * F.col("c")).alias("x"), F.expr("cast(embedding[2 * i + 1] as double)").alias("y"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g, n, c, ch, x, y): every point of FX1 as a node, numbered densely within its line."""
    return points(spark, sf_dir).select("g", (F.col("c") * POINTS + F.col("i")).cast("bigint").alias("n"), "c", "ch", "x", "y")


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, x, y): a long closed polyline for each user, in order of time."""
    e = table(spark, sf_dir, "events")
    order = F.struct(micros().alias("t"), "event_id", "value")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(order)).alias("p")).select("user_id", F.posexplode("p").alias("i", "p"))
    return rows.select("user_id", "i", ((F.col("p.t") - F.lit(EPOCH_US)) / F.lit(DAY_US)).alias("x"), (F.col("p.value") / 100).alias("y"))


def glyphs(spark: SparkSession, sf_dir: str, pool: list[str], fonts: list[str]) -> tuple[DataFrame, DataFrame]:
    """Glyph table and outlines: line j's eight contours are the outlines of eight characters of the pool in one font."""
    p = points(spark, sf_dir).where(F.col("g") < 2 * len(fonts))
    named = p.select(F.element_at(F.array(*[F.lit(f) for f in fonts]), (F.expr("g div 2") + 1).cast("int")).alias("font"), F.element_at(F.array(*[F.lit(c) for c in pool]), ((F.col("g") % 2) * 8 + F.col("c") + 1).cast("int")).alias("char"), "i", (F.col("x") * 200).alias("x"), (F.col("y") * 200).alias("y"))
    table_ = named.groupBy("font", "char").agg(F.lit(1000.0).alias("upem"), F.lit(600.0).alias("advance"), F.lit(0.0).alias("dx"), F.lit(10.0).alias("dy"))
    return table_, named.select("font", "char", F.lit(0).alias("k"), "i", "x", "y")
