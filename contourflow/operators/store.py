"""The graph store: checks, derived columns, packed flags, dictionaries, offsets, summaries."""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratio
from . import model
from .scan import running

FORMAT_VERSION = 4
U16 = 65535
#: Nodes of a graph that is kept, at least.
LEAST_NODES = 8


def validate(nodes: DataFrame, edges: DataFrame, contours: DataFrame) -> DataFrame:
    """One row of violation counts: ids beyond 16 bits, edges to missing nodes, nodes without contour rows, self edges."""
    n = nodes.agg(F.count_if((F.col("n") < 0) | (F.col("n") > U16)).alias("wide_nodes"), F.count_if((F.col("c") < 0) | (F.col("c") > U16)).alias("wide_contours"), F.count_if(F.coalesce(F.col("ch"), F.lit(0)) > U16).alias("wide_chars"))
    known = nodes.select("g", F.col("n").alias("id")).distinct()
    ends = edges.select("g", F.explode(F.array("src", "dst")).alias("id"))
    lost = ends.join(known, ["g", "id"], "left_anti").agg(F.count("*").alias("lost_ends"))
    bare = nodes.select("g", "c").distinct().join(contours.select("g", "c").distinct(), ["g", "c"], "left_anti").agg(F.count("*").alias("bare_contours"))
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_edges"))
    return functools.reduce(lambda a, b: a.join(b), [n, lost, bare, loops])


def record_violations(records: DataFrame) -> DataFrame:
    """One row: how many nested records (shards.SCHEMA) break each rule, nulls as breaks.

    Dimensions and sizes of the arrays, edges within the nodes, contour ids with a contour, ids within 16 bits, and flags
    that are 0 or 1. Everything is aggregated before the shuffle; no array leaves its row.
    """
    size, n, e, k = F.size, F.col("num_nodes"), F.size("edge_labels"), F.col("num_contours")
    top = lambda c: F.coalesce(F.array_max(c).cast("bigint"), F.lit(-1).cast("bigint"))
    same = F.filter("edge_features", lambda x, i: i % len(model.EDGE) == 3)
    rules = {
        "nodes_dim": (F.col("node_dim") == len(model.NODE)) & (size("node_features") == n * F.col("node_dim")),
        "edges_dim": size("edge_features") == e * len(model.EDGE),
        "edges_size": size("edge_index") == 2 * e,
        "contours_dim": size("contour_features") == k * len(model.CONTOUR),
        "ids_size": (size("node_contour_ids") == n) & (size("node_char_ids") == n),
        "edges_range": top("edge_index") < n,
        "contours_range": top("node_contour_ids") < k,
        "wide": (n <= U16) & (top("node_contour_ids") <= U16) & (top("node_char_ids") <= U16),
        "flags": F.forall(same, lambda x: x.isin(0.0, 1.0)) & F.forall("edge_labels", lambda x: x.isin(0, 1)),
    }
    return records.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def narrowed(nodes: DataFrame) -> DataFrame:
    """nodes with n, c and ch as 32-bit integers that hold 16; a value beyond fails the query."""
    fits = lambda c: F.when(F.col(c).isNull() | F.col(c).between(0, U16), F.col(c).cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{c} is beyond 16 bits: "), F.col(c).cast("string"))).cast("int"))
    return nodes.withColumns({c: fits(c) for c in ("n", "c", "ch")})


def check_widths(records: DataFrame) -> int:
    """The node width of all records, which is what a model over them must take; ValueError if they differ."""
    widths = [r.node_dim for r in records.select("node_dim").distinct().orderBy("node_dim").limit(9).collect()]
    if len(widths) > 1:
        raise ValueError(f"records have nodes of different widths: {widths}")
    return widths[0] if widths else len(model.NODE)


def warmed(df: DataFrame) -> DataFrame:
    """df kept by the executors, on disk what doesn't fit in memory, and read once."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    df.count()
    return df


def checked(nodes: DataFrame, edges: DataFrame, contours: DataFrame) -> None:
    """Raises ValueError with the counts if validate finds any."""
    counts = validate(nodes, edges, contours).first().asDict()
    if any(counts.values()):
        raise ValueError(f"invalid graph store: { {k: v for k, v in counts.items() if v} }")


def check_version(version: int) -> None:
    if version != FORMAT_VERSION:
        raise ValueError(f"store has format version {version}, not {FORMAT_VERSION}")


def flags(label: Column, same: Column) -> Column:
    """Bit 0: label, bit 1: same contour."""
    return label.cast("int").bitwiseOR(F.shiftleft(same.cast("int"), 1)).cast("smallint")


def unpack_flags(packed: Column) -> tuple[Column, Column]:
    return packed.bitwiseAND(F.lit(1).cast("smallint")) != 0, packed.bitwiseAND(F.lit(2).cast("smallint")) != 0


def packed_edges(edges: DataFrame) -> DataFrame:
    """What is stored of edges: single-precision offsets and flags; the distance is left out."""
    return edges.select("g", "e", "src", "dst", F.col("dx").cast("float").alias("dx"), F.col("dy").cast("float").alias("dy"), flags(F.col("label"), F.col("same")).alias("flags"))


def unpacked_edges(packed: DataFrame) -> DataFrame:
    """Edges as before, the distance made again from the stored offsets."""
    label, same = unpack_flags(F.col("flags"))
    dx, dy = F.col("dx").cast("double"), F.col("dy").cast("double")
    return packed.select("g", "e", "src", "dst", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("dist"), label.alias("label"), same.alias("same"))


def dist_drift(edges: DataFrame) -> DataFrame:
    """One row: the largest difference between a distance and the one made again."""
    again = unpacked_edges(packed_edges(edges)).select("g", "e", F.col("dist").alias("again"))
    return edges.join(again, ["g", "e"]).agg(F.max(F.abs(F.col("dist") - F.col("again"))).alias("drift"))


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(column, id): distinct values in order, from 0, numbered in ranges."""
    return running(rows.select(column).distinct(), [column]).withColumnRenamed("pos", "id")


def offsets(sizes: DataFrame, key: str, size: str) -> DataFrame:
    """Adds offset: the sum of the sizes before each key. sizes has one row for each graph; ranges of them are summed in
    parallel (scan.running)."""
    return running(sizes, [key], {"offset": size}).drop("pos")


def graph_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, num_nodes, num_contours, num_edges, positives) of each graph with nodes."""
    n = nodes.groupBy("g").agg(F.count("*").alias("num_nodes"), F.count_distinct("c").alias("num_contours"))
    e = edges.groupBy("g").agg(F.count("*").alias("num_edges"), F.count_if("label").alias("positives"))
    return n.join(e, "g", "left").na.fill(0, ["num_edges", "positives"])


def statistics(graphs: DataFrame) -> DataFrame:
    """One row: graphs, nodes, edges and the share of positive edges, 0 without edges, and distinct fonts if there is a
    column font."""
    fonts = [F.count_distinct("font").alias("fonts")] if "font" in graphs.columns else []
    rows = graphs.agg(*fonts, F.count("*").alias("graphs"), F.coalesce(F.sum("num_nodes"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("num_edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"))
    return rows.withColumn("pos_ratio", ratio(F.col("positives"), F.col("edges")))


def reject_small(graphs: DataFrame, least_nodes: int = LEAST_NODES) -> DataFrame:
    return graphs.where((F.col("num_nodes") >= least_nodes) & (F.col("num_edges") > 0))


def write(tables: dict[str, DataFrame], path: str, size: int = 1000) -> None:
    """Each table as Parquet, parted by shard: graph id div size."""
    for name, df in tables.items():
        df.withColumn("shard", F.expr(f"cast(g div {size} as int)")).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/{name}")


def read(spark, path: str, name: str, shards: int = 0) -> DataFrame:
    """A table of the store; the first shards shards only if that isn't 0, by partition pruning."""
    df = spark.read.parquet(f"{path}/{name}")
    return df.where(F.col("shard") < shards) if shards else df
