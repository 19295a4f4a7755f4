"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, folder

#: ASCII white space, the only characters that separate words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """As checkpointed, but as compressed Parquet, for what is large. The files go when this process ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(modulus))


def repaired(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with what isn't UTF-8 in a text replaced by U+FFFD: Parquet and Spark let any bytes be a string."""
    return docs.withColumn(column, F.make_valid_utf8(column))


def raw_text(column: str = "text") -> Column:
    """The UTF-8 bytes of a text, what isn't UTF-8 replaced by U+FFFD; null is empty."""
    return F.make_valid_utf8(F.coalesce(F.col(column), F.lit(""))).cast("binary")


def words_of(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space: bytes.lower and bytes.split do exactly that."""
    return raw.lower().split()


def batches(parts, limit: int):
    """Arrow batches cut so that each holds about limit bytes at most, or one row."""
    for part in parts:
        rows = max(1, min(part.num_rows, int(part.num_rows * limit / max(1, part.nbytes))))
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


#: Bits of the bitmap that may_hold tells keys by: 4 MB, whatever their number.
HOLD_BITS = 1 << 25


def may_hold(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows with a boolean _held added, which is false only where keys (a table of one column of that type) lack the value.

    A bitmap of the keys' hashes goes to all tasks, so that rows which are surely not among the keys needn't be shuffled. More
    keys than it has bits make more rows true, never one false that isn't; what is true must be joined to be sure.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(HOLD_BITS))
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = keys.select(place(keys.columns[0]).alias("_at")).select(F.expr("_at div 32768").alias("_map"), (F.col("_at") % 32768).alias("_at"))
    maps = stored(bits.repartition(parts, "_map").groupBy("_map").agg(F.bitmap_construct_agg("_at").alias("_bits")))
    at = place(column) % 32768
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    return rows.join(F.broadcast(maps), F.floor(place(column) / 32768) == F.col("_map"), "left").select(*[rows[f"`{c}`"] for c in rows.columns], held.alias("_held"))


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def components(edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of the component.

    Each round every node points at its smallest neighbour, pointers are doubled until all are at a node that points at
    itself, and the edges are contracted to those; rounds and doublings are logarithmic. Every round is written as Parquet, of
    which Spark knows the true size: a checkpoint keeps its plan's estimate, which each join of a round with itself squares. Nodes of no edge get no row. Self-links and nulls are dropped, repeated links count once.
    """
    edges = edges.select(F.col("a").cast(kind), F.col("b").cast(kind)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges)
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up"))
        moved = True
        while moved:
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            up = stored(up.join(over, "up").select("node", F.col("over").alias("up"), (F.col("up") != F.col("over")).alias("moved")))
            moved = not up.where("moved").isEmpty()
        if roots is None:
            roots = up.select("node", F.col("up").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), "up")
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left, right = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = stored(edges)
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
