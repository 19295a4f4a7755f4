"""Filter interaction audit: what each filter removes, alone and after others, in every order.

A packed bitmap index: each partition packs its rows' flags to bitsets, one for each filter and label, the rows of a part
side by side. AND-NOT and popcount give what is left after each set of filters; those counts are summed over partitions,
and all orders are read from them.
"""

from __future__ import annotations

import functools
import itertools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The orders of a filter set grow as its factorial.
MOST_FILTERS = 7
#: A task sums over this many parts before it hands counts on.
PARTS_HELD = 4096


def _key(*columns: str):
    """A join key that no aggregation is dealt by: both sides are dealt anew, and Spark may split what is hot."""
    return F.struct(*columns).alias("k")


def repeats(rows: DataFrame, key: str = "doc_id", content: str = "digest") -> DataFrame:
    """Adds repeat: a row of the same content and a smaller key exists. Rows without key are no repeats and make none."""
    first = rows.where(F.col(key).isNotNull()).groupBy(content).agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last").select(_key(content), "first")
    return rows.withColumn("k", _key(content)).join(first, "k", "left").withColumn("repeat", F.coalesce(F.col(key) > F.col("first"), F.lit(False))).drop("k", "first")


def text_filters(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E): which of the five filters each document fails.

    A: under 200 words; B: less than half of the words are distinct; C: over 2 % of the code points are A-Z; D: one of
    #$%&*| occurs; E: a smaller doc_id has the same text. part is the source, null the empty string. A null text is
    empty: it fails A, and E if another empty text has a smaller doc_id. Texts are read whole, whatever their length.
    Repeated rows (one doc_id) don't repeat each other; rows without doc_id never fail E. Bytes that aren't UTF-8 are
    compared as they are; for the other filters each counts as whatever Spark's string functions make of it.
    """
    own = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    own = own.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (n < 200).alias("A"), (100 * distinct < 50 * n).alias("B"), (100 * capitals > 2 * F.length("text")).alias("C"), F.col("text").rlike("[#$%&*|]").alias("D"))
    return repeats(stored(own)).select("doc_id", "part", "A", "B", "C", "D", F.col("repeat").alias("E"))


def labelled(flags: DataFrame, labels: DataFrame, names: dict[str, str]) -> DataFrame:
    """Adds for each name whether the document's label column of that name is 1. Of several label rows any counts; a
    document without a label row, or a null label, has none."""
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for name, c in names.items()])
    own = own.select(_key("doc_id"), *names)
    return flags.withColumn("k", _key("doc_id")).join(own, "k", "left").drop("k").na.fill(False, [*names])


def packed_counts(codes: np.ndarray, filters: list[np.ndarray], labels: list[np.ndarray]) -> np.ndarray:
    """counts[part, done, 0] is how many rows of the part pass all filters of the bit mask done; [.., 1 + i]: those of
    label i among them. codes: each row's part, from 0, every one used."""
    sizes = np.bincount(codes)
    first = np.concatenate([[0], np.cumsum(-(-sizes // 8))])  # a part begins with a byte
    order = np.argsort(codes, kind="stable")
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 8 * np.repeat(first[:-1], sizes)

    def packed(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(8 * first[-1], dtype=bool)
        bits[place] = flags[order]
        return np.packbits(bits)

    fails, marks = [packed(f) for f in filters], [packed(m) for m in labels]
    left = [packed(np.ones(len(codes), dtype=bool))]
    out = np.zeros((len(sizes), 1 << len(fails), 1 + len(marks)), dtype=np.int64)
    for done in range(1 << len(fails)):
        if done:
            low = (done & -done).bit_length() - 1
            left.append(left[done & (done - 1)] & ~fails[low])
        for i, bits in enumerate([left[done], *[left[done] & m for m in marks]]):
            out[:, done, i] = np.add.reduceat(np.bitwise_count(bits), first[:-1], dtype=np.int64)
    return out


def prefix_counts(flags: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, done, kept, labels): rows of each part that pass all filters of the bit mask done, and those labelled."""

    def mapped(parts):
        held: dict[str, np.ndarray] = {}
        for batch in parts:
            if batch.num_rows:
                coded = batch.column("part").dictionary_encode()
                counts = packed_counts(coded.indices.to_numpy(), *[[batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in names] for names in (filters, labels)])
                for part, own in zip(coded.dictionary.to_pylist(), counts, strict=True):
                    held[part] = held[part] + own if part in held else own
            if len(held) > PARTS_HELD:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = 1 << len(filters)
        counts = np.concatenate(list(held.values()))
        columns = [pa.array([p for p in held for _ in range(n)], pa.string()), pa.array(np.tile(np.arange(n, dtype=np.int32), len(held)))]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[:, i]) for i in range(counts.shape[1])]], names=["part", "done", "kept", *labels])

    schema = ", ".join(["part string", "done int", "kept bigint", *[f"{x} bigint" for x in labels]])
    each = flags.select("part", *filters, *labels).mapInArrow(mapped, schema)
    return each.groupBy("part", "done").agg(*[F.sum(c).alias(c) for c in ("kept", *labels)])


def every_order(counts: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <label>_lost, shapley) for all orders of filters.

    Each part has a row of 2 ** len(filters) counts, so what is collected is bounded.
    """
    if len(filters) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    names = ["kept", *labels]
    own = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("done", *names))).alias("c"))
    rows = own.select("part", "c", F.explode(F.array(*[F.lit("".join(o)) for o in itertools.permutations(filters)])).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    rows = rows.withColumn("own", F.substring("filter_order", F.col("step"), F.lit(1)))
    before = functools.reduce(operator.add, [F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0) for i, f in enumerate(filters)])
    bit = F.coalesce(*[F.when(F.col("own") == f, 1 << i) for i, f in enumerate(filters)])
    rows = rows.withColumn("before", before).withColumn("bit", bit)
    at = lambda mask, name: F.element_at("c", (mask + 1).cast("int"))[name]
    gone = lambda mask, name: at(mask, name) - at(mask + F.col("bit"), name)
    rows = rows.select("part", "filter_order", "step", "own", at(F.col("before") + F.col("bit"), "kept").alias("kept"), gone(F.col("before"), "kept").alias("removed"), gone(F.lit(0), "kept").alias("fails"),
                       gone(F.lit((1 << len(filters)) - 1) - F.col("bit"), "kept").alias("unique_fails"), *[gone(F.col("before"), x).alias(f"{x}_lost") for x in labels])
    shapley = F.sum("removed").over(Window.partitionBy("part", "own"))
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *[f"{x}_lost" for x in labels], shapley.alias("shapley"))


def audit(flags: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """What every filter does in every order of all of them, for each part: one row for each part, order and step.

    flags has part (string), and booleans named by filters (single letters; true: fails) and labels. kept: rows left
    after this step; removed: those it takes; redundant: those that fail it and were gone before; unique_fails: those
    that fail it alone; <label>_lost: labelled ones among the removed; shapley: removed, summed over all orders. Counts
    are of rows, repeated ones too. Steps that remove nothing have zeros; an empty table gives no part. Nulls among flags
    count as false. Ties and other columns don't matter.
    """
    flags = flags.na.fill(False, [*filters, *labels])
    return every_order(prefix_counts(flags, filters, labels), filters, labels)
