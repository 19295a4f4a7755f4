"""Whole graphs in buckets: what is a fold or a search within one graph runs in Arrow, many graphs to a task."""

from __future__ import annotations

import math
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows to a bucket, about: nodes, whose edges are some ten times as many.
ROWS = 4_096


class Times(AccumulatorParam):
    """Wall time of work within tasks, by stage: {stage: (calls, seconds, longest)}, which executors send with their results."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802  Spark's name
        for stage, (n, total, most) in b.items():
            m, t, x = a.get(stage, (0, 0.0, 0.0))
            a[stage] = m + n, t + total, max(x, most)
        return a


class Watch:
    """While it is entered, what dealt runs is timed where it runs. Of each stage the first skip calls of a Python worker warm
    up and don't count; a task that runs twice counts twice."""

    _now: Watch | None = None

    def __init__(self, spark: SparkSession, skip: int = 0):
        self.skip, self.id = skip, uuid.uuid4().hex
        self.times = spark.sparkContext.accumulator({}, Times())

    def __enter__(self) -> Watch:
        Watch._now = self
        return self

    def __exit__(self, *error) -> None:
        Watch._now = None

    def rows(self) -> list[tuple[str, int, float, float]]:
        """(stage, calls, mean, longest) in milliseconds, the longest mean first."""
        return sorted(((s, n, 1000 * t / n, 1000 * x) for s, (n, t, x) in self.times.value.items()), key=lambda r: (-r[2], r[0]))


_CALLS: dict[tuple[str, str], int] = {}


def _watched(run, tables: int):
    """run of so many tables, timed while a Watch is entered."""
    call = run
    if Watch._now is not None:
        stage, times, skip, watch = run.__qualname__.split(".")[0], Watch._now.times, Watch._now.skip, Watch._now.id

        def call(*given):
            began = time.perf_counter()
            out = run(*given)
            took = time.perf_counter() - began
            seen = _CALLS[watch, stage] = _CALLS.get((watch, stage), 0) + 1
            if seen > skip:
                times.add({stage: (1, took, took)})
            return out

    return (lambda left, right: call(left, right)) if tables == 2 else lambda table: call(table)


def _number(df: DataFrame, rows: int | None):
    return F.pmod(F.xxhash64("g"), F.lit(max(1, math.ceil((df.count() if rows is None else rows) / ROWS)))).alias("bucket")


def dealt(left: DataFrame, right: DataFrame, run, schema: str, rows: int | None = None) -> DataFrame:
    """run(left, right) on each bucket of whole graphs, as flat Arrow tables; rows: those of left, counted if not given.

    Graphs are dealt by a hash of g, so that no value makes a large bucket; one graph is never cut.
    """
    bucket = _number(left, rows)
    left, right = (df.select(bucket, "*").toDF("bucket", *df.columns) for df in (left, right))  # so that both sides' columns differ
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_watched(run, 2), schema)


def dealt_alone(left: DataFrame, run, schema: str) -> DataFrame:
    """As dealt, of one table."""
    return left.select(_number(left, None), "*").groupBy("bucket").applyInArrow(_watched(run, 1), schema)


def in_buckets(df: DataFrame, rows: int) -> DataFrame:
    """df with bucket, dealt by it, for some rows in all that will come of it: whatever goes by bucket and g stays in its task."""
    buckets = max(1, math.ceil(rows / ROWS))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(buckets / 16))
    return df.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets))).repartition(tasks, "bucket")


def matrix(table: pa.Table, columns: list[str], order: np.ndarray) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in columns])[order]


def by_graph(*tables: tuple[pa.Table, list[str]]):
    """(g, places of its rows in each table, in order of the table's keys) for each graph of the first table."""
    ids = [t.column("g").to_numpy() if t.num_rows else np.empty(0, np.int64) for t, _ in tables]
    orders = [np.lexsort([*[t.column(c).to_numpy() for c in reversed(keys)], g]) if len(g) else np.empty(0, np.int64) for g, (t, keys) in zip(ids, tables, strict=True)]
    ids = [g[o] for g, o in zip(ids, orders, strict=True)]
    for g in np.unique(ids[0]).tolist():
        yield g, *[o[np.searchsorted(i, g) : np.searchsorted(i, g, side="right")] for i, o in zip(ids, orders, strict=True)]
