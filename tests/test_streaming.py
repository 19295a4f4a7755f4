"""Evaluation over a stream against the same rows as one batch."""

import numpy as np
import pytest
from contourflow.operators import decode, metrics
from contourflow.streaming import latest, streamed_tallies
from pyspark.sql import functions as F

SCHEMA = "g bigint, c bigint, ch bigint, ca bigint, cb bigint, prob double, label boolean, ts timestamp"
THRESHOLDS = [0.3, 0.6, 0.9]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def events():
    draw, out = np.random.default_rng(1), []
    for g in range(6):
        out += [(g, c, c // 2 if c < 8 else None, None, None, None, None) for c in range(9)]
        for _ in range(60):
            a, b = draw.integers(0, 9, 2).tolist()
            out.append((g, None, None, a, b, float(draw.integers(0, 11)) / 10, a // 2 == b // 2))
    return [out[i] for i in draw.permutation(len(out))]


def run(spark, folder, parts, name, ts=None):
    for k, rows in enumerate(parts):
        stamped = [(*r, None) if ts is None else (*r, None) for r in rows]
        frame = spark.createDataFrame(stamped, SCHEMA)
        if ts is not None:
            frame = frame.withColumn("ts", F.to_timestamp(F.lit(ts[k])))
        frame.coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/part=*")
    out = streamed_tallies(stream, THRESHOLDS, **({"ts": "ts", "late": "1 minute"} if ts else {}))
    query = out.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name)


def test_any_batches_give_what_one_batch_gives(rocks, tmp_path):
    spark, rows = rocks, events()
    every = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    edges, contours = every.where("ca is not null"), every.where("c is not null").select("g", "c", "ch")
    want = metrics.sweep(decode.pair_max(edges), contours, contours.select("g").distinct(), THRESHOLDS)
    for n in (1, 4):
        got = run(spark, str(tmp_path / str(n)), [rows[k::n] for k in range(n)], f"tallies{n}")
        assert sorted(map(tuple, metrics.summed(latest(got)).collect())) == sorted(map(tuple, want.collect()))
        assert got.select("g", "version").distinct().count() == 6 * n and got.where("final").count() == 0


def test_a_graph_that_nothing_comes_of_is_final(rocks, tmp_path):
    spark, rows = rocks, events()
    parts = [[r for r in rows if r[0] == 0], [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 2], [r for r in rows if r[0] == 3]]
    got = run(spark, str(tmp_path), parts, "finals", ["2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 02:00:00", "2024-01-01 03:00:00"])
    done = {r.g for r in got.where("final").collect()}
    assert 0 in done and 3 not in done
    last = latest(got.where("g = 0")).collect()
    first = got.where("g = 0 and version = 1").drop("version", "final").collect()
    assert sorted(map(tuple, last)) == sorted(map(tuple, first))
