import math
import random

from contourflow.llm import kdsearch
from pyspark.sql import functions as F


def slow(rows, every, k):
    vec = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in vec:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(vec[q], vec[i])), i) for i in vec if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, every, k=5, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, v string")
    vectors = df.select("vec_id", kdsearch.integers(F.col("embedding")).alias("v"))
    return sorted(tuple(r) for r in kdsearch.top_k(vectors, vectors.where(f"vec_id % {every} = 0"), k, **more).collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.125, 1.0]) if i % 3 else rng.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    rows += [(i, [0.5] * 6) for i in range(700, 1000)] + [(1000, None), (1050, [0.1, None, 0.2]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (None, [1.0] * 6)]
    want = slow(rows, 50, 5)
    assert run(spark, rows, 50) == want
    assert run(spark, rows, 50, shard_rows=150, block_rows=4) == want


def test_small_and_large_values(spark):
    rows = [(0, [1e9, -2e9]), (1, [2e9, 1e9]), (50, [3e9, 3e9]), (2, [0.0, 0.0])]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    big = slow(rows, 50, 5)
    assert run(spark, rows, 50) == [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in big]
    assert run(spark, [], 50) == [] and run(spark, [(0, [1.0])], 50) == [] and run(spark, [(0, []), (3, [])], 50) == [(0, 1, 3, 0)]


def test_tree_is_exact_below_a_floor():
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (2000, 4)).astype(float)
    tree = kdsearch.KDTree(v, np.arange(2000), leaf=16)
    for q in rng.integers(-50, 50, (20, 4)).astype(float):
        s = v @ q
        want = sorted(((int(x), i) for i, x in enumerate(s)), key=lambda x: (-x[0], x[1]))[:5]
        assert tree.search(q, -1, 5, None) == want
        assert tree.search(q, -1, 5, want[4][0]) == want


def test_repeated_rows_are_rows_and_equal_the_sql(spark):
    import duckdb
    import pandas as pd
    from contourflow.llm import sql

    rng = random.Random(3)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.25, 1.0]), (50, [0.0, 1.0]), (50, [1.0, 1.0])]
    rows += [(60 + i % 40, [float(rng.randrange(-4, 5)), 0.5]) for i in range(200)] + [(100, [2.0, 2.0])] * 300
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841  DuckDB reads it by name
    want = sorted(duckdb.sql(sql.TOP_K).fetchall())
    assert run(spark, rows, 50) == want and run(spark, rows, 50, shard_rows=40, block_rows=3) == want


def test_boxes_spare_shards_of_clustered_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.05, 8) + 4 * np.eye(8)[i % 8])]) for i in range(1600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").select("vec_id", kdsearch.integers(F.col("embedding")).alias("v"))
    shards = kdsearch.sharded(df.checkpoint() if spark.sparkContext.getCheckpointDir() else df, 100)
    sizes = [r["count"] for r in shards.groupBy("shard").count().collect()]
    assert sum(sizes) == 1600 and max(sizes) <= 130
    assert run(spark, rows, 50, shard_rows=100) == slow(rows, 50, 5)
