import json

import pytest
from contourflow.operators import candidates
from contourflow.plans import engine
from pyspark.sql import functions as F


def outlines(spark):
    square = lambda x, y, h: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    shapes = {0: (square(0.1, 0, 0.1), 0), 1: (square(0.1, 0.35, 0.05), 0), 2: (square(0.6, 0, 0.1), 1), 3: ([(0.0, 0.0), (0.1, 0.1)], 1), 4: (square(1.0, 0, 0.1), 2)}
    rows = [(g, c, ch, i, float(x), float(y)) for g in range(3) for c, (p, ch) in shapes.items() for i, (x, y) in enumerate(p)]
    return spark.createDataFrame(rows, "g bigint, c bigint, ch bigint, i int, x double, y double")


def test_segments_from_left_to_right(spark):
    got = engine.segment(outlines(spark), engine.oracle_scorer).where("g = 1").orderBy("pos").collect()
    assert [r.members for r in got] == [[0, 1], [2], [3]]  # the degenerate contour is gone and ids are dense


def test_evaluation_of_the_oracle_and_of_a_seeded_model(spark):
    r = engine.evaluate(outlines(spark), engine.oracle_scorer, [0.5]).first()
    assert (r.grouping_acc, r.char_split_rate, r.char_merge_rate, r.pair_f1) == (1, 0, 0, 1)
    rows = engine.evaluate(outlines(spark), thresholds=[0.0, 1.1]).orderBy("threshold").collect()
    assert rows[0].char_merge_rate == 1 and rows[1].char_merge_rate == 0


def test_payload(spark):
    p = outlines(spark)
    texts = p.select("g").distinct().withColumn("text", F.lit("Ag"))
    payload = json.loads(engine.export_json(p, texts, engine.oracle_scorer).where("g = 0").first().payload)
    assert [len(c) for c in payload["contours"]] == [4, 4, 4, 4] and payload["contours"][0][0] == [0.0, -0.1] and payload["timing_ms"] == {"preprocess": 0.0, "inference": 0.0}
    assert payload["text"] == "Ag" and len(payload["nodes"]["x"]) == len(payload["nodes"]["contour_id"]) and set(payload["edges"]["prob"]) <= {0.0, 1.0}


def test_merge_candidates(spark):
    contours = spark.createDataFrame([(0, c, c // 4, float(c)) for c in range(8)] + [(0, 8, 2, 20.0)], "g bigint, c bigint, ch bigint, cx double")
    pairs = spark.createDataFrame([(0, 0, 1, 0.9), (0, 3, 4, 0.4), (0, 7, 8, 0.2)], "g bigint, ca bigint, cb bigint, prob double")
    rows = candidates.merge_candidates(contours, pairs).collect()
    assert sorted(r.kind for r in rows) == ["cut"] * 6 + ["part"] * 2 + ["whole"] * 3
    for r in rows:
        assert r.left and r.right and not set(r.left) & set(r.right)
        assert r.label == int(r.kind == "cut")
    assert {(r.ch, r.link) for r in rows if r.kind == "whole"} == {(0, 0.4), (1, 0.4), (2, 0.2)}
    assert {r.link for r in rows if r.kind == "part" and r.ch == 0} == {0.0}


def test_options():
    with pytest.raises(ValueError):
        engine.CorpusOptions(aspect=(2.0, 1.0))
    assert engine.CorpusOptions().graph.knn == 8


def test_loss_of_a_model_against_numpy(spark):
    import numpy as np
    from contourflow.operators import graph, model

    points = outlines(spark)
    contours, nodes, edges = engine.build(points)
    probs = {(r.g, r.e): r.prob for r in model.model_scores(nodes, edges, graph.contour_features(contours), every=True).collect()}
    rows = edges.collect()
    assert len(probs) == len(rows)
    p, y = np.array([probs[r.g, r.e] for r in rows]), np.array([float(r.label) for r in rows])
    same = np.array([r.same for r in rows])
    p_t, a_t = p * y + (1 - p) * (1 - y), 0.25 * y + 0.75 * (1 - y)
    point = (-a_t * (1 - p_t) ** 2 * np.log(p_t) * np.where(same, 0.05, 1)).sum() / len(rows)
    got = engine.losses(points).first()
    assert got.point == pytest.approx(point, rel=1e-6) and got.loss == pytest.approx(0.5 * got.point + 0.5 * got.pair)
