import random

import numpy as np
from contourflow.llm import toxicity
from contourflow.llm.common import id_remainder
from pyspark.sql import functions as F


def slow_segments(x):
    """By definition: take the best segment, then the same left and right of it."""

    def best(lo, hi):
        found = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += x[j]
                if total > 1e-12 and (found is None or total > found[0] + 1e-9):
                    found = (total, i, j + 1)
        return found

    out, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        if b := best(lo, hi):
            out.append((b[1], b[2]))
            todo += [(lo, b[1]), (b[2], hi)]
    return sorted(out)


def test_segments_against_definition():
    rng = random.Random(4)
    for _ in range(200):
        x = np.array([rng.choice([-1, 1]) * rng.random() for _ in range(rng.randrange(14))])
        got = toxicity.segments(x)
        assert [(s, e) for s, e, _ in got] == slow_segments(list(x))
        assert all(abs(v - x[s:e].sum()) < 1e-9 for s, e, v in got)


def made(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(60)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vilezz", "vilezzen", "badqx"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    rows, marks = made(random.Random(1), 800)
    extra = [(9000, None), (9001, ""), (9002, "1234 !!"), (9002, "1234 !!"), (None, "the of"), (9003, "the of " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows + extra], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([*marks, (5, 1, None), (None, 1, 1), (5, 0, 0), (77777, 1, 1)], "doc_id bigint, quality int, toxic int")
    held = id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.score(docs, model, held).collect()
    assert len(got) == len(rows) + len(extra)
    want = {i: t for i, _, t in marks}
    own = [(want[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in want]
    assert sum(a == b for a, b in own) / len(own) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.n_passages == len(r.passages) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id is None or r.doc_id >= 9000)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert [r.predicted for r in toxicity.score(docs, model, F.lit(False)).collect()] == [0]
    assert toxicity.score(docs.limit(0), model, F.lit(False)).count() == 0


def test_base_rate_does_not_depend_on_where_the_sample_is_cut(spark, monkeypatch):
    rows, marks = made(random.Random(2), 1500)
    # Toxic words in clean texts too, so that the classes overlap; an eighth of the labels is toxic.
    rng = random.Random(3)
    rows = [(i, t if y else t + " vilezz badqx" * rng.choice([0, 0, 1])) for (i, t), (_, _, y) in zip(rows, marks, strict=True)]
    keep = [i for (i, _, y) in marks if not y or i % 3 == 0]
    docs = spark.createDataFrame([rows[i] for i in keep], "doc_id bigint, text string")
    labels = spark.createDataFrame([marks[i] for i in keep], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE", 140)
    mean = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)), F.lit(False)).agg(F.avg("score")).first()[0]
    assert abs(mean - sum(marks[i][2] for i in keep) / len(keep)) < 0.04
