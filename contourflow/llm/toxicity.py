"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpointed, repaired

#: Labelled documents of each class that the model is fitted on, at most; those of the smallest id hashes.
SAMPLE = 8_000
#: Units (words and beginnings of words) that the model keeps, at most; those of the largest z.
UNITS = 50_000
#: Beginnings of words that back off for words that the sample hardly has.
STEMS = (7, 6, 5, 4)
#: Weight of the Dirichlet prior, in tokens; least z of a unit that counts; what every token costs.
PRIOR, LEAST_Z, DRIFT = 1_000.0, 3.0, 0.05
THRESHOLD = 0.3

_words = re.compile(r"[^\W\d_]+").findall


def tokens(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _words(text.lower())


def units(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time, by Ruzzo and Tompa.

    None can be extended or cut for a higher score, and they don't overlap.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []  # start, end, what is summed before the start and at the end
    link: list[int] = []  # the nearest segment to the left with less before its start
    for i in at.tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = link[j]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right))
                link.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], link[j:]
    return [(s, e, r - x) for s, e, x, r in found]


@dataclass(frozen=True)
class Model:
    """Scores of units; lam and log_k of the extreme-value law of clean documents' best scores; and the calibration."""

    scores: dict[str, float]
    lam: float
    log_k: float
    weights: tuple[float, ...]

    def token_scores(self, words: list[str]) -> np.ndarray:
        get = self.memo.get
        return np.array([x if (x := get(w)) is not None else self._score(w) for w in words]) - DRIFT

    @property
    def memo(self) -> dict[str, float]:
        return self.__dict__.setdefault("_memo", {})

    def _score(self, word: str) -> float:
        if len(self.memo) > 200_000:
            self.memo.clear()
        x = next((self.scores[u] for u in units(word) if u in self.scores), 0.0)
        self.memo[word] = x
        return x

    def passages(self, words: list[str]) -> list[tuple[int, int, float, float]]:
        """Toxic passages (start, end, score, evidence), in words; evidence: minus log of the chance that a clean text
        of this length has one that scores so high. Those whose evidence is at most log 2 are left out."""
        out = []
        for s, e, x in segments(self.token_scores(words)) if words else []:
            expected = math.exp(min(700.0, self.log_k + math.log(len(words)) - self.lam * x))
            chance = -math.expm1(-expected)
            evidence = -math.log(max(chance, 1e-300))
            if evidence > math.log(2):
                out.append((s, e, x, evidence))
        return out

    @staticmethod
    def features(found: list[tuple[int, int, float, float]]) -> tuple[float, float, float]:
        best = max((e for *_, e in found), default=0.0)
        return 1.0, math.log1p(best), math.log1p(sum(e for *_, e in found))

    def probability(self, found: list[tuple[int, int, float, float]]) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit_lam(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(lam * value)) = 1; the mean of values is negative."""
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        if float((shares * np.exp(np.minimum(700, mid * values))).sum()) < 1:
            low = mid
        else:
            high = mid
    return low


def _fit_logistic(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge; v are the weights of the rows."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (v * (p - y)) + 0.01 * w
        step = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def _chosen(docs: DataFrame, labels: DataFrame, use: Column) -> tuple[DataFrame, dict[bool, int]]:
    """Rows (text, toxic) of at most SAMPLE documents of each class, and how many documents have each label."""
    of = labels.where(use & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    of = checkpointed(of)
    labelled = {r.toxic: r["count"] for r in of.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    some = [of.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in ("toxic = 1", "toxic <> 1")]
    some = checkpointed(some[0].union(some[1]))
    # At most 2 * SAMPLE rows of two numbers are broadcast.
    rows = repaired(docs.where("text is not null").select("doc_id", "text")).join(F.broadcast(some), "doc_id")
    # Of rows that share a doc_id one counts, so that what is fitted on stays bounded.
    chosen = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", (F.col("toxic") == 1).alias("toxic"))
    return checkpointed(chosen), labelled


def fit(docs: DataFrame, labels: DataFrame, use: Column) -> Model:
    """Fits the model on labelled documents for which use (of doc_id) holds.

    Token log-odds have an informative Dirichlet prior: the frequencies over both classes. Duplicate labels of a
    document count once, the higher one; null labels don't count; of several texts of one doc_id the smallest counts. The calibration weights each class by its share of all
    labels, so chances don't depend on where SAMPLE cuts. Of no rows the model finds nothing and gives 0.5 at
    most. What comes to the driver is bounded: UNITS units, and three numbers for each document of the sample.
    """
    chosen, labelled = _chosen(docs, labels, use)

    def counted(parts):
        schema = pa.schema([("unit", pa.string()), ("toxic", pa.bool_()), ("n", pa.int64())])
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def out():
            for toxic, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([toxic] * len(own), pa.bool_()), pa.array(list(own.values()), pa.int64())], schema=schema)
                own.clear()

        for part in batches(parts, 4 << 20):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                for word, n in Counter(tokens(text)).items():
                    for u in units(word):
                        counts[toxic][u] += n
                    counts[toxic][""] += n  # the total
            if len(counts[True]) + len(counts[False]) > 500_000:
                yield from out()
        yield from out()

    counts = chosen.mapInArrow(counted, "unit string, toxic boolean, n bigint").groupBy("unit").agg(F.sum(F.expr("if(toxic, n, 0L)")).alias("t"), F.sum(F.expr("if(toxic, 0L, n)")).alias("c"))
    counts = checkpointed(counts)
    total = counts.where("unit = ''").first()
    if total is None or not total.t or not total.c:
        return Model({}, 1.0, 0.0, (-5.0, 0.0, 0.0))
    t, c = float(total.t), float(total.c)
    prior = F.lit(PRIOR) * (F.col("t") + F.col("c")) / F.lit(t + c)
    odds = lambda n, whole: F.log((F.col(n) + prior) / (F.lit(whole + PRIOR) - F.col(n) - prior))
    z = (odds("t", t) - odds("c", c)) / F.sqrt(1 / (F.col("t") + prior) + 1 / (F.col("c") + prior))
    kept = counts.where("unit <> ''").select("unit", (odds("t", t) - odds("c", c)).alias("d"), z.alias("z"), "c").where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "unit").limit(UNITS).collect()
    raw = Model({r.unit: r.d for r in kept}, 1.0, 0.0, (0.0, 0.0, 0.0))

    def measured(parts):
        for part in batches(parts, 4 << 20):
            best, sizes, values = [], [], []
            for text in part.column("text").to_pylist():
                words = tokens(text)
                s = raw.token_scores(words)
                best.append(max((x for *_, x in segments(s)), default=0.0))
                sizes.append(len(words))
                values.append([float(s.sum()), float(np.square(s).sum())])
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(best, pa.float64()), pa.array(sizes, pa.int64())], names=["toxic", "best", "size"])

    seen = chosen.where("not toxic").mapInArrow(measured, "toxic boolean, best double, size bigint").where("size > 0").collect()
    # Scores of clean tokens: what the kept units have there, all other tokens the drift alone.
    words = [(r.d - DRIFT, r.c) for r in kept if not r.unit.endswith("*")]
    values = np.array([v for v, _ in words] + [-DRIFT])
    shares = np.array([n for _, n in words] + [max(1.0, c - sum(n for _, n in words))])
    shares = shares / shares.sum()
    hits = [r for r in seen if r.best > 0]
    lam = _fit_lam(values, shares) if (values > 0).any() and float((values * shares).sum()) < 0 else 1.0
    lam = min(lam, 10.0)
    # The mean of an extreme-value law is (log(K n) + Euler's constant) / lam; texts without any segment have none.
    log_k = float(np.mean([lam * r.best - math.log(r.size) for r in hits])) - 0.5772156649 if hits else -10.0
    law = Model(raw.scores, lam, log_k, (0.0, 0.0, 0.0))

    def featured(parts):
        for part in batches(parts, 4 << 20):
            x = [law.features(law.passages(tokens(text))) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), *[pa.array([v[i] for v in x], pa.float64()) for i in range(3)]], names=["toxic", "x0", "x1", "x2"])

    rows = chosen.mapInArrow(featured, "toxic boolean, x0 double, x1 double, x2 double").collect()
    x, y = np.array([[r.x0, r.x1, r.x2] for r in rows]), np.array([float(r.toxic) for r in rows])
    # The sample holds a share of each class; the weights, 1 on average, give each its part of all labels again.
    v = np.where(y == 1, labelled[True] / max(1, min(SAMPLE, labelled[True])), labelled[False] / max(1, min(SAMPLE, labelled[False])))
    return Model(raw.scores, lam, log_k, _fit_logistic(x, y, v / v.mean()))


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted, n_passages, passages): each whole text's chance of being toxic.

    passages: array of (start, end, score, evidence), start and end in words. Null and empty texts, and those without
    letters, have none. Repeated rows each get a row; other columns of docs don't matter, whatever their names. A map over the rows; the model is broadcast, UNITS bounds it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.scores, model.lam, model.log_k, model.weights))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("evidence", pa.float64())]))

    def scored(parts):
        own = Model(*shared.value)
        for part in batches(parts, 4 << 20):
            p, found = [], []
            for text in part.column("text").to_pylist():
                passages = own.passages(tokens(text or ""))
                p.append(own.probability(passages))
                found.append([dict(zip(("start", "end", "score", "evidence"), x, strict=True)) for x in passages])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(p, pa.float64()), pa.array([int(x >= THRESHOLD) for x in p], pa.int32()), pa.array(list(map(len, found)), pa.int32()), pa.array(found, shape)],
                names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"],
            )

    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, n_passages int, passages array<struct<start:int,end:int,score:double,evidence:double>>"
    return repaired(docs.select("doc_id", held_out.alias("held_out"), "text")).mapInArrow(scored, schema)
