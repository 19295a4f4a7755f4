"""Language identification: n-gram presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import batches, checkpointed, repaired

#: Labelled documents that the classifier is fitted on, at most: as many of each language, those of the smallest id hashes.
SAMPLE = 3_000
#: Documents of the sample that serve as landmarks; ridge; n-grams are of 1 to this many letters.
LANDMARKS, RIDGE, BLEND = 160, 1e-2, 3
UNKNOWN = "und"
_SLOTS = 1 << 16
_letters = np.array([chr(i).isalpha() for i in range(0x10000)])
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def presence(text: str) -> np.ndarray | None:
    """The slots of the n-grams that occur in the lower-cased text, runs of other characters as one space; None without
    letters. An n-gram's slot is a hash of its code points."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    low = cp < 0x10000
    letter = _letters[np.where(low, cp, 0)]
    if not low.all():
        far = np.flatnonzero(~low)
        own, inverse = np.unique(cp[far], return_inverse=True)
        letter[far] = np.array([chr(c).isalpha() for c in own.tolist()])[inverse]
    if not letter.any():
        return None
    cp = np.where(letter, cp, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    cp = np.concatenate([np.array([32], np.uint32), cp[keep]])
    if cp[-1] != 32:
        cp = np.append(cp, np.uint32(32))
    seen = np.zeros(_SLOTS, dtype=bool)
    h = cp * _MULT[0]
    seen[((h ^ (h >> 13)) * _MULT[1]) >> 16] = True
    for n in range(1, BLEND):
        h = (h[:-1] * _MULT[2] + np.uint32(n)) ^ (cp[n:] * _MULT[0])
        seen[((h ^ (h >> 13)) * _MULT[1]) >> 16] = True
    return np.flatnonzero(seen)


@dataclass(frozen=True)
class Classifier:
    """Classes; for each slot its column among the landmarks' n-grams (the last if none has it); the landmarks' presence
    by column, scaled; and the weight of each landmark for each class."""

    classes: list[str]
    column: np.ndarray
    landmarks: np.ndarray
    alpha: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Shared n-grams of each text with each landmark, over the root of the product of their numbers."""
        width = len(self.landmarks)
        x = np.zeros((len(sets), width + 1), dtype=np.float32)
        for row, own in enumerate(sets):
            x[row, self.column[own]] = 1
        sizes = np.array([max(1, len(s)) for s in sets], dtype=np.float32)
        return (x[:, :width] @ self.landmarks) / np.sqrt(sizes)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        sets = [presence(t) if t else None for t in texts]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, s in enumerate(sets) if s is not None]
        if at and self.classes:
            f = self.kernel([sets[i] for i in at]) @ self.alpha
            p = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            for i, k, v in zip(at, f.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                names[i], scores[i] = self.classes[k], min(1.0, float(v))
        return names, scores


def chosen(own: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, lang, weight) of a sample of at most most documents of own, as many of each language.

    The languages are all that occur, or the most most frequent. Of each the documents of the smallest id hashes are
    drawn, repeated rows once; weight is how many documents of the language each stands for. What is shuffled is one
    row for each language, and about twice the sample: larger hashes go before.
    """
    found = own.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    found = checkpointed(found)
    each = max(1, most // max(1, found.count()))
    place = F.xxhash64("doc_id")
    some = own.join(F.broadcast(found), "lang").where((place / F.lit(2.0**64) + 0.5) * F.col("n") <= 4 * each + 40).select("lang", "doc_id", "n").distinct()
    by = Window.partitionBy("lang").orderBy(place, "doc_id")
    some = some.withColumn("place", F.row_number().over(by)).where(F.col("place") <= each)
    taken = some.groupBy("lang").agg(F.count("*").alias("taken"))
    return checkpointed(some.join(F.broadcast(taken), "lang").select("doc_id", "lang", (F.greatest("n", "taken") / F.col("taken")).alias("weight")))


def fit(docs: DataFrame, use: Column) -> Classifier:
    """Fits on rows for which use holds and whose doc_id, text and lang aren't null.

    The sample is bounded by SAMPLE, texts of any length; a language however rare is in it. What comes to the driver is
    the n-grams of each document, at most as many as there are slots. Of a document with several texts the smallest
    counts, ties of hashes go to the smaller doc_id. The first documents, language by
    language in turn, are the landmarks. The kernel of all sample documents with the landmarks (Nyström's approximation)
    is regressed on +1 for the own language, -1 for others, each language weighing its share of all rows, with a ridge
    in the landmarks' own kernel. Of no rows, every text is UNKNOWN.
    """
    own = docs.where(use & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    own = repaired(own)
    texts = own.join(F.broadcast(chosen(own)), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"), F.first("weight").alias("weight"))

    def mapped(parts):
        for part in batches(parts, 4 << 20):
            sets = [presence(t) for t in part.column("text").to_pylist()]
            packed = [None if x is None else x.astype(np.uint16).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("place", "id", "lang", "weight")], pa.array(packed, pa.binary())], names=["place", "id", "lang", "weight", "slots"])

    rows = texts.select(F.xxhash64("doc_id").alias("place"), F.col("doc_id").cast("string").alias("id"), "lang", "weight", "text").mapInArrow(mapped, "place bigint, id string, lang string, weight double, slots binary")
    rows = sorted(rows.where("slots is not null").collect(), key=lambda r: (r.place, r.id, r.lang))
    sample = [(np.frombuffer(r.slots, np.uint16).astype(np.int64), r.lang) for r in rows]
    weight = np.array([r.weight for r in rows])
    weight = weight / max(1e-9, weight.mean()) if len(weight) else weight
    classes = sorted({g for _, g in sample})
    by = {g: [s for s, x in sample if x == g] for g in classes}
    marks = [by[g][i] for i in range(LANDMARKS) for g in classes if i < len(by[g])][:LANDMARKS]
    if not marks:
        return Classifier([], np.zeros(_SLOTS, np.int32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    slots = np.unique(np.concatenate(marks))
    column = np.full(_SLOTS, len(slots), dtype=np.int32)
    column[slots] = np.arange(len(slots))
    scaled = np.zeros((len(slots), len(marks)), dtype=np.float32)
    for j, s in enumerate(marks):
        scaled[column[s], j] = 1 / np.sqrt(len(s))
    plain = Classifier(classes, column, scaled, np.zeros((len(marks), len(classes)), np.float32))
    k = np.concatenate([plain.kernel([s for s, _ in sample[i : i + 256]]) for i in range(0, len(sample), 256)]).astype(np.float64)
    k_mm = plain.kernel(marks).astype(np.float64)
    y = np.array([[1.0 if g == c else -1.0 for c in classes] for _, g in sample])
    kw = k * weight[:, None]
    alpha = np.linalg.solve(kw.T @ k + RIDGE * len(sample) / 10 * k_mm + 1e-6 * np.eye(len(marks)), kw.T @ y)
    return Classifier(classes, column, scaled, alpha.astype(np.float32))


def predict(docs: DataFrame, model: Classifier, held_out: Column | None = None, keep_all: bool = False) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), or with keep_all docs with lang_pred and score added.

    Null texts and texts without any letter are UNKNOWN with score 0. Whole texts are read; repeated rows each get a row.
    Of languages of equal value the first by name is predicted. Columns lang_pred and score of docs are replaced.
    A map over the rows; the model that is broadcast is bounded by LANDMARKS and the number of slots.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.column, model.landmarks, model.alpha))
    own = docs if keep_all else docs.select("doc_id", held_out.alias("held_out"), "text")
    own = repaired(own.drop("lang_pred", "score"))

    def mapped(parts):
        classifier = Classifier(*shared.value)
        for part in batches(parts, 2 << 20):
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                names, scores = classifier.predict(some.column("text").to_pylist())
                kept = [(n, some.column(n)) for n in some.schema.names if keep_all or n != "text"]
                yield pa.RecordBatch.from_arrays([*[c for _, c in kept], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*[n for n, _ in kept], "lang_pred", "score"])

    fields = [f for f in own.schema if keep_all or f.name != "text"]
    return own.mapInArrow(mapped, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
