"""Spelling variant grouping: words one inserted, deleted or replaced letter apart, each under its frequent form.

Two words are near if they agree once a letter is taken from one or both. Prefix and suffix polynomial hashes give the
hashes of a word without each of its letters at once, in NumPy; these are dealt by their top bits and sorted, and what
shares one is compared as strings.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, checkpointed, raw_text, stored

#: What a word is made of.
RUN = "[A-Za-zÀ-ÿ]"
LEAST_LETTERS, LEAST_TIMES, DELETE_ONE_IN, FORM_TIMES = 7, 2, 31, 10
#: Deletion keys to a bucket, about.
BUCKET_KEYS = 1 << 20
#: Different words that a task counts before it hands them on.
WORDS_HELD = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Where a key has its letter from: a place (replaced letters), or one of these.
WHOLE = -1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of_documents(docs: DataFrame, delete_one_in: int = DELETE_ONE_IN, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): how often each run of letters of least_letters or more occurs, A-Z lower-cased, all texts together.

    Of the runs whose crc32 of "doc_id:run" delete_one_in divides, the code point at crc32 % length is taken out first.
    Each task counts before anything is shuffled.
    """
    runs = re.compile(f"{RUN}{{{least_letters},}}")

    def mapped(parts):
        held: Counter[str] = Counter()
        for part in batches(parts, 4 << 20):
            for doc_id, raw in zip(part.column("id").to_pylist(), part.column("raw").to_pylist(), strict=True):
                head = crc32(f"{doc_id}:".encode())
                for run, n in Counter(runs.findall(raw.lower().decode())).items():
                    h = crc32(run.encode(), head)
                    if h % delete_one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_letters:
                            continue
                    held[run] += n
                if len(held) > WORDS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), raw_text().alias("raw"))
    return own.mapInArrow(mapped, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, key) of words of one length, a row of code points each.

    Of each word: a key without each letter, with its place, which words share that differ there (at: the place); a key
    of the whole word (at: WHOLE), and keys without a letter that equal it (at: -2 - place). Of a run of equal letters
    only the first is taken out for those, so that a word has each such key once.
    """
    rows, size = letters.shape
    x = letters.astype(np.uint64) + np.uint64(1)
    prefix, suffix = np.zeros((size + 1, rows), np.uint64), np.zeros((size + 1, rows), np.uint64)
    power = np.cumprod(np.append(np.uint64(1), np.full(size, _BASE)), dtype=np.uint64)
    for i in range(size):
        prefix[i + 1] = prefix[i] * _BASE + x[:, i]
    for i in reversed(range(size)):
        suffix[i] = x[:, i] * power[size - 1 - i] + suffix[i + 1]
    without = prefix[:-1] * power[size - 1 :: -1, None] + suffix[1:]
    place = np.arange(size)
    once = np.ones((size, rows), dtype=bool)
    once[1:] = (letters[:, 1:] != letters[:, :-1]).T
    lengths = _mixed(np.array([size, size - 1], np.uint64))
    replaced = _mixed(without ^ _mixed(place.astype(np.uint64) + np.uint64(1 << 32))[:, None] ^ lengths[0])
    taken, whole = _mixed(without ^ lengths[1])[once], _mixed(prefix[size] ^ lengths[0])
    row = np.broadcast_to(np.arange(rows), (size, rows))
    at = np.broadcast_to(place[:, None], (size, rows))
    return np.concatenate([row.ravel(), row[once], np.arange(rows)]), np.concatenate([at.ravel(), -2 - at[once], np.full(rows, WHOLE)]), np.concatenate([replaced.ravel(), taken, whole])


def keyed(words: DataFrame) -> DataFrame:
    """(key, id, at): the deletion keys of each word; id is the word's hash, in place of the word itself."""

    def mapped(parts):
        for part in batches(parts, 1 << 17):
            ids = part.column("id").to_numpy()
            texts = part.column("word").to_pylist()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                step = max(1, 400_000 // size)
                for k in range(0, len(own), step):
                    some = own[k : k + step]
                    letters = np.frombuffer("".join([texts[i] for i in some.tolist()]).encode("utf-32-le"), np.uint32).reshape(len(some), size)
                    row, at, key = deletion_keys(letters)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[some][row]), pa.array(at.astype(np.int32))], names=["key", "id", "at"])

    return words.select(F.xxhash64("word").alias("id"), "word").mapInArrow(mapped, "key bigint, id bigint, at int")


def shared(keys: DataFrame, buckets_log2: int) -> DataFrame:
    """(id, at) of the keys that more than one row has: dealt by their top bits, sorted within."""

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key)
        same = np.concatenate([[False], key[order][1:] == key[order][:-1], [False]])
        return table.select(["id", "at"]).take(pa.array(order[same[1:] | same[:-1]]))

    bucket = F.shiftrightunsigned("key", 64 - buckets_log2) if buckets_log2 else F.lit(0).cast("bigint")
    return keys.select(bucket.alias("bucket"), "key", "id", "at").groupBy("bucket").applyInArrow(run, "id bigint, at int")


def near_words(words: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(word, n_near, near_n, near): of each word (word, n) that has near words their number, and that of largest n, ties
    to the smaller word.

    What agrees without a letter is grouped by the very strings. Words that share all but the letter at one place, or a
    word that is left of others without a letter, are as many as there are letters to put at a place (times places), so
    no group grows with the input; of a group only its first words are passed on, never its pairs.
    """
    total = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    found = shared(keyed(words), max(0, int(total // bucket_keys).bit_length()))
    rows = found.join(words.select(F.xxhash64("word").alias("id"), "word", "n"), "id").where(F.col("at") < F.length("word"))
    place = F.when(F.col("at") >= 0, F.col("at")).when(F.col("at") < WHOLE, -2 - F.col("at"))
    left = F.when(place.isNull(), F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, if(at >= 0, at, -2 - at))"), F.expr("substring(word, if(at >= 0, at, -2 - at) + 2)")))
    rows = rows.select(F.greatest("at", F.lit(WHOLE)).alias("at"), left.alias("left"), F.struct((F.col("at") != WHOLE).alias("taken"), (-F.col("n")).alias("less"), "word").alias("x"))
    groups = rows.groupBy("at", "left").agg(F.array_sort(F.collect_set("x")).alias("x")).where(F.size("x") > 1)
    groups = groups.select("at", (F.size("x").cast("bigint") - 1).alias("others"), F.col("x")[0].alias("one"), F.col("x")[1].alias("two"), F.explode("x").alias("own"))
    # Of a replaced letter all are near each other; else only the whole word and each of those with a letter more.
    groups = groups.where((F.col("at") >= 0) | ~F.col("one.taken"))
    first = F.col("own.word") == F.col("one.word")
    near = F.when(first, F.struct("two.less", "two.word")).otherwise(F.struct("one.less", "one.word"))
    each = groups.select(F.col("own.word").alias("word"), F.when((F.col("at") >= 0) | first, F.col("others")).otherwise(1).alias("k"), near.alias("near"))
    out = each.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("near").alias("near"))
    return out.select("word", "n_near", (-F.col("near.less")).alias("near_n"), F.col("near.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form: the last that forms lead to. Pointers are doubled until all are there; a
    form occurs several times as often as its word, so no chain is longer than the logarithm of the counts."""
    up = checkpointed(forms.select("word", F.col("form").alias("root")))
    moved = True
    while moved:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("over"))
        up = checkpointed(up.join(on, "root", "left").select("word", F.coalesce("over", "root").alias("root"), F.col("over").isNotNull().alias("moved")))
        moved = not up.where("moved").isEmpty()
        up = up.drop("moved")
    return up


def group_variants(words: DataFrame, form_times: int = FORM_TIMES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row (word, n), words being distinct.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. form is the near word of
    largest n, ties to the smaller in code-point order, if that n is form_times the word's or more, else null; root is
    what forms lead to in the end, the word itself without one; form_n is the form's n or null.

    Null and empty words go; words may have any length. An empty table gives none.
    """
    words = stored(words.where("word <> ''").select("word", "n"))
    found = stored(words.join(near_words(words, bucket_keys), "word", "left"))
    close = F.col("near_n") >= form_times * F.col("n")
    out = found.select("word", F.when(close, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(close, F.col("near_n")).alias("form_n"))
    return out.join(roots(out.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def corpus_variants(docs: DataFrame, least_times: int = LEAST_TIMES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """group_variants of the words of docs that occur least_times or more.

    Texts are read whole, whatever their length; a null text has no words; bytes that aren't UTF-8 count as replacement
    characters, which no word holds. A row without doc_id counts with an empty id. Repeated rows count each. Other columns
    don't matter.
    """
    return group_variants(words_of_documents(docs).where(F.col("n") >= least_times), bucket_keys=bucket_keys)
