"""Prediction by partial matching: code length of each document under a byte-context trie trained on the corpus."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, raw_text, release, repaired, stored, words_of

#: Bytes of context at most.
ORDER = 5
#: Ends a document; its token is the empty word. Words end in a space.
END = b"\n"
_EIGHT = np.uint64(8)


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def serial(words: list[bytes]) -> bytes:
    """The bytes that the model predicts: each word and a space, then the end."""
    return (b" ".join(words) + b" " if words else b"") + END


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER + 1 bytes at each predicted byte, and where each text's begin.

    Before its first byte a text has a context of end bytes.
    """
    pad = END * ORDER
    x = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    g = x.astype(np.uint64)
    for back in range(1, ORDER + 1):
        g[back:] |= x[:-back].astype(np.uint64) << np.uint64(8 * back)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    keep = np.ones(len(x), bool)
    keep[(starts[:, None] + np.arange(ORDER)).ravel()] = False
    return g[keep], np.cumsum(sizes) - sizes


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


_COUNTED = pa.schema([("b", pa.int64()), ("word", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


def _counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and grams of a block of documents, and how often its training rows have them, maybe never."""
    words: dict[bool, Counter] = {True: Counter({b"": 0}), False: Counter({b"": 0})}
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    block = None
    for part in batches(parts, 1 << 20):
        block = part.column("b")[0].as_py() if part.num_rows else block
        held = part.column("held_out").to_pylist()
        own = [words_of(raw) for raw in part.column("_raw").to_pylist()]
        for is_held in (True, False):
            some = [w for w, h in zip(own, held, strict=True) if h == is_held]
            if not some:
                continue
            for w in some:
                words[is_held].update(w)
            words[is_held][b""] += len(some)
            u, n = np.unique(grams([serial(w) for w in some])[0], return_counts=True)
            seen.append((u, n * (not is_held)))
        if sum(len(x) for x, _ in seen) > 2_000_000:
            seen = [_summed(np.concatenate([x for x, _ in seen]), np.concatenate([x for _, x in seen]))]
    known = words[False]
    known.update(dict.fromkeys(words.pop(True), 0))
    while known:  # a part at a time, so that what is sent is no longer held
        keys, counts = zip(*[known.popitem() for _ in range(min(len(known), 65_536))], strict=True)
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(keys, pa.binary()).cast(pa.string()), pa.nulls(n, pa.int64()), pa.array(counts, pa.int64())], schema=_COUNTED)
    if seen:
        u, n = _summed(np.concatenate([x for x, _ in seen]), np.concatenate([x for _, x in seen]))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(block, pa.int64()), len(u)), pa.nulls(len(u), pa.string()), pa.array(u.view(np.int64)), pa.array(n)], schema=_COUNTED)


class Trie:
    """Nodes of the depths 0 to ORDER over some training grams, sorted by context.

    Depths below shared come from grams counted over the whole corpus (low, by depth); the deeper ones from the grams
    given here, which hold every training gram of each of their contexts of that depth.
    """

    def __init__(self, top: np.ndarray, counts: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]):
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        gram, count = _summed(top, counts)
        for k in range(ORDER, len(low) - 1, -1):
            gram, count = _summed(gram & _mask(k + 1), count)
            levels.append((gram, count))
        self.at = []
        below = None
        for k, (gram, count) in enumerate([*low, *levels[::-1]]):
            count = count.astype(np.float64)
            contexts = gram >> _EIGHT
            start = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(gram) else np.empty(0, np.int64)
            add = (lambda x, s=start: np.add.reduceat(x, s)) if len(start) else (lambda x: np.empty(0))
            # What these bytes weigh in the node of the next shorter context.
            weight = below[1][np.searchsorted(below[0], gram & _mask(k))] if k and len(gram) else np.zeros(len(gram))
            self.at.append((contexts[start], add(count), np.diff(np.append(start, len(gram))).astype(np.float64), add(weight), gram, count))
            below = (gram, count)

    def log10(self, u: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after its others.

        From the longest context that the trie holds: a byte seen c of T times among D distinct ones has c / (T + D),
        escape D / (T + D); bytes of the context left are excluded from T and D. At last the bytes never seen at all
        share what is left alike.
        """
        out = np.zeros(len(u))
        rest = np.arange(len(u))
        mass, kinds = np.zeros(len(u)), np.zeros(len(u))
        for k in range(ORDER, -1, -1):
            contexts, total, distinct, weight, gram, count = self.at[k]
            if not len(contexts) or not len(rest):
                continue
            own = u[rest]
            context = (own >> _EIGHT) & _mask(k)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            here = contexts[at] == context
            t, d = total[at] - mass[rest], distinct[at] - kinds[rest]
            g = own & _mask(k + 1)
            to = np.minimum(np.searchsorted(gram, g), len(gram) - 1)
            hit = here & (gram[to] == g)
            out[rest[hit]] += np.log10(count[to[hit]] / (t[hit] + d[hit]))
            left = here & ~hit
            escape = left & (d > 0)
            out[rest[escape]] += np.log10(d[escape] / (t[escape] + d[escape]))
            mass[rest[left]], kinds[rest[left]] = weight[at[left]], distinct[at[left]]
            rest = rest[~hit]
        out[rest] -= np.log10(256 - kinds[rest])
        return out


class Lookup:
    """Values of distinct grams by an open table of slots; grams that lost their slot are searched for."""

    def __init__(self, u: np.ndarray, p: np.ndarray):
        order = np.argsort(u)
        self.u, self.p = np.append(u[order], np.uint64(0)), np.append(p[order], 0.0)
        bits = min(22, max(4, 1 + len(u).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.at = np.full(1 << bits, len(u), dtype=np.int32)
        self.at[self._slot(self.u[:-1])] = np.arange(len(u), dtype=np.int32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = self.at[self._slot(g)]
        if len(miss := np.flatnonzero(self.u[at] != g)):
            at[miss] = np.searchsorted(self.u[:-1], g[miss])
        return self.p[at]


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, v): log10 of the probability of each gram's last byte; counts has each gram once with its training count n.

    Grams are dealt by the last two bytes of their context, so that a task has every context of depth two or more of its
    grams whole. Of depths 0 and 1 there are 65,536 counts at most; they go to all tasks.
    """
    pairs = counts.where("n > 0").groupBy(F.expr("gram & 65535").alias("g")).agg(F.sum("n").alias("n")).collect()
    one = _summed(np.array([r.g for r in pairs], dtype=np.uint64), np.array([r.n for r in pairs], dtype=np.int64))
    low = [_summed(one[0] & _mask(1), one[1]), one]
    n_parts = max(16, math.ceil(counts.count() / 250_000))
    shared = counts.sparkSession.sparkContext.broadcast(low)

    def scored(group: pa.Table) -> pa.Table:
        u, n = group.column("gram").to_numpy().view(np.uint64), group.column("n").to_numpy()
        trie = Trie(u[n > 0], n[n > 0], shared.value)
        return pa.table({"gram": u.view(np.int64), "v": trie.log10(u)})

    dealt = counts.select(F.pmod(F.xxhash64(F.expr("(gram >> 8) & 65535")), F.lit(n_parts)).alias("part"), "gram", "n")
    return dealt.groupBy("part").applyInArrow(scored, "gram bigint, v double")


def score_documents(docs: DataFrame, held_out: Column, block_bytes: int = 24 << 20, least_blocks: int = 12) -> DataFrame:
    """Scores every text under a model of the rows that aren't held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (of single words) and score: log10 of the
    probability that the trie gives the text, its words lower-cased and parted by single spaces, with its end. Each row
    gets its row, repeated or not; null texts are empty, one end token. Texts of any length are taken whole. Without
    training rows all bytes are alike; an empty table gives none. Equal texts score alike, whatever their id. Other
    columns of docs don't matter, whatever their names. Repeated rows of one id are in one block, which one task holds.

    Documents are dealt into blocks of about block_bytes by a hash of their id. Each block counts its words and grams,
    the counts are summed by key, every distinct gram is scored once for the corpus, and the values go back to the blocks
    that have the key. So what is gathered grows with the corpus, and no part of it is broadcast or cut.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = repaired(docs)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(least_blocks, math.ceil(n_bytes / block_bytes))
    block = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n_blocks)).cast("bigint")
    blocks = docs.select(block.alias("b"), "doc_id", held_out.alias("held_out"), raw_text().alias("_raw"))
    asked = stored(blocks.groupBy("b").applyInArrow(_counted, "b bigint, word string, gram bigint, n bigint"))
    release(spark)
    words = stored(asked.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.where("n > 0").agg(F.sum("n"), F.count("*")).first()
    n, whole = total[0] or 0, math.log10((total[0] or 0) + 0.1 * (total[1] + 1))
    values = stored(gram_scores(stored(asked.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")))))
    release(spark)
    lent = asked.where("word is not null").select("b", "word").join(words, "word").select("b", F.col("word").cast("binary").alias("word"), F.lit(None).cast("bigint").alias("gram"), F.col("n").cast("double").alias("v"))
    lent = lent.unionByName(asked.where("gram is not null").select("b", "gram").join(values, "gram").select("b", F.lit(None).cast("binary").alias("word"), "gram", "v"))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[bytes, float] = {}
        u, v = [np.empty(0, np.uint64)], [np.empty(0)]
        for part in right.select(["word", "gram", "v"]).to_batches(max_chunksize=65_536):
            is_word = pc.is_valid(part.column("word"))
            logs = np.log10(part.column("v").filter(is_word).to_numpy(zero_copy_only=False) + 0.1)  # of a word's count
            known.update(zip(part.column("word").filter(is_word).to_pylist(), logs.tolist(), strict=True))
            rest = pc.invert(is_word)
            u.append(part.column("gram").filter(rest).to_numpy(zero_copy_only=False).view(np.uint64))
            v.append(part.column("v").filter(rest).to_numpy(zero_copy_only=False))
        del right
        lookup = Lookup(np.concatenate(u), np.concatenate(v))
        del u, v
        floor = math.log10(0.1)
        end = known.get(b"", floor)
        out: list[list] = [[], [], [], []]
        for part in batches(left.select(["_raw"]).to_batches(), 1 << 20):
            some = [words_of(raw) for raw in part.column("_raw").to_pylist()]
            g, at = grams([serial(w) for w in some])
            out[3].append(np.add.reduceat(lookup(g), at))
            for w in some:
                p = np.fromiter(map(known.get, w, repeat(floor)), np.float64, len(w))
                out[0].append(len(w) + 1)
                out[1].append(int((p > floor + 1e-9).sum()) + (end > floor + 1e-9))
                out[2].append(float(p.sum()) + end - (len(w) + 1) * whole)
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(out[0], pa.int64()), "n_known": pa.array(out[1], pa.int64()),
            "train_tokens": pa.repeat(pa.scalar(n, pa.int64()), left.num_rows), "base_score": pa.array(out[2], pa.float64()), "score": pa.array(np.concatenate([*out[3], np.empty(0)])),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return blocks.groupBy("b").cogroup(lent.groupBy("b")).applyInArrow(scored, schema)
