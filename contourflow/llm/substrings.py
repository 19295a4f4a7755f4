"""Substring dedup: runs of words that a document of smaller id holds too are cut out.

Windows of a fixed number of words are dealt to shards by the least hash of the word groups in them, so that equal windows
meet; the text around them goes along. Each shard builds an FM-index over a wavelet matrix of its texts and streams the
texts through it by backward search: the matching statistics, cut at the window's length, and the smallest document of
each interval tell which windows repeat.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, raw_text, stored

WINDOW = 50
#: Words of a group; a window's least group decides its shard.
GROUP = 20
#: Windows of one segment at most: a text of one repeated word has equal groups everywhere.
LONGEST = 64
#: Bytes of text to a shard's index, about.
SHARD_BYTES = 2_500_000
#: A key of more different segments than this is settled window by window.
HOT = 2_048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Hashes:
    """64-bit hashes of words, remembered up to a bound, and of groups of words."""

    def __init__(self, most: int = 500_000):
        self.memo: dict[bytes, int] = {}
        self.most = most
        self.powers = np.ones(1, np.uint64)
        self.back = np.ones(1, np.uint64)

    def words(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > self.most:
            self.memo = {}
        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def groups(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of size words, rolled: differences of prefix sums, scaled back."""
        n = len(hashes)
        if n < size:
            return np.empty(0, np.uint64)
        if len(self.powers) < n:
            most = 2 * n
            self.powers, self.back = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[:n], dtype=np.uint64)])
        return _mixed((sums[size:] - sums[:-size]) * self.back[: n - size + 1])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each width neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


def segments(hashes: Hashes, words: list[bytes], window: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of the runs of windows that have one least group, at most LONGEST windows each."""
    groups = hashes.groups(hashes.words(words), group)
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    keys = least_of(groups, window - group + 1)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(keys)))
    parts = -(-sizes // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(starts, parts) + nth * LONGEST
    count = np.minimum(np.repeat(sizes, parts) - nth * LONGEST, LONGEST)
    return keys[first].view(np.int64), first.astype(np.int32), count.astype(np.int32)


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one bit vector for each bit of a symbol, packed, with counts by 64-bit word."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.n = len(symbols)
        self.levels = []
        for bit in reversed(range(max(1, int(largest).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=bool)
            padded[: self.n] = ones
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((bit, packed, before, self.n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(largest + 1)
        self.starts = self._place(every, np.zeros_like(every))

    def _place(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, packed, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> bit & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._place(symbols, at) - self.starts[symbols]


class Index:
    """FM-index of texts (arrays of symbols from 1), for matches of up to depth symbols.

    Kept are the wavelet matrix of the transformed texts, the symbols' counts, where suffixes begin to differ within
    depth - 1 symbols, and of each group that agrees in depth symbols the least value of its texts; the suffix array
    is made only to build them.
    """

    def __init__(self, texts: list[np.ndarray], values: np.ndarray, depth: int):
        self.depth = depth
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        symbols = np.zeros(int(sizes.sum()), dtype=np.int64)
        ends = np.cumsum(sizes) - 1
        inside = np.ones(len(symbols), dtype=bool)
        inside[ends] = False
        symbols[inside] = np.concatenate(texts) if texts else []
        largest = int(symbols.max(initial=0))
        order, ranks = self._suffixes(symbols, ends, int(sizes.max(initial=1)))
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        self.matrix = WaveletMatrix(symbols[order - 1], largest)  # before the first symbol: the last end, a 0 too
        shallow, deep = (self._differs(order, ranks, d) for d in (depth - 1, depth))
        at = np.arange(len(order))
        self.first = np.maximum.accumulate(np.where(shallow, at, 0)).astype(np.int32)
        starts = np.flatnonzero(shallow)
        self.last = np.append(starts[1:], len(order))[np.cumsum(shallow) - 1].astype(np.int32)
        self.block = (np.cumsum(deep) - 1).astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), sizes)[order]
        self.least = np.minimum.reduceat(values[owner], np.flatnonzero(deep)) if len(order) else values

    def _suffixes(self, symbols: np.ndarray, ends: np.ndarray, longest: int):
        """Order of the suffixes by doubling, and their ranks by 1, 2, 4 .. symbols. Each text's end is a symbol of its
        own, smaller than all others, so that no two suffixes agree beyond one."""
        n = len(symbols)
        key = symbols + len(ends)
        key[ends] = np.arange(len(ends))
        ranks, size = [], 1
        while True:
            order = np.argsort(key, kind="stable")
            changes = np.empty(n, dtype=bool)
            changes[:1], sorted_ = False, key[order]
            changes[1:] = sorted_[1:] != sorted_[:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(changes)
            ranks.append(rank.astype(np.int32))
            if size >= longest or n == 0 or rank[order[-1]] == n - 1:
                return order, ranks
            beyond = np.zeros(n, dtype=np.int64)
            beyond[: max(0, n - size)] = rank[size:] + 1
            key = rank * (n + 1) + beyond
            size *= 2

    def _differs(self, order: np.ndarray, ranks: list[np.ndarray], depth: int) -> np.ndarray:
        """Where a suffix differs from the one before within depth symbols: two overlapping powers of two tell."""
        power = min(depth.bit_length() - 1, len(ranks) - 1)
        a, b, out = order[1:], order[:-1], np.ones(len(order), dtype=bool)
        same = ranks[power][a] == ranks[power][b]
        more = np.flatnonzero(same)
        shift = depth - (1 << power)
        same[more] = ranks[power][np.minimum(a[more] + shift, len(order) - 1)] == ranks[power][np.minimum(b[more] + shift, len(order) - 1)]
        out[1:] = ~same
        return out

    def extended(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of what the intervals stand for with a symbol before it."""
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high])) + np.tile(self.counts[symbols], 2)
        return both[: len(low)], both[len(low) :]

    def streamed(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of depth symbols of each text (one of the index's own) the least value of all texts with it.

        All texts go backwards through the index at once, one symbol a step. Whenever a match has depth symbols, its
        interval is the window's, and widens to those that agree in depth - 1 before the next symbol.
        """
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
        out = np.zeros(len(flat), dtype=np.int64)
        low, high = np.zeros(len(texts), np.int64), np.full(len(texts), self.matrix.n, np.int64)
        for step in range(int(sizes.max(initial=0))):
            some = order[: np.searchsorted(-sizes[order], -step)]  # those that are longer than step
            at = starts[some] + sizes[some] - 1 - step
            lo, hi = low[some], high[some]
            if step >= self.depth:
                lo, hi = self.first[lo].astype(np.int64), self.last[hi - 1].astype(np.int64)
            lo, hi = self.extended(flat[at], lo, hi)
            low[some], high[some] = lo, hi
            if step + 1 >= self.depth:
                out[at] = self.least[self.block[lo]]
        return [out[s : s + n - self.depth + 1] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


def scanned(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(id, n_words, whole, spans): of each document the hash of its words joined by a space, and its segments."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(parts):
        hashes = Hashes()
        for part in batches(parts, 4 << 20):
            ids, ns, wholes, spans = part.column("doc_id"), [], [], []
            for raw in part.column("raw").to_pylist():
                words = raw.split()
                ns.append(len(words))
                wholes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                spans.append(segments(hashes, words, window, group))
            offsets = pa.array(np.cumsum([0, *[len(s[0]) for s in spans]]), pa.int32())
            flat = [np.concatenate([s[i] for s in spans]) for i in range(3)]
            rows = pa.StructArray.from_arrays([pa.array(f) for f in flat], names=["key", "first", "n"])
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(wholes, pa.string()), pa.ListArray.from_arrays(offsets, rows)], names=["id", "n_words", "whole", "spans"])

    return docs.select("doc_id", raw_text().alias("raw")).mapInArrow(mapped, f"id {kind}, n_words bigint, whole string, spans array<struct<key:bigint,first:int,n:int>>")


def _key(*columns: str):
    """A join key that no aggregation is dealt by: both sides are dealt anew, and Spark may split what is hot."""
    return F.struct(*columns).alias("k")


def candidates(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """(id, whole, raw, spans): texts with segments whose key another document has too; of equal texts the first alone."""
    once = stored(seen.where("id is not null and size(spans) > 0").groupBy("whole").agg(F.min("id").alias("id"), F.first("spans").alias("spans")))
    rows = once.select("id", "whole", F.explode("spans").alias("x")).select("id", "whole", "x.*")
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(_key("key"))
    rows = rows.withColumn("k", _key("key")).join(shared, "k", "left_semi").drop("k")
    listed = rows.groupBy("id", "whole").agg(F.array_sort(F.collect_list(F.struct("first", "n", "key"))).alias("spans"))
    texts = docs.select(_key("doc_id"), raw_text().alias("raw"))
    return listed.withColumn("k", F.struct(F.col("id").alias("doc_id"))).join(texts, "k").select("id", "whole", "raw", "spans")


def cut_segments(texts: DataFrame, window: int) -> DataFrame:
    """(id, whole, key, digest, first, n, words) for each span of candidates. A row of the same id and another text gives none."""
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, whole string, key bigint, digest binary, first int, n int, words binary"

    def mapped(parts):
        for part in batches(parts, 1 << 20):
            own: list[list] = [[], [], [], [], [], []]
            rows = []
            for i, (whole, raw, spans) in enumerate(zip(part.column("whole").to_pylist(), part.column("raw").to_pylist(), part.column("spans").to_pylist(), strict=True)):
                words = raw.split()
                if hashlib.sha256(b" ".join(words)).hexdigest() != whole:
                    continue
                for s in spans:
                    text = b" ".join(words[s["first"] : s["first"] + s["n"] + window - 1])
                    rows.append(i)
                    for column, value in zip(own, (whole, s["key"], _digest(text), s["first"], s["n"], text), strict=True):
                        column.append(value)
            types = [pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            ids = part.column("id").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(own, types, strict=True)]], names=["id", "whole", "key", "digest", "first", "n", "words"])

    return texts.mapInArrow(mapped, schema)


def searched(distinct: DataFrame, window: int, shards: int) -> DataFrame:
    """(digest, runs): the runs (from, n) of windows of each segment that a segment of a smaller id holds too.

    distinct: (key, digest, words, id), each content once, with the smallest id that has it.
    """

    def run(table: pa.Table) -> pa.Table:
        words = [w.split(b" ") for w in table.column("words").to_pylist()]
        codes: dict[bytes, int] = {}
        texts = [np.fromiter((codes.setdefault(w, len(codes) + 1) for w in ws), np.int64, len(ws)) for ws in words]
        del words
        ids = table.column("id").to_pylist()
        place = {v: i for i, v in enumerate(sorted(set(ids)))}
        values = np.array([place[v] for v in ids], dtype=np.int64)
        found = Index(texts, values, window).streamed(texts)
        digests, runs = [], []
        for digest, least, own in zip(table.column("digest").to_pylist(), found, values.tolist(), strict=True):
            again = _runs(least < own)
            if again:
                digests.append(digest)
                runs.append([{"from": a, "n": n} for a, n in again])
        kind = pa.list_(pa.struct([("from", pa.int32()), ("n", pa.int32())]))
        return pa.table({"digest": pa.array(digests, pa.binary()), "runs": pa.array(runs, kind)})

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    return distinct.select(shard, "digest", "words", "id").groupBy("shard").applyInArrow(run, "digest binary, runs array<struct<from:int,n:int>>")


def settled(hot: DataFrame, window: int) -> DataFrame:
    """As searched, for keys of many different segments: each window by its digest, the smallest id of equal ones first.

    Equal windows are counted together before they are dealt, so that no window is a large group.
    """
    kind = hot.schema["id"].dataType.simpleString()

    def mapped(parts):
        for part in batches(parts, 1 << 18):
            at, firsts, wins = [], [], []
            for i, text in enumerate(part.column("words").to_pylist()):
                words = text.split(b" ")
                for k in range(len(words) - window + 1):
                    at.append(i)
                    firsts.append(k)
                    wins.append(_digest(b" ".join(words[k : k + window])))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("digest").take(rows), pa.array(firsts, pa.int32()), pa.array(wins, pa.binary())], names=["id", "digest", "from", "w"])

    rows = stored(hot.select("id", "digest", "words").mapInArrow(mapped, f"id {kind}, digest binary, from int, w binary"))
    least = rows.groupBy("w").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(_key("w"), "least")
    again = rows.withColumn("k", _key("w")).join(least, "k").where("least < id")
    return again.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("from", F.lit(1).alias("n")))).alias("runs"))


def repeated_windows(parts: DataFrame, window: int, hot: int, shard_bytes: int) -> DataFrame:
    """(id, whole, runs): of each document the runs (first window, windows) that a document of smaller id holds too."""
    distinct = stored(parts.groupBy("digest").agg(F.first("key").alias("key"), F.first("words").alias("words"), F.min("id").alias("id")))
    total = distinct.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    many = distinct.groupBy("key").count().where(F.col("count") > hot).select(_key("key"), F.lit(True).alias("hot"))
    distinct = stored(distinct.withColumn("k", _key("key")).join(many, "k", "left").drop("k"))
    found = searched(distinct.where("hot is null"), window, max(1, math.ceil(total / shard_bytes))).unionByName(settled(distinct.where("hot"), window))
    known = distinct.select("digest", F.col("id").alias("least")).join(found, "digest", "left").select(_key("digest"), "least", "runs")
    own = parts.select("id", "whole", "first", "n", _key("digest")).join(known, "k")
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n")))
    runs = F.when(F.col("id") > F.col("least"), whole).otherwise(F.col("runs"))
    runs = F.transform(runs, lambda r: F.struct((r["from"] + F.col("first")).alias("from"), r["n"].alias("n")))
    own = own.select("id", "whole", F.explode(runs).alias("x"))
    return own.groupBy("id", "whole").agg(F.array_sort(F.collect_set("x")).alias("runs"))


def cut(texts: DataFrame, window: int) -> DataFrame:
    """(id, whole, spans, kept): the spans (from, n) of words that the runs of windows cover, and the other words."""
    kind = texts.schema["id"].dataType.simpleString()

    def mapped(parts):
        for part in batches(parts, 4 << 20):
            rows, spans, kept = [], [], []
            for i, (whole, raw, runs) in enumerate(zip(part.column("whole").to_pylist(), part.column("raw").to_pylist(), part.column("runs").to_pylist(), strict=True)):
                words = raw.split()
                if hashlib.sha256(b" ".join(words)).hexdigest() == whole:
                    gone = np.zeros(len(words), dtype=bool)
                    for r in runs:
                        gone[r["from"] : r["from"] + r["n"] + window - 1] = True
                    rows.append(i)
                    spans.append([{"from": a, "n": n} for a, n in _runs(gone)])
                    kept.append(b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()]).decode())
            at, kind_ = pa.array(rows, pa.int64()), pa.list_(pa.struct([("from", pa.int32()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([part.column("id").take(at), part.column("whole").take(at), pa.array(spans, kind_), pa.array(kept, pa.string())], names=["id", "whole", "spans", "kept"])

    return texts.mapInArrow(mapped, f"id {kind}, whole string, spans array<struct<from:int,n:int>>, kept string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, group: int = GROUP, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept, whole): what of each document a document of smaller doc_id holds too.

    A word goes if window neighbouring words around it stand, the same and in that order, in a document of smaller doc_id.
    Windows are judged on the texts as given. spans are the stretches (from, n) of words that go, kept is what stays,
    joined by a space, null where all stays; whole is the SHA-256 of all words joined by a space.

    Words are what ASCII white space parts, unchanged. A null text has none. Texts are read whole, whatever their length;
    one shorter than the window loses nothing. Of equal texts all but the smallest doc_id go whole. Repeated rows are one
    document, each gives its row; rows of one doc_id and other texts don't repeat each other. Rows without doc_id lose
    nothing and repeat nothing. Bytes that aren't UTF-8 count as replacement characters. Other columns don't matter, an
    empty table gives none. hot and shard_bytes bear on the cost alone.
    """
    if not 0 < group <= window or window < 2:
        raise ValueError("a window has two words or more, and at least those of a group")
    seen = stored(scanned(docs, window, group))
    texts = stored(candidates(docs, seen))
    parts = stored(cut_segments(texts, window))
    runs = repeated_windows(parts, window, hot, shard_bytes)
    kept = cut(texts.select("id", "whole", "raw").join(runs, ["id", "whole"]), window).dropDuplicates(["id", "whole"])
    first = seen.where("id is not null").groupBy("whole").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(_key("whole"), "least")
    rows = seen.select("id", "n_words", "whole").withColumn("k", _key("whole")).join(first, "k", "left").drop("k")
    rows = rows.withColumn("copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False)) & (F.col("n_words") >= window))
    rows = rows.withColumn("k", _key("id", "whole")).join(kept.select(_key("id", "whole"), "spans", "kept"), "k", "left")
    every = F.array(F.struct(F.lit(0).alias("from"), F.col("n_words").cast("int").alias("n")))
    spans = F.when(F.col("copy"), every).otherwise(F.coalesce("spans", F.array().cast("array<struct<from:int,n:int>>")))
    rows = rows.select(F.col("id").alias("doc_id"), "n_words", spans.alias("spans"), F.when(F.col("copy"), "").otherwise(F.col("kept")).alias("kept"), "whole")
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return rows.select("doc_id", "n_words", gone.alias("n_removed"), "spans", "kept", "whole")
