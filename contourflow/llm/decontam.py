"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import batches, repaired, stored
from .simhash import majority

WIDTH, LEAST = 5, 0.8
#: Bits of a fingerprint. Texts of equal length whose weighted-shingle similarity is 0.8 share 8/9 of their shingles;
#: fingerprints then differ in 128 * acos(8/9) / pi = 19.4 bits, with a deviation of 4.1. RADIUS is 4.8 deviations more.
BITS, RADIUS = 128, 39
#: Bytes of benchmark that one pass over the documents is held against.
SLICE = 32 << 20

_words = re.compile(r"\w+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased: case, punctuation and spacing don't hide a passage."""
    return _words(text.lower())


def shingles(words: list, width: int = WIDTH) -> list[tuple]:
    """Runs of width words, repeats included; all words if there are fewer."""
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of shingle counts: the sum of the lesser counts over that of the greater."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def simhash(grams: list[tuple]) -> int:
    """BITS bits, of two hashes; each shingle counts as often as it occurs."""
    joined = [" ".join(g) for g in grams]
    halves = [majority(np.array([xxhash.xxh64_intdigest(g, seed) for g in joined], dtype=np.uint64)) for seed in range(BITS // 64)]
    return sum(h << (64 * i) for i, h in enumerate(halves))


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of so many bits with at most most of them set."""
    masks = np.arange(1 << bits, dtype=np.uint32)
    return masks[np.bitwise_count(masks) <= most].astype(np.uint64)


class HammingIndex:
    """All stored fingerprints within radius of a query, by blocks.

    The bits are cut into four blocks; of radius differing bits some block has at most radius // 4. A block is looked up by
    its halves, one of which then differs in at most half as many bits: all those variants of a half are looked up in a
    table of the halves, and what has one of them is kept if the whole block is near. So nothing is missed, and a query asks
    for as many values however many fingerprints there are. Of four blocks of 32 bits, within nine bits each, an unrelated
    fingerprint passes one in 4 %. Of few fingerprints all blocks are compared, which finds the same.
    """

    BLOCKS, FEW = 4, 2_048
    FLIPS = _flips(BITS // BLOCKS // 2, RADIUS // BLOCKS // 2)

    def __init__(self, fingerprints: list[int], radius: int = RADIUS):
        self.radius, self.size = radius, BITS // self.BLOCKS
        self.words = np.array([[fp >> (64 * i) & (1 << 64) - 1 for i in range(BITS // 64)] for fp in fingerprints], dtype=np.uint64).reshape(-1, BITS // 64)
        self.blocks = np.array([self._blocks(fp) for fp in fingerprints], dtype=np.uint64).reshape(-1, self.BLOCKS)
        self.halves: list[tuple[np.ndarray, np.ndarray]] = []
        if len(fingerprints) > self.FEW:
            for k in range(2 * self.BLOCKS):
                half = self._half(self.blocks, k).astype(np.int64)
                starts = np.concatenate([[0], np.cumsum(np.bincount(half, minlength=1 << self.size // 2))])
                self.halves.append((starts, np.argsort(half, kind="stable")))

    def _blocks(self, fp: int) -> list[int]:
        return [(fp >> (self.size * i)) & ((1 << self.size) - 1) for i in range(self.BLOCKS)]

    def _half(self, blocks: np.ndarray, k: int) -> np.ndarray:
        return blocks[..., k // 2] >> np.uint64(self.size // 2 * (k % 2)) & np.uint64((1 << self.size // 2) - 1)

    def proposed(self, fp: int) -> np.ndarray:
        """What some block finds."""
        own, most = np.array(self._blocks(fp), dtype=np.uint64), self.radius // self.BLOCKS
        if not self.halves:
            return np.flatnonzero((np.bitwise_count(self.blocks ^ own) <= most).any(axis=1))
        found = []
        for k, (starts, order) in enumerate(self.halves):
            value = (self._half(own, k) ^ self.FLIPS).astype(np.int64)
            low, sizes = starts[value], starts[value + 1] - starts[value]
            held = np.flatnonzero(sizes)
            low, sizes = low[held], sizes[held]
            some = order[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)]
            found.append(some[np.bitwise_count(self.blocks[some, k // 2] ^ own[k // 2]) <= most])
        return np.unique(np.concatenate(found))

    def near(self, fp: int) -> list[int]:
        some = self.proposed(fp)
        own = np.array([fp >> (64 * i) & (1 << 64) - 1 for i in range(BITS // 64)], dtype=np.uint64)
        return some[np.bitwise_count(self.words[some] ^ own).sum(axis=1, dtype=np.int64) <= self.radius].tolist()


class Benchmark:
    """Items by length, their shingles, and what finds their shingles in a stream of words."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if (w := words_of(t or ""))]
        self.vocabulary: dict[str, int] = {}
        for _, words in self.items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.counts = [Counter(shingles(w)) for _, w in self.items]
        self.indexes: dict[int, tuple[list[int], HammingIndex]] = {}
        by_length = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            by_length[len(w)].append(k)
        for n, own in by_length.items():
            self.indexes[n] = own, HammingIndex([simhash(shingles(self.items[k][1])) for k in own])
        self.widths = sorted({min(WIDTH, len(w)) for _, w in self.items})
        self.codes: dict[int, tuple[np.ndarray, list[list[int]], np.ndarray]] = {}
        self.held: list[np.ndarray] = [np.empty(0, np.uint64)] * len(self.items)
        for width in self.widths:
            own = [k for k, (_, w) in enumerate(self.items) if min(WIDTH, len(w)) == width]
            each = {k: Counter(self._code(np.array([self.vocabulary[x] for x in self.items[k][1]], dtype=np.uint64), width).tolist()) for k in own}
            often = Counter(c for counts in each.values() for c in counts)
            of: dict[int, list[int]] = defaultdict(list)
            for k, counts in each.items():
                self.held[k] = np.array(sorted(counts), dtype=np.uint64)
                for c in self._rarest(counts, often):
                    of[c].append(k)
            keys = np.array(sorted(of), dtype=np.uint64)
            filter_ = np.zeros(1 << 20, dtype=bool)
            filter_[keys >> np.uint64(44)] = True
            self.codes[width] = keys, [of[c] for c in keys.tolist()], filter_

    @staticmethod
    def _rarest(counts: Counter, often: Counter) -> list[int]:
        """Shingles of an item, those that the fewest items have first, of which any window as similar as LEAST holds one: as
        many occurrences as such a window may lack, and one more."""
        total = sum(counts.values())
        left, out = total - math.ceil(LEAST * total - 1e-9) + 1, []
        for c in sorted(counts, key=lambda c: (often[c], c)):
            if left <= 0:
                break
            out.append(c)
            left -= counts[c]
        return out

    @staticmethod
    def _code(ids: np.ndarray, width: int) -> np.ndarray:
        """A hash of each run of width words; 0 where one of them isn't in the vocabulary."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        for i in range(width):
            part = ids[i : i + n]
            known &= part != 0
            h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.where(known, h * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1), np.uint64(0))

    @staticmethod
    def _around(code: np.ndarray, begin: int, size: int, seen: list[int], n: int, held: np.ndarray) -> np.ndarray:
        """The places of a text, at most n words from one of those seen, where a shingle is one of held."""
        out, done = [], 0
        for p in seen:
            low, high = max(done, p - n), min(size, p + n)
            if high > low:
                some = code[begin + low : begin + high]
                where = np.minimum(np.searchsorted(held, some), len(held) - 1)
                out.append(low + np.flatnonzero(held[where] == some))
                done = high
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text (item_id, start, number of words, similarity) of the best window of each item that it holds.

        Windows are as long as the item, or the whole text if that is shorter. A window as similar as LEAST to an item
        holds one of its rarest shingles, and so many of all its shingles. Around where the rarest occur the others are
        counted, and only windows that hold enough are fingerprinted, which loses none. The fingerprint proposes the items of its length, and those are compared exactly. A whole text
        shorter than the item has another length than any fingerprint; it is compared with the item itself.
        """
        words = [words_of(t) if t else [] for t in texts]
        sizes = np.array([len(w) for w in words])
        gap = [0] * WIDTH
        stream: list[int] = []
        for w in words:
            stream += map(self.vocabulary.get, w, repeat(0))
            stream += gap
        ids = np.array(stream, dtype=np.uint64)
        begins = np.cumsum(sizes + WIDTH) - sizes - WIDTH
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        coded: dict[int, np.ndarray] = {}
        for width in self.widths:
            keys, items, filter_ = self.codes[width]
            coded[width] = code = self._code(ids, width)
            at = np.flatnonzero(filter_[code >> np.uint64(44)] & (code != 0))
            where = np.minimum(np.searchsorted(keys, code[at]), len(keys) - 1)
            fits = keys[where] == code[at]
            at, where = at[fits], where[fits]
            doc = np.searchsorted(begins, at, side="right") - 1
            for d, p, c in zip(doc.tolist(), (at - begins[doc]).tolist(), where.tolist(), strict=True):
                for k in items[c]:
                    hits[d, k].append(p)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for (d, k), seen in hits.items():
            n = len(self.items[k][1])
            need = LEAST * max(1, n - WIDTH + 1) - 1e-9
            places = self._around(coded[min(WIDTH, n)], int(begins[d]), int(sizes[d]), sorted(seen), n, self.held[k])
            if len(places) < need:
                continue
            size = min(n, int(sizes[d]))
            span = max(0, size - min(WIDTH, size))  # from a window's start to its last shingle's
            p = places
            starts = np.unique(np.clip((p[:, None] - np.array([0, span])[None, :]).ravel(), 0, sizes[d] - size))
            starts = np.unique(np.concatenate([np.arange(max(0, a - 1), min(int(sizes[d]) - size, a + 1) + 1) for a in starts.tolist()]))
            inside = np.searchsorted(p, starts + span, side="right") - np.searchsorted(p, starts, side="left")
            for s in starts[inside >= need].tolist():
                if size == n and (d, s, n) in tried:
                    continue
                grams = shingles(words[d][s : s + size])
                proposed = [k]
                if size == n:
                    tried.add((d, s, n))
                    own, index = self.indexes[n]
                    proposed = [own[i] for i in index.near(simhash(grams))]
                counts = Counter(grams)
                for j in proposed:
                    x = similarity(counts, self.counts[j])
                    if x >= LEAST and (x, -s) > best.get((d, j), (0.0, 0, 0))[:2]:
                        best[d, j] = x, -s, size
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for (d, k), (x, s, size) in sorted(best.items()):
            out[d].append((self.items[k][0], -s, size, x))
        return out


def _slices(items: DataFrame, limit: int = SLICE):
    """The items in parts of about limit bytes, each small enough to be sent to all executors, and how many parts there are."""
    items = repaired(items.where("text is not null").select("item_id", "text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / limit))
    for i in range(n):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).orderBy("item_id", "text").collect()], n


def find_leaks(docs: DataFrame, items: DataFrame, limit: int = SLICE) -> DataFrame:
    """Rows (doc_id, item_id, start, n_words, similarity): the passages of documents that repeat benchmark items.

    start counts words. Per row of docs and item the most similar window, the first of equals. Null and empty texts and
    items leak nothing; texts and items of any length are read whole, and a repeated row of docs gives its rows again, a
    repeated item too. Items of fewer than five words must match whole. Other columns don't matter, whatever their names. A benchmark larger than limit is taken in
    slices, each with a pass of its own over the documents.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"doc_id {kind}, item_id {item_kind}, start int, n_words int, similarity double")
    out = None
    for part, n in _slices(items, limit):
        shared = _send(docs, part)
        found = repaired(docs.select("doc_id", "text")).mapInArrow(_leaks_by(shared, schema), schema)
        if n > 1:  # written before the next slice is sent, so that the driver holds one at a time
            found = stored(found)
            shared.destroy()
        out = found if out is None else out.union(found)
    return out


_built: dict[int, Benchmark] = {}


def _benchmark(shared) -> Benchmark:
    key = shared.value[0]
    if key not in _built:
        _built.clear()
        _built[key] = Benchmark(shared.value[1])
    return _built[key]


def _send(docs: DataFrame, part: list):
    return docs.sparkSession.sparkContext.broadcast((xxhash.xxh64_intdigest(repr(part)), part))


def _leaks_by(shared, schema: StructType):
    def mapped(parts):
        own, shape = _benchmark(shared), to_arrow_schema(schema)
        for batch in batches(parts, 4 << 20):
            rows = [(i, *x) for i, found in zip(batch.column("doc_id").to_pylist(), own.leaks(batch.column("text").to_pylist()), strict=True) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, shape.types, strict=True)], schema=shape)

    return mapped


def decontaminate(docs: DataFrame, items: DataFrame, limit: int = SLICE) -> DataFrame:
    """docs without the rows whose text holds a passage that find_leaks would report. A map over the rows.

    Rows of null or empty texts stay, repeated rows and extra columns too; an empty benchmark leaves all.
    """
    schema = docs.schema

    def keep(shared):
        def mapped(parts):
            own = _benchmark(shared)
            for batch in batches(parts, 4 << 20):
                clean = [not found for found in own.leaks(batch.column("text").to_pylist())]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return mapped

    docs = repaired(docs)
    for part, n in _slices(items, limit):
        shared = _send(docs, part)
        docs = docs.mapInArrow(keep(shared), schema)
        if n > 1:
            docs = stored(docs)
            shared.destroy()
    return docs
