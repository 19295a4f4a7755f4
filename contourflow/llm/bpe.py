"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import heapq
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, raw_text

_MIX = 0x9E3779B97F4A7C15
_64 = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line the base64 of a token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displacement: n keys in n slots, no two in one.

    Keys share buckets of about four. Largest buckets first, each takes the smallest displacement that sends its keys to
    free slots; buckets of one key name a slot that is still free.
    """

    def __init__(self, keys: list[bytes]):
        self.n, self.n_buckets = len(keys), max(1, len(keys) // 4)
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * self.n
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh64_intdigest(key, 1)
            buckets.setdefault(h % self.n_buckets, []).append((h, key))
        free_from = 0
        for at, bucket in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(bucket) == 1:
                while self.keys[free_from] is not None:
                    free_from += 1
                self.shift[at], self.keys[free_from] = -free_from - 1, bucket[0][1]
                continue
            d = 0
            while True:
                slots = {self._place(h, d) for h, _ in bucket}
                if len(slots) == len(bucket) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[at] = d
            for h, key in bucket:
                self.keys[self._place(h, d)] = key

    def _place(self, h: int, d: int) -> int:
        x = ((h ^ d * _MIX) * _MIX) & _64
        return (x >> 20) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key, -1 for any other string."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key, 1)
        d = self.shift[h % self.n_buckets]
        slot = -d - 1 if d < 0 else self._place(h, d)
        return slot if self.keys[slot] == key else -1


class Codec:
    """Encoder and decoder of one vocabulary; memo_size bounds the pre-tokens whose ids are remembered, as bytes of int32."""

    #: Bytes of a pre-token up to which scanning all its pairs is faster than a heap; tokens that are spelled out at once.
    SHORT, AT_ONCE = 64, 1 << 16

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int = 200_000, whole: PerfectHash | None = None):
        self.find = regex.compile(pattern).findall
        self.whole = whole or PerfectHash(list(ranks))
        self.rank_at = [ranks[k] for k in self.whole.keys]
        size = max(ranks.values(), default=-1) + 1
        token = [b""] * size
        for k, r in ranks.items():
            token[r] = k
        self.token, self.digits = _spelled(token), _spelled([b"%d " % i for i in range(size)])
        self.byte = [ranks.get(bytes([i]), -1) for i in range(256)]
        #: What two tokens merge to, by the first's id times 2**20 plus the second's.
        self.merged = {(ranks[k[:i]] << 20) | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}
        codec = self

        class Memo(dict):
            """Two generations of half the size each: what is still in use comes back from the older one."""

            older: dict = {}

            def __missing__(self, piece: str):
                if len(self) * 2 >= memo_size:
                    self.older = dict(self)
                    self.clear()
                ids = self.older.get(piece)
                if ids is None:
                    raw = piece.encode()
                    slot = codec.whole.slot(raw)
                    ids = array("i", (codec.rank_at[slot],) if slot >= 0 else codec.merge(raw)).tobytes()
                self[piece] = ids
                return ids

        self.memo = Memo()

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: the adjacent pair of lowest rank merges first, leftmost among equals.

        ids[i] is the token that begins at byte i, after and before link those that are left, pair[i] is what the token
        at i and the next would merge to. The heap holds rank and place; entries that pair no longer confirms are stale.
        """
        n, merged = len(raw), self.merged.get
        ids = [self.byte[x] for x in raw]
        if n <= self.SHORT:
            none = len(self.byte) << 32
            pair = [merged((a << 20) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
            while pair and (r := min(pair)) < none:
                i = pair.index(r)
                ids[i] = r
                del ids[i + 1], pair[i]
                if i < len(pair):
                    pair[i] = merged((r << 20) | ids[i + 1], none)
                if i:
                    pair[i - 1] = merged((ids[i - 1] << 20) | r, none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [merged((a << 20) | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        pair.append(-1)
        heap = [(r << 32) | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if pair[i] != r:
                continue
            j = after[i]
            ids[i], pair[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair[i] = merged((r << 20) | ids[k], -1)
                if new >= 0:
                    push(heap, (new << 32) | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                new = pair[h] = merged((ids[h] << 20) | r, -1)
                if new >= 0:
                    push(heap, (new << 32) | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def packed(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.find(text))), dtype=np.int32)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(self._spell(self.token, ids))

    def hashes(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the ids in decimal, joined by a space, and of what they decode to."""
        shown, decoded, left = sha256(), sha256(), len(ids)
        for part in self._spell(self.digits, ids):
            left -= self.AT_ONCE
            shown.update(part if left > 0 else part[:-1])
        for part in self._spell(self.token, ids):
            decoded.update(part)
        return shown.hexdigest(), decoded.hexdigest()

    def _spell(self, table: tuple[np.ndarray, np.ndarray, np.ndarray], ids):
        """The bytes that ids stand for in a table of _spelled, some at once."""
        flat, starts, sizes = table
        for at in range(0, len(ids), self.AT_ONCE):
            own = np.asarray(ids[at : at + self.AT_ONCE])
            n = sizes[own]
            ends = np.cumsum(n, dtype=np.int32)
            yield flat[np.repeat(starts[own] - ends + n, n) + np.arange(ends[-1], dtype=np.int32)].tobytes()


def _spelled(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings side by side, where each begins and how long it is."""
    sizes = np.array([len(s) for s in strings], dtype=np.int32)
    return np.frombuffer(b"".join(strings), dtype=np.uint8), np.cumsum(sizes, dtype=np.int32) - sizes, sizes


class _Vocabulary:
    """What is broadcast. The codec is built once in each Python worker and goes there with the broadcast, which Spark drops
    when the worker runs a task that doesn't need it: what was remembered doesn't stay for later stages."""

    def __init__(self, *settings):
        self.settings, self.codec = settings, None

    def __getstate__(self) -> dict:
        return {"settings": self.settings, "codec": None}


def _codec(shared) -> Codec:
    """The codec of a broadcast vocabulary."""
    own = shared.value
    if own.codec is None:
        ranks, pattern, whole = own.settings
        own.codec = Codec(ranks, pattern, whole=whole)
    return own.codec


def _shared(spark: SparkSession, ranks: dict[bytes, int], pattern: str):
    """The vocabulary and its perfect hash, made once on the driver; as large as the vocabulary file."""
    return spark.sparkContext.broadcast(_Vocabulary(ranks, pattern, PerfectHash(list(ranks))))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, keep_ids: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """Each text's token ids, and what decoding them gives back.

    Columns: doc_id, those in also, n_tokens, ids (array of int; left out if not keep_ids), ids_sha256 (of the ids in
    decimal, joined by a space) and decoded_sha256 (of the decoded bytes). A null text is empty: no ids and the hashes
    of nothing. Texts of any length are encoded whole; of pairs of equal rank the leftmost merges first. Repeated rows stay, an empty table gives none; other columns than those named don't matter. ranks must hold all single bytes that
    occur; it is broadcast, its size is the vocabulary file's. One map over the rows, nothing is shuffled.
    """
    settings = _shared(docs.sparkSession, ranks, pattern)
    fields = [(c, docs.schema[c].dataType.simpleString()) for c in ("doc_id", *also)]
    fields += [("n_tokens", "bigint")] + [("ids", "array<int>")] * keep_ids + [("ids_sha256", "string"), ("decoded_sha256", "string")]

    def encode(parts):
        codec = _codec(settings)
        for part in batches(parts, 4 << 20):
            ids, ends, counts, first, second = [], [0], [], [], []
            for raw in part.column("_raw").to_pylist():
                own = codec.packed(raw.decode("utf-8", "replace"))
                if keep_ids:
                    ids.append(own)
                    ends.append(ends[-1] + len(own))
                counts.append(len(own))
                shown, decoded = codec.hashes(own)
                first.append(shown)
                second.append(decoded)
            columns = [part.column(c) for c in ("doc_id", *also)] + [pa.array(counts, pa.int64())]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]))))
            columns += [pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    given = docs.select("doc_id", *also, raw_text().alias("_raw"))
    return given.mapInArrow(encode, ", ".join(f"`{n}` {t}" for n, t in fields))


def decode_ids(tokens: DataFrame, ranks: dict[bytes, int], *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the column ids stands for; null ids give null."""
    settings = _shared(tokens.sparkSession, ranks, ".")

    @F.udf("binary", useArrow=True)
    def decoded(own):
        return None if own is None else _codec(settings).decode(own)

    return tokens.withColumn(out, decoded(F.col(ids)))
