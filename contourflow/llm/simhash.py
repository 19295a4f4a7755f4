"""SimHash near-duplicates: fingerprints, and links within three bits by balls that meet half way."""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, checkpointed, components, may_hold, raw_text, release, repaired, stored, words_of

RADIUS = 3
#: Variants that a cell holds at once: some 100 MB.
AT_ONCE = 1 << 21
_ONE = np.uint64(1)
_BITS = _ONE << np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the 64-bit hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[counts * 2 > len(hashes)].sum()) if len(hashes) else 0


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of width words joined by a space; of all words if there are fewer."""
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], seed) for s, e in zip((ends - sizes).tolist(), ends[width - 1 :].tolist(), strict=False)], dtype=np.uint64)


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(words_of(raw), width, seed))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp): the SimHash of each whole text's word shingles, as a signed 64-bit number; no words: 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mapped(parts):
        for part in batches(parts, 4 << 20):
            fps = np.array([fingerprint(raw, width, seed) for raw in part.column("_raw").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", raw_text().alias("_raw")).mapInArrow(mapped, f"doc_id {kind}, fp bigint")


def _parity(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & 1).astype(bool)


@functools.cache
def _pairs(bits: int) -> np.ndarray:
    """The pairs of bits that an even fingerprint flips: those within the same half. Any three bits hold such a pair, so
    the third bit is left for the odd fingerprint to flip."""
    return np.array([(i, j) for i in range(bits) for j in range(i + 1, bits) if (i < bits // 2) == (j < bits // 2)])


def _top(x: np.ndarray, bits: int, cell_bits: int) -> np.ndarray:
    return x >> np.uint64(bits - cell_bits) if cell_bits else x * np.uint64(0)


@functools.lru_cache(1 << 14)
def _variants(bits: int, cell_bits: int, even: bool, cell_flip: int) -> tuple[np.ndarray, np.ndarray]:
    """Masks, and how many bits each flips, of the variants whose top cell_bits bits differ in just cell_flip. Kept, as every
    cell asks for the same ones."""
    masks, sizes = [np.zeros(1, np.uint64), _BITS[:bits]], [np.zeros(1, np.int8), np.ones(bits, np.int8)]
    if even:
        pairs = _pairs(bits)
        masks.append(_BITS[pairs[:, 0]] | _BITS[pairs[:, 1]])
        sizes.append(np.full(len(pairs), 2, np.int8))
    mask, size = np.concatenate(masks), np.concatenate(sizes)
    at = _top(mask, bits, cell_bits) == np.uint64(cell_flip)
    return mask[at], size[at]


def _meet(fps: np.ndarray, cell: int, bits: int, cell_bits: int, at_once: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints whose balls meet in variants with the top bits cell.

    All that share a variant and are at most one bit from it are linked to the smallest of them; so is each that is two
    bits from it. Two that are both two bits away and linked at all also meet in a variant one bit from each. Variants
    are taken in parts of about at_once by the bits below the top ones, which bounds memory; each part forms all variants
    again, so the number of parts goes by that of variants. Of all these links a spanning forest is returned.
    """
    flips = _top(fps, bits, cell_bits) ^ np.uint64(cell)
    odd = _parity(fps)
    balls: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.lexsort([odd, flips])
    bounds = np.flatnonzero((np.diff(flips[order]) != 0) | (np.diff(odd[order]) != 0)) + 1
    for own in np.split(order, bounds) if len(order) else []:
        masks, sizes = _variants(bits, cell_bits, not odd[own[0]], int(flips[own[0]]))
        if len(masks):
            balls.append((own, masks, sizes))
    out_a, out_b = [], []
    slice_bits = max(0, math.ceil(math.log2(max(1, sum(len(own) * len(masks) for own, masks, _ in balls) / at_once))))
    slice_bits = min(slice_bits, 12, bits - cell_bits)
    down = np.uint64(max(0, bits - cell_bits - slice_bits))
    for part in range(1 << slice_bits):
        values, owners, dists = [], [], []
        for own, masks, sizes in balls:
            step = max(1, 2_000_000 // len(masks))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                v = fps[some][:, None] ^ masks[None, :]
                if slice_bits:
                    keep = ((v >> down) & np.uint64((1 << slice_bits) - 1)) == np.uint64(part)
                    row, col = np.nonzero(keep)
                    values.append(v[keep])
                    owners.append(some[row])
                    dists.append(sizes[col])
                else:
                    values.append(v.ravel())
                    owners.append(np.repeat(some, len(masks)))
                    dists.append(np.tile(sizes, len(some)))
        if not values:
            continue
        v, o, d = np.concatenate(values), np.concatenate(owners), np.concatenate(dists)
        order = np.argsort(v, kind="stable")
        v = v[order]
        same = v[1:] == v[:-1]
        hit = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
        if not len(hit):
            continue
        v, o, d = v[hit], o[order[hit]], d[order[hit]]
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(start, len(v)))
        near = np.where(d <= 1, fps[o], np.uint64(2**64 - 1))
        has = np.maximum.reduceat((d <= 1).astype(np.int8), start).astype(bool)
        centre = np.repeat(np.minimum.reduceat(near, start), size)
        mine = fps[o]
        take = np.repeat(has, size) & (mine != centre)
        a, b = centre[take], mine[take]
        ok = np.bitwise_count(a ^ b) <= RADIUS
        out_a.append(a[ok])
        out_b.append(b[ok])
    if not out_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    both = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
    return _forest(both[:, 0], both[:, 1])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links those that a minimum spanning forest by Hamming distance takes: one fewer than members, the nearest."""
    order = np.argsort(np.bitwise_count(a ^ b), kind="stable")
    a, b = a[order], b[order]
    _, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(int(at.max(initial=-1)) + 1))
    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[y] = x
            keep[k] = True
    return a[keep], b[keep]


def _flips(bits: int, cell_bits: int, even: bool) -> np.ndarray:
    """What the variants of a fingerprint change in its top cell_bits bits."""
    down, tops = np.uint64(bits - cell_bits), range(bits - cell_bits, bits)
    out = {0, *[int(_BITS[i] >> down) for i in tops]}
    if even:
        out |= {int((_BITS[i] | _BITS[j]) >> down) for i, j in _pairs(bits).tolist() if i in tops and j in tops}
    return np.array(sorted(out), dtype=np.uint64)


def _emit(bits: int, before: int, after: int):
    """Rows (t, cell, fp), cell of before bits, become one row for each value of after bits that variants in the cell have."""
    flips = {odd: _flips(bits, after, not odd) for odd in (True, False)}
    coarse = {odd: _top(f, after, before) for odd, f in flips.items()}

    def emit(parts):
        for part in parts:
            t, cell, fps = (part.column(c).to_numpy(zero_copy_only=False) for c in ("t", "cell", "fp"))
            fps = fps.view(np.uint64)
            flip, top, odd = _top(fps, bits, before) ^ cell.view(np.uint64), _top(fps, bits, after), _parity(fps)
            rows, cells = [], []
            for is_odd in (True, False):
                for f in np.unique(flip[odd == is_odd]):
                    own = np.flatnonzero((odd == is_odd) & (flip == f))
                    masks = flips[is_odd][coarse[is_odd] == f]
                    rows.append(np.repeat(own, len(masks)))
                    cells.append((top[own][:, None] ^ masks[None, :]).ravel())
            at = np.concatenate([*rows, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(t[at], pa.int32()), pa.array(np.concatenate([*cells, np.empty(0, np.uint64)]).view(np.int64)), pa.array(fps[at].view(np.int64))], names=["t", "cell", "fp"])

    return emit


def ball_links(distinct: DataFrame, bits: int = 64, per_cell: int = 4096, most: int = 16) -> DataFrame:
    """Rows (t, a, b): links that join all fingerprints of one table t within three bits of each other into components.

    distinct has t (int) and fp (bigint, of that many bits), each pair once. Each fingerprint emits its variants: of even
    weight all within two bits (pairs in the same half of the word), of odd weight all within one. Two within three bits
    share a variant. Variants are shuffled by their top bits, and what travels is the fingerprint, once for each value
    of those bits that its variants have; the receiving task forms the variants again. Top bits are as many as give
    about per_cell fingerprints to each value; cells of over most times that are dealt again by eight bits more, until
    none is left: fingerprints are distinct, so no cell stays dense to the last bit. A task returns a spanning forest of
    the links that it finds, so they never grow with the square of a group. No cap anywhere.
    """
    schema = "t int, cell bigint, fp bigint"
    n = distinct.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    before, after = 0, max(0, min(28, math.ceil(math.log2(max(1, n / per_cell)))))
    sent = distinct.select(F.col("t").cast("int"), F.lit(0).cast("bigint").alias("cell"), F.col("fp").cast("bigint"))

    def meet_by(cell_bits: int):
        def meet(key, group):
            fps = np.sort(group.column("fp").to_numpy().view(np.uint64))
            a, b = _meet(fps, key[1].as_py(), bits, cell_bits)
            return pa.table({"t": np.full(len(a), key[0].as_py(), np.int32), "a": a.view(np.int64), "b": b.view(np.int64)})

        return meet

    out = None
    while True:
        sent = sent.mapInArrow(_emit(bits, before, after), schema)
        dense = None
        if after < bits:
            dense = sent.groupBy("t", "cell").count().where(F.col("count") > most * per_cell).select("t", "cell")
            dense = None if dense.isEmpty() else checkpointed(dense)
        calm = sent if dense is None else sent.join(dense, ["t", "cell"], "left_anti")
        # Few bytes ask for much work here: told how many partitions, Spark doesn't join small ones.
        calm = calm.repartition(max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "t", "cell")
        links = calm.groupBy("t", "cell").applyInArrow(meet_by(after), "t int, a bigint, b bigint")
        out = links if out is None else out.union(links)
        if dense is None:
            return out.distinct()
        sent = checkpointed(sent.join(dense, ["t", "cell"], "left_semi").select("t", "cell", "fp"))
        before, after = after, min(bits, after + 8)


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): documents linked, directly or not, at three or fewer differing bits.

    component_id is the smallest doc_id of the component. Texts without words (null, empty) have fingerprint zero and
    are linked like any other. Repeated rows stay and each gets its row; a null doc_id counts as larger than any other
    and stands for a component only if nothing else does. Texts of any length are read whole; other columns of docs don't
    matter, whatever their names; an empty table gives no rows. Equal fingerprints are one before any link is sought, so
    groups of copies cost nothing; the join back to documents is one that Spark may split.
    """
    own = checkpointed(fingerprints(docs, width, seed))
    distinct = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(ball_links(distinct.select(F.lit(0).alias("t"), "fp")).select("a", "b"))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpointed(rooted.join(least, "root").select(F.col("fp").alias("fp_"), "component_id"))
    out = own.join(named, own.fp == named.fp_, "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of a document's distinct words that candidates for a similarity of 0.8 are sought by, their bits, and how many
#: of them meet in one value of their top bits. These bear on the cost alone, what they miss the exact path finds.
TABLES, TABLE_BITS, TABLE_CELL = 2, 48, 4096
_tokens = re.compile(r"\w+").findall


def table_fingerprints(words: set[str]) -> np.ndarray:
    """One fingerprint for each table, of the same word hashes mixed anew; no words: all zero."""
    return _table_fingerprints(np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64))


def _table_fingerprints(own: np.ndarray) -> np.ndarray:
    out = np.zeros(TABLES, dtype=np.uint64)
    for t in range(TABLES):
        h = (own ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out[t] = majority(h ^ (h >> np.uint64(32))) & ((1 << TABLE_BITS) - 1)
    return out


#: Slices of the prefix shingles, by value, that are searched for shared ones in turn: a slice's shuffles go before the next.
PASSES = 4
#: Of the exact path: documents of the sample that frequent shingles are looked up in, how many of them count, and words of 64 bits in
#: a text's parity sketch. They bear on the cost alone, not on what is found.
SAMPLE, FREQUENT, SKETCH = 8_000, 100_000, 16


def shingle_set(words: list[str], width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles that jaccard compares."""
    return _shingle_set(words, {w: xxhash.xxh64_intdigest(w) for w in set(words)}, width)


def _shingle_set(words: list[str], hashes: dict[str, int], width: int) -> np.ndarray:
    size = min(width, len(words))
    own = np.array(list(map(hashes.__getitem__, words)), dtype=np.uint64)
    h = np.full(len(own) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h = (h ^ own[i : len(own) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def prefix(shingles: np.ndarray, frequent: np.ndarray, ranks: np.ndarray, least: float) -> np.ndarray:
    """The first shingles in one order for all texts, the least frequent first, of which two texts share one at least if
    their similarity is least or more."""
    n = len(shingles)
    rank = np.zeros(n, dtype=np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, ranks[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - math.ceil(least * n - 1e-9) + 1]]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles in each of 64 * SKETCH cells: two texts' sketches differ in no more bits than
    there are shingles that only one of the texts has."""
    cells = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _frequent(known: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more documents of a sample hold, sorted, and in how many."""
    share = max(1, math.ceil(known.count() / SAMPLE))

    def mapped(parts):
        for part in batches(parts, 1 << 20):
            own = [shingle_set(_tokens((t or "").lower()), width) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *own]).view(np.int64))], names=["h"])

    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("text")
    rows = some.mapInArrow(mapped, "h bigint").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).collect()
    hashes, counts = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64), np.array([r["count"] for r in rows], dtype=np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def jaccard(a: list[str], b: list[str], width: int = 5) -> float:
    """Of the sets of shingles of width words, all words if there are fewer; two texts without words are alike."""
    x, y = ({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def _verified(pairs: DataFrame, bodies: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b, ok): whether the texts of two documents are similar."""
    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(bodies.toDF("a", "text_a"), "a").join(bodies.toDF("b", "text_b"), "b")

    def verified(parts):
        for part in batches(parts, 4 << 20):
            a, b = (part.column(c).to_pylist() for c in ("text_a", "text_b"))
            ok = [jaccard(_tokens((x or "").lower()), _tokens((y or "").lower()), width) >= least for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(verified, f"a {kind}, b {kind}, ok boolean")


def _may_be_similar(x: str, y: str, least: float):
    """False only where the sizes and sketches of two texts prove a similarity below least."""
    sizes = F.least(f"{x}.n", f"{y}.n") >= F.lit(least) * F.greatest(f"{x}.n", f"{y}.n") - 1e-6
    differ = sum((F.bit_count(F.col(f"{x}.sketch")[i].bitwiseXOR(F.col(f"{y}.sketch")[i])) for i in range(SKETCH)), F.lit(0))
    return sizes & (differ <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * ((1 - least) / (1 + least)) + 1e-6)


def similar_roots(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """Rows (doc_id, text_key, root): the near-duplicate group of each document, named by its smallest doc_id.

    Groups are the components of all pairs of texts whose words (runs of letters and digits, lower-cased) have a shingle
    Jaccard of at least least. Equal texts are one at once, by hash. Then texts of which one of TABLES fingerprints of 48
    bits is within three bits are linked, as stars and spanning forests, and each link is checked exactly: that settles
    large groups of copies by few links. What it leaves is found exactly: similar texts share one of their
    prefix shingles, so a shingle whose texts are of one group already is done. Of any other its texts are compared with
    the smallest first, and then all those pairs of different groups that sizes, sketches and the number of shared prefix
    shingles do not rule out. The number of these is bounded by nothing but the texts. Rows without doc_id aren't listed.
    """
    known = repaired(docs.where("doc_id is not null").select("doc_id", "text")).select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"))
    frequent = known.sparkSession.sparkContext.broadcast(_frequent(known, width))

    def mapped(parts):
        for part in batches(parts, 4 << 20):
            fps, sizes, prefixes, sketches = [np.empty(0, np.uint64)], [], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for t in part.column("text").to_pylist():
                words = _tokens((t or "").lower())
                hashes = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
                own = _shingle_set(words, hashes, width)
                fps.append(_table_fingerprints(np.array(list(hashes.values()), dtype=np.uint64)))
                sizes.append(len(own))
                prefixes.append(prefix(own, *frequent.value, least))
                sketches.append(sketch(own))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([len(v) for v in x]), pa.int32()), pa.array(np.concatenate(x).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), lists(fps), pa.array(sizes, pa.int32()), lists(prefixes), lists(sketches)], names=["doc_id", "text_key", "fps", "n", "prefix", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = known.mapInArrow(mapped, f"doc_id {kind}, text_key binary, fps array<bigint>, n int, prefix array<bigint>, sketch array<bigint>")
    texts = stored(made.groupBy("text_key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("fps", "n", "prefix", "sketch")]))
    release(known.sparkSession)
    by_table = checkpointed(texts.select("rep", F.posexplode("fps").alias("t", "fp")).groupBy("t", "fp").agg(F.min("rep").alias("centre"), F.count("*").alias("n")))
    alike = texts.select("rep", F.posexplode("fps").alias("t", "fp")).join(by_table.where("n > 1"), ["t", "fp"]).select(F.col("centre").alias("a"), F.col("rep").alias("b"))
    links = checkpointed(ball_links(by_table.select("t", "fp"), TABLE_BITS, TABLE_CELL))
    ends = by_table.select("t", "fp", "centre")
    near = links.join(ends.toDF("t", "a", "x"), ["t", "a"]).join(ends.toDF("t", "b", "y"), ["t", "b"]).select(F.col("x").alias("a"), F.col("y").alias("b"))

    def similar(pairs):
        pairs = checkpointed(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        some = may_hold(known, "doc_id", ids).where("_held").drop("_held")  # else all texts would be shuffled for a few
        bodies = some.join(texts.select(F.col("rep").alias("doc_id"), "text_key"), ["doc_id", "text_key"], "left_semi")
        bodies = stored(bodies.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text"))
        return checkpointed(_verified(pairs, bodies, width, least).where("ok").select("a", "b"))

    def with_roots(rows, roots):
        return rows.join(roots, rows["rep"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "rep").alias("root"))

    def enough(shared):
        """Of pairs with a row for each prefix shingle that both hold, those that may be similar: of the text whose prefix
        ends first, all prefix shingles that the other's lacks are not in the other text at all."""
        pairs = shared.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("x.n").alias("n"), F.first("y.n").alias("m"))
        both = F.ceil((F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-6)
        fits = [F.col(n) - F.ceil(F.col(n) * least - 1e-9) + 1 - F.col("c") <= F.col(n) - both for n in ("n", "m")]
        return pairs.where(fits[0] | fits[1]).select("a", "b")

    found = similar(alike.union(near))
    del by_table, alike, links, ends, near
    release(known.sparkSession)
    shared = []
    for at in range(PASSES):
        keyed = texts.select("rep", F.explode("prefix").alias("key")).where(F.pmod("key", F.lit(PASSES)) == at)
        several = keyed.groupBy("key").count().where("count > 1").select(F.struct("key").alias("k"))
        shared.append(stored(keyed.withColumn("k", F.struct("key")).join(several, "k", "left_semi").select("key", "rep")))
        del keyed, several
        release(known.sparkSession)
    left = functools.reduce(DataFrame.union, shared)

    def unsettled(left):
        """The rows of left whose key has texts of different groups, with root."""
        left = with_roots(left.select("key", "rep"), components(found, kind))
        keys = left.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min("rep").alias("first")).where("least <> most").select(F.struct("key").alias("k"), "first")
        return stored(left.withColumn("k", F.struct("key")).join(keys, "k").select("key", "rep", "root", "first"))

    shape = texts.select("rep", F.struct("n", "sketch").alias("shape"))
    left = unsettled(left)
    first = left.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    first = first.join(shape.toDF("a", "x"), "a").join(shape.toDF("b", "y"), "b")
    found = found.union(similar(enough(first.where(_may_be_similar("x", "y", least)))))
    left = unsettled(left).join(shape, "rep").select("rep", "key", "root", "shape")
    x, y = left.toDF("a", "key", "x_root", "x"), left.toDF("b", "key", "y_root", "y")
    rest = x.join(y, (x["key"] == y["key"]) & (x["a"] < y["b"]) & (x["x_root"] != y["y_root"]) & _may_be_similar("x", "y", least)).select("a", "b", "x", "y")
    found = found.union(similar(enough(rest)))
    roots = components(found, kind)
    rooted = checkpointed(texts.join(roots, texts.rep == roots.node, "left").select("text_key", F.coalesce("root", "rep").alias("root")))
    return known.select("doc_id", "text_key").join(rooted, "text_key")


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one row of each near-duplicate group: the one of the smallest doc_id.

    Groups are those of similar_roots. Of rows that share a doc_id one stays, that of the smallest text, nulls last. Rows
    without doc_id stay. Null and empty texts are alike and leave one row. Texts of any length are read whole; all columns
    of docs are kept, whatever their names; an empty table stays empty.
    """
    roots = similar_roots(docs, width, least)
    ids = stored(roots.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("root")).alias("first")))
    release(docs.sparkSession)
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    # Rows whose doc_id is neither repeated nor to go stay where they are; only what may be is shuffled.
    own = may_hold(rows.where("doc_id is not null"), "doc_id", ids.where("n > 1 or not first").select("doc_id"))
    by = Window.partitionBy("doc_id").orderBy(F.col("text").isNull(), "text")
    chosen = own.where("_held").join(ids.where("first").select("doc_id"), "doc_id", "left_semi").withColumn("n", F.row_number().over(by)).where("n = 1")
    chosen = chosen.select("row").union(own.where("not _held").select("row")).union(rows.where("doc_id is null").select("row"))
    return chosen.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
