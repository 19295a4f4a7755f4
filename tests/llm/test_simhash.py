import itertools
import random

import numpy as np
import xxhash
from contourflow.llm import simhash
from contourflow.llm.common import components, may_hold
from pyspark.sql import functions as F


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_against_loops():
    for text in [None, "", "a", "A b", "one two three", "x y z w " * 40, "Über alles \x0b ok fine"]:
        assert simhash.fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_ball_links_find_every_component(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(12):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])))
            fps.add(x)
    links = [(a, b) for a, b in itertools.combinations(sorted(fps, key=signed), 2) if bin(a ^ b).count("1") <= 3]
    want = slow_components([signed(x) for x in fps], [(signed(a), signed(b)) for a, b in links])
    df = spark.createDataFrame([(t, signed(x)) for x in fps for t in (0, 3)], "t int, fp bigint")
    for per_cell, most in ((512, 1), (10_000, 16)):
        every = simhash.ball_links(df, per_cell=per_cell, most=most)
        edges = every.where("t = 3").select("a", "b")
        assert every.where("t = 0").count() == edges.count()
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in edges.collect())
        got = {n: n for n in want} | {r.node: r.root for r in components(edges).collect()}
        assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(300, 350)] + [(9, 9), (None, 3), (5, 4), (4, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {7: 7} | {i: 7 for i in range(300, 350)} | {4: 4, 5: 4}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    named = {r.node: r.root for r in components(spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string"), "string").collect()}
    assert named == {"a": "a", "b": "a", "c": "a"}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base), (9, base.replace("w150", "other")), (1, None), (2, ""), (4, " \n"), (6, "lone text"), (6, "lone text"), (None, "without id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        assert by[i].fingerprint == f"{slow_fingerprint(t):016x}"
    fps = {signed(slow_fingerprint(t)): 0 for _, t in rows}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    roots = slow_components(fps, links)
    for i, t in rows:
        same = [j for j, u in rows if roots[signed(slow_fingerprint(u))] == roots[signed(slow_fingerprint(t))] and j is not None]
        assert by[i].component_id == (min(same) if same else None)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_groups_of_similar_texts(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(4000)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 300))]
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(len(w) // 100):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, " "), (503, "two words"), (504, "Two, words!"), (505, "two other"), (505, "two other"), (None, "x"), (None, "x"), (506, rows[0][1])]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, root string")
    words = {i: simhash._tokens((t or "").lower()) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(words), 2) if simhash.jaccard(words[a], words[b]) >= 0.8]
    want = sorted(set(slow_components(words, links).values()))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == want
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_forest_keeps_what_is_connected():
    import numpy as np

    none = np.empty(0, np.uint64)
    assert [len(x) for x in simhash._forest(none, none)] == [0, 0]
    a, b = np.array([1, 1, 2, 8], dtype=np.uint64), np.array([2, 3, 3, 9], dtype=np.uint64)
    x, y = simhash._forest(a, b)
    assert len(x) == 3 and {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} >= {(8, 9), (2, 3), (1, 3)}


def _whole_groups(rows):
    words = {i: simhash._tokens((t or "").lower()) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(words), 2) if simhash.jaccard(words[a], words[b]) >= 0.8]
    return sorted(set(slow_components(words, links).values()))


def test_texts_that_differ_in_one_block(spark):
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(4000)]
    rows = []
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(60, 400))]
        block = [rng.choice(vocab) for _ in range(int(len(base) * rng.uniform(0.1, 0.24)))]
        other = rng.choice([base + block, base[: -len(block)], base[:20] + block[: len(block) // 2] + base[20 + len(block) // 2 :]])
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    rows += [(900, ""), (901, "..."), (902, "one two"), (903, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == _whole_groups(rows)


def test_prefix_and_sketch_rule_out_nothing_similar():
    import numpy as np

    rng = random.Random(12)
    for _ in range(300):
        x = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 90))]
        y = list(x[: rng.randrange(len(x) + 1)] if rng.random() < 0.3 else x) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(8))]
        a, b = simhash.shingle_set(x), simhash.shingle_set(y)
        same = len(np.intersect1d(a, b))
        assert abs(same / (len(a) + len(b) - same) - simhash.jaccard(x, y)) < 1e-12
        frequent = np.sort(np.unique(np.concatenate([a[::3], b[::4]])))
        if simhash.jaccard(x, y) >= 0.8:
            assert len(np.intersect1d(simhash.prefix(a, frequent, np.arange(len(frequent)) + 3, 0.8), simhash.prefix(b, frequent, np.arange(len(frequent)) + 3, 0.8)))
        differ = int(np.bitwise_count((simhash.sketch(a) ^ simhash.sketch(b)).view(np.uint64)).sum())
        assert differ <= len(a) + len(b) - 2 * same


def test_copies_inside_a_family_of_letters(spark):
    rng = random.Random(13)
    vocab, fixed = [f"v{i}" for i in range(3000)], [f"f{i}" for i in range(100)]
    pairs = []
    for _ in range(800):
        own = [rng.choice(vocab) if i % 12 == 6 else w for i, w in enumerate(fixed)]
        copy = list(own)
        copy[rng.randrange(100)] = rng.choice(vocab)
        pairs.append((own, copy))
    # Texts of different pairs have at most 0.6 of their shingles in common, those of one pair 0.9.
    ids = rng.sample(range(1600), 1600)
    rows = [(i, " ".join(w)) for i, w in zip(ids, itertools.chain(*pairs), strict=True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == sorted(map(min, ids[::2], ids[1::2]))


def test_a_cell_gives_the_same_links_in_any_number_of_parts():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**16, 3_000, dtype=np.uint64) << np.uint64(32)
    fps = np.unique(np.concatenate([fps, fps ^ simhash._BITS[rng.integers(0, 60, 3_000)]]))
    one, many = simhash._meet(fps, 0, 64, 0, 1 << 30), simhash._meet(fps, 0, 64, 0, 1 << 16)
    roots = lambda links: simhash._forest(*links)[0].size
    assert len(one[0]) == roots(many) == roots((np.concatenate([one[0], many[0]]), np.concatenate([one[1], many[1]]))) > 0


def test_rounds_of_components_keep_true_sizes(spark):
    edges = spark.range(2_000).selectExpr("cast(pmod(hash(id), 100000) as bigint) a", "cast(pmod(hash(id + 1), 100000) as bigint) b")
    roots = components(edges)
    assert int(str(roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 30


def test_masks_of_variants_are_made_once():
    """Every cell asks for the same ones; making them anew took most of near-dedup's time."""
    assert simhash._variants(48, 14, True, 3) is simhash._variants(48, 14, True, 3) and simhash._pairs(48) is simhash._pairs(48)


def shuffled(spark, run):
    """What run returns, and the bytes that its stages shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    out = run()
    return out, sum(n for k, n in written().items() if k not in before)


def test_texts_without_copies_are_not_shuffled(spark):
    """The disk that near-dedup takes is that of its shuffles; whole texts went through four of them."""
    rng = random.Random(14)
    rows = [(i, " ".join(f"{rng.randrange(10**9):x}" for _ in range(2_000))) for i in range(150)]
    rows += [(500 + i, rows[i][1] + " more") for i in range(3)] + [(7, rows[7][1]), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).cache()
    docs.count()
    got, n = shuffled(spark, lambda: sorted(r.doc_id for r in simhash.one_of_each(docs).select("doc_id").collect()))
    assert got == list(range(150)) and n < 2 * sum(len(t or "") for _, t in rows)


def test_bitmap_never_loses_a_key(spark):
    for kind in ("bigint", "string"):
        rows = spark.range(40_000).select((F.col("id") * 7919).cast(kind).alias("k"), F.lit(1).alias("a b"), (F.col("id") % 40 == 0).alias("is"))
        told = may_hold(rows, "k", rows.where("is").select("k"))
        assert told.columns == ["k", "a b", "is", "_held"] and told.count() == 40_000
        assert told.where("is and not _held").count() == 0 and told.where("not is and _held").count() < 100
        assert may_hold(rows, "k", rows.where("k is null").select("k")).where("_held").count() == 0
