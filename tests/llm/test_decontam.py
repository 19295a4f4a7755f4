import random
import time
from collections import Counter

from contourflow.llm import decontam
from pyspark.sql import functions as F


def slow(docs, items):
    """Every window of every item's length, by exact similarity."""
    out = []
    for d, text in docs:
        w = decontam.words_of(text or "")
        for k, t in items:
            own = decontam.words_of(t or "")
            if not own or not w:
                continue
            n, want = min(len(own), len(w)), Counter(decontam.shingles(own))
            best = max((decontam.similarity(Counter(decontam.shingles(w[s : s + n])), want), -s) for s in range(len(w) - n + 1))
            if best[0] >= 0.8:
                out.append((d, k, -best[1], n, round(best[0], 9)))
    return sorted(out, key=repr)


def made(rng):
    vocab = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 14, 15, 25, 40])))) for k in range(25)]
    docs = []
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randrange(5, 80))]
        if d % 2:
            leak = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(leak))
                leak[at : at + 1] = rng.choice([[], ["other"], [leak[at], "more"]])
            at = rng.randrange(len(words))
            words[at:at] = leak
        docs.append((d, " ".join(words).upper() if d % 3 else ", ".join(words)))
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (903, " ".join(items[4][1].split()[:-1])), (None, items[5][1])]
    return docs, items + [(50, None), (51, ""), (52, "..."), (53, items[0][1])]


def test_against_every_window(spark):
    rows, items = made(random.Random(12))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = slow(rows, items)
    for limit in (decontam.SLICE, 300):
        got = [(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in decontam.find_leaks(docs, bench, limit).collect()]
        assert sorted(got, key=repr) == want
        kept = decontam.decontaminate(docs, bench, limit)
        bad = {x[0] for x in want}
        assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(i) for i, _ in rows if i not in bad)
        assert kept.columns == docs.columns
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_index_finds_all_within_radius():
    rng = random.Random(3)
    fps = [rng.getrandbits(decontam.BITS) for _ in range(50)]
    index = decontam.HammingIndex(fps)
    for fp in fps[:20]:
        q = fp ^ sum(1 << b for b in rng.sample(range(decontam.BITS), rng.randrange(45)))
        assert index.near(q) == [i for i, x in enumerate(fps) if (x ^ q).bit_count() <= decontam.RADIUS]


def test_index_proposes_few_of_unrelated_items():
    rng = random.Random(4)
    index = decontam.HammingIndex([rng.getrandbits(decontam.BITS) for _ in range(2_000)])
    share = sum(len(index.proposed(rng.getrandbits(decontam.BITS))) for _ in range(100)) / 200_000
    assert share < 0.05


def test_tables_of_halves_find_what_comparing_all_blocks_finds():
    rng = random.Random(8)
    fps = [rng.getrandbits(decontam.BITS) for _ in range(decontam.HammingIndex.FEW + 500)]
    index, plain = decontam.HammingIndex(fps), decontam.HammingIndex(fps)
    plain.halves = []
    assert index.halves
    for i in range(60):
        q = fps[i] ^ sum(1 << b for b in rng.sample(range(decontam.BITS), rng.randrange(60)))
        assert index.proposed(q).tolist() == plain.proposed(q).tolist() and index.near(q) == [j for j, x in enumerate(fps) if (x ^ q).bit_count() <= decontam.RADIUS]


def seconds(work, rounds=3):
    best = float("inf")
    for _ in range(rounds):
        began = time.perf_counter()
        work()
        best = min(best, time.perf_counter() - began)
    return best


def test_cost_of_a_query_grows_less_than_the_index():
    rng = random.Random(9)
    queries = [rng.getrandbits(decontam.BITS) for _ in range(50)]
    small, large = (decontam.HammingIndex([rng.getrandbits(decontam.BITS) for _ in range(n)]) for n in (10_000, 80_000))
    few, many = (seconds(lambda index=index: [index.near(q) for q in queries]) for index in (small, large))
    assert many < 6 * few, (few, many)


def test_a_common_opening_costs_no_more_for_more_items():
    rng = random.Random(10)
    opening = "which of the following statements is"
    items = [(k, opening + " " + " ".join(f"v{rng.randrange(50_000)}" for _ in range(20))) for k in range(4_000)]
    text = " ".join(f"{opening} w{i}" for i in range(400))
    some, every = (decontam.Benchmark(items[:n]) for n in (500, 4_000))
    few, many = (seconds(lambda b=b: b.leaks([text, text])) for b in (some, every))
    assert many < 2 * few + 0.05, (few, many)
    assert [x[0] for x in every.leaks([f"{text} {items[7][1]} {text}"])[0]] == [7]


def test_radius_loses_nothing_at_the_least_similarity():
    rng = random.Random(5)
    worst = 0
    for _ in range(300):
        n = rng.choice([13, 22, 40, 100])
        words = [str(rng.random()) for _ in range(n + 4)]
        other = list(words)
        cut = n // 9  # as many shingles differ as similarity 0.8 allows
        other[:cut] = [str(rng.random()) for _ in range(cut)]
        a, b = decontam.shingles(words), decontam.shingles(other)
        if decontam.similarity(Counter(a), Counter(b)) >= 0.8:
            worst = max(worst, (decontam.simhash(a) ^ decontam.simhash(b)).bit_count())
    assert 0 < worst <= decontam.RADIUS


def test_ids_of_any_type_long_texts_and_clashing_columns(spark):
    rng = random.Random(6)
    item = " ".join(f"v{rng.randrange(500)}" for _ in range(30))
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, f"{long} {item} {long}", 0.5, 7), (2, long, 0.5, 7)], "doc_id int, text string, similarity double, start int")
    for kind in ("int", "string", "bigint"):
        bench = spark.createDataFrame([(5, item, "x")], "item_id int, text string, doc_id string").withColumn("item_id", F.col("item_id").cast(kind))
        got = decontam.find_leaks(docs, bench)
        assert got.schema["item_id"].dataType.simpleString() == kind and [(r.doc_id, str(r.item_id), r.start, r.similarity) for r in got.collect()] == [(1, "5", 200_000, 1.0)]
        assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [2]
