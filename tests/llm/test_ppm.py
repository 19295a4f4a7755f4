import math
import random
import zlib
from collections import Counter, defaultdict

from contourflow.llm import ppm
from contourflow.llm.common import id_remainder


def slow_scores(rows):
    """By loops over a dict trie: PPM with escape method C and exclusion."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    words = [(t or "").encode().lower().split() for _, t in rows]
    count, trie = Counter(), defaultdict(Counter)
    for h, w in zip(held, words):
        if h:
            continue
        count.update(w + [b""])
        x = b"\n" * 5 + ppm.serial(w)
        for i in range(5, len(x)):
            for k in range(6):
                trie[x[i - k : i]][x[i]] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for (i, _), h, w in zip(rows, held, words):
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w + [b""])
        x, score = b"\n" * 5 + ppm.serial(w), 0.0
        for p in range(5, len(x)):
            gone: set = set()
            for k in range(5, -1, -1):
                node = trie.get(x[p - k : p])
                if node is None:
                    continue
                left = {s: c for s, c in node.items() if s not in gone}
                total = sum(left.values()) + len(left)
                if x[p] in left:
                    score += math.log10(left[x[p]] / total)
                    break
                if left:
                    score += math.log10(len(left) / total)
                gone |= set(node)
            else:
                score -= math.log10(256 - len(gone))
        out.append((i, h, len(w) + 1, sum(t in count for t in w + [b""]), n, base, score))
    return out


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=repr), sorted(b, key=repr)):
        assert x[:5] == y[:5] and abs(x[5] - y[5]) < 1e-6 and abs(x[6] - y[6]) < 1e-6, (x, y)


def test_against_loops(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sät", "on", "Mat.", "zz", "a"]) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \t\x0b\n "), (63, "ünïcode ☃ new word"), (63, "same id"), (None, "no id"), (64, "x" * 20_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double")
    got = [tuple(r) for r in ppm.score_documents(docs, id_remainder("doc_id", 10) == 0, block_bytes=500, least_blocks=3).collect()]
    same(got, slow_scores(rows))


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(held, "only held out")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    same([tuple(r) for r in ppm.score_documents(docs, id_remainder("doc_id", 10) == 0).collect()], slow_scores(rows))
    assert ppm.score_documents(docs.limit(0), id_remainder("doc_id", 10) == 0).count() == 0
