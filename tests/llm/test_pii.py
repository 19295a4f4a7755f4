import hashlib
import random
import re

from contourflow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(x):
    return [int(c) for c in x if c.isascii() and c.isdigit()]


def passes(kind, x):
    d = digits(x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def slow(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def test_base_spans_against_loops(spark):
    rng = random.Random(11)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "a@b.c", "x.y+z%@mail-1.example.co.uk", "@", "user@host", "a@b.c_d@e.f", "10.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "0000255.1.1.1",
            "99999999999999999999.1.1.1", "+1 (449) 555-7462", "+49 30 1234567", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "(602) 555-5136", "é", "🙂", "\n", " ", ".", "-", "7", "word", "ſ٣"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += [None, "", "1 " * 20_000, "9" * 30_000, "a" * 30_000, "a@b" + ".c" * 10_000, "+1" * 5_000, "1." * 9_000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, "a@b.c", "y"), (7, "a@b.c", "y"), (None, "10.0.0.1", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_email string")
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == len(rows)
    want = sorted([(-1 if i is None else i, hashlib.sha256(",".join(slow(t)).encode()).hexdigest()) for i, t, _ in rows])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.base_sha256) for r in got) == want
    for r in got:
        base = [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert r.n_email == sum(s.startswith("email") for s in base) and r.n_card == sum(s.startswith("card") for s in base)
    assert pii.digest(pii.find(docs.limit(0))).count() == 0


def test_added_kinds_and_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 end"), (2, "DE89370400440532013001"), (3, "ssn 123-45-6789"), (4, "code 123-45-6789"), (5, "call (602) 555-5136 now"), (6, "mail a@b.example")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(s.kind, s.text) for s in got[1]] == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert got[2] == [] and got[4] == []
    assert [s.kind for s in got[3]] == ["ssn"] and [s.kind for s in got[5]] == ["tel"]
    assert got[6][0].score > 0.9 and (got[6][0].start, got[6][0].end) == (5, 16)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a@b.c and 10.0.0.1"), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in pii.redacted(docs).collect()} == {1: "[email] and [ip]", 2: ""}


def test_many_spans_in_one_text_take_no_quadratic_time(spark):
    import time

    took = []
    for n in (8_000, 8_000, 32_000):
        text = "mail " + " ".join(f"a{i}@example.com" for i in range(n))
        docs = spark.createDataFrame([(1, text, "x"), (1, text, "x")], "doc_id int, text string, spans string")
        began = time.time()
        rows = pii.find(docs).collect()
        took.append(time.time() - began)
        assert [len(r.spans) for r in rows] == [n, n]
        assert all(text[s.start : s.end] == s.text for s in rows[0].spans[:: n // 50])
    assert took[2] < 8 * took[1] + 2
