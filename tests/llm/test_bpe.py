import hashlib

import tiktoken
from contourflow.llm import bpe
from contourflow.llm.queries import vocabulary

TEXTS = ["Hello world, it's   fine", "", "über straße 12345  \n\n\t x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語テキスト 🙂🙂", " " * 3000, "=" * 5000, "qwzxjkv" * 800, "<|endoftext|> 'll 've"]


def reference():
    ranks, pattern = vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_tiktoken():
    ranks, pattern = vocabulary()
    codec, own = bpe.Codec(ranks, pattern, memo_size=10), reference()
    for text in TEXTS:
        assert codec.encode(text) == own.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_perfect_hash_is_minimal():
    keys = [str(i * 7919).encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(3000))
    assert h.slot(b"absent") == -1 and bpe.PerfectHash([]).slot(b"x") == -1


def test_rows(spark):
    ranks, pattern = vocabulary()
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(50, None, None), (50, None, None), (None, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = bpe.encode_documents(docs, ranks, pattern).collect()
    assert len(got) == len(rows)
    own = reference()
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        ids = own.encode_ordinary(t)
        assert by[i].ids == ids and by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert by[50].n_tokens == 0 and by[50].ids == []
    assert bpe.encode_documents(docs.limit(0), ranks, pattern).count() == 0


def test_decode_column(spark):
    ranks, pattern = vocabulary()
    docs = spark.createDataFrame([(1, "round trip"), (2, None)], "doc_id bigint, text string")
    got = bpe.decode_ids(bpe.encode_documents(docs, ranks, pattern), ranks)
    assert {r.doc_id: bytes(r.decoded) for r in got.collect()} == {1: b"round trip", 2: b""}


def test_a_worker_keeps_a_codec_no_longer_than_its_broadcast():
    import pickle

    ranks, pattern = vocabulary()
    own = bpe._Vocabulary(ranks, pattern, bpe.PerfectHash([]))
    own.codec = "built"
    assert pickle.loads(pickle.dumps(own)).codec is None
    assert not [x for x in vars(bpe).values() if isinstance(x, dict) and any(isinstance(v, bpe.Codec) for v in x.values())] and not hasattr(bpe, "_codecs")


def test_short_and_long_merges_and_spelling_in_parts():
    ranks, pattern = vocabulary()
    codec, own = bpe.Codec(ranks, pattern), reference()
    raw = [b"thoninti", b"aaaaaaaaaaaaaaaaaaaaaaaa", "wörthlich".encode(), b"qwzxjkv" * 9]
    short = [codec.merge(x) for x in raw]
    codec.SHORT, codec.AT_ONCE = 0, 7
    assert short == [codec.merge(x) for x in raw]
    for text in TEXTS:
        ids = own.encode_ordinary(text)
        assert codec.packed(text).tolist() == ids and codec.decode(ids) == text.encode()
        assert codec.hashes(codec.packed(text)) == (hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
