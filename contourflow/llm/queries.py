"""Queries of the corpus operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, decontam, kdsearch, langid, linededup, pii, ppm, simhash, sql, substrings, toxicity, urlfilter, variants
from .common import id_remainder, table

#: (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pre-token pattern of a public tokenizer."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"), id_remainder("doc_id", 10) == 0)


def op2_kdsearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", kdsearch.integers(F.col("embedding")).alias("v"))
    return kdsearch.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary(), keep_ids=False)


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), linededup.LONE_WORDS)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model, held_out)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_remainder("doc_id", 4) == 2
    return langid.predict(docs, langid.fit(docs, ~held_out), held_out)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = audit.labelled(audit.text_filters(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"), {"good": "quality", "toxic": "toxic"})
    return audit.audit(flags, list("ABCDE"), ["good", "toxic"])


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), F.col("whole")).alias("kept_sha256"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.corpus_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm": op1_ppm,
    "op2_kdsearch": op2_kdsearch,
    "op3_bpe": op3_bpe,
    "op4_decontam": op4_decontam,
    "op5_linededup": op5_linededup,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_urlfilter": op8_urlfilter,
    "op9_langid": op9_langid,
    "op10_pii": op10_pii,
    "op11_audit": op11_audit,
    "op12_substrings": op12_substrings,
    "op13_variants": op13_variants,
}

ORACLES: dict[str, str] = {
    "op2_kdsearch": sql.TOP_K,
    "op5_linededup": sql.LINE_DEDUP,
    "op8_urlfilter": sql.url_verdicts(URL_RULES),
    "op11_audit": sql.FILTER_AUDIT,
    "op12_substrings": sql.REPEATED_WINDOWS,
    "op13_variants": sql.SPELLING_VARIANTS,
}
