"""From raw documents to tokens: five stages, each written as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contourflow.llm import bpe, common, decontam, langid, linededup, simhash
from contourflow.llm.queries import vocabulary

#: SQL can't express the kernel classifier, SimHash or BPE; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter (null or empty texts too) go.

    Texts of any length are read whole. Of languages of equal value the first by name is told, and the row stays in any
    case. Repeated rows stay; all columns are kept, whatever their names; an empty table stays empty.
    """
    model = langid.fit(docs, common.id_remainder("doc_id", 4) != 2)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    told = langid.predict(docs.select("text", rest.alias("row")), model, keep_all=True).where(F.col("lang_pred") != langid.UNKNOWN)
    return told.select(*[F.col(c if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines, and single lines of 40 words or more, go after their first occurrence, and documents of which nothing else was left.

    n_chars follows the text. Ties, repeated rows, nulls and long texts as linededup.dedup_lines has them; columns
    n_lines and n_removed would be replaced, all others are kept.
    """
    out = linededup.dedup_lines(docs, linededup.LONE_WORDS).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document of the smallest doc_id stays.

    Nulls, ties, repeated rows, long texts and columns as simhash.one_of_each has them.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go.

    Documents and items without text hold and are none; an empty benchmark leaves all. Whole texts of any length are
    searched; repeated rows share their fate, ties between items don't matter, all columns are kept.
    """
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hashes of them and of what they decode to: doc_id, lang, source, n_tokens, ids,
    ids_sha256, decoded_sha256.

    A null text has no ids; texts of any length are encoded whole; repeated rows stay; other columns go.
    """
    return bpe.encode_documents(docs, *vocabulary(), also=("lang", "source"))


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stored in the shared folder for the next."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
