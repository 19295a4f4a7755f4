"""Texts that aren't UTF-8: every operator reads them with replacement characters."""

import pytest
from contourflow.llm import bpe, decontam, langid, linededup, pii, ppm, simhash, toxicity
from contourflow.llm.queries import vocabulary
from pyspark.sql import functions as F

ROW = "FF41422061206220632064206520660A"


@pytest.fixture(scope="module")
def docs(spark):
    bad = [f"select {i}L as doc_id, cast(X'{h}' as string) as text, 'en' as lang, 's' as source" for i, h in ((1, ROW), (2, "C328" + ROW), (3, "E28228A1" + ROW * 40), (4, "414220612062"))]
    return spark.sql(" union all ".join(bad)).withColumn("n_chars", F.length("text").cast("bigint"))


def test_no_operator_fails(spark, docs):
    none, items = F.lit(False), docs.select(F.col("doc_id").alias("item_id"), "text")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1)], "doc_id bigint, toxic int")
    assert ppm.score_documents(docs, none).count() == 4
    leaks = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, items).collect()}
    assert {(i, i) for i in (1, 2, 3, 4)} <= leaks and decontam.decontaminate(docs, items).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True)), none).count() == 4
    assert langid.predict(docs, langid.fit(docs, F.lit(True)), none).count() == 4
    kept = langid.predict(docs, langid.fit(docs, F.lit(True)), keep_all=True).where("doc_id = 1").first()
    assert kept.text == bytes.fromhex(ROW).decode(errors="replace")
    assert simhash.near_duplicates(docs).count() == 4 and simhash.one_of_each(docs).count() >= 2
    assert linededup.dedup_lines(docs).count() == 4 and pii.digest(pii.find(docs)).count() == 4
    assert bpe.encode_documents(docs, *vocabulary()).count() == 4


def test_replaced_as_other_decoders_do(docs):
    for r in docs.select(F.make_valid_utf8("text").alias("t"), F.col("text").cast("binary").alias("raw")).collect():
        assert r.t == bytes(r.raw).decode(errors="replace")
