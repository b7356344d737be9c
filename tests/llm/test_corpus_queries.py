"""Registered queries of the corpus subpackage, against their SQL where there is one, and the pipeline."""

import pytest
from check import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from phrasebench.llm import ORACLES, QUERIES, bpe, mixing, ordermin, perplexity, pii
from phrasebench.llm.queries import tokenizer

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, ROOT)
    if name in ORACLES:
        diff, _ = compare(df, connect(ROOT), ORACLES[name])
        assert not diff, diff
    else:
        assert df.count() > 0


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").withColumn("gone", F.lit("clash")).withColumn("id", F.lit(1))
    good = {r.doc_id for r in perplexity.judge(docs, "doc_id", "text", "lang").where("kept").collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, ROOT)
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == docs.columns
    texts = {r.doc_id: r.text.split() for r in kept.collect()}
    left = {r.doc_id for r in stages["MinHash near-dedup"](spark, kept, ROOT).collect()}
    for i in texts:  # a document that went has a document like it, and no two that stayed are alike
        like = [j for j in texts if j != i and ordermin.similar(texts[i], texts[j]) is not None]
        assert like if i not in left else not [j for j in like if j in left]
    safe = stages["PII"](spark, kept, ROOT)
    old = {v for r in kept.select(pii.found(F.col("text")).alias("h")).collect() for v in r.h}
    new = {v for r in safe.select(pii.found(F.col("text")).alias("h")).collect() for v in r.h}
    assert not old & new and safe.columns == docs.columns
    mixed = stages["mixing"](spark, safe, ROOT)
    assert {r.doc_id for r in mixed.collect()} == good and mixed.columns == docs.columns
    spread = mixed.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("n"))
    before = safe.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("m"))
    rates = [r.n / r.m for r in spread.join(before, "source").collect()]
    assert min(rates) >= 1 and max(rates) <= 2.0 + 1e-9
    ranks, pattern = tokenizer()
    back = bpe.decode(stages["byte-level BPE"](spark, safe, ROOT), "ids", ranks, pattern)
    assert back.join(safe, "doc_id").where(F.col("decoded") != F.col("text").cast("binary")).count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, ROOT)
    assert out.columns == ["doc_id", "source", "lang", "ids"] and out.count() > 100
