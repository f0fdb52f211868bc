"""The corpus pipeline on a small corpus with planted cases."""

from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id").where("n_chars BETWEEN 1500 AND 6000").orderBy("doc_id").first()
    words = good.text.split(" ")
    # one copy only: lines that three documents hold would go before
    near = " ".join([*words[:40], "other", *words[41:]])
    more = spark.createDataFrame([(10_000, near, good.lang, "planted", len(near))], docs.schema)
    at = docs.unionByName(more)
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, at, DATA), f"test-{name}")
        assert after.columns == docs.columns
        assert after.count() <= at.count()
        assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        at = after
        counts.append(at.where("source = 'planted'").count())
    # the near copy passes the classifier and the line stage; then a document with a smaller id is left
    assert counts == [1, 1, 0, 0]
    packed = corpus_pipeline.STAGES[-1][1](spark, at, DATA)
    assert packed.select("doc_id").distinct().count() == at.count()


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, DATA).where("length > 2048 OR ids IS NULL").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "substring_dedup", "packing"]
