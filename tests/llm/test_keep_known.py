"""The language stage keeps texts with a letter where no row has a language."""

import corpus_pipeline


def test_nothing_learnt(spark):
    docs = spark.createDataFrame([(0, "some words", None), (1, None, None), (2, "12 !", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [0]
