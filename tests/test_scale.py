"""What only shows above the sizes at which ranges are sampled."""

import pytest
from pyspark.sql import functions as F

from quern.api import CorpusConfig, CorpusWriter, verify_corpus
from quern.operators.store import read_spans
from quern.plans import catalogue
from quern.sources.listing import with_ordinal
from tests.test_catalogue import TABLES, rows

SF = "/root/testdata/sf0.1"


def test_ordinals_of_two_million_rows(spark):
    n = 2_000_000
    df = spark.range(n, numPartitions=13).select(((F.col("id") * 7919 + 13) % n).alias("doc_id"))
    got = with_ordinal(df, "doc_id").agg(F.count("*"), F.count_if(F.col("ord") != F.col("doc_id"))).first()
    assert tuple(got) == (n, 0)


def test_ordinals_with_nulls_and_two_columns(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 100).cast("string")).alias("a"), "id")
    got = sorted((r["ord"], r["a"], r["id"]) for r in with_ordinal(df, "a", "id").collect())
    assert [r[0] for r in got] == list(range(100_000))
    assert [r[1:] for r in got] == sorted((r[1:] for r in got), key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_written_corpus_of_100_000_documents(spark, tmp_path):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    CorpusWriter(str(tmp_path), CorpusConfig(byte_tokens=True, holdout_rate=5.0)).write(docs)
    seen = 0
    for split in ("train", "holdout"):
        assert verify_corpus(spark, str(tmp_path), split).collect() == []
        spans = read_spans(spark, str(tmp_path), split)
        n, places, least, greatest = spans.agg(F.count("*"), F.countDistinct("shard", "span"), F.min("doc_id"), F.countDistinct("doc_id")).first()
        assert n == places == greatest
        seen += n
    assert seen == 100_000


@pytest.mark.parametrize("name", "q04_chunk4 q05_strided_shard q15_offsets q19_footer_xor q21_verify_corrupt q22_permutation q25_interleave".split())
def test_same_rows_at_ten_times(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert rows(got) == rows(want)
