"""Tokens on their way into batches, and what is counted where they are put together."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import batch, metrics, pack
from quern.plans import catalogue
from tests.test_catalogue import SF, rows

TINY = [["a"], ["ab"], ["abc"], ["abcd", "x" * 2047], ["x" * 2050]]


def same_as_sql(spark, folder, name, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{folder}/documents.parquet/*.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert rows(got.astype(object).where(got.notna(), None)) == rows(want.astype(object).where(want.notna(), None))


def test_tokens_of_any_width_arrive(spark):
    r = random.Random(5)
    most = [255, 65_535, 2**31 - 1]
    made = [(0, i, [r.randrange(0, most[i % 3] + 1) for _ in range(r.randrange(1, 60))]) for i in range(90)]
    spans = spark.createDataFrame(made, "shard int, span long, tokens array<int>").repartition(9, "span")
    ordered = spans.select(F.lit(0).alias("epoch"), F.lit(0).alias("rank"), F.col("span").alias("vt"), "shard", "span", F.size("tokens").alias("token_count"))
    got = {(x["step"], x["lane"]): x["tokens"] for x in batch.assemble(pack.segments(ordered, 3, 32, 4), spans).collect()}
    tokens, want = {i: t for _, i, t in made}, {}
    for step, lane, _, _, _, span, read, write, n in pack.plan_rows(((0, i, len(t)) for _, i, t in made), 3, 32, 4):
        row = want.setdefault((step, lane), [-1] * 32)
        row[write : write + n] = tokens[span][read : read + n]
    width = {s: max(len(t) for (q, _), t in got.items() if q == s) for s, _ in got}
    assert got == {k: t[: width[k[0]]] for k, t in want.items()}
    part = pa.array([b"\x01\x02", b"\xff\xff\x00\x01", b"\xff\xff\xff\xff"], pa.binary())
    values, sizes = batch.widened(part, pa.array([1, 2, 4]).to_numpy())
    assert values.tolist() == [1, 2, 65535, 256, -1] and sizes.tolist() == [2, 2, 1]
    assert batch.widened(part.slice(1, 1), pa.array([2]).to_numpy())[0].tolist() == [65535, 256]


def test_binaries_are_byte_tokens(spark):
    plan = catalogue.planned_by_hash(spark, SF)
    lists, bytes_ = (sorted((x["step"], x["tokens"]) for x in batch.assemble(plan, t(spark, SF)).collect()) for t in (catalogue.tokens_of, catalogue.bytes_of))
    assert lists == bytes_


@pytest.mark.parametrize("name", ["q29b_batches_bn", "q29_batches", "q33_shift_targets"])
def test_texts_are_shuffled_as_they_are(spark, name):
    """Lists of tokens, four times as large, are made only of what a row holds."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "part#" in plan


@pytest.mark.parametrize("texts", TINY)
def test_targets_of_short_rows(spark, tmp_path, texts):
    same_as_sql(spark, tmp_path, "q33_shift_targets", texts)


def test_sums_are_those_of_the_views(spark):
    plan = catalogue.planned_by_hash(spark, SF)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, t: a + t)
    views = metrics.training_views(batch.assemble(plan, catalogue.tokens_of(spark, SF)))
    want = views.select("step", "n_target1", "n_target2", total("inputs"), total("target1"), total("target2"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, catalogue.q33_shift_targets(spark, SF).collect()))
