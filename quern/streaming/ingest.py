"""Incremental ingest of text files into tokenized spans, and a live worker registry, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.tokens import byte_tokens
from quern.operators.average import registry


def tokenized(docs: DataFrame) -> DataFrame:
    """doc_id, token_count, tokens of documents with text; works on batches and streams."""
    return docs.where(F.octet_length("text") > 0).select("doc_id", F.octet_length("text").alias("token_count"), byte_tokens(F.col("text")).alias("tokens"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = 4, num_shards: int = 4) -> StreamingQuery:
    """Append the tokens of all files that are new in `source` to `target`, by shard.

    Back-pressure is the number of files per trigger; the checkpoint and the file
    sink's log make each file count once, also after a restart.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    spans = tokenized(stream).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(num_shards)).cast("int"))
    return spans.writeStream.format("parquet").partitionBy("shard").option("path", target).option("checkpointLocation", checkpoint).option("compression", "zstd").trigger(availableNow=True).start()


def live_registry(events: DataFrame, worker: str, order: list[str], name: str, checkpoint: str, *columns: str) -> StreamingQuery:
    """A table in memory of each worker's latest row, kept up to date as events come."""
    return registry(events, worker, order, *columns).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
