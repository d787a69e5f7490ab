"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, linededup, neardup, packing
from quern.llm._common import materialize
from quern.llm.queries import public_byte_bpe
from quern.sources import read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and those without a letter go; the languages learnt, and their scores, reject nothing."""
    model = langid.fit(docs.where(~langid.part(docs["doc_id"], 4, 2)))
    return langid.keep_known(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of two or more lines, found by content-defined chunks and then exactly to their edges, are cut out but for the first; a document of which nothing is left goes. n_chars follows the text."""
    kept = linededup.drop_runs(docs).where("text <> ''")
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one stays: whatever goes has a similarity of 0.8 or more, of five-word shingles, to one that stays."""
    return neardup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.drop_documents(docs, read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, each a sequence of a power of two of tokens."""
    return packing.digest(packing.pack(docs, public_byte_bpe()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontaminate", decontaminate_stage),
    ("packing", pack),
]

#: Connected components and a tokenizer are among the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
