"""The facade: write, load and verify corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import CorpusConfig, EpochConfig
from quern.functions.tokens import byte_tokens, check_ids
from quern.operators.batch import CorpusLoader
from quern.operators.split import holdout
from quern.operators.store import write_corpus
from quern.operators.verify import verify_corpus
from quern.shipping import ship
from quern.sources.listing import with_ordinal

__all__ = ["CorpusConfig", "CorpusLoader", "CorpusWriter", "EpochConfig", "verify_corpus"]


class CorpusWriter:
    """Splits documents (doc_id, unique, and tokens or text) into train and holdout and writes both."""

    def __init__(self, path: str, config: CorpusConfig | None = None) -> None:
        self.path, self.config = path, config or CorpusConfig()

    def write(self, docs: DataFrame, metadata_only: bool = False, n_vocab: int | None = None) -> DataFrame:
        """Returns how many documents were rejected: null or empty ones, of which byte-token texts are made here."""
        ship(docs.sparkSession)
        as_bytes = "tokens" not in docs.columns
        tokens = byte_tokens(F.col("text")) if as_bytes else check_ids(F.col("tokens"))
        ready = docs.select("doc_id", tokens.alias("tokens"))
        good = ready.where(F.size(F.coalesce("tokens", F.array().cast("array<int>"))) > 0)
        lanes = max(1, self.config.lanes)
        flags = holdout(good.select("doc_id", F.size("tokens").alias("n"), F.pmod("doc_id", F.lit(lanes)).alias("lane")), self.config.holdout_rate, lane="lane")
        sized = with_ordinal(flags.withColumn("split", F.when(F.col("held_out"), "holdout").otherwise("train")), "split", "doc_id", name="_at")
        first = sized.groupBy("split").agg(F.min("_at").alias("_first"))  # a row per split
        placed = good.join(sized.join(F.broadcast(first), "split").select("doc_id", "split", (F.col("_at") - F.col("_first")).alias("ord")), "doc_id")
        write_corpus(placed, self.path, self.config, 1 if as_bytes else 4, n_vocab or 256, metadata_only)
        return ready.agg(F.count_if(F.col("tokens").isNull()).alias("n_null"), F.count_if(F.size("tokens") == 0).alias("n_empty"))


def open_corpus(spark: SparkSession, path: str, split: str = "train") -> CorpusLoader:
    return CorpusLoader(spark, path, split)
