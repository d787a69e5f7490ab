"""The holdout split."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.folds import ordered_fold


def holdout(docs: DataFrame, rate_percent: float = 0.1, order: str = "doc_id", length: str = "n", lane: str | None = None) -> DataFrame:
    """(lane, `order`, n, held_out) of each document, decided greedily in order within a lane.

    A document is held out while the tokens held so far are under the rate's share of
    all tokens seen, its own included; so a lane overshoots by one document at most.
    Only `order`, `length` and `lane` reach the fold.
    """
    rate = rate_percent / 100
    lanes = F.lit(0) if lane is None else F.col(lane)
    narrow = docs.select(lanes.cast("int").alias("lane"), F.col(order).cast("long").alias(order), F.col(length).cast("long").alias("n"))

    def fold(key: tuple, rows: Iterator[tuple]):
        seen = held = 0
        for lane_, doc, n in rows:
            seen += n
            out = held < int(seen * rate)
            if out:
                held += n
            yield lane_, doc, n, out

    return ordered_fold(narrow, ["lane"], [order], fold, f"lane int, {order} long, n long, held_out boolean")


def split_of(docs: DataFrame, flags: DataFrame, order: str = "doc_id") -> DataFrame:
    """`docs` with split, train or holdout."""
    return docs.join(flags.select(order, "held_out"), order).withColumn("split", F.when(F.col("held_out"), "holdout").otherwise("train")).drop("held_out")


def summary(flags: DataFrame) -> DataFrame:
    """Documents and tokens of each split, and by how much the holdout exceeds nothing: its last document at most."""
    return flags.groupBy("held_out").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))
