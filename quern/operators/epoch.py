"""Epoch order: permutations, rank slices and the interleaving of shards, without loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.config import SHARD_REPEATS


def shuffle_key(seed0: Column, seed1: Column, item: Column) -> Column:
    """What a seeded permutation sorts by; the same in every engine."""
    return F.md5(F.concat_ws("|", seed0.cast("string"), seed1.cast("string"), item.cast("string")))


def permutation(index: DataFrame, seed0: int, epochs: DataFrame) -> DataFrame:
    """(epoch, shard, span, pos, ...): each shard's spans in its order of each epoch.

    `epochs` has epoch, of which there are few; a shard's second seed is the epoch
    plus its number. Sorted by shard, in parallel.
    """
    every = index.crossJoin(F.broadcast(epochs.select("epoch")))
    key = shuffle_key(F.lit(seed0), F.col("epoch") + F.col("shard"), F.col("span"))
    return every.withColumn("pos", (F.row_number().over(W.partitionBy("epoch", "shard").orderBy(key, "span")) - 1).cast("long"))


def rank_slice(ordered: DataFrame, ranks: int) -> DataFrame:
    """`ordered` with rank and k, the place in the rank's slice: contiguous slices of ceil(N / ranks), the last ones short or empty."""
    size = F.ceil(F.count("*").over(W.partitionBy("epoch", "shard")) / F.lit(ranks))
    return ordered.withColumn("_m", size).withColumns({"rank": F.floor(F.col("pos") / F.col("_m")).cast("int"), "k": (F.col("pos") % F.col("_m")).cast("long")}).drop("_m")


def shard_order(shards: DataFrame, seed0: int, epochs: DataFrame) -> DataFrame:
    """(epoch, place, shard, nth): every shard sixteen times, shuffled; nth counts a shard's places from 0."""
    listed = shards.select("shard").distinct().select("shard", F.explode(F.sequence(F.lit(0), F.lit(SHARD_REPEATS - 1))).alias("copy"))
    each = listed.crossJoin(F.broadcast(epochs.select("epoch")))
    key = shuffle_key(F.lit(seed0), F.col("epoch"), F.col("shard") * SHARD_REPEATS + F.col("copy"))
    placed = each.withColumn("place", (F.row_number().over(W.partitionBy("epoch").orderBy(key, "shard", "copy")) - 1).cast("long"))
    return placed.select("epoch", "place", "shard", (F.row_number().over(W.partitionBy("epoch", "shard").orderBy("place")) - 1).cast("int").alias("nth"))


def interleaved(index: DataFrame, seed0: int, epochs: DataFrame, ranks: int = 1) -> DataFrame:
    """(epoch, rank, vt, shard, span, token_count): vt orders a rank's spans as drawing from the shard list in turn would.

    The k-th span of a shard is drawn in round k div 16, at the shard's place number
    k mod 16, so its turn is a sum. The list has 16 rows per shard (a shard holds
    gigabytes) and is joined by broadcast.
    """
    sliced = rank_slice(permutation(index, seed0, epochs), ranks)
    order = shard_order(index, seed0, epochs)
    length = order.groupBy("epoch").agg(F.count("*").alias("_l"))
    places = order.join(length, "epoch").select("epoch", "shard", "nth", "place", "_l")
    joined = sliced.withColumn("nth", F.pmod("k", F.lit(SHARD_REPEATS)).cast("int")).join(F.broadcast(places), ["epoch", "shard", "nth"])
    return joined.withColumn("vt", (F.floor(F.col("k") / SHARD_REPEATS) * F.col("_l") + F.col("place")).cast("long")).drop("nth", "place", "_l")
