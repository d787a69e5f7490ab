"""What the operators of this subpackage share."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.shipping import ship


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, not just one task."""
    module = sys.modules.setdefault("_quern_worker_cache", types.ModuleType("_quern_worker_cache"))
    return module.__dict__.setdefault("kept", {})


def trimmed(run):
    """A function of batches that gives memory it has freed back to the system after each batch, for the many others on a machine."""

    def outer(batches):
        import ctypes

        import pyarrow as pa

        try:
            trim = ctypes.CDLL(None).malloc_trim
        except AttributeError:  # not glibc
            trim = None
        for batch in run(batches):
            yield batch
            del batch
            pa.default_memory_pool().release_unused()
            if trim:
                trim(0)

    return outer


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset (local mode)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    cache = worker_cache()
    if "dir" not in cache:
        cache["dir"] = tempfile.mkdtemp(prefix="quern-")
    return "file://" + cache["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read again: cuts the lineage, survives lost executors, evaluates once."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A stored table is broadcast up to this size, counted beforehand, and shuffled beyond.
BROADCAST_BYTES = 64 << 20


def small(table: DataFrame, size: Column) -> DataFrame:
    """`table`, which must be stored, to be broadcast if the sum of `size` over its rows is small; as it is otherwise."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def text_key(text: Column) -> list[Column]:
    """The 128-bit name of a text, t1 and t2; null is named as empty."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(7), body).alias("t2")]


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: Column, hot: int = 200_000, how: str = "inner") -> DataFrame:
    """`rows` joined to `table`, which has one row per key, without a hot key meeting in one task.

    `weight` is the column of `table` that says how many rows have the key. A key
    with over `hot` rows is split into as many salts as it has `hot`s: its row of
    `table` is repeated per salt, its rows are spread over the salts by `spread`.
    There are at most rows / `hot` such keys, which bounds the broadcast list.
    """
    salts = F.ceil(F.col(weight) / F.lit(hot)).cast("int")
    few = table.where(F.col(weight) > hot).select(*keys, salts.alias("_salts"))
    left = rows.join(F.broadcast(few), keys, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_salts")).cast("int"))).drop("_salts")
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
