"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.shipping import ship


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder: one parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
