"""Averaging of asynchronous weight updates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.folds import ordered_fold


def mean_update(updates: DataFrame, *keys: str, column: str = "values") -> DataFrame:
    """(keys, idx, value): the element-wise mean of named vectors, combined map-side."""
    return updates.select(*keys, F.posexplode(column).alias("idx", "_v")).groupBy(*keys, "idx").agg(F.avg(F.col("_v").cast("double")).alias("value"))


def mean_vector(updates: DataFrame, *keys: str, column: str = "values") -> DataFrame:
    """The means put together as vectors."""
    each = mean_update(updates, *keys, column=column)
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias(column))


def diloco(updates: DataFrame, every: int, inner_lr: float = 0.1, outer_lr: float = 0.7, momentum: float = 0.9) -> DataFrame:
    """(name, idx, seq, value): each parameter after each of its updates (name, idx, seq, value), from 0.

    Until the buffer is full an update is taken at once, p -= inner_lr u; the one
    that fills it applies the buffer's mean with Nesterov momentum instead and
    empties it. Those taken at once count again in the mean; there is no check of
    staleness. Both are how the method is defined. Parameters run in parallel.
    """

    def fold(key: tuple, rows: Iterator[tuple]):
        value, speed, held = 0.0, 0.0, []
        for name, idx, seq, u in rows:
            held.append(u)
            if len(held) < every:
                value -= inner_lr * u
            else:
                g = sum(held) / every
                speed = momentum * speed + g
                value -= outer_lr * (g + momentum * speed)
                held = []
            yield name, idx, seq, value

    narrow = updates.select(F.col("name").cast("string"), F.col("idx").cast("int"), F.col("seq").cast("long"), F.col("value").cast("double"))
    return ordered_fold(narrow, ["name", "idx"], ["seq"], fold, "name string, idx int, seq long, value double")


def registry(events: DataFrame, worker: str, order: list[str], *columns: str) -> DataFrame:
    """The latest row of each worker."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return events.groupBy(worker).agg(last.alias("_l"), F.count("*").alias("n_events")).select(worker, "_l.*", "n_events")


def work_items(workers: DataFrame, epoch: int, model: str, num_steps: int = 50, batch_size: int = 32, learning_rate: float = 1e-3) -> DataFrame:
    """A work item for each registered worker; its id is made of the epoch and the worker, so none occurs twice."""
    return workers.select("worker", F.concat(F.lit("work_"), F.md5(F.concat_ws("|", F.lit(epoch), "worker"))).alias("work_item_id"), F.lit(model).alias("model"), F.lit(num_steps).alias("num_steps"), F.lit(learning_rate).alias("learning_rate"), F.lit(batch_size).alias("batch_size"))
