"""Folds over ordered rows.

A fold keeps a little state and can't be split inside one key, so it sees narrow
integer columns only; keys run in parallel. Rows come as a sorted stream, never as
a group in memory. The partition count is explicit: such an exchange is not
re-planned at run time, so no key straddles partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.shipping import ship

BATCH = 20_000


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, Iterator[tuple]], Iterable[tuple]], schema: str, partitions: int | None = None) -> DataFrame:
    """Rows of `schema` that `fold` makes of each key's rows: fold(key, rows), rows as tuples of df's columns, in `order`."""
    ship(df.sparkSession)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = df.columns
    at = [columns.index(k) for k in keys]

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], f.type) for i, f in enumerate(target)], schema=target)
            held.clear()
            return batch

        for key, group in groupby(rows, key=lambda r: tuple(r[i] for i in at)):
            for out in fold(key, group):
                held.append(out)
                if len(held) >= BATCH:
                    yield made()
        yield made()

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
