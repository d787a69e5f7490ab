"""Packing spans into rows of a fixed context, as a plan of segments: no token is read."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.folds import ordered_fold

SEGMENT = "epoch int, rank int, step int, lane int, is_continuation boolean, seg int, shard int, span long, read_off int, write_off int, write_count int"


def plan_rows(spans: Iterator[tuple[int, int, int]], batch: int, context: int, least: int) -> Iterator[tuple]:
    """(step, lane, is_continuation, seg, shard, span, read_off, write_off, write_count) from (shard, span, tokens).

    Per step each lane in turn writes what it carries, then a separator and further
    spans while over `least` places are free. What doesn't fit is carried to the
    lane's next step, unless it is shorter than `least`.
    """
    carry: list[tuple[int, int, int, int] | None] = [None] * batch
    step = 0
    while True:
        wrote = False
        for lane in range(batch):
            held, carry[lane] = carry[lane], None
            at, parts = 0, []
            if held:
                shard, span, done, rest = held
                count = min(rest, context)
                parts.append((shard, span, done, 0, count))
                if rest >= context:
                    at = context
                    if rest - count >= max(least, 1):
                        carry[lane] = (shard, span, done + count, rest - count)
                else:
                    at = rest + 1
            while context - at > least and at < context:
                found = next(spans, None)
                if found is None:
                    break
                shard, span, n = found
                count = min(n, context - at)
                parts.append((shard, span, 0, at, count))
                if at + n >= context:
                    if n - count >= max(least, 1):
                        carry[lane] = (shard, span, count, n - count)
                    break
                at += n + 1
            for seg, part in enumerate(parts):
                yield (step, lane, held is not None, seg, *part)
            wrote = wrote or bool(parts)
        if not wrote:
            return
        step += 1


def segments(ordered: DataFrame, batch: int, context: int, least: int, order: str = "vt") -> DataFrame:
    """Rows of SEGMENT for spans (epoch, rank, `order`, shard, span, token_count); every epoch and rank is planned by itself, all in one job."""

    def fold(key: tuple, rows: Iterator[tuple]):
        for out in plan_rows(((r[3], r[4], r[5]) for r in rows), batch, context, least):
            yield (*key, *out)

    narrow = ordered.select(F.col("epoch").cast("int"), F.col("rank").cast("int"), order, F.col("shard").cast("int"), F.col("span").cast("long"), F.col("token_count").cast("int"))
    return ordered_fold(narrow, ["epoch", "rank"], [order], fold, SEGMENT)


def total_steps(plan: DataFrame) -> DataFrame:
    """(epoch, rank, total_steps) of a plan."""
    return plan.groupBy("epoch", "rank").agg((F.max("step") + 1).alias("total_steps"))


def resumed(plan: DataFrame, start_step: int) -> DataFrame:
    """The plan from a step on; filtered before tokens are joined, so what was done isn't read."""
    return plan.where(F.col("step") >= start_step)


def limited(plan: DataFrame, steps: int) -> DataFrame:
    """The plan up to a training run's last step."""
    return plan.where(F.col("step") < steps)
