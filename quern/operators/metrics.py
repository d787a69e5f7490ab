"""What trainers count: tokens, accuracy, losses, sequence lengths, checkpoints."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.config import PADDING
from quern.functions.tokens import shifted, targets_count


def training_views(batches: DataFrame) -> DataFrame:
    """Batches with inputs, both rows of targets and the targets that aren't padding."""
    inputs, first, second = shifted(F.col("tokens"))
    viewed = batches.withColumns({"inputs": inputs, "target1": first, "target2": second})
    return viewed.withColumns({"n_target1": targets_count(F.col("target1")), "n_target2": targets_count(F.col("target2"))})


def running(tokens: pa.Array):
    """Where each row's tokens begin, and how many it has; and of the tokens before each place their sum and how many aren't padding."""
    import numpy as np

    offsets = tokens.offsets.to_numpy().astype(np.int64)
    values = tokens.flatten().to_numpy(zero_copy_only=False)
    before = lambda c: np.concatenate([[0], np.cumsum(c, dtype=np.int64)])
    return offsets[:-1] - offsets[0], np.diff(offsets), before(values), before(values != PADDING)


VIEWS = "step int, n_target1 long, n_target2 long, sum_inputs long, sum_target1 long, sum_target2 long"


def view_sums(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of VIEWS of batches: what training_views() has, summed; nothing is the sum of no tokens."""
    import numpy as np

    start, size, total, real = running(batch.column("tokens"))
    n = np.maximum(size - 2, 0)

    def over(before, by: int):
        at = np.minimum(start + by, len(before) - 1 - n)
        return before[at + n] - before[at]

    sums = [pa.array(over(total, by), mask=n == 0) for by in (0, 1, 2)]
    return pa.RecordBatch.from_arrays([batch.column("step"), pa.array(over(real, 1)), pa.array(over(real, 2)), *sums], names=["step", "n_target1", "n_target2", "sum_inputs", "sum_target1", "sum_target2"])


FILLED = "step int, num_tokens int, n_tokens long"


def filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of FILLED of batches: how many of a row's tokens aren't padding."""
    start, size, _, real = running(batch.column("tokens"))
    return pa.RecordBatch.from_arrays([batch.column("step"), batch.column("num_tokens"), pa.array(real[start + size] - real[start])], names=["step", "num_tokens", "n_tokens"])


DIGESTS = "step int, row int, is_continuation boolean, num_tokens int, sum_tokens long, tokens_md5 string"


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of DIGESTS of batches: the sum of a row's tokens and the MD5 of their list, with commas."""
    import hashlib

    start, size, total, _ = running(batch.column("tokens"))
    values = batch.column("tokens").flatten().to_numpy(zero_copy_only=False)
    sums = [hashlib.md5(",".join(map(str, values[a : a + n].tolist())).encode(), usedforsecurity=False).hexdigest() for a, n in zip(start.tolist(), size.tolist())]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("step", "row", "is_continuation", "num_tokens")], pa.array(total[start + size] - total[start]), pa.array(sums, pa.string())], names=["step", "row", "is_continuation", "num_tokens", "sum_tokens", "tokens_md5"])


def correct(predicted: Column, target: Column) -> Column:
    """1 where a prediction meets a target that isn't padding."""
    return F.when((predicted == target) & (target != -1), 1).otherwise(0)


def all_reduce(by_rank: DataFrame, *keys: str) -> DataFrame:
    """Over ranks: mean loss, tokens and correct ones summed, accuracy in percent."""
    summed = by_rank.groupBy(*keys).agg(F.avg("loss").alias("loss"), F.sum("tokens").alias("tokens"), F.sum("correct").alias("correct"))
    return summed.withColumn("accuracy", 100.0 * F.col("correct") / F.nullif(F.col("tokens"), F.lit(0)))


def masked_loss(log_prob: Column, target: Column) -> Column:
    """Mean cross-entropy of the targets that aren't padding."""
    return F.avg(F.when(target != -1, -log_prob))


def two_heads(first: Column, second: Column) -> Column:
    return (first + second) * 0.5


def running_totals(per_step: DataFrame, *keys: str, order: str = "step", value: str = "tokens") -> DataFrame:
    """Steps with the tokens up to each."""
    return per_step.withColumn(f"{value}_so_far", F.sum(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def throughput(per_step: DataFrame) -> DataFrame:
    """Tokens a second of each step, nothing where no time passed."""
    return per_step.withColumn("tokens_per_s", F.col("tokens") / F.nullif(F.col("step_time"), F.lit(0.0)))


def compression_ratio(index: DataFrame, *keys: str) -> DataFrame:
    """Bytes on disk per token; 0 where there are none."""
    return index.groupBy(*keys).agg(F.coalesce(F.sum("cbytes") / F.nullif(F.sum("token_count"), F.lit(0)), F.lit(0.0)).alias("ratio"))


def parameter_count(parameters: DataFrame) -> DataFrame:
    """Number of trainable parameters, from their shapes."""
    return parameters.where("trainable").agg(F.sum(F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, n: a * n)).alias("n_parameters"))


def cu_seqlens(lengths: DataFrame, key: str, place: str, length: str) -> DataFrame:
    """(key, place, length, start, end, longest): running ends of the sequences of a row that have a length."""
    real = lengths.where(F.col(length) > 0)
    own = W.partitionBy(key)
    end = F.sum(length).over(own.orderBy(place).rowsBetween(W.unboundedPreceding, 0)).cast("long")
    return real.select(key, place, F.col(length).cast("long").alias("length"), (end - F.col(length)).cast("long").alias("start"), end.alias("end"), F.max(length).over(own).cast("long").alias("longest"))


def mask_lengths(masks: DataFrame, key: str = "row", column: str = "lengths") -> DataFrame:
    """Rows (key, place, length) of ragged length arrays."""
    return masks.select(key, F.posexplode(column).alias("place", "length"))


def flat_indices(lengths: DataFrame, key: str, place: str, length: str, width: int) -> DataFrame:
    """Where the tokens of all sequences stand in the flattened, padded rows of `width`."""
    found = cu_seqlens(lengths, key, place, length)
    return found.select(key, place, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("_i")).select(key, place, (F.col(key).cast("long") * width + F.col("_i")).alias("flat_index"))


def to_delete(checkpoints: DataFrame, most: int, by_name: bool = True) -> DataFrame:
    """The one checkpoint to delete when there are over `most`: the first by name or, as it should be, by epoch and step."""
    order = F.struct("name") if by_name else F.struct("epoch", "step", "name")
    found = checkpoints.agg(F.min_by(F.struct(*checkpoints.columns), order).alias("_c"), F.count("*").alias("_n"))
    return found.where(F.col("_n") > most).select("_c.*")


def resume_state(checkpoints: DataFrame) -> DataFrame:
    """Where the latest checkpoint goes on: its epoch, the step after its own, and the totals it kept."""
    last = F.max_by(F.struct(*checkpoints.columns), F.struct("epoch", "step"))
    return checkpoints.agg(last.alias("c")).where("c is not null").select("c.*").withColumn("start_step", F.col("step") + 1)


def next_epoch(state: DataFrame) -> DataFrame:
    """The state at an epoch's rollover; the epoch is the next shuffle's second seed."""
    return state.withColumns({"epoch": F.col("epoch") + 1, "start_step": F.lit(0)})


def seconds_left(done: Column, total: Column, elapsed: Column) -> Column:
    """What remains of a run of `total` equal parts, by the time that the first ones took."""
    return elapsed / F.nullif(done, F.lit(0)) * (total - done)


def progress(parts: DataFrame, every: int = 10) -> DataFrame:
    """Of (done, total, seconds), a row per part that is done: the first of each `every`, with the seconds left."""
    return parts.where(F.col("done") % every == 1).withColumn("seconds_left", seconds_left(F.col("done"), F.col("total"), F.col("seconds")))
