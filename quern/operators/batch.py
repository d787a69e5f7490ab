"""Batches: a plan joined to its tokens, rows put together, and the loader."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import PADDING, EpochConfig
from quern.operators.epoch import interleaved
from quern.operators.pack import resumed, segments, total_steps
from quern.operators.store import read_index, read_spans
from quern.shipping import ship


def steps(plan: DataFrame) -> DataFrame:
    """(epoch, rank, step, n_rows, num_tokens): rows written and the longest of them, without tokens."""
    rows = plan.groupBy("epoch", "rank", "step", "lane").agg(F.max(F.col("write_off") + F.col("write_count")).alias("_end"))
    return rows.groupBy("epoch", "rank", "step").agg(F.count("*").alias("n_rows"), F.max("_end").alias("num_tokens"))


CUT = "epoch int, rank int, step int, lane int, is_continuation boolean, write_off int, width int, part binary"
BATCHES = "epoch int, rank int, step int, row int, lane int, is_continuation boolean, num_tokens int, tokens array<int>"
#: Tokens travel as little-endian numbers of so many bytes.
KINDS = {1: "<u1", 2: "<u2", 4: "<i4"}


def spread(starts, sizes):
    """The places start, start + 1, ... of runs of these sizes, one after the other."""
    import numpy as np

    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def numbers(column: pa.Array):
    """The tokens of a batch of lists, or of binaries with a byte a token, and where each row's begin and end."""
    import numpy as np

    if not pa.types.is_binary(column.type):
        offsets = column.offsets.to_numpy()
        return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, np.int32)
    held = column.buffers()[2]
    return np.frombuffer(held, np.uint8, ends[-1] - ends[0], ends[0]) if held is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8), ends - ends[0]


def narrow(values) -> int:
    """The bytes that each of these tokens needs at most: a key of KINDS."""
    least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    return 4 if least < 0 or most >= 1 << 16 else 2 if most >= 1 << 8 else 1


def widened(part: pa.Array, width):
    """The tokens of binaries whose tokens have `width` bytes each, one row after the other; and how many each has."""
    import numpy as np

    raw, ends = numbers(part)
    sizes = np.diff(ends).astype(np.int64) // width
    kinds = np.unique(width)
    if len(kinds) == 1:
        return raw.view(KINDS[int(kinds[0])]), sizes
    values, starts = np.empty(sizes.sum(), np.int32), np.cumsum(sizes) - sizes
    for kind in kinds:
        own = np.flatnonzero(width == kind)
        values[spread(starts[own], sizes[own])] = raw[spread(ends[:-1][own].astype(np.int64), sizes[own] * kind)].view(KINDS[int(kind)])
    return values, sizes


def cut_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each span's segments with their tokens, from spans with a list of segments."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column(0)
        flat, (values, first) = parts.flatten(), numbers(batch.column(1))
        owner = np.repeat(np.arange(len(batch)), np.diff(parts.offsets.to_numpy()))
        column = {f: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(x.name for x in flat.type)}
        sizes = column["write_count"].astype(np.int64)
        picked = values[spread(first[:-1].astype(np.int64)[owner] + column["read_off"], sizes)]
        width = narrow(picked)
        ends = (np.concatenate([[0], np.cumsum(sizes)]) * width).astype(np.int32)
        cut = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(picked.astype(KINDS[width]).tobytes())])
        names = ["epoch", "rank", "step", "lane", "is_continuation", "write_off"]
        yield pa.RecordBatch.from_arrays([*[pa.array(column[n]) for n in names], pa.array(np.full(len(sizes), width, np.int32)), cut], names=[*names, "width", "part"])


def put_together(padding: int, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None):
    """Rows of BATCHES, or what `then` makes of them, from segments sorted by step, lane and place; a step that a batch breaks off is held for the next."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        import numpy as np

        epoch, rank, step, lane, continues, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        given, sizes = widened(batch.column(7), batch.column(6).to_numpy())

        def changes(*columns):
            return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]))

        starts = changes(epoch, rank, step, lane)
        ends = np.concatenate([starts[1:], [len(at)]]) - 1
        used = at[ends] + sizes[ends]
        steps = changes(epoch[starts], rank[starts], step[starts])
        in_step = np.diff(np.concatenate([steps, [len(starts)]]))
        width = np.repeat(np.maximum.reduceat(used, steps), in_step)
        out = np.concatenate([[0], np.cumsum(width)])
        values = np.full(out[-1], padding, np.int32)
        row_of = np.repeat(np.arange(len(starts)), ends - starts + 1)
        values[spread(out[row_of] + at, sizes)] = given
        tokens = pa.ListArray.from_arrays(pa.array(out.astype(np.int32)), pa.array(values))
        row = np.arange(len(starts)) - np.repeat(steps, in_step)
        columns = [epoch[starts], rank[starts], step[starts], row.astype(np.int32), lane[starts], continues[starts], width.astype(np.int32)]
        made = pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], tokens], names=["epoch", "rank", "step", "row", "lane", "is_continuation", "num_tokens", "tokens"])
        return then(made) if then else made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(i)[-1].as_py() for i in range(3)]
            n = batch.num_rows
            while n and [batch.column(i)[n - 1].as_py() for i in range(3)] == last:
                n -= 1
            if n or (held and [held[-1].column(i)[-1].as_py() for i in range(3)] != last):
                done = [*held, batch.slice(0, n)] if n else held
                yield rows(whole(done))
                held = []
            held.append(batch.slice(n))
        if held:
            yield rows(whole(held))

    return run


def assemble(plan: DataFrame, spans: DataFrame, padding: int = PADDING, n_steps: int | None = None, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = BATCHES) -> DataFrame:
    """Rows of BATCHES: (epoch, rank, step, row, lane, is_continuation, num_tokens, tokens), a step's rows padded to its longest.

    The tokens of `spans` are arrays of ids, or binaries with a byte a token, which
    are a quarter as large. A span's segments are collected (a span has few) and meet
    its tokens once, are cut there, and only what a row needs is shuffled to its step,
    in as few bytes a token as hold it. Empty lanes are left out and later ones move
    up: `row` is the place, `lane` stays. With `n_steps`, the steps of the one epoch
    and rank planned, partitions hold steps in order. `then` makes rows of `schema`
    of batches of whole steps where they are put together, so that tokens which are
    only counted stay there.
    """
    ship(plan.sparkSession)
    segment = F.struct("epoch", "rank", "step", "lane", "is_continuation", "write_off", "read_off", "write_count")
    wanted = plan.groupBy("shard", "span").agg(F.collect_list(segment).alias("parts"))
    kept = F.col("tokens") if dict(spans.dtypes)["tokens"] == "binary" else F.col("tokens").cast("array<int>")
    # Tokens are far larger than what they are made of, by which a broadcast would be judged.
    cut = wanted.join(spans.select("shard", "span", "tokens").hint("merge"), ["shard", "span"]).select("parts", kept.alias("tokens")).mapInArrow(cut_spans, CUT)
    n = max(1, int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut.repartition(n, "epoch", "rank", "step") if n_steps is None else cut.repartitionById(n, F.least(F.floor(F.col("step") * n / max(1, n_steps)), F.lit(n - 1)).cast("int"))
    placed = placed.sortWithinPartitions("epoch", "rank", "step", "lane", "write_off")
    return placed.mapInArrow(put_together(padding, then), schema)


class CorpusLoader:
    """Reads a written corpus in epochs."""

    def __init__(self, spark: SparkSession, path: str, split: str = "train") -> None:
        self.spans = read_spans(spark, path, split)
        self.index = read_index(spark, path, split)
        self.spark = spark
        self.plan: DataFrame | None = None
        self._batches: DataFrame | None = None
        self._rows: Iterator | None = None
        self._held = None
        self.total_steps = 0

    def begin_epoch(self, config: EpochConfig, epoch: int | None = None) -> DataFrame:
        """Plan an epoch; the batches of this rank, as a lazy table whose partitions hold the steps in order."""
        number = config.seed1 if epoch is None else epoch
        epochs = self.spark.range(1).select(F.lit(number).alias("epoch"))
        ordered = interleaved(self.index.select("shard", "span", "token_count"), config.seed0, epochs, config.local_rank_count).where(F.col("rank") == config.local_rank)
        whole = segments(ordered, config.micro_batch_size, config.context_size, config.min_data_length).cache()
        self.plan = whole
        found = total_steps(whole).first()
        self.total_steps = found["total_steps"] if found else 0
        batches = assemble(resumed(whole, config.start_step), self.spans, config.padding_token, self.total_steps)
        self._batches, self._rows, self._held = batches, None, None
        return batches

    def get_micro_batch(self):
        """(rows of tokens, is_continuation, step, total_steps) of the next step, four Nones at the end."""
        if self._batches is None:
            raise RuntimeError("no epoch has begun")
        if self._rows is None:
            self._rows = self._batches.toLocalIterator(prefetchPartitions=True)
        first = self._held or next(self._rows, None)
        if first is None:
            return None, None, None, None
        rows, self._held = [first], None
        for r in self._rows:
            if r["step"] != first["step"]:
                self._held = r
                break
            rows.append(r)
        return [list(r["tokens"]) for r in rows], [r["is_continuation"] for r in rows], first["step"], self.total_steps

    def destroy(self) -> None:
        if self.plan is not None:
            self.plan.unpersist()
        self.plan = self._batches = self._rows = self._held = None
