"""Settings and constants."""

from __future__ import annotations

from dataclasses import dataclass

FORMAT_VERSION = 14
PADDING = -1
#: A shard's data file is closed by the write that reaches this size.
ROTATE_BYTES = 0x7FFFFFFF - 1_000_000
#: How often a shard stands in the list from which spans are drawn.
SHARD_REPEATS = 16


@dataclass(frozen=True)
class EpochConfig:
    """What one rank reads in one epoch."""

    seed0: int = 0  # of the run
    seed1: int = 0  # of the epoch
    local_rank: int = 0  # which slice of each shard is read
    local_rank_count: int = 1  # of how many
    padding_token: int = PADDING
    micro_batch_size: int = 4  # rows of a step
    context_size: int = 4096  # places of a row
    min_data_length: int = 64  # shorter tails are dropped
    start_step: int = 0  # steps before it are skipped unread

    def __post_init__(self) -> None:
        if not 0 <= self.local_rank < self.local_rank_count:
            raise ValueError("local_rank must be from 0 to local_rank_count - 1")
        if self.micro_batch_size < 1 or self.context_size < 1 or self.min_data_length < 0 or self.start_step < 0:
            raise ValueError("sizes must be positive")


@dataclass(frozen=True)
class CorpusConfig:
    """How a corpus is made."""

    encoding: str = "p50k_base"
    byte_tokens: bool = False
    holdout_rate: float = 0.1  # percent of tokens
    num_shards: int = 4
    lanes: int = 8  # of the holdout split, decided in parallel
    rotate_bytes: int = ROTATE_BYTES


@dataclass(frozen=True)
class TrainConfig:
    """Defaults of the trainer that reads the batches."""

    context: int = 2050
    microbatch: int = 6
    grad_accum: int = 4
    steps: int = 160_000
    warmup: int = 100
    cooldown: int = 32_000
    lr: float = 1e-2
    min_data_length: int = 64
    checkpoint_interval: int = 100
    max_checkpoints: int = 20


#: The second trainer's settings differ in these.
SECOND_TRAINER = TrainConfig(microbatch=10, lr=4e-3)
