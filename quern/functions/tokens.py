"""Tokens: bytes, hashed regex pieces, encoders that are plugged in, and what trainers do with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space is spelt out: engines differ in what \s holds.
PIECES = r" ?\p{L}+| ?\p{N}+| ?[^ \t\n\r\f\x0B\p{L}\p{N}]+|[ \t\n\r\f\x0B]+"


def byte_count(text: Column) -> Column:
    """Number of byte tokens."""
    return F.octet_length(text).cast("long")


def bytes_to_list(texts: pa.Array) -> pa.Array:
    """Lists of the UTF-8 bytes of a batch of texts: the same buffers, seen as numbers."""
    import numpy as np

    raw = texts.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset) if len(raw) else np.zeros(1, np.int32)
    data = raw.buffers()[2]
    values = np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(values.astype(np.int32)), mask=raw.is_null() if raw.null_count else None)


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes, 0 to 255, one token each.

    An Arrow function, several times as fast as cutting up the text's hexadecimal
    form, which is what built-in functions offer.
    """
    return F.arrow_udf(bytes_to_list, "array<int>")(text)


def decode_bytes(tokens: Column) -> Column:
    """The text of byte tokens."""
    return F.decode(F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(t.cast("long")), 2, "0")), "")), "UTF-8")


def regex_pieces(text: Column) -> Column:
    """The pieces a text's hashed tokens stand for; concatenated they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def hashed_id(piece: Column, n_vocab: int) -> Column:
    """A token id from 0 to n_vocab - 1 of a piece: 28 bits of its MD5 modulo n_vocab."""
    return (F.conv(F.substring(F.md5(piece), 1, 7), 16, 10).cast("long") % n_vocab).cast("int")


def encode_with(docs: DataFrame, make: Callable[[], Callable[[str], list[int]]], column: str = "text") -> DataFrame:
    """`docs` with tokens by any encoder; `make` builds it once per task. Special tokens' strings are the encoder's to treat."""
    at = docs.columns.index(column)
    schema = T.StructType([*docs.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            ids = [None if t is None else encode(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "tokens"])

    return docs.mapInArrow(run, schema)


def with_tokens(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with at least one byte token, with their count n; and how many were null or empty."""
    counted = docs.withColumn("n", F.coalesce(byte_count(F.col("text")), F.lit(0)))
    rejected = counted.agg(F.count_if(F.col("text").isNull()).alias("n_null"), F.count_if((F.col("n") == 0) & F.col("text").isNotNull()).alias("n_empty"))
    return counted.where("n > 0"), rejected


def padded_vocab(n_vocab: int, to: int = 128) -> int:
    """n_vocab and a padding token, rounded up to a multiple of `to`."""
    return -(-(n_vocab + 1) // to) * to


def remap_padding(tokens: Column, padding_id: int) -> Column:
    """Padding as the model's own id."""
    return F.transform(tokens, lambda t: F.when(t == -1, F.lit(padding_id)).otherwise(t))


def shifted(tokens: Column) -> list[Column]:
    """inputs, first and second targets of a row of tokens."""
    n = F.greatest(F.size(tokens) - 2, F.lit(0))
    return [F.slice(tokens, at, n) for at in (1, 2, 3)]


def targets_count(targets: Column) -> Column:
    """How many targets aren't padding."""
    return F.size(F.filter(targets, lambda t: t != -1)).cast("long")


def check_ids(tokens: Column) -> Column:
    """The tokens, or an error where an id is outside a signed 32-bit number (its bits would read as padding or less)."""
    return F.when(F.exists(tokens, lambda t: (t < 0) | (t >= 1 << 31)), F.raise_error(F.lit("token id out of range"))).otherwise(tokens)


def rms_norm(vector: Column, eps: float = 1e-6) -> Column:
    """x / sqrt(mean(x^2) + eps)."""
    return F.transform(vector, lambda x: x / F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")) / F.size(vector) + eps))


def rms_norm_by_length(vector: Column) -> Column:
    """x / |x| * sqrt(d); zero vectors stay zero."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double")))
    return F.transform(vector, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x / length * F.sqrt(F.size(vector))))


def learning_rate(step: Column, lr: float, warmup: int, cooldown: int, steps: int) -> Column:
    """Linear warm-up, a constant middle, a square-root cooldown; an error beyond the last step."""
    tail = (step - (steps - cooldown)) / F.lit(cooldown)
    rate = F.when(step < warmup, F.lit(lr) * (step + 1) / warmup).when(step < steps - cooldown, F.lit(lr)).otherwise(F.lit(lr) * (1 - F.sqrt(F.greatest(tail, F.lit(0.0)))))
    return F.when(step > steps, F.raise_error(F.lit("step beyond the last"))).otherwise(rate)


def training_seed(seed: int = -1) -> int:
    """A seed for a whole run: the given one, or a random one of 31 bits where it is negative. As a literal of a plan it is the same for every task."""
    import secrets

    return seed if seed >= 0 else secrets.randbits(31)


def byte_bpe(ranks_path: str, pattern: str):
    """A byte-level BPE of a file of ranks; special tokens' strings are ordinary text."""
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def decode_with(docs: DataFrame, make: Callable[[], Callable[[list[int]], str]], column: str = "tokens") -> DataFrame:
    """`docs` with decoded, the text of its tokens; `make` builds the decoder once per task."""
    at = docs.columns.index(column)
    schema = T.StructType([*docs.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = make()
        for batch in batches:
            texts = [None if t is None else decode(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, schema)
