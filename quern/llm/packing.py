"""Packing by power-of-two decomposition: documents are cut into pieces whose lengths are powers of two.

A document of n tokens becomes n // max_len pieces of `max_len` tokens, then one
piece for each set bit of the rest, longest first. A piece is a whole sequence, so
none crosses documents and none is padded; sequences of one length form a bucket,
from which batches of equal shape are drawn.

A null text is an empty one and has the end token only. Repeated rows are packed
each for itself. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import trimmed, worker_cache
from quern.shipping import ship

PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long"
SPECIAL = "<|endoftext|>"


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    """An encoder of a byte-level BPE given both as a tokenizers file and as the same vocabulary in ranks.

    The rank form gives the same ids several times as fast; the tokenizers file is
    used where the text holds a special token's string, which it gives its own id.
    """
    cache = worker_cache()
    if (json_path, ranks_path) not in cache:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        cache[json_path, ranks_path] = fast.encode_ordinary
    fast = cache[json_path, ranks_path]

    def slow(text: str) -> list[int]:
        from tokenizers import Tokenizer

        if json_path not in cache:
            cache[json_path] = Tokenizer.from_file(json_path)
        return cache[json_path].encode(text, add_special_tokens=False).ids

    return lambda text: slow(text) if SPECIAL in text else fast(text)


def cuts(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; `max_len` is a power of two."""
    out = [(i * max_len, max_len) for i in range(n // max_len)]
    at, rest = n // max_len * max_len, n % max_len
    bit = max_len >> 1
    while bit:
        if rest & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def decompose(docs: DataFrame, tokenizer: tuple[str, str, str], max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Rows of PIECES for each document; `ids` are the piece's ids as little-endian unsigned 32-bit numbers."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = byte_bpe(*tokenizer)
        names = ["doc_id", "start", "length", "ids", "doc_tokens"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = np.array(ids, "<u4").tobytes()
                for start, length in cuts(len(ids), max_len):
                    for column, value in zip(rows, (doc_id, start, length, raw[4 * start : 4 * (start + length)], len(ids))):
                        column.append(value)
                size += len(raw)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
                    rows, size = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), PIECES)


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of decompose() with the sequence each fills: `sequence_id` and its `bucket`, log2 of the length.

    Ids of sequences are unique in one result and don't depend on which tokens they
    hold; they follow the order of the partitions, without a shuffle or a sort.
    """
    pieces = decompose(docs, tokenizer, max_len, end_id)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")})


def buckets(packed: DataFrame) -> DataFrame:
    """How many sequences and tokens each bucket holds."""
    return packed.groupBy("bucket", "length").agg(F.count("*").alias("n_sequences"), F.sum(F.col("length").cast("long")).alias("n_tokens"))


def digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
