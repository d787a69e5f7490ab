"""Shards: assignment, offsets, footers, manifest, rotation; writing and reading corpora."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import FORMAT_VERSION, ROTATE_BYTES, CorpusConfig
from quern.functions.tokens import padded_vocab
from quern.shipping import ship
from quern.sources.listing import count_at_most, longs

SPLITS = ("train", "holdout")
SPANS = "span long, doc_id long, token_count int, cbytes long, tokens array<int>, split string, shard int"
INDEX = "span long, offset long, token_count int, split string, shard int"


def assign(docs: DataFrame, num_shards: int, ordinal: str = "ord") -> DataFrame:
    """`docs` with shard and span, dealt in turn by their ordinal: no counter, no shuffle."""
    return docs.withColumns({"shard": F.pmod(F.col(ordinal), F.lit(num_shards)).cast("int"), "span": F.floor(F.col(ordinal) / F.lit(num_shards)).cast("long")})


def with_offsets(spans: DataFrame, size: str = "cbytes", by: list[str] | None = None) -> DataFrame:
    """`spans` with the bytes before each in its shard."""
    before = W.partitionBy(*by or ["shard"]).orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def with_sizes(index: DataFrame, footers: DataFrame) -> DataFrame:
    """`index` with each span's size: to the next one's offset, the last one's to the file's end as its footer has it."""
    following = F.lead("offset").over(W.partitionBy("shard").orderBy("span"))
    return index.join(footers.select("shard", "data_bytes"), "shard").withColumn("size", F.coalesce(following, F.col("data_bytes")) - F.col("offset")).drop("data_bytes")


def md5_bits(value: Column) -> Column:
    """The first 60 bits of a value's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def footers(index: DataFrame, record_hash: Column, data_hash: Column, token_bytes: int, version: int = FORMAT_VERSION) -> DataFrame:
    """A footer for each shard: counts, bytes and XORs of its records' hashes, combined map-side.

    A XOR doesn't see two equal records come or go, so spans are counted too.
    """
    made = index.groupBy("shard").agg(F.count("*").alias("n_spans"), F.sum("token_count").cast("long").alias("n_tokens"), F.sum("cbytes").cast("long").alias("data_bytes"), F.bit_xor(record_hash).alias("index_hash"), F.bit_xor(data_hash).alias("data_hash"))
    return made.withColumns({"version": F.lit(version), "token_bytes": F.lit(token_bytes)})


def rotate(spans: DataFrame, cap: int = ROTATE_BYTES, keys: str | list[str] = "shard", order: str = "span", size: str = "cbytes") -> DataFrame:
    """(keys, order, size, file, offset): which file of its writer a span falls in; a file is closed by the write that reaches `cap`.

    Sequential within a writer, but a step of the loop is a file: where it ends is
    looked up in running sums.
    """
    ship(spans.sparkSession)
    keys = [keys] if isinstance(keys, str) else keys
    narrow = spans.select(*keys, F.col(order).cast("long"), F.col(size).cast("long"))
    k, columns = len(keys), [*narrow.columns, "file", "offset"]
    schema = T.StructType([*narrow.schema.fields, T.StructField("file", T.IntegerType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        writer, file, used = None, 0, 0
        for batch in batches:
            names = list(zip(*(c.to_pylist() for c in batch.columns[:k])))
            sizes = batch.column(k + 1).to_numpy().astype(np.int64)
            files, offsets = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
            before = np.concatenate([[0], sizes.cumsum()])
            start = 0
            while start < len(sizes):
                if names[start] != writer:
                    writer, file, used = names[start], 0, 0
                stop = bisect_right(names, writer, start) if names[-1] != writer else len(names)
                at = start
                while at < stop:
                    # The first span with which the file reaches its cap, if there is one here.
                    end = min(int(np.searchsorted(before[at + 1 : stop + 1], before[at] + cap - used)) + at + 1, stop)
                    files[at:end] = file
                    offsets[at:end] = used + before[at:end] - before[at]
                    used += int(before[end] - before[at])
                    if used >= cap:
                        file, used = file + 1, 0
                    at = end
                start = stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(files), pa.array(offsets)], names=columns)

    n = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartition(n, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def manifest(footer_rows: list, token_bytes: int, version: int = FORMAT_VERSION) -> dict:
    """The manifest of shards, from their footers (one small row each); a corpus without shards is valid."""
    shards = sorted(footer_rows, key=lambda r: r["shard"])
    return {
        "version": version,
        "token_bytes": token_bytes,
        "total_tokens": sum(r["n_tokens"] for r in shards),
        "data_files": [f"data_{r['shard']}.bin" for r in shards],
        "index_files": [f"index_{r['shard']}.bin" for r in shards],
    }


def read_manifest(text: str, token_bytes: int | None = None, version: int = FORMAT_VERSION) -> dict:
    """A manifest, checked: its lists are there and of one length, its version and width as expected."""
    found = json.loads(text)
    if found.get("version") != version:
        raise ValueError(f"version {found.get('version')} where {version} was expected")
    if not isinstance(found.get("token_bytes"), int) or token_bytes not in (None, found["token_bytes"]):
        raise ValueError("token_bytes differ")
    data, index = found.get("data_files"), found.get("index_files")
    if not isinstance(data, list) or not isinstance(index, list) or len(data) != len(index):
        raise ValueError("data_files and index_files must be lists of one length")
    return found


def manifest_table(spark: SparkSession, found: dict) -> DataFrame:
    """shard, data_file and index_file of a manifest."""
    one = spark.createDataFrame([(found["data_files"], found["index_files"])], "d array<string>, i array<string>")
    return one.select(F.posexplode(F.arrays_zip("d", "i")).alias("shard", "f")).select("shard", F.col("f.d").alias("data_file"), F.col("f.i").alias("index_file"))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in any file system Spark can write to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def get_text(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path, wholetext=True).first()
    return row["value"] if row else ""


def files_of(placed: DataFrame) -> DataFrame:
    """(split, writer, file, first, shard) of rotated spans: where each file begins, and its number among its split's shards, from 0.

    A row a file, of gigabytes, so the one window over them is short.
    """
    files = placed.groupBy("split", "writer", "file").agg(F.min("seq").alias("first"))
    return files.withColumn("shard", F.row_number().over(W.partitionBy("split").orderBy("file", "writer")) - 1)


def write_corpus(docs: DataFrame, path: str, config: CorpusConfig, token_bytes: int = 4, n_vocab: int = 256, metadata_only: bool = False) -> None:
    """Write documents (doc_id, split, ord, tokens) under `path`: spans as zstd Parquet by split and shard, their index, footers, manifests and the arguments.

    Documents are dealt to config.num_shards writers in turn; a writer's file is
    closed by the write that reaches config.rotate_bytes, and each file is a shard,
    written by a task of its own. Offsets are those of the rotation and are stored in
    the index, apart from the data. Overwrites. Ordinals count within a split.
    Documents without tokens must have been taken out before.
    """
    spark = docs.sparkSession
    arguments = asdict(config) | {"n_vocab": n_vocab, "padded_vocab": padded_vocab(n_vocab)}
    put_text(spark, f"{path}/args.json", json.dumps(arguments, indent=1, sort_keys=True))
    if metadata_only:
        return
    dealt = assign(docs, config.num_shards).withColumnsRenamed({"shard": "writer", "span": "seq"}).withColumns({"token_count": F.size("tokens"), "cbytes": (F.size("tokens") * token_bytes).cast("long")})
    rotated = rotate(dealt.select("split", "writer", "seq", "cbytes"), config.rotate_bytes, ["split", "writer"], "seq")
    files_of(rotated).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
    # A row a file, of gigabytes: few enough to be literals, in which a document finds its file by halving.
    files = sorted(spark.read.parquet(f"{path}/files").collect(), key=lambda r: (SPLITS.index(r["split"]), r["writer"], r["first"]))
    writers = [SPLITS.index(r["split"]) * config.num_shards + r["writer"] for r in files]
    code = F.when(F.col("split") == SPLITS[0], F.col("writer")).otherwise(F.col("writer") + config.num_shards).cast("long")
    place = count_at_most(longs([w << 40 | r["first"] for w, r in zip(writers, files)]), len(files), F.shiftleft(code, 40) + F.col("seq")) - 1
    located = dealt.withColumn("_f", place)
    shard, first = F.get(longs([r["shard"] for r in files]), F.col("_f")), F.get(longs([r["first"] for r in files]), F.col("_f"))
    spans = located.select("split", shard.cast("int").alias("shard"), (F.col("seq") - first).alias("span"), "doc_id", "token_count", "cbytes", "tokens")
    n_files = max(1, len(files))
    spans.repartition(n_files, "split", "shard").sortWithinPartitions("split", "shard", "span").write.mode("overwrite").option("compression", "zstd").partitionBy("split", "shard").parquet(f"{path}/spans")
    stored = spark.read.schema(SPANS).parquet(f"{path}/spans")
    # The index is made of lengths again, not of the rows before them, and its offsets are sums within a file.
    with_offsets(stored.select("split", "shard", "span", "token_count", "cbytes"), by=["split", "shard"]).select("split", "shard", "span", "offset", "token_count").sortWithinPartitions("split", "shard", "span").write.mode("overwrite").option("compression", "zstd").partitionBy("split", "shard").parquet(f"{path}/index")
    for split in SPLITS:
        index = read_index(spark, path, split)
        hashed = stored.where(F.col("split") == split).select("shard", "span", "cbytes", F.xxhash64("span", "tokens").alias("h"))
        made = footers(index.join(hashed, ["shard", "span"]), F.xxhash64("span", "offset", "token_count"), F.col("h"), token_bytes)
        made.coalesce(1).write.mode("overwrite").parquet(f"{path}/footers/{split}")
        put_text(spark, f"{path}/{split}.json", json.dumps(manifest(spark.read.parquet(f"{path}/footers/{split}").collect(), token_bytes), indent=1))


def read_index(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """shard, span, offset and token_count of a split, as stored."""
    return spark.read.schema(INDEX).parquet(f"{path}/index").where(F.col("split") == split).drop("split")


def read_spans(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """shard, span, doc_id, token_count, cbytes and tokens of a split, its manifest checked first."""
    read_manifest(get_text(spark, f"{path}/{split}.json"))
    return spark.read.schema(SPANS).parquet(f"{path}/spans").where(F.col("split") == split).drop("split")
