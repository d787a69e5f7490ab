"""Command line: python -m quern write | verify | plan | export.

write reads Parquet files with a text column (and doc_id, or numbers the rows),
splits, tokenizes and writes a corpus; --just-args writes its arguments only. Of a
sorted file list each node may take its slice (--world-size, --rank-start,
--rank-count).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.api import CorpusConfig, CorpusWriter, verify_corpus
from quern.config import ROTATE_BYTES
from quern.functions.tokens import byte_bpe, encode_with
from quern.operators import epoch, interchange, pack, store
from quern.sources import listing


GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def inputs(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """doc_id and text of this node's files."""
    files = listing.list_folder(spark, args.input).where(F.col("file").endswith(".parquet")).select("file")
    node = spark.createDataFrame([(0, args.rank_start, args.rank_count)], "node int, rank_start int, rank_count int")
    mine = [r["file"] for r in listing.file_slice(files, node, args.world_size).orderBy("ord").collect()]
    if not mine:
        return spark.createDataFrame([], "doc_id long, text string")
    docs = spark.read.parquet(*mine)
    if "doc_id" not in docs.columns:
        docs = listing.with_ordinal(docs.select("text", F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_m")), "_f", "_m", name="doc_id")
    return docs.select("doc_id", "text")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser("quern", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    write = commands.add_parser("write")
    write.add_argument("--input", required=True)
    write.add_argument("--output", required=True)
    write.add_argument("--holdout-rate", type=float, default=0.1, help="percent of tokens")
    write.add_argument("--shards", type=int, default=4)
    write.add_argument("--lanes", type=int, default=8)
    write.add_argument("--rotate-bytes", type=int, default=ROTATE_BYTES)
    write.add_argument("--byte-tokens", action="store_true")
    write.add_argument("--ranks", help="file of BPE ranks")
    write.add_argument("--pattern", default=GPT2_PATTERN)
    write.add_argument("--just-args", action="store_true")
    write.add_argument("--world-size", type=int, default=1)
    write.add_argument("--rank-start", type=int, default=0)
    write.add_argument("--rank-count", type=int, default=1)
    for name in ("verify", "plan", "export"):
        sub = commands.add_parser(name)
        sub.add_argument("--corpus", required=True)
        sub.add_argument("--split", default="train", choices=store.SPLITS)
        if name == "plan":
            for option, default in (("--seed", 0), ("--epoch", 0), ("--ranks", 1), ("--microbatch", 4), ("--context", 4096), ("--min-data-length", 64)):
                sub.add_argument(option, type=int, default=default)
        if name == "export":
            sub.add_argument("--output", required=True)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    if args.command == "write":
        if not args.byte_tokens and not args.ranks:
            parser.error("--byte-tokens or --ranks")
        docs, vocab = inputs(spark, args), 256
        if not args.byte_tokens:
            with open(args.ranks, "rb") as lines:
                vocab = sum(1 for _ in lines) + 1
            docs = encode_with(docs.where(F.col("text").isNotNull()), lambda: byte_bpe(args.ranks, args.pattern).encode_ordinary)
        config = CorpusConfig(encoding=args.ranks or "bytes", byte_tokens=args.byte_tokens, holdout_rate=args.holdout_rate, num_shards=args.shards, lanes=args.lanes, rotate_bytes=args.rotate_bytes)
        rejected = CorpusWriter(args.output, config).write(docs, args.just_args, vocab)
        print(json.dumps({} if args.just_args else rejected.first().asDict()))
        return 0
    if args.command == "verify":
        found = [r.asDict() for r in verify_corpus(spark, args.corpus, args.split).collect()]
        print(json.dumps({"ok": not found, "violations": found}))
        return int(bool(found))
    spans = store.read_spans(spark, args.corpus, args.split)
    if args.command == "export":
        width = store.read_manifest(store.get_text(spark, f"{args.corpus}/{args.split}.json"))["token_bytes"]
        print(json.dumps(interchange.export_shards(spans, args.output, width)))
        return 0
    ordered = epoch.interleaved(spans.select("shard", "span", "token_count"), args.seed, spark.range(1).select(F.lit(args.epoch).alias("epoch")), args.ranks)
    plan = pack.segments(ordered, args.microbatch, args.context, args.min_data_length)
    print(json.dumps([r.asDict() for r in pack.total_steps(plan).orderBy("rank").collect()]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
