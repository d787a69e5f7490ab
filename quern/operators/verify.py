"""Verification: which rule fails in which shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.config import FORMAT_VERSION
from quern.operators.store import SPANS, get_text, read_index, read_manifest

RULES = ("V2", "V3", "V4", "V5", "V6", "count", "size")


def violations(index: DataFrame, footers: DataFrame, record_hash: Column, data_hash: Column, token_bytes: int, version: int = FORMAT_VERSION) -> DataFrame:
    """(shard, rule) of every rule that fails.

    `index` has shard, span, offset, token_count, cbytes and what the hashes read;
    `footers` what each shard claims. V2: version and width; V3: bytes; V4: offsets
    rise; V5, V6: XORs of record and data hashes; count: spans, as XORs cancel; size:
    what lies between two offsets, and from the last one to the file's end, is a
    span's data. One shuffle by shard does for all.
    """
    following = F.lead("offset").over(W.partitionBy("shard").orderBy("span"))
    seen = index.withColumns({"_next": following, "_r": record_hash, "_d": data_hash})
    real = seen.groupBy("shard").agg(F.count("*").alias("r_n"), F.sum("cbytes").alias("r_bytes"), F.count_if(F.col("_next") <= F.col("offset")).alias("r_falls"), F.count_if(F.col("offset").isNull() | (F.col("_next") - F.col("offset") != F.col("cbytes"))).alias("r_gaps"), F.max_by(F.col("offset") + F.col("cbytes"), "span").alias("r_end"), F.bit_xor("_r").alias("r_index"), F.bit_xor("_d").alias("r_data"))
    both = footers.join(real, "shard", "full")
    fails = {
        "V2": (F.col("version") != version) | (F.col("token_bytes") != token_bytes),
        "V3": ~F.col("data_bytes").eqNullSafe(F.col("r_bytes")),
        "V4": F.coalesce(F.col("r_falls"), F.lit(0)) > 0,
        "V5": ~F.col("index_hash").eqNullSafe(F.col("r_index")),
        "V6": ~F.col("data_hash").eqNullSafe(F.col("r_data")),
        "count": ~F.col("n_spans").eqNullSafe(F.col("r_n")),
        "size": (F.coalesce(F.col("r_gaps"), F.lit(0)) > 0) | ~F.col("r_end").eqNullSafe(F.col("data_bytes")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in fails.items()]), lambda r: r.isNotNull())
    return both.select("shard", F.explode(found).alias("rule"))


def verify_corpus(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """The violations of a written corpus; none means it is intact. A manifest that can't be read is an error, as is a run that is broken off.

    Stored records are held against the footers and the data, whose sizes and hashes
    are taken from the tokens; a record without data, or data without a record, fails
    the rule of sizes.
    """
    known = read_manifest(get_text(spark, f"{path}/{split}.json"))
    width = known["token_bytes"]
    data = spark.read.schema(SPANS).parquet(f"{path}/spans").where(F.col("split") == split).select("shard", "span", (F.size("tokens") * width).cast("long").alias("cbytes"), F.xxhash64("span", "tokens").alias("h"))
    both = read_index(spark, path, split).join(data, ["shard", "span"], "full").withColumn("cbytes", F.coalesce("cbytes", F.lit(0)))
    footers = spark.read.parquet(f"{path}/footers/{split}")
    listed = spark.createDataFrame([(int(f[5:-4]),) for f in known["data_files"]], "shard int")
    missing = listed.join(footers, "shard", "left_anti").select("shard", F.lit("V1").alias("rule"))
    record = F.when(F.col("offset").isNotNull(), F.xxhash64("span", "offset", "token_count"))
    return violations(both, footers, record, F.col("h"), width).union(missing)
