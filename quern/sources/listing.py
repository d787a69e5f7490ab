"""File listings, slices of files per node, host files and subsets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LISTING = "siblings array<struct<rfilename: string>>"


def files_of_listing(listing: DataFrame, column: str = "body", status: str | None = None) -> DataFrame:
    """File names under `data/` of a dataset API's JSON answers; answers other than 200 give none."""
    if status:
        listing = listing.where(F.col(status) == 200)
    names = listing.select(F.explode(F.from_json(column, LISTING)["siblings"]["rfilename"]).alias("file"))
    return names.where(F.col("file").startswith("data/"))


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """file and bytes of the files below a folder; the contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def new_files(listed: DataFrame, done: DataFrame) -> DataFrame:
    """The listed files that aren't done yet."""
    return listed.join(done.select("file"), "file", "left_anti")


def file_slice(files: DataFrame, nodes: DataFrame, world: int) -> DataFrame:
    """Each node's contiguous slice of the sorted files: node, ord, file; nodes beyond the end have no row.

    `nodes` has node, rank_start and rank_count. A file list is a listing, so its
    ranks are made by one window.
    """
    ranked = files.select("file", (F.row_number().over(W.orderBy("file")) - 1).alias("ord"), F.count("*").over(W.partitionBy()).alias("_n"))
    size = F.ceil(F.col("_n") / F.lit(world))
    ends = (F.col("ord") >= F.col("rank_start") * size) & (F.col("ord") < F.least((F.col("rank_start") + F.col("rank_count")) * size, F.col("_n")))
    return ranked.join(F.broadcast(nodes), ends).select("node", "ord", "file")


def parse_hosts(lines: DataFrame) -> DataFrame:
    """hostname, rank_count and ord of a host file's lines (value, and ord, their order); blank lines and comments go."""
    kept = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    word = F.split(F.trim("value"), r"\s+")
    return kept.select(word[0].alias("hostname"), word[1].cast("int").alias("rank_count"), "ord")


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """A host file, parsed."""
    return parse_hosts(spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value")))


def rank_starts(hosts: DataFrame, count: str = "rank_count", order: str = "ord") -> DataFrame:
    """The hosts with rank_start, the ranks before theirs, and world, the ranks of all. A host list is small."""
    before = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return hosts.withColumns({"rank_start": F.coalesce(F.sum(count).over(before), F.lit(0)).cast("long"), "world": F.sum(count).over(W.partitionBy()).cast("long")})


def longs(values: list[int]) -> Column:
    """A literal array, made at once however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def count_at_most(listed: Column, size: int, key: Column) -> Column:
    """How many of the `size` ascending elements of an array are at most `key`, by halving."""
    steps = [1 << i for i in reversed(range(size.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps or [1])), F.lit(0), lambda at, step: F.when((at + step <= size) & (F.get(listed, at + step - 1) <= key), at + step).otherwise(at))


#: Rows drawn for each range when bounds are chosen.
DRAWN = 24


def range_of(df: DataFrame, order: tuple[str, ...], ranges: int) -> Column:
    """Which of `ranges` consecutive ranges of the order a row is in, by bounds that are literals of the plan.

    They are drawn once: a range partitioning that runs twice draws others each
    time. A row finds its range by halving, so many ranges cost little. DRAWN rows
    a range come to the driver, of the order's columns only.
    """
    keys = df.select(*order)
    share = min(1.0, 1.2 * DRAWN * ranges / max(1, keys.count()))
    drawn = (keys.sample(share, seed=7) if share < 1 else keys).orderBy(*order).collect()
    bounds = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)] if drawn else []
    if not bounds:
        return F.lit(0)
    kinds = [f.dataType for f in keys.schema.fields]
    listed = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(row, kinds, order)]) for row in bounds])
    key = F.struct(*[F.col(n).alias(n) for n in order])
    return count_at_most(listed, len(bounds), key)


def with_ordinal(df: DataFrame, *order: str, name: str = "ord", partitions: int | None = None) -> DataFrame:
    """Rows numbered from 0 in the total order of `order` (which must be unique), sorted in parallel.

    A row's number is the rows of all lesser ranges and its place in its own. Both
    follow from its order and literals of the plan, so a part that is run again
    gets the same numbers. Only a count per range comes to the driver.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(4 * n, 4096)
    placed = df.withColumn("_p", range_of(df, order, ranges))
    counts = dict(placed.groupBy("_p").count().collect())
    starts, total = [], 0
    for p in range(ranges):
        starts.append(total)
        total += counts.get(p, 0)
    before = F.get(longs(starts), F.col("_p"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(*order))
    return placed.withColumn(name, before + place - 1).drop("_p")


def chunk_of(ordinal: Column, size: int = 4) -> Column:
    """Which chunk of `size` consecutive rows a row is in."""
    return F.floor(ordinal / F.lit(size)).cast("long")


def strided(ordinal: Column, num_shards: int) -> Column:
    """The shard of row i is i mod `num_shards`."""
    return F.pmod(ordinal, F.lit(num_shards)).cast("int")


def contiguous(ordinal: Column, total: int, num_shards: int) -> Column:
    """Shards of consecutive rows; the first total mod num_shards have one row more."""
    size, more = divmod(total, num_shards)
    edge = more * (size + 1)
    return F.when(ordinal < edge, F.floor(ordinal / F.lit(size + 1))).otherwise(F.floor((ordinal - edge) / F.lit(max(size, 1))) + more).cast("int")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """Files with their whole content."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), "content")
