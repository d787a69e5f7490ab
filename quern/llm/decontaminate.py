"""Benchmark decontamination: windows of a benchmark's words are looked up in all documents.

Words are the longest runs of ASCII letters and digits and of characters beyond
ASCII, in lower case as to A-Z only. An item's windows are its runs of `n`
consecutive words; an item of fewer words, but not none, is one window. The hash
set of all windows is broadcast where a count beforehand proves it small, joined
by shuffle beyond; each document's windows are probed and a hit is verified word
for word. Everything is a built-in expression.

Null texts have no words. Repeated rows each get a row. doc_id may be null. Extra
columns are not read by hits() and report(), and kept by the removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A window in the broadcast hash set takes about its text and this much more.
ENTRY_BYTES = 200


def words(text: Column) -> Column:
    """The words of a text as written; null and wordless texts have an empty list."""
    return F.coalesce(F.array_remove(F.split(text, GAP), ""), F.array().cast("array<string>"))


def low(text: Column) -> Column:
    """A text in lower case as to A-Z."""
    return F.translate(text, UPPER, LOWER)


def windows(items: DataFrame, n: int) -> DataFrame:
    """The different windows of the items: size, key (hash of the words), window (the words), item_ids."""
    split = items.select("item_id", words(low(F.col("text"))).alias("_w")).where(F.size("_w") > 0)
    split = split.withColumn("size", F.least(F.size("_w"), F.lit(n)))
    each = split.select("item_id", "size", "_w", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("size") + 1)).alias("_at"))
    each = each.select("item_id", "size", F.slice("_w", F.col("_at"), F.col("size")).alias("_s"))
    each = each.select("item_id", "size", F.array_join("_s", " ").alias("window"))
    grouped = each.groupBy("size", "window").agg(F.collect_set("item_id").alias("item_ids"))
    return grouped.withColumn("key", F.xxhash64(F.split("window", " ")))


def hits(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Each verified occurrence: doc_id, text_hash (the text's, to tell rows of one doc_id apart), at (word, from 0), size, item_ids."""
    table = windows(items, n)
    known = table.agg(F.count("*").alias("n"), F.sum(F.octet_length("window") + F.size("item_ids") * 8).alias("b"), F.collect_set("size").alias("sizes")).first()
    sizes = sorted(known["sizes"])  # at most n numbers
    small = (known["b"] or 0) + known["n"] * ENTRY_BYTES <= broadcast_bytes
    if small:
        table = F.broadcast(table)
    found = None
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(low(F.col("text"))).alias("_w"))
    for size in sizes or [n]:
        each = split.select("doc_id", "text_hash", "_w", F.posexplode_outer("_w").alias("at", "_word"))
        each = each.where(F.col("at") <= F.size("_w") - size).withColumn("key", F.xxhash64(F.slice("_w", F.col("at") + 1, F.lit(size))))
        met = each.join(table.where(F.col("size") == size), "key")
        # Equality by two containments: as a plain equality it would become a join key, made of every window.
        same = F.array_join(F.slice("_w", F.col("at") + 1, F.lit(size)), " ")
        if not small:
            # A shuffled row carries its window, never its document.
            each, same = each.select("doc_id", "text_hash", "at", "key", same.alias("_same")), F.col("_same")
            met = each.join(table.where(F.col("size") == size), "key")
        met = met.where(F.contains(same, F.col("window")) & F.contains(F.col("window"), same)).select("doc_id", "text_hash", "at", "size", "item_ids")
        found = met if found is None else found.unionByName(met)
    return found


def spans(found: DataFrame) -> DataFrame:
    """One row for each document with hits: spans (its occurrences, as words [at, end), in order), n_hit, item_ids.

    Occurrences of one document are merged here, so memory follows the longest
    document, not the number of its copies: repeated rows give equal occurrences,
    which are one.
    """
    flat = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("_s"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
    # Each word counts with the first occurrence that reaches it: what an occurrence adds beyond all before it.
    reach = F.aggregate("_s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["at"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")))
    return flat.select("doc_id", "text_hash", F.col("_s").alias("spans"), reach["n"].cast("long").alias("n_hit"), "item_ids")


def report(docs: DataFrame, items: DataFrame, n: int = 10, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (those with windows in the document) and spans of each row of `docs`."""
    merged = spans(hits(docs, items, n, broadcast_bytes)).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    base = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), F.xxhash64("text").alias("_text"))
    joined = base.join(merged, base["doc_id"].eqNullSafe(merged["_id"]) & (base["_text"] == merged["_hash"]), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "spans")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of report()."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def with_hits(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """`docs` with __quern_spans and __quern_hit of spans(), null where there are none."""
    merged = spans(hits(docs, items, n)).select(F.col("doc_id").alias("__quern_id"), F.col("text_hash").alias("__quern_hash"), F.col("spans").alias("__quern_spans"), F.col("n_hit").alias("__quern_hit"))
    return docs.join(merged, docs["doc_id"].eqNullSafe(F.col("__quern_id")) & (F.xxhash64(docs["text"]) == F.col("__quern_hash")), "left")


def drop_documents(docs: DataFrame, items: DataFrame, n: int = 10, at_least: float = 0.0) -> DataFrame:
    """The rows of `docs` without those of which more than the share `at_least` of all words is hit."""
    bad = F.col("__quern_hit") > F.lit(at_least) * F.size(words(F.col("text")))
    return with_hits(docs, items, n).where(F.col("__quern_hit").isNull() | ~bad).select(*docs.columns)


def runs(found: Column) -> Column:
    """Occurrences in order, joined where they overlap or touch."""
    last = lambda a: F.element_at(a, -1)
    grown = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["at"].alias("at"), F.greatest(last(a)["end"], x["end"]).alias("end"))))
    return F.aggregate(found, F.array().cast("array<struct<at:int,end:int>>"), lambda a, x: F.when((F.size(a) > 0) & (x["at"] <= F.try_element_at(a, F.lit(-1))["end"]), grown(a, x)).otherwise(F.concat(a, F.array(x))))


def drop_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """`docs` with the hit words, and what stands between two of one run, taken out of their texts."""
    # Gap i precedes word i; the last follows the last word.
    pieces = with_hits(docs, items, n).withColumn("__quern_spans", runs(F.col("__quern_spans"))).withColumns({"__quern_w": words(F.col("text")), "__quern_g": F.split("text", WORD)})
    hit = lambda i: F.exists("__quern_spans", lambda s: (s["at"] <= i) & (i < s["end"]))
    kept = F.transform("__quern_w", lambda w, i: F.when(~hit(i), F.concat(F.get("__quern_g", i), w)).otherwise(F.when((i > 0) & hit(i - 1), F.lit("")).otherwise(F.get("__quern_g", i))))
    clean = F.concat(F.array_join(kept, ""), F.element_at("__quern_g", -1))
    return pieces.withColumn("text", F.when(F.col("__quern_spans").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)
