"""Line dedup: repeated runs of two or more lines are removed but for their first copy.

A run is two or more consecutive lines that hold a letter or digit. Every line of a
run that other documents, or earlier places of the same one, hold too goes, however
long the run is and wherever in the text; the first copy stays: of the documents
with the same run that of the least doc_id, therein the first place. Where a run
overlaps its own first copy only what lies behind that goes. Every different line
of the corpus stays somewhere.

Texts are cut into content-defined chunks: a rolling hash over the last `span` line
hashes closes a chunk where it is 0 modulo `divisor`. Chunks of two or more lines are
grouped, and all copies of one but the first go. That is all `drop_repeats` does, by
which short runs and the edges of long ones stay.

`drop_runs` goes on from there to the whole of each run, by seeds, which are as short
as a run can be: two lines with a letter or digit in one of them, or, where several
lines without any follow each other, such a line and all up to the nearest with one,
on either side. A repeated run is the union of its seeds, each of them repeated, and a
repeated seed is a repeated run; so no run is missed. Seeds inside a later copy of a
chunk are settled: they aren't named again, as the chunk's first copy has the same
ones at an earlier place. A text's last line end doesn't start another line.

First the 128-bit hashes of chunks, and then of seeds, are counted, which is all that
is shuffled of most. Of those that repeat the very bytes are compared before anything
is removed, so different lines are never taken for one another. (Seeds of three and
more lines are compared by SHA-256, as their bytes would grow by the square.)

A null text stays null, an empty one empty; a text all of which goes becomes
empty. Repeated rows of one doc_id count as one document: their first copies stay
in each. Rows with a null doc_id are never the first where others have the run.
All columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import lookup, materialize, small, text_key, trimmed

def chunks(text: str, span: int = 3, divisor: int = 4) -> list[tuple[str, int]]:
    """The chunks of a text, which concatenated are the text, with their numbers of lines."""
    import xxhash

    lines = text.split("\n")
    last = len(lines) - 1
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    power = pow(base, span, 1 << 64)
    hashes: list[int] = []
    out: list[tuple[str, int]] = []
    rolling, start = 0, 0
    for i, line in enumerate(lines):
        hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")))
        rolling = (rolling * base + hashes[i] - (hashes[i - span] * power if i >= span else 0)) & mask
        if i == last or (rolling >> 40) % divisor == 0:
            out.append(("\n".join(lines[start : i + 1]) + ("\n" if i < last else ""), i - start + 1))
            start = i + 1
    return out


def body(chunk: str) -> str:
    """A chunk without the line end that parts it from the next, so the last chunk of a text compares with others."""
    return chunk[:-1] if chunk.endswith("\n") else chunk


def name(chunk: str) -> tuple[int, int]:
    import xxhash

    digest = xxhash.xxh3_128_digest(body(chunk).encode("utf-8", "surrogatepass"))
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def counts_as(chunk: str, lines: int) -> bool:
    return lines > 1 and any(map(str.isalnum, chunk))


def chunk_keys(text: str, known: dict[tuple[int, int], bool]) -> list[str]:
    return [body(chunk) for chunk, lines in chunks(text) if counts_as(chunk, lines)]


def passages(text: str) -> list[tuple[int, int, str]]:
    """The chunks of two or more lines, in the form of `seeds`; the empty string behind a last line end is no line."""
    n = text.count("\n") + (not text.endswith("\n") and text != "")
    out, start = [], 0
    for chunk, lines in chunks(text):
        end = min(start + lines, n)
        if counts_as(chunk, end - start):
            out.append((start, end, body(chunk)))
        start += lines
    return out


def passage_keys(text: str, known: dict[tuple[int, int], bool]) -> list[str]:
    return [key for _, _, key in passages(text)]


def seeds(text: str) -> list[tuple[int, int, str]]:
    """The seeds of a text: first line, line behind the last, and what is compared; the copies of each in order."""
    import hashlib

    lines = text.split("\n")
    n = len(lines) - (lines[-1] == "")
    holds = [any(map(str.isalnum, line)) for line in lines[:n]]
    out = [(i, i + 2, f"{lines[i]}\n{lines[i + 1]}") for i in range(n - 1) if holds[i] or holds[i + 1]]
    start = 0
    for end in [*[i for i in range(n) if holds[i]], n]:
        # The lines from start to end hold nothing.
        if end - start > 1:
            for way, order in (("after", range(start - 1, end)), ("before", range(end, start - 1, -1))):
                if not 0 <= order[0] < n:
                    continue
                chain = hashlib.sha256()
                for count, i in enumerate(order, 1):
                    chain.update(lines[i].encode("utf-8", "surrogatepass") + b"\n")
                    if count > 2:
                        out.append((min(i, order[0]), max(i, order[0]) + 1, f"{way} {chain.hexdigest()}"))
        start = end + 1
    return out


def copies(found: list[tuple[int, int, str]], known: dict[tuple[int, int], bool]) -> Iterator[tuple[int, int]]:
    """The lines that go, from and to: of those in `known`, but for the first copy of those that are true there."""
    behind: dict[tuple[int, int], int] = {}
    for start, end, key in found:
        which = name(key)
        if which not in known:
            continue
        if known[which] and which not in behind:
            behind[which] = end
            continue
        start = max(start, behind.get(which, 0))
        if start < end:
            yield start, end


def seed_keys(text: str, known: dict[tuple[int, int], bool] = {}) -> list[str]:  # noqa: B006
    """The seeds of a text, but for those inside a chunk that goes as `known` has it."""
    if not known:
        return [key for _, _, key in seeds(text)]
    inside = [0] * (text.count("\n") + 1)
    for which, (start, end) in enumerate(copies(passages(text), known), 1):
        inside[start:end] = [which] * (end - start)
    return [key for start, end, key in seeds(text) if not inside[start] or inside[start] != inside[end - 1]]


Keys = Callable[[str, dict[tuple[int, int], bool]], list[str]]


def places(docs: DataFrame, keys: Keys, settled: DataFrame | None = None) -> DataFrame:
    """(id, t1, t2, low, high, copies): the names of each text's `keys`, given what of it is `settled`; t1 and t2 name the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "t1", "t2", "low", "high", "copies"]
        kinds = [pa.int64()] * 6
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, t1, t2, text, repeats in zip(*(c.to_pylist() for c in batch.columns[:3]), *batch.columns[3:]):
                own: dict[tuple[int, int], int] = {}
                for key in keys(text.as_py(), {(r["low"], r["high"]): r["first"] for r in repeats.as_py() or []}):
                    which = name(key)
                    own[which] = own.get(which, 0) + 1
                for (low, high), copies in own.items():
                    for column, value in zip(rows, (doc_id, t1, t2, low, high, copies)):
                        column.append(value)
                if len(rows[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=names)

    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    none = F.lit(None).cast("array<struct<low:bigint,high:bigint,first:boolean>>")
    known = texts.withColumn("__quern_repeats", none) if settled is None else with_repeats(texts, settled, "left")
    source = known.select(F.col("doc_id").cast("long").alias("id"), *text_key(F.col("text")), "text", "__quern_repeats")
    return source.mapInArrow(trimmed(run), "id long, t1 long, t2 long, low long, high long, copies long")


def with_repeats(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """`docs` joined to `lists` (__quern_id, __quern_t1, __quern_t2, __quern_repeats), by doc_id and text."""
    t1, t2 = text_key(docs["text"])
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__quern_id")) & (t1 == F.col("__quern_t1")) & (t2 == F.col("__quern_t2"))
    return docs.join(small(lists, F.size("__quern_repeats") * 40 + 60), same, how).select(*docs.columns, "__quern_repeats")


def unequal(docs: DataFrame, lists: DataFrame, keys: Keys) -> DataFrame:
    """(low, high) of `lists` that stand for different bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["low", "high", "chunk"]
        for batch in batches:
            rows: list[list] = [[], [], []]
            held = 0
            seen: set[str] = set()
            for text, repeats in zip(*batch.columns):
                known = {(r["low"], r["high"]) for r in repeats.as_py()}
                for key in keys(text.as_py(), {}):
                    if key in seen or (which := name(key)) not in known:
                        continue
                    seen.add(key)
                    for column, value in zip(rows, (*which, key)):
                        column.append(value)
                    held += len(key)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.string()))], names=names)
                    rows, held, seen = [[], [], []], 0, set()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.string()))], names=names)

    listed = with_repeats(docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")), lists, "inner").select("text", "__quern_repeats")
    different = listed.mapInArrow(trimmed(run), "low long, high long, chunk string").groupBy("low", "high", "chunk").agg(F.lit(1).alias("_"))
    return different.groupBy("low", "high").agg(F.count("*").alias("_k")).where("_k > 1").select("low", "high")


def repeated(docs: DataFrame, keys: Keys = chunk_keys, settled: DataFrame | None = None) -> DataFrame:
    """(__quern_id, __quern_t1, __quern_t2, __quern_repeats): of each document with any the `keys` that other places repeat, each (low, high, first); `first` where its own first copy stays."""
    every = materialize(places(docs, keys, settled), "places")
    counted = every.groupBy("low", "high").agg(F.min("id").alias("keeper"), F.sum("copies").alias("n"), F.count("*").alias("rows")).where("n > 1")
    met = lookup(every.drop("copies"), counted.drop("n"), ["low", "high"], "rows", F.xxhash64("id", "t1"))
    repeat = F.struct("low", "high", F.col("id").eqNullSafe(F.col("keeper")).alias("first"))
    listed = met.groupBy(F.col("id").alias("__quern_id"), F.col("t1").alias("__quern_t1"), F.col("t2").alias("__quern_t2")).agg(F.collect_set(repeat).alias("__quern_repeats"))
    listed = materialize(listed, "repeats")
    unsure = materialize(unequal(docs, listed, keys), "unequal")
    if unsure.isEmpty():
        return listed
    # Different bytes of one hash, should they ever occur, are left alone.
    each = listed.select("__quern_id", "__quern_t1", "__quern_t2", F.explode("__quern_repeats").alias("r"))
    sure = each.join(unsure, (F.col("r.low") == unsure["low"]) & (F.col("r.high") == unsure["high"]), "left_anti")
    return materialize(sure.groupBy("__quern_id", "__quern_t1", "__quern_t2").agg(F.collect_set("r").alias("__quern_repeats")), "repeats")


def without_chunks(text: str, known: dict[tuple[int, int], bool]) -> tuple[str, int]:
    """The text without the chunks in `known`, but for the first copy of those that are true there; and the number of lines gone."""
    kept, removed = [], 0
    for chunk, lines in chunks(text):
        which = name(chunk) if counts_as(chunk, lines) else None
        if which not in known:
            kept.append(chunk)
        elif known[which]:
            known[which] = False
            kept.append(chunk)
        else:
            removed += lines
    return "".join(kept), removed


def without_runs(text: str, chunked: dict[tuple[int, int], bool], seeded: dict[tuple[int, int], bool]) -> tuple[str, int]:
    """The text without the lines of later copies of chunks and of seeds, and their number."""
    lines = text.split("\n")
    gone = bytearray(len(lines))
    for found, known in ((passages, chunked), (seeds, seeded)):
        for start, end in copies(found(text), known) if known else ():
            gone[start:end] = b"\1" * (end - start)
    last = len(lines) - 1
    return "".join(line + ("\n" if i < last else "") for i, line in enumerate(lines) if not gone[i]), sum(gone)


def drop(docs: DataFrame, lists: DataFrame, without: Callable) -> DataFrame:
    """`docs` with what `lists` have taken out of the texts by `without`, and n_lines_removed, instead of a column of that name."""
    docs = docs.drop("n_lines_removed")
    joined = with_repeats(docs, lists, "left")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines_removed", T.LongType())])
    at, last = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, repeats in zip(batch.column(at), batch.column(last)):
                text, removed = text.as_py(), 0
                if text is not None and repeats.is_valid:
                    text, removed = without(text, repeats.as_py())
                texts.append(text)
                counts.append(removed)
            columns = list(batch.columns[:last])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names[:last], "n_lines_removed"])

    return joined.mapInArrow(trimmed(run), schema)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """`docs` without repeated chunks, the coarser rule."""
    return drop(docs, repeated(docs), lambda text, repeats: without_chunks(text, {(r["low"], r["high"]): r["first"] for r in repeats}))


def drop_runs(docs: DataFrame) -> DataFrame:
    """`docs` without repeated runs of two or more lines: first those of whole chunks, then what these leave of each run."""
    chunked = repeated(docs, passage_keys)
    seeded = repeated(docs, seed_keys, chunked)
    # A row for each document, of both lists.
    of = lambda lists, is_chunk: lists.withColumn("__quern_repeats", F.transform("__quern_repeats", lambda r: r.withField("chunk", F.lit(is_chunk))))
    each = of(chunked, True).unionByName(of(seeded, False)).groupBy("__quern_id", "__quern_t1", "__quern_t2")
    lists = materialize(each.agg(F.flatten(F.collect_list("__quern_repeats")).alias("__quern_repeats")), "lists")

    def without(text: str, repeats: list[dict]) -> tuple[str, int]:
        return without_runs(text, *({(r["low"], r["high"]): r["first"] for r in repeats if r["chunk"] == kind} for kind in (True, False)))

    return drop(docs, lists, without)


def digest(kept: DataFrame) -> DataFrame:
    """doc_id, characters and lines removed, and a hash of what is left of each row."""
    return kept.select("doc_id", "n_lines_removed", F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
