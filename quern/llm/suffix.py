"""Exact repeats by content-defined anchors and hash grouping, in place of prefix doubling.

Every byte covered by a string of `length` bytes that also starts elsewhere, in
any document, is removed. Plain prefix doubling ranks every byte position at every
offset, some hundred times the corpus in shuffled pairs; here it runs on anchors:
each window of `length` bytes has one position that its bytes alone choose (see
anchors.py), so equal windows meet at equal positions, of which there is one in
over a hundred bytes. A position's rank is a hash of the string there, which tells
the same classes apart as a rank in sorted order:

1. Names at `size` bytes, by which Spark sorts the positions, together with the
   names of all bytes of the windows that share the position. Where a name at `size`
   bytes is unique no window is a repeat. Where all bytes agree all windows are.
2. What remains, at the edges of repeats, is named at `length` bytes for each of its
   windows, against one of each class: one in a dozen positions.

Equal texts are one with a count; of two or more everything from `length` bytes
on is a repeat. Copies of a position are combined within each batch before the
shuffle; groups are read as sorted streams, a group too large to be held is named
by a shuffle of its windows instead. Names have 128 bits.

A null text is an empty one. Texts under `length` bytes keep all. Repeated rows are
documents of their own, hence repeats. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import lookup, materialize
from quern.llm.anchors import anchors

#: A group of more positions with different surroundings isn't held by one task.
HELD = 4000
NO_ID = -(1 << 63)
POSITION = "t1 long, t2 long, at long, first long, last long, key long, c1 long, c2 long, copies int"
OPEN = "t1 long, t2 long, at long, first long, last long, key long, copies int, kind int"


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's 128-bit name."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text")).withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


def positions(texts: DataFrame, length: int, size: int) -> DataFrame:
    """Rows of POSITION for all anchors; what a batch holds twice has copies 2 and one row per copy, those after the first with key null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["t1", "t2", "at", "first", "last", "key", "c1", "c2", "copies"]
        for batch in batches:
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            raw, start = batch.column(2), 0
            once: dict[tuple, int] = {}
            rows: list[list] = [[] for _ in names]
            seen_text: set[tuple[int, int]] = set()
            while start < len(ids):
                stop, held, part = start, 0, []
                while stop < len(ids) and held < 2_000_000:
                    # The same text twice says nothing new here.
                    part.append(b"" if ids[stop] in seen_text else raw[stop].as_py().encode("utf-8", "surrogatepass"))
                    seen_text.add(ids[stop])
                    held += len(part[-1])
                    stop += 1
                of, at, first, last, key = anchors(part, length, size)
                for i, p, a, b, k in zip(of.tolist(), at.tolist(), first.tolist(), last.tolist(), key.tolist()):
                    name = xxhash.xxh3_128_digest(part[i][a : b + length], seed=(p - a) * 65536 + b - a)
                    c1, c2 = int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)
                    where = once.setdefault((k, c1, c2), len(rows[0]))
                    again = where != len(rows[0])
                    if again:
                        rows[8][where] = 2
                    for column, value in zip(rows, (*ids[start + i], p, a, b, None if again else k, c1, c2, 2 if again else 1)):
                        column.append(value)
                start = stop
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "copies" else pa.int64()) for n, c in zip(names, rows)], names=names)

    return texts.select("t1", "t2", "text").where(F.octet_length("text") >= length).mapInArrow(run, POSITION)


def sort_out(found: DataFrame) -> DataFrame:
    """Rows of OPEN from sorted positions: kind 0 is a repeat, 1 an open position, 2 one of a class to compare with.

    A stream over (key, c1, c2, ...): of a key only the first position and the
    present class's first are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t1", "t2", "at", "first", "last", "key", "copies", "kind"]
        out: list[tuple] = []
        key = name = lone = head = None
        twice, classes = False, 0

        def close() -> None:
            """The present class has ended. Of a key with several classes each is to be compared further."""
            nonlocal lone, classes
            if head is None:
                return
            classes += 1
            now = (*head, 2, 2) if twice else (*head, 1, 1)
            if classes == 1:
                lone = now
                return
            if classes == 2:
                out.append(lone)
            out.append(now)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32() if n in ("copies", "kind") else pa.int64()) for i, n in enumerate(names)], names=names)
            out.clear()
            return batch

        for batch in batches:
            for t1, t2, at, first, last, k, c1, c2, copies in zip(*(c.to_pylist() for c in batch.columns)):
                row = (t1, t2, at, first, last, k)
                if k != key or (c1, c2) != name:
                    close()
                    if k != key:
                        key, lone, classes = k, None, 0
                    name, head, twice = (c1, c2), row, copies > 1
                    if twice:
                        out.append((*row, 2, 0))
                elif (t1, t2, at) != head[:3]:
                    if not twice:
                        out.append((*head, 2, 0))
                        twice = True
                    out.append((*row, 2, 0))
            yield made()
        close()
        yield made()

    n = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = found.where("key is not null").repartition(n, "key").sortWithinPartitions("key", "c1", "c2", "t1", "t2", "at")
    local = found.where("key is null").select("t1", "t2", "at", "first", "last", "key", "copies", F.lit(0).alias("kind"))
    return placed.mapInArrow(run, OPEN).union(local)


def compare(surroundings: DataFrame, length: int) -> DataFrame:
    """(t1, t2, start, end) of the repeats among the windows of positions with one key.

    `surroundings` has OPEN's columns and `bytes`, from `first` to `last` + length.
    """
    n = max(1, int(surroundings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["t1", "t2", "at", "start", "end", "open", "d", "w1", "w2", "copies"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    schema = "t1 long, t2 long, at long, start long, end long, open boolean, d long, w1 long, w2 long, copies int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def windows(row):
            t1, t2, at, first, last, key, copies, kind, data = row
            for s in range(last - first + 1):
                yield at - first - s, xxhash.xxh3_128_digest(data[s : s + length])

        def settle(group: list, out: list) -> None:
            """The repeats of a group in memory."""
            seen: dict[tuple, tuple | bool] = {}
            for row in group:
                who = row[:3]
                for w in windows(row):
                    had = seen.get(w)
                    if had is None:
                        seen[w] = True if row[6] > 1 else who
                    elif had is not True and had != who:
                        seen[w] = True
            for row in group:
                if row[7] == 1:
                    t1, t2, at, first, last = row[:5]
                    run_from = None
                    for s, w in enumerate(windows(row)):
                        if seen[w] is True:
                            if run_from is None:
                                run_from = s
                        elif run_from is not None:
                            out.append((t1, t2, at, first + run_from, first + s - 1 + length, False, None, None, None, None))
                            run_from = None
                    if run_from is not None:
                        out.append((t1, t2, at, first + run_from, last + length, False, None, None, None, None))

        def spill(row, out: list) -> None:
            """A row per window, for a group that isn't held."""
            t1, t2, at, first, last = row[:5]
            for s, (d, digest) in enumerate(windows(row)):
                out.append((t1, t2, at, first + s, first + s + length, row[7] == 1, d, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), row[6]))

        def made(out: list) -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            return batch

        key, group, large, out = None, [], False, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[5] != key:
                    settle(group, out)
                    key, group, large = row[5], [], False
                if large:
                    spill(row, out)
                else:
                    group.append(row)
                    if len(group) > HELD:
                        large = True
                        for r in group:
                            spill(r, out)
                        group = []
                if len(out) > 100_000:
                    yield made(out)
            yield made(out)
        settle(group, out)
        yield made(out)

    placed = surroundings.select("t1", "t2", "at", "first", "last", "key", "copies", "kind", "bytes").repartition(n, "key").sortWithinPartitions("key")
    found = materialize(placed.mapInArrow(run, schema), "windows")
    each = found.where("w1 is not null")
    who = F.xxhash64("t1", "t2", "at")
    named = each.groupBy("d", "w1", "w2").agg(F.max("copies").alias("_c"), F.min(who).alias("_a"), F.max(who).alias("_b"), F.count("*").alias("_n")).where("_c > 1 or _a <> _b").select("d", "w1", "w2", "_n")
    met = lookup(each.where("open"), named, ["d", "w1", "w2"], "_n", F.col("start"))
    return found.where("w1 is null").select("t1", "t2", "start", "end").union(met.select("t1", "t2", "start", "end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of what sorted or unsorted spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def repeats(docs: DataFrame, length: int = 400, size: int = 100) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_bytes, spans (maximal repeated runs, in bytes), kept (the other bytes, null where nothing is removed), kept_sha256."""
    texts = texts_of(docs)
    one = materialize(texts.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first(F.octet_length("text")).alias("n_bytes")), "texts")
    sorted_out = materialize(sort_out(positions(texts, length, size)), "positions")
    spans = sorted_out.where("kind = 0").groupBy("t1", "t2").agg(F.collect_set(F.struct("first", F.col("last").alias("last"))).alias("whole"))
    wanted = sorted_out.where("kind > 0").groupBy("t1", "t2").agg(F.collect_list(F.struct("at", "first", "last", "key", "copies", "kind")).alias("open"))
    touched = spans.join(wanted, ["t1", "t2"], "full").join(one.select("t1", "t2", "n", F.col("rep").alias("id")), ["t1", "t2"])
    held = materialize(texts.join(touched, ["t1", "t2", "id"]).select("t1", "t2", "n", "text", "whole", "open"), "touched")
    data = F.encode(F.col("text"), "utf-8")
    around = held.where("open is not null").select("t1", "t2", data.alias("_b"), F.explode("open").alias("o")).select("t1", "t2", "o.*", F.substring(F.col("_b"), (F.col("o.first") + 1).cast("int"), (F.col("o.last") - F.col("o.first") + length).cast("int")).alias("bytes"))
    edges = compare(around, length).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("edges"))
    # Of texts that occur more than once all is a repeat: they are here to be compared with only.
    both = held.where("n = 1").select("t1", "t2", "text", "whole").join(edges, ["t1", "t2"], "left").where("whole is not null or edges is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string()), ("kept", pa.binary())])
        for batch in batches:
            rows = []
            for t1, t2, text, whole, edge in zip(*batch.columns):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                runs = merged([(x["first"], x["last"] + length) for x in whole.as_py() or []] + [(x["start"], x["end"]) for x in edge.as_py() or []])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append({"t1": t1.as_py(), "t2": t2.as_py(), "spans": [{"start": a, "end": b} for a, b in runs], "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    cut = both.mapInArrow(run, "t1 long, t2 long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end")))
    copied = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    table = one.join(cut, ["t1", "t2"], "left").select(
        "t1", "t2", "n",
        F.when(copied, all_of).otherwise(F.col("spans")).alias("spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("_kept_sha256"),
        F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    table = materialize(table.where("spans is not null"), "cut")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_sha256"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"))
    joined = lookup(rows, table, ["t1", "t2"], "n", F.col("doc_id"), how="left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select("doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), "kept", F.coalesce("_kept_sha256", "_sha256").alias("kept_sha256"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
