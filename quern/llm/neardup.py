"""One document of each group of near-duplicates stays: covering LSH over long SimHash sketches, then exact similarity.

A document is its set of word shingles (`size` words between ASCII blanks, A-Z in
lower case; fewer words are one shingle). Documents of equal sets are one class. A
class has a sketch of WORDS 64-bit SimHash words. Each word goes through the
covering tables of radius RADIUS (see simhash.py), and by the pigeonhole principle
every pair that differs in at most WORDS * (RADIUS + 1) - 1 bits of all is within
RADIUS in some word, so it meets in a bucket; most pairs further apart do so too.
Pairs that meet and differ in at most LIMIT bits of all are candidates: of those
at similarity 0.8 some nine in ten are, of those at 0.85 nearly all.

A drop is decided by the similarity of two sets of shingles (hashed to 32 bits),
never by a sketch. Classes are ordered by name, which is a hash of the set, so at
random. A class without a similar candidate before it stays; a class similar to
one that stays goes; the others wait for those before them, and all is done again
for what is left. In such an order few rounds are needed, however large or dense a
family is. Whatever goes is that similar to a document that stays, and no two that
stay are candidates of that similarity.

In each class the row of the least doc_id stays, null ones last. Null and empty
texts are one class. Of rows that agree in doc_id and text one stays. All columns
are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._common import lookup, materialize, small, text_key, trimmed, worker_cache
from quern.llm.simhash import BLOCK, HELD, bucket_name, in_buckets, masks, signed

WORDS, RADIUS, LIMIT = 9, 3, 104
#: Bits of one word in which members of its bucket may differ to be looked at in all words.
REACH = 16
NAMES = [f"f{k}" for k in range(WORDS)]


def mixed(hashes, k: int):
    """Other 64 bits of each hash (the finaliser of SplitMix64)."""
    import numpy as np

    h = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & ((1 << 64) - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, size: int):
    """The different shingles of a text as sorted hashes. A word is hashed once a worker, a shingle by arithmetic on its words' hashes."""
    import numpy as np
    import xxhash

    known = worker_cache().setdefault("words", {})
    if len(known) > 100_000:
        known.clear()
    if "blanks" not in known:
        known["blanks"] = bytes(32 if b in b"\t\n\v\f\r " else b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = (text or "").encode("utf-8", "surrogatepass").translate(known["blanks"]).split()
    if not words:
        return np.zeros(0, np.uint64)
    found = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w, 42)
        found.append(h)
    single = np.array(found, np.uint64)
    count = min(size, len(words))
    sums = np.zeros(len(words) - count + 1, np.uint64)
    for j in range(count):
        sums += mixed(single[j : len(words) - count + 1 + j], 2 * j + 1)
    return np.unique(sums)


def sketches(sets: list):
    """(n, WORDS) words: a bit is set where over half of a set's hashes have it."""
    import numpy as np

    spread = np.array([sum((b >> j & 1) << 8 * j for j in range(8)) for b in range(256)], np.uint64)
    out = np.zeros((len(sets), WORDS), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)

    def part(members: list[int]) -> None:
        sizes = np.array([len(sets[i]) for i in members])
        begin = np.concatenate([[0], sizes.cumsum()])
        # Bytes count up to 255, so sums are made of runs of so many rows first.
        runs = np.concatenate([np.arange(a, b, 255) for a, b in zip(begin, begin[1:])])
        first = np.searchsorted(runs, begin[:-1])
        hashes = np.concatenate([sets[i] for i in members])
        for k in range(WORDS):
            lanes = spread[mixed(hashes, 1000 + k).view(np.uint8).reshape(-1, 8)]
            counts = np.add.reduceat(lanes, runs, axis=0).view(np.uint8).reshape(-1, 64)
            counts = np.add.reduceat(counts, first, axis=0, dtype=np.int64)
            out[members, k] = np.where(2 * counts > sizes[:, None], weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)

    held, total = [], 0
    for i in full:
        held.append(i)
        total += len(sets[i])
        if total > 100_000:
            part(held)
            held, total = [], 0
    if held:
        part(held)
    return out


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """id, t1, t2 (the text's name), s1, s2 (the set's name) and the sketch, f0 to f8, of each row."""
    names = ["id", "t1", "t2", "s1", "s2", *NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            t1, t2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            # A text that a batch has more than once is sketched once.
            once: dict[tuple[int, int], int] = {}
            where = [once.setdefault(t, len(once)) for t in zip(t1.tolist(), t2.tolist())]
            first = np.unique(np.array(where, np.int64), return_index=True)[1] if where else []
            made, rows = np.zeros((len(once), 2 + WORDS), np.uint64), 0
            for a in range(0, len(first), 256):
                sets = [shingles(batch.column(3)[int(i)].as_py(), size) for i in first[a : a + 256]]
                stop = rows + len(sets)
                for k in (0, 1):
                    made[rows:stop, k] = [mixed(s, 100 + k).sum(dtype=np.uint64) for s in sets]
                made[rows:stop, 2:] = sketches(sets)
                rows = stop
            every = made[where].view(np.int64) if where else made.view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(c)) for c in every.T]], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("id"), *text_key(F.col("text")), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(trimmed(run), ", ".join(f"{n} long" for n in names))


def word_buckets(words: DataFrame) -> DataFrame:
    """(bucket, word) of (k, word): every covering table of each word; the table's number names k."""
    tables = [signed(m) for m in masks(RADIUS, 3)]
    each = words.select("k", "word", F.posexplode(F.array(*[F.col("word").bitwiseAND(F.lit(m)) for m in tables])).alias("_i", "_b"))
    return each.select(bucket_name(F.col("k") * len(tables) + F.col("_i"), F.col("_b")).alias("bucket"), "word")


def close_words(words: DataFrame) -> DataFrame:
    """The rows of word_buckets() that have another at most REACH bits apart in their bucket; a large bucket's members all count as such."""

    def rows(names, values) -> pa.RecordBatch:
        import numpy as np

        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (names, values)], names=["bucket", "word"])

    def near(groups: list) -> pa.RecordBatch:
        import numpy as np

        names, values = [], []
        for bucket, members in groups:
            unsigned, some = members.view(np.uint64), np.zeros(len(members), bool)
            for a in range(0, len(members), 256):
                apart = np.bitwise_count(unsigned[a : a + 256, None] ^ unsigned[None, :]) <= REACH
                some[a : a + 256] = apart.sum(axis=1) > 1
            names.append(np.full(int(some.sum()), bucket, np.int64))
            values.append(members[some])
        return rows(names, values)

    def beyond(bucket: int, members) -> pa.RecordBatch:
        import numpy as np

        return rows([np.full(len(members), bucket, np.int64)], [members])

    return in_buckets(word_buckets(words), near, "bucket long, word long", beyond)


def in_pairs_of_groups(keyed: DataFrame) -> DataFrame:
    """`keyed` (bucket, node, ...) with buckets of over HELD rows cut into groups, a bucket of its own for each two of them: every pair still meets, in some task.

    There are at most rows / HELD such buckets, which bounds the broadcast list.
    """
    few = keyed.groupBy("bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > HELD).select("bucket", F.ceil(F.col("_n") * 2 / HELD).cast("int").alias("_g"))
    joined = keyed.join(F.broadcast(few), "bucket", "left").withColumn("_own", F.pmod(F.xxhash64("node"), F.coalesce("_g", F.lit(1))).cast("int"))
    each = joined.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_g", F.lit(1)) - 1)))
    name = F.when(F.col("_g").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("_own", "_other"), F.greatest("_own", "_other")))
    return each.withColumn("bucket", name).select(*keyed.columns)


def meeting(words, table: int, first: int):
    """Which of the members from `first` on, BLOCK at most, are candidates of which members in a bucket of this table, as a matrix.

    A pair counts in one table only: the first of those in which it collides with at
    most REACH differing bits of the word. Tables of equal words come first.
    """
    import numpy as np

    n, some = len(words), words[first : first + BLOCK]
    apart = np.zeros((len(some), n), np.uint16)
    for k in range(WORDS):
        apart += np.bitwise_count(some[:, k][:, None] ^ words[:, k][None, :])
    near = apart <= LIMIT
    near[np.arange(len(some)), first + np.arange(len(some))] = False
    rows, columns = np.nonzero(near)
    tables = np.array(masks(RADIUS, 3), np.uint64)
    for a in range(0, len(rows), 16384):
        i, j = rows[a : a + 16384], columns[a : a + 16384]
        differ = some[i] ^ words[j]
        own = np.ones(len(i), bool)
        for k in range(WORDS):
            if table >= len(tables) * WORDS and k == table - len(tables) * WORDS:
                own &= differ[:, k] == 0
                break
            own &= differ[:, k] != 0
        else:
            for k in range(table // len(tables) + 1):
                close = np.bitwise_count(differ[:, k]) <= REACH
                at = table % len(tables) if k == table // len(tables) else len(tables)
                if at:
                    own &= ~(close & ((differ[:, k, None] & tables[:at]) == 0).any(axis=1))
                if at < len(tables):
                    own &= close & ((differ[:, k] & tables[at]) == 0)
        near[i, j] = own
    return near


def unpacked(sketches_: list[bytes]):
    import numpy as np

    return np.frombuffer(b"".join(sketches_), ">u8").reshape(-1, WORDS).astype(np.uint64)


def candidates(classes: DataFrame) -> DataFrame:
    """(bucket, table, node): the members of buckets that have a candidate there, of `classes` (node, sketch, f0 to f8)."""

    def found(groups: list) -> pa.RecordBatch:
        import numpy as np

        rows = []
        for bucket, members in groups:
            words, table = unpacked(members[:, 1]), int(members[0, 2])
            for a in range(0, len(members), BLOCK):
                rows += [(bucket, table, node) for node in members[a : a + BLOCK, 0][meeting(words, table, a).any(axis=1)]]
        kinds = (pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "table", "node"])

    n_tables = len(masks(RADIUS, 3))
    each = classes.select("node", F.posexplode(F.array(*NAMES)).alias("k", "word"))
    words = materialize(each.groupBy("k", "word").agg(F.count("*").alias("_k")), "words")
    close = close_words(words).withColumn("table", F.shiftrightunsigned("bucket", 56).cast("int")).withColumn("k", F.floor(F.col("table") / n_tables).cast("int"))
    # Classes of an equal word are in no bucket together, as it is there once.
    alike = words.where("_k > 1").withColumn("table", F.col("k") + n_tables * WORDS).select(bucket_name(F.col("table"), F.col("word")).alias("bucket"), "word", "table", "k")
    met = materialize(close.unionByName(alike), "close")
    members = met.join(each, ["k", "word"]).select("bucket", "table", "node").join(classes.select("node", "sketch"), "node").select("bucket", "node", "sketch", "table")
    return in_buckets(in_pairs_of_groups(materialize(members, "members")), found, "bucket long, table int, node binary")


def hashed_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, set) of `wanted` (node, rep): the sorted hashes of its text's shingles, in 32 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [np.unique((shingles(t.as_py(), size) >> np.uint64(32)).astype("<u4")).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["node", "set"])

    rows = materialize(wanted.select("node", F.col("rep.id").alias("_id"), F.col("rep.t1").alias("_t1"), F.col("rep.t2").alias("_t2")), "wanted")
    named = docs.select(F.col("doc_id").cast("long").alias("_doc"), *text_key(F.col("text")), F.col("text").cast("string").alias("text"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    return named.join(small(rows, F.lit(60)), same).select("node", "text").mapInArrow(trimmed(run), "node binary, set binary").dropDuplicates(["node"])


def before_each(members: DataFrame, least: float) -> DataFrame:
    """(node, root, waits, similarity): of each undecided member the first, in order, that is similar to it and before it; those that stay come first.

    `members` has bucket, node, sketch, set, table and stays (1 or 0).
    """

    def found(groups: list) -> pa.RecordBatch:
        import numpy as np

        rows = []
        for _, members in groups:
            members = members[sorted(range(len(members)), key=lambda i: (-members[i, 4], members[i, 0]))]
            words, table = unpacked(members[:, 1]), int(members[0, 3])
            sets = [np.frombuffer(x, "<u4") for x in members[:, 2]]
            stay = int(members[:, 4].sum())
            for a in range(0, len(members), BLOCK):
                if a + BLOCK <= stay:
                    continue
                for j, near in enumerate(meeting(words, table, a), a):
                    if j < stay:
                        continue
                    for i in np.flatnonzero(near[:j]).tolist():
                        x, y = sets[i], sets[j]
                        if min(len(x), len(y)) < least * max(len(x), len(y)):
                            continue
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if both >= least * (len(x) + len(y) - both):
                            rows.append((members[j, 0], members[i, 0], i >= stay, both / max(1, len(x) + len(y) - both)))
                            break
        kinds = (pa.binary(), pa.binary(), pa.bool_(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["node", "root", "waits", "similarity"])

    best = in_buckets(members, found, "node binary, root binary, waits boolean, similarity double")
    return best.groupBy("node").agg(F.min(F.struct("waits", "root", "similarity")).alias("b")).select("node", "b.root", "b.waits", "b.similarity")


def groups(docs: DataFrame, classes: DataFrame, size: int, least: float) -> DataFrame:
    """(node, root, similarity) of the classes that go, each with one that it is similar to and that stays.

    `classes` has node, rep (a row of it: unset, id, t1, t2), sketch and its words.
    """
    places = materialize(candidates(classes), "candidates")
    state = materialize(places.select("node").distinct().withColumn("stays", F.lit(0)), "state")
    gone = classes.sparkSession.createDataFrame([], "node binary, root binary, similarity double")
    if state.isEmpty():
        return gone
    mine = classes.join(state, "node", "left_semi")
    held = materialize(hashed_sets(docs, mine, size).join(mine.select("node", "sketch"), "node"), "sets")
    while True:
        # Only buckets with an undecided member have anything to say.
        open_ = places.join(state.where("stays = 0"), "node", "left_semi").select("bucket").distinct()
        members = places.join(open_, "bucket", "left_semi").join(state, "node").join(held, "node").select("bucket", "node", "sketch", "set", "table", "stays")
        best = materialize(before_each(members, least), "best")
        gone = gone.union(best.where("not waits").select("node", "root", "similarity"))
        # What nothing similar precedes stays.
        now = state.join(best, "node", "left").where("waits is null or waits").select("node", F.when(F.col("waits"), 0).otherwise(1).alias("stays"))
        state = materialize(now, "state")
        if state.where("stays = 0").isEmpty():
            return materialize(gone, "gone")


def classes_of(prints: DataFrame) -> DataFrame:
    """node (its set's name), rep (the row of the least doc_id), n and the sketch of each class."""
    rep = F.min(F.struct(F.col("id").isNull().alias("unset"), "id", "t1", "t2")).alias("rep")
    made = prints.groupBy("s1", "s2").agg(rep, F.count("*").alias("n"), *[F.first(f).alias(f) for f in NAMES])
    raw = lambda names: F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in names])
    return made.withColumns({"node": raw(["s1", "s2"]), "sketch": raw(NAMES)})


def keep_one(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of `docs` that stay when one of each group of near-duplicates does."""
    prints = materialize(sketched(docs, size), "prints")
    classes = materialize(classes_of(prints), "classes")
    gone = groups(docs, classes.select("node", "rep", "sketch", *NAMES), size, least)
    # Classes of one row that stay have nothing to decide.
    touched = classes.join(gone.select("node", F.lit(True).alias("_gone")), "node", "left").where("_gone or n > 1").select("s1", "s2", "n", "rep", F.coalesce("_gone", F.lit(False)).alias("_gone"))
    rows = lookup(prints.select("id", "t1", "t2", "s1", "s2"), touched, ["s1", "s2"], "n", F.col("id"))
    stays = ~F.col("_gone") & F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("t1") == F.col("rep.t1")) & (F.col("t2") == F.col("rep.t2"))
    keys = rows.groupBy(F.col("id").alias("__quern_id"), F.col("t1").alias("__quern_t1"), F.col("t2").alias("__quern_t2")).agg(F.max(stays).alias("_stays"), F.count("*").alias("_rows"))
    out = materialize(keys.where("not _stays or _rows > 1"), "out")
    t1, t2 = text_key(docs["text"])
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__quern_id")) & (t1 == F.col("__quern_t1")) & (t2 == F.col("__quern_t2"))
    once = docs.join(small(out, F.lit(40)), same, "left_anti")
    twice = out.where("_stays")
    if twice.isEmpty():
        return once
    return once.union(docs.join(small(twice, F.lit(40)), same, "left_semi").dropDuplicates(["doc_id", "text"]))
