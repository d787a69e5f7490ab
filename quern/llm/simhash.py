"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits; bit i is set if over half of the document's word
shingles have bit i set in their XXH64 hash. To find all pairs at most `radius`
bits apart, bit i gets a vector v(i) of radius + 1 bits, and for each of the
2^(radius + 1) - 1 nonzero vectors m there is a table that compares the bits with
v(i).m odd only. Where two fingerprints differ in at most `radius` bits, some m is
orthogonal to the vectors of all those bits, so in that table the two collide: no
pair is missed. Beyond radius 4 the bits are covered three times two thirds of them:
of r differing bits one of the three parts has at most 2 r / 3, for which there are
fewer tables. Members of a bucket are then compared in all their bits.

Equal fingerprints are joined first, so a bucket holds different fingerprints
only, and only the links that span a bucket leave it: never all of its pairs. A
bucket of more than HELD fingerprints isn't compared by one task: its members go
through a second covering, of the bits its table leaves free, which splits it
without losing a pair. For radius 2 that leaves 13 free bits at most, hence at most
2^13 members of any bucket, however many documents meet in a hot one.

Null and empty texts have fingerprint zero, which links as any other does. Rows
with a null doc_id get a component but are never its representative unless all
are null. Repeated rows each stay a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import lookup, materialize, trimmed

#: Members of a bucket that one task holds.
HELD = 8192
BLOCK = 256


def fingerprint_texts(texts: list[str | None], size: int):
    """The fingerprints of some texts, unsigned 64-bit numbers."""
    import numpy as np
    import xxhash

    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    spaces = bytes.maketrans(b"\t\n\v\f\r", b"     ")
    table = bytes(spaces[lower[i]] for i in range(256))
    hash64 = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for at, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").translate(table).split(b" ")
        words = [w for w in words if w]
        n = len(words)
        if not n:
            continue
        total, counts = max(n - size + 1, 1), np.zeros(64, np.int64)
        for first in range(0, total, 65536):
            if n < size:
                hashes = [hash64(b" ".join(words), 42)]
            else:
                last = min(first + 65536, total)
                joined = b" ".join(words[first : last + size - 1])
                ends, end = [], -1
                for w in words[first : last + size - 1]:
                    end += len(w) + 1
                    ends.append(end)
                starts = [0, *[e + 1 for e in ends[: last - first - 1]]]
                hashes = [hash64(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])]
            raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[at] = weights[2 * counts > total].sum(dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long with the 64 bits) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = fingerprint_texts(batch.column(1).to_pylist(), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(run), "doc_id long, fingerprint long")


def cover(bits: list[int], radius: int) -> list[int]:
    """Masks of these bits, one for each nonzero vector, of which two numbers agree in one if they differ in at most `radius` of the bits."""
    n = 1 << (radius + 1)
    return [sum(1 << b for i, b in enumerate(bits) if bin((i % (n - 1) + 1) & m).count("1") % 2) for m in range(1, n)]


def masks(radius: int, parts: int | None = None) -> list[int]:
    """The covering tables' masks of the 64 bits, covered at once or in `parts` (1 or 3)."""
    if (parts or (1 if radius <= 4 else 3)) == 1:
        return cover(list(range(64)), radius)
    return [m for part in range(3) for m in cover([b for b in range(64) if b % 3 != part], 2 * radius // 3)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def spanning_links(words, most: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the members of one bucket exactly as all its pairs at most `most` bits apart would.

    `words` has a row of unsigned 64-bit numbers for each member. Components are
    grown one by one, and what is reached is looked at no more, so members that are
    all close to each other cost a pass and not all their pairs.
    """
    import numpy as np

    def apart(some, others):
        out = np.zeros((len(some), len(others)), np.uint16)
        for k in range(words.shape[1]):
            out += np.bitwise_count(words[some, k][:, None] ^ words[others, k][None, :])
        return out

    if len(words) == 2:
        return [(0, 1)] if apart(np.array([0]), np.array([1]))[0, 0] <= most else []
    links: list[tuple[int, int]] = []
    left = np.arange(len(words))
    while len(left) > 1:
        edge, left = left[:1], left[1:]
        while len(edge) and len(left):
            near = apart(edge[:BLOCK], left) <= most
            met = near.any(axis=0)
            links += zip(edge[:BLOCK][near.argmax(axis=0)[met]].tolist(), left[met].tolist())
            edge, left = np.concatenate([edge[BLOCK:], left[met]]), left[~met]
    return links


def bucket_name(table: int | Column, *parts: Column) -> Column:
    """A bucket's name: its table in the first eight bits, a hash in the others.

    Should two buckets share a name they are compared together, which changes nothing.
    """
    of = F.lit(table) if isinstance(table, int) else table
    return F.shiftleft(of.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*parts), 8))


def buckets(distinct: DataFrame, radius: int) -> DataFrame:
    """(bucket, fingerprint): each fingerprint in every covering table."""
    named = [bucket_name(i, F.col("fingerprint").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks(radius))]
    return distinct.select(F.explode(F.array(*named)).alias("bucket"), "fingerprint")


def split(large: DataFrame, radius: int) -> DataFrame:
    """(bucket, fingerprint) of members of large buckets, by coverings of the bits that each bucket's table doesn't compare."""
    second = [[signed(m) for m in cover([b for b in range(64) if not table >> b & 1], radius)] for table in masks(radius)]
    listed = F.array(*[F.array(*[F.lit(m).cast("long") for m in ms]) for ms in second])
    own = F.get(listed, F.shiftrightunsigned("bucket", 56).cast("int"))
    each = large.select("bucket", "fingerprint", F.posexplode(own).alias("_j", "_m"))
    return each.select(F.xxhash64("bucket", "_j", F.col("fingerprint").bitwiseAND(F.col("_m"))).alias("bucket"), "fingerprint")


def in_buckets(keyed: DataFrame, found: Callable[[list], pa.RecordBatch], schema: str, beyond: Callable | None = None) -> DataFrame:
    """`found` of lists of (bucket, members) with two members at least; `keyed` is the bucket and one column, or several, of which members have rows.

    With `beyond`, the members of a bucket of more than HELD are passed to that as
    they come, as (bucket, members), and never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # The last bucket of a batch may go on in the next one.
        name, held, large = None, [], False
        for batch in batches:
            bucket, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            value = columns[0] if len(columns) == 1 else np.stack(columns, axis=1)
            if not len(bucket):
                continue
            edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            groups = []
            if name is not None and bucket[0] != name:
                if not large:
                    groups.append((name, np.concatenate(held)))
                held, large = [], False
            several = np.flatnonzero(np.diff(edges) > 1).tolist()
            for g in sorted({0, len(edges) - 2, *several}):
                members = value[edges[g] : edges[g + 1]]
                was, large = large and g == 0, large and g == 0
                if g == 0 and not was:
                    members = np.concatenate([*held, members])
                    held = []
                if was or (beyond and len(members) > HELD):
                    yield beyond(bucket[edges[g]], members)
                    large, members = True, members[:0]
                if g == len(edges) - 2:
                    name, held = bucket[-1], [members.copy()]
                elif not large:
                    groups.append((bucket[edges[g]], members))
            yield found([x for x in groups if len(x[1]) > 1])
        if held and not large:
            yield found([x for x in [(name, np.concatenate(held))] if len(x[1]) > 1])

    n = max(1, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return keyed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(run), schema)


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between the different fingerprints of `distinct` that connect what all pairs within the radius would."""
    names, kind = ["a", "b", "bucket", "fingerprint"], pa.int64()

    def found(groups: list) -> pa.RecordBatch:
        import numpy as np

        out = [(members[i], members[j]) for _, members in groups for i, j in spanning_links(members.view(np.uint64)[:, None], radius)]
        return pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in out], kind) for k in (0, 1)], *[pa.nulls(len(out), kind)] * 2], names=names)

    def beyond(bucket: int, members) -> pa.RecordBatch:
        n = len(members)
        return pa.RecordBatch.from_arrays([*[pa.nulls(n, kind)] * 2, pa.array([bucket] * n, kind), pa.array(members, kind)], names=names)

    schema = "a long, b long, bucket long, fingerprint long"
    first = materialize(in_buckets(buckets(distinct, radius), found, schema, beyond), "links")
    again = in_buckets(split(first.where("bucket is not null").select("bucket", "fingerprint"), radius), found, schema)
    return first.where("bucket is null").union(again).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge: the least node that it is connected to, by large and small stars in turn."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        # Large star: each node's larger neighbours go to its least neighbour or itself.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("_n"))
        large = lookup(both, least, ["u"], "_n", F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        # Small star: each node's smaller neighbours and itself go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = lookup(large, least, ["u"], "_n", F.col("v"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "small")
        # A star forest is a fixed point: every node has one edge, to a node without one.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the least doc_id that links reach, of each row."""
    prints = materialize(fingerprints(docs, size), "prints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")), "distinct")
    roots = components(links(distinct, radius))
    classes = materialize(distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "least", "_n", F.coalesce("root", "fingerprint").alias("root")), "classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("_r"))
    named = materialize(lookup(classes, ids, ["root"], "_r", F.col("fingerprint")).select("fingerprint", "_n", "component_id"), "named")
    return lookup(prints, named, ["fingerprint"], "_n", F.col("doc_id")).select("doc_id", "fingerprint", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """The fingerprint as 16 hexadecimal digits."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
