"""Near-duplicate removal against exact similarities of all pairs."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quern.llm import neardup, simhash
from quern.sources import read_table


def plain_set(text, size=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def similar_pairs(sets, least):
    """All pairs of different sets at least that similar: rare shingles first, by the prefixes that two such sets must share."""
    count = defaultdict(int)
    for s in sets:
        for x in s:
            count[x] += 1
    seen, pairs = defaultdict(list), {}
    for i, s in enumerate(sets):
        ordered = sorted(s, key=lambda x: (count[x], x))
        met = set()
        for x in ordered[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]:
            met.update(seen[x])
            seen[x].append(i)
        for j in met:
            if min(len(s), len(sets[j])) >= least * max(len(s), len(sets[j])) and (v := alike(s, sets[j])) >= least:
                pairs[j, i] = v
    return pairs


def check(before, after, recall, sure):
    """`before` and `after`: text by doc_id. Drops are right; of similar pairs not both stay."""
    sets = {i: plain_set(t) for i, t in before.items()}
    first = {}
    for i in sorted(before):
        first.setdefault(sets[i], i)
    kept = [i for i in after]
    assert all(after[i] == before[i] for i in kept)
    # One row of equal sets at most, that of the least doc_id.
    assert all(first[sets[i]] == i for i in kept)
    different = list(first)
    at = {s: k for k, s in enumerate(different)}
    pairs = similar_pairs(different, 0.8)
    stays = {at[sets[i]] for i in kept}
    partners = defaultdict(set)
    for a, b in pairs:
        partners[a].add(b)
        partners[b].add(a)
    for k in set(range(len(different))) - stays:
        assert partners[k] & stays, different[k]
    missed = [v for (a, b), v in pairs.items() if a in stays and b in stays]
    assert len(missed) <= (1 - recall) * len(pairs), (len(missed), len(pairs))
    assert not [v for v in missed if v >= sure]
    return len(pairs), len(missed)


def families(rng):
    """Texts in families: edits of one text by ever more words, chains of edits, templates of which half is shared."""
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = []
    for _ in range(25):
        base = prose(rng.randrange(60, 400))
        texts += [base, base]
        for edits in (1, 1, 2, 3, 4, 6, 8, 12):
            other = list(base)
            for _ in range(max(1, edits * len(base) // 400)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(other)
        for _ in range(12):
            base = list(base)
            for _ in range(3):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(base)
        half = prose(150)
        texts += [half + prose(100) for _ in range(6)]
    texts += [prose(200) for _ in range(60)]
    return [" ".join(t) for t in texts]


def test_against_all_pairs(spark):
    rng = random.Random(5)
    texts = families(rng) + ["", "one", "one", "ONE", "two words", "A b c d e", "a  B c\td e", "a b c d f"]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (90001, None), (90002, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit(1)).withColumn("node", F.col("doc_id"))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    n, missed = check(dict(rows), {r["doc_id"]: r["text"] for r in kept.collect()}, 0.9, 0.88)
    assert n > 300, (n, missed)


def test_rows(spark):
    """Repeated rows, null doc_ids and an empty table."""
    schema = "doc_id long, text string, source string"
    rows = [(1, "a b", "x"), (1, "a b", "y"), (1, "c d", "x"), (None, "a b", "x"), (None, "e f", "x"), (None, "e f", "y"), (None, "g h", "x"), (2, "A  b", "x"), (3, "", "x"), (4, None, "x")]
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in neardup.keep_one(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, "e f"), (0, "g h"), (1, "a b"), (1, "c d"), (3, "")]
    assert neardup.keep_one(spark.createDataFrame([], schema)).count() == 0


def test_sketches():
    sets = [neardup.shingles(t, 5) for t in ("", "a", "a b c d e f g", " ".join(map(str, range(2000))))]
    got = neardup.sketches(sets)
    for s, row in zip(sets, got):
        for k in range(neardup.WORDS):
            hashes = neardup.mixed(s, 1000 + k).tolist()
            assert int(row[k]) == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def classes(n, pairs):
    p = list(range(n))

    def f(i):
        while p[i] != i:
            i = p[i]
        return i

    for i, j in pairs:
        p[max(f(i), f(j))] = min(f(i), f(j))
    return [f(i) for i in range(n)]


def test_links_of_a_dense_bucket():
    rng = random.Random(2)
    heads = [[rng.getrandbits(64) for _ in range(4)] for _ in range(40)]
    rows = np.array([[w ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(12))) for w in rng.choice(heads)] for _ in range(1500)], np.uint64)
    apart = np.bitwise_count(rows[:, None, :] ^ rows[None, :, :]).astype(int).sum(axis=2)
    want = classes(len(rows), zip(*np.nonzero(apart <= 44)))
    found = simhash.spanning_links(rows, 44)
    assert 2 < len(set(want)) < len(rows)
    assert classes(len(rows), found) == want and len(found) == len(rows) - len(set(want))


def test_groups_of_a_large_bucket(spark):
    """Every two members of a bucket of over HELD meet in some part of it."""
    n = 2 * simhash.HELD + 77
    cut = neardup.in_pairs_of_groups(spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node")).union(spark.createDataFrame([(2, 1), (2, 2)], "bucket long, node long"))).toPandas()
    assert set(cut[cut.bucket == 2].node) == {1, 2}
    parts = [np.sort(g.node.values) for b, g in cut[cut.bucket != 2].groupby("bucket")]
    assert max(map(len, parts)) < 1.2 * simhash.HELD
    met = np.zeros((n, n), bool)
    for p in parts:
        met[np.ix_(p, p)] = True
    assert met.all()


def test_recall_at_ten_thousand_documents(spark):
    docs = read_table(spark, "/root/testdata/sf0.1", "documents")
    before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    after = {r["doc_id"]: r["text"] for r in neardup.keep_one(docs).select("doc_id", "text").collect()}
    n, missed = check(before, after, 0.9, 0.9)
    assert n > 30, (n, missed)
    print(n, missed, len(before) - len(after))


def test_a_pair_counts_in_one_table():
    """Of all tables in which two classes collide, within reach of the word, exactly one has them as candidates."""
    rng = np.random.default_rng(4)
    tables = np.array(simhash.masks(neardup.RADIUS, 3), np.uint64)
    seen = 0
    for _ in range(60):
        a = rng.integers(0, 1 << 63, neardup.WORDS, np.uint64)
        b = a ^ np.array([sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 14), replace=False)) for _ in range(neardup.WORDS)], np.uint64)
        words = np.stack([a, b])
        met = [t for t in range(len(tables) * neardup.WORDS) if not (a[t // len(tables)] ^ b[t // len(tables)]) & tables[t % len(tables)] and np.bitwise_count(a[t // len(tables)] ^ b[t // len(tables)]) <= neardup.REACH]
        same = [len(tables) * neardup.WORDS + k for k in range(neardup.WORDS) if a[k] == b[k]]
        counted = [t for t in range(len(tables) * neardup.WORDS + neardup.WORDS) if neardup.meeting(words, t, 0)[0, 1]]
        near = np.bitwise_count(a ^ b).sum() <= neardup.LIMIT
        assert counted == ((same or met)[:1] if near else [])
        seen += bool(counted)
    assert seen > 10


def test_dense_families_take_few_rounds(spark, monkeypatch):
    """A family in which many pairs are nearly similar, and a chain of versions: rounds don't follow their size."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    texts = []
    for _ in range(150):
        other = list(base)
        for _ in range(7):
            other[rng.randrange(300)] = rng.choice(vocabulary)
        texts.append(" ".join(other))
    for _ in range(150):
        base = list(base)
        base[rng.randrange(300)] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    rounds, plain = [], neardup.before_each
    monkeypatch.setattr(neardup, "before_each", lambda *a: rounds.append(1) or plain(*a))
    rows = list(enumerate(texts))
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    check(dict(rows), {r["doc_id"]: r["text"] for r in kept.collect()}, 0.9, 0.88)
    assert len(rounds) < 12
