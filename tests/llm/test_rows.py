"""Repeated rows, null ids and very long texts for every operator; models against plain versions of their formulas."""

import math
import zlib

import numpy as np
import pytest

from quern.llm import chat, decontaminate, langid, linededup, media, packing, pii, quality, queries, simhash, suffix
from quern.sources import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def doubled(spark):
    """The documents, some of them twice, some without an id."""
    docs = read_table(spark, SF, "documents")
    return docs.union(docs.where("doc_id < 12")).union(docs.where("doc_id between 20 and 31").selectExpr("cast(null as long)", "text", "lang", "source", "n_chars")).cache()


def test_repeated_rows_and_null_ids(spark, doubled):
    labels, bench = read_table(spark, SF, "labels"), read_table(spark, SF, "benchmark")
    want = doubled.groupBy("doc_id").count().collect()
    want = {r["doc_id"]: r["count"] for r in want}
    made = {
        "op1": media.digest(media.read_films(media.encode(doubled))),
        "op3": quality.rank(doubled, labels),
        "op4": decontaminate.digest(decontaminate.report(doubled, bench)),
        "op5": linededup.digest(linededup.drop_runs(doubled)),
        "op6": pii.digest(pii.find(doubled)),
        "op8": suffix.digest(suffix.repeats(doubled)),
        "op9": langid.identify(doubled),
        "op10": simhash.digest(simhash.near_duplicates(doubled)),
    }
    for name, frame in made.items():
        rows = frame.collect()
        got = {}
        for r in rows:
            got.setdefault(r["doc_id"], []).append(tuple(r))
        assert {k: len(v) for k, v in got.items()} == want, name
        assert all(len(set(v)) == 1 for k, v in got.items() if k is not None), name
    packed = packing.digest(packing.pack(doubled, queries.public_byte_bpe()))
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg({"start": "count"}).withColumnRenamed("count(start)", "n").where("doc_id < 12").collect()} == {
        r["doc_id"]: 2 * r["n"] for r in packing.digest(packing.pack(read_table(spark, SF, "documents"), queries.public_byte_bpe())).groupBy("doc_id").agg({"start": "count"}).withColumnRenamed("count(start)", "n").where("doc_id < 12").collect()
    }


def test_very_long_texts(spark):
    """Texts of some MB, one of them a single word, through all operators."""
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 9, 4000)]
    prose = " ".join(words[i] for i in rng.integers(0, 4000, 200_000))
    lines = "\n".join(" ".join(words[i] for i in rng.integers(0, 4000, 8)) for _ in range(10_000))
    rows = [(1, prose, "en", "x", len(prose)), (2, "q" * 1_500_000, "en", "x", 1_500_000), (3, lines, "de", "y", len(lines)), (4, "short text", "de", "y", 10)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(7, " ".join(prose.split()[150_000:150_012]))], "item_id long, text string")
    films = {r["doc_id"]: r for r in media.digest(media.read_films(media.encode(docs))).collect()}
    assert all(films[i]["n_bytes"] == len(t) and films[i]["payload_bytes"] % 192 == 0 for i, t, *_ in rows)
    pieces = packing.digest(packing.pack(docs, queries.public_byte_bpe())).collect()
    for i, *_ in rows:
        own = sorted((p["start"], p["length"], p["doc_tokens"]) for p in pieces if p["doc_id"] == i)
        assert sum(n for _, n, _ in own) == own[0][2] and all(a + n == b for (a, n, _), (b, _, _) in zip(own, own[1:]))
    assert {r["doc_id"]: r["n_hit"] for r in decontaminate.report(docs, bench).collect()} == {1: 12, 2: 0, 3: 0, 4: 0}
    assert {r["doc_id"]: r["n_lines_removed"] for r in linededup.drop_runs(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert pii.find(docs).count() == quality.rank(docs, labels).count() == langid.identify(docs).count() == 4
    removed = {r["doc_id"]: r["n_removed"] for r in suffix.digest(suffix.repeats(docs)).collect()}
    assert removed == {1: 0, 2: 1_500_000, 3: 0, 4: 0}
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {1, 2, 3, 4}


def test_an_empty_table_of_conversations(spark):
    made = chat.digest(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))
    assert made.count() == 0


def test_buckets(spark):
    packed = packing.pack(read_table(spark, SF, "documents"), queries.public_byte_bpe())
    got = {r["bucket"]: (r["length"], r["n_sequences"], r["n_tokens"]) for r in packing.buckets(packed).collect()}
    assert all(size == 1 << b and tokens == n * size for b, (size, n, tokens) in got.items())
    assert sum(n for _, n, _ in got.values()) == packed.count()


def plain_trigrams(text):
    """Weights of a text's hashed trigrams, byte by byte."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode()]
    out = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        h = ((a * 0x9E3779B1) ^ (b * 0x85EBCA6B) ^ (c * 0xC2B2AE35)) & 0xFFFFFFFF
        out[h >> 20] = out.get(h >> 20, 0) + 1
    norm = math.sqrt(sum(out.values()))
    return {k: math.sqrt(n) / norm for k, n in out.items()}


def test_language_by_hand(spark):
    """The family of the largest margin, then votes of its pairs, from the model's weights in plain loops."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit(docs.where(~langid.part(docs["doc_id"], 4, 2)))
    got = {r["doc_id"]: r for r in langid.annotate(docs.select("doc_id", "text"), model).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    right = held = 0
    for r in rows[::3]:
        x = plain_trigrams(r["text"])
        margin = lambda k: sum(v * float(model["weights"][i, k]) for i, v in x.items()) + float(model["weights"][-1, k])
        top = max(range(len(model["families"])), key=margin)
        family = model["families"][top]
        votes = {v: [0, 0.0] for v in model["langs"] if model["family"][v] == family}
        for k, (a, b) in enumerate(model["pairs"], len(model["families"])):
            if a in votes:
                m = margin(k)
                votes[a][0] += m >= 0
                votes[b][0] += m < 0
                votes[a][1] += m
                votes[b][1] -= m
        best = max(votes, key=lambda v: votes[v])
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["family"]) == (best, family)
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            held += 1
            right += best == r["lang"]
    assert held > 50 and right >= 0.97 * held


def test_every_language_is_learnt(spark):
    """However many there are: 202 languages of two rows each, all of which are predicted somewhere."""
    rng = np.random.default_rng(2)
    names = [f"x{i:03d}" for i in range(202)]
    words = {n: ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(4)] for n in names}
    rows = [(k * 202 + i, " ".join(words[n][j] for j in rng.integers(0, 4, 30)), n, "s", 1) for k in range(2) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = langid.annotate(docs.select("doc_id", "text", "lang"), langid.fit(docs))
    assert got.select("lang_pred").distinct().count() == 202
    assert got.where("lang_pred = lang").count() >= 0.99 * len(rows)


def test_quality_by_hand(spark):
    """Scores are the logistic of the standardised features' weighted sum over the threshold; better rows outrank worse ones."""
    docs, labels = read_table(spark, "/root/testdata/sf0.01", "documents"), read_table(spark, "/root/testdata/sf0.01", "labels")
    held = langid.part(labels["doc_id"], 3, 1)
    model = quality.fit(docs, labels.where(~held))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in sorted(texts)[::10]:
        x = quality.features([texts[i]])[0].astype(float)
        strength = sum(float(w) * (float(v) - float(m)) / float(s) for w, v, m, s in zip(model["w"], x, model["mean"], model["scale"])) - model["at"]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-500, min(500, strength)))), abs=1e-9)
    rows = labels.where(held).collect()
    good, bad = [got[r["doc_id"]] for r in rows if r["quality"] == 1], [got[r["doc_id"]] for r in rows if r["quality"] == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad)
    assert wins >= 0.95 * len(good) * len(bad)


def test_quality_features_by_hand():
    """Bigrams of byte classes and the statistics of words and lines, counted in plain loops."""
    text = "The cat, the CAT!\nsat  on\n\nthe the mat 12 é"
    classes = quality.byte_classes()
    kinds = [classes[b] for b in text.encode()]
    want = np.zeros(256)
    for a, b in zip(kinds, kinds[1:]):
        want[a * 16 + b] += 1
    got = quality.features([text, None])
    assert np.allclose(got[0, :256], np.sqrt(want / (len(kinds) - 1)), atol=1e-6) and not got[1].any()
    words, lines = text.split(), text.split("\n")
    n, m = len(words), len(lines)
    sizes = sorted(map(len, lines))
    stats = [math.log1p(n), math.log1p(m), len(text) / n / 10, len(set(words)) / math.sqrt(n) / 10, 1 / n, len(set(lines)) / m, math.log1p(n / m), math.log1p(sizes[-1]), math.log1p(sizes[m // 2]), 0 / n, sum(w.isalpha() for w in words) / n, 1]
    stats[9] = sum(w.isupper() for w in words) / n
    assert np.allclose(got[0, 256:], stats, atol=1e-5)
