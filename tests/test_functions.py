"""Codecs, tokens and numbers."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import codec, tokens
from quern.operators import average, metrics

STRINGS = ["Hello, World!", "<|endoftext|>", "ünïcödé 😀", "\t\n x  \r\n", "trailing\n", "a" * 500, " ", "0123", "日本語 テスト"]


def test_planes_and_frames():
    raw = bytes(i % 256 for i in range(1024 * 3 * 5 * 7))
    for width in (1, 2, 3, 4):
        assert codec.from_planes(codec.to_planes(raw, width), width) == raw
        assert codec.decompress(codec.compress(raw, width), len(raw), width) == raw
    assert codec.to_planes(bytes([1, 0, 2, 0]), 2) == bytes([1, 2, 0, 0])
    assert codec.token_words(bytes([1, 0, 2, 0, 255, 255]), 2) == [1, 2, 65535]
    frame = codec.compress(b"abcd" * 4)
    for bad in (lambda: codec.compress(b""), lambda: codec.compress(b"abc", 2), lambda: codec.decompress(frame, 12), lambda: codec.decompress(b"xx", 4), lambda: codec.decompress(frame, 99)):
        with pytest.raises(ValueError):
            bad()


def test_city_hash():
    assert codec.city64(b"") == 0x9AE16A3B2F90404F
    seen = {codec.city64(bytes((i * 7 + j) % 256 for j in range(n))) for n in (1, 3, 4, 7, 8, 16, 17, 32, 33, 64, 65, 128, 129, 1000) for i in range(50)}
    r = random.Random(9)
    many = [r.randbytes(n) for n in [*range(0, 400), 1000, 4096, 5000]]
    assert codec.city64_rows(many).tolist() == [codec.signed(codec.city64(v)) for v in many]
    assert codec.city64_rows([]).tolist() == []
    assert len(seen) == 14 * 50 and codec.signed(1 << 63) == -(1 << 63)


def test_tokens_round_trip(spark):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "doc_id long, text string")
    made = docs.select("text", tokens.byte_tokens(F.col("text")).alias("t"), tokens.regex_pieces(F.col("text")).alias("p"))
    for r in made.select("text", "t", tokens.decode_bytes(F.col("t")).alias("back"), F.array_join("p", "").alias("joined")).collect():
        assert r["t"] == list(r["text"].encode()) and r["back"] == r["text"] == r["joined"]
    plugged = tokens.encode_with(docs, lambda: lambda text: [ord(c) for c in text]).collect()
    assert all("".join(map(chr, r["tokens"])) == r["text"] for r in plugged)
    assert len(docs.columns) == 2
    raw = made.select(codec.words_binary(F.col("t")).alias("b"), "t").first()
    assert codec.token_words(bytes(raw["b"]), 4) == raw["t"]


def test_counts_and_vocabulary(spark):
    kept, rejected = tokens.with_tokens(spark.createDataFrame([(None,), ("",), (" ",)], "text string"))
    assert kept.count() == 1 and tuple(rejected.first()) == (1, 1)
    assert tokens.padded_vocab(50_280) == 50_304 and tokens.padded_vocab(127) == 128 and tokens.padded_vocab(128) == 256
    row = spark.range(1).select(F.array(*map(F.lit, (5, 6, -1, 7, -1))).alias("t"))
    a, b, c = row.select(*tokens.shifted(F.col("t"))).first()
    assert (a, b, c) == ([5, 6, -1], [6, -1, 7], [-1, 7, -1]) and row.select(tokens.remap_padding(F.col("t"), 9)).first()[0] == [5, 6, 9, 7, 9]
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(tokens.check_ids(F.array(F.lit(1 << 31)))).collect()


def test_norms_and_rates(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    (a,), (b,) = v.select(tokens.rms_norm(F.col("v"))).collect()
    (c,), (d,) = v.select(tokens.rms_norm_by_length(F.col("v"))).collect()
    assert a == pytest.approx(c, abs=1e-6) and a[0] == pytest.approx(3 / 12.5**0.5, abs=1e-6) and b == d == [0, 0]
    with pytest.raises(Exception, match="beyond the last"):
        spark.range(11, 12).select(tokens.learning_rate(F.col("id"), 1.0, 2, 3, 10)).collect()


def test_sequence_lengths(spark):
    masks = spark.createDataFrame([(0, [2, 3, 0, 0, 0, 0]), (1, [3, 2, 0, 0, 0, 0]), (2, [6, 0, 0, 0, 0, 0])], "row int, lengths array<int>")
    flat = metrics.flat_indices(metrics.mask_lengths(masks), "row", "place", "length", 6).orderBy("flat_index")
    assert [r["flat_index"] for r in flat.collect()] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 12, 13, 14, 15, 16, 17]
    assert {r["longest"] for r in metrics.cu_seqlens(metrics.mask_lengths(masks), "row", "place", "length").collect()} == {3, 6}


def test_update_averages(spark):
    updates = spark.createDataFrame([("w", i, [float(i), 1.0]) for i in range(5)], "name string, seq long, values array<double>")
    assert average.mean_vector(updates, "name").first()["values"] == [2.0, 1.0]
    long = updates.select("name", "seq", F.posexplode("values").alias("idx", "value"))
    for every in (2, 4):
        value = speed = 0.0
        held, want = [], []
        for u in map(float, range(5)):
            held.append(u)
            if len(held) < every:
                value -= 0.1 * u
            else:
                g = sum(held) / every
                speed = 0.9 * speed + g
                value -= 0.7 * (g + 0.9 * speed)
                held = []
            want.append(value)
        got = average.diloco(long, every).where("idx = 0").orderBy("seq").collect()
        assert [r["value"] for r in got] == pytest.approx(want)
    assert average.work_items(spark.createDataFrame([("a",), ("b",)], "worker string"), 1, "m").select("work_item_id").distinct().count() == 2


def test_losses_and_totals(spark):
    rows = spark.createDataFrame([(0, -1.0, 4), (0, -3.0, 5), (0, -9.0, -1)], "step int, lp double, target int")
    assert rows.agg(metrics.masked_loss(F.col("lp"), F.col("target"))).first()[0] == 2.0
    ranks = spark.createDataFrame([(0, 2.0, 3, 1), (0, 4.0, 5, 3), (1, 1.0, 0, 0)], "step int, loss double, tokens long, correct long")
    got = {r["step"]: r for r in metrics.all_reduce(ranks, "step").collect()}
    assert (got[0]["loss"], got[0]["tokens"], got[0]["accuracy"], got[1]["accuracy"]) == (3.0, 8, 50.0, None)
    shapes = spark.createDataFrame([([3, 4], True), ([5], True), ([9], False)], "shape array<long>, trainable boolean")
    assert metrics.parameter_count(shapes).first()[0] == 17
    speed = metrics.throughput(spark.createDataFrame([(10, 2.0), (1, 0.0)], "tokens long, step_time double")).collect()
    assert [r["tokens_per_s"] for r in speed] == [5.0, None]
    assert metrics.compression_ratio(spark.createDataFrame([(0, 0)], "cbytes long, token_count long")).first()[0] == 0.0
