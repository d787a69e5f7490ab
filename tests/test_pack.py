"""Packing, ordering and batches against plain models."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.config import EpochConfig
from quern.operators import batch, epoch, pack

GOLDEN = [
    (0, 0, False, [(0, 0, 0, 10), (1, 0, 11, 3)]),
    (0, 1, False, [(2, 0, 0, 16)]),
    (1, 0, False, [(3, 0, 0, 2), (4, 0, 3, 13)]),
    (1, 1, True, [(2, 16, 0, 9), (5, 0, 10, 6)]),
    (2, 0, True, [(4, 13, 0, 16)]),
    (2, 1, False, [(6, 0, 0, 5)]),
    (3, 0, True, [(4, 29, 0, 11)]),
]


def plan(lengths, b, c, m):
    return list(pack.plan_rows(iter([(0, i, n) for i, n in enumerate(lengths)]), b, c, m))


def grouped(rows):
    out = {}
    for step, lane, cont, _, _, span, ro, wo, n in rows:
        out.setdefault((step, lane, cont), []).append((span, ro, wo, n))
    return [(*k, v) for k, v in out.items()]


def test_golden_trace():
    assert grouped(plan([10, 3, 25, 2, 40, 7, 5], 2, 16, 4)) == GOLDEN
    assert sum(r[-1] for r in plan([10, 3, 25, 2, 40, 7, 5], 2, 16, 4)) == 91


def test_exact_fit_has_no_carry():
    assert grouped(plan([16, 16], 1, 16, 4)) == [(0, 0, False, [(0, 0, 0, 16)]), (1, 0, False, [(1, 0, 0, 16)])]


def test_no_least_length_drops_nothing():
    assert sum(r[-1] for r in plan([1] * 9, 1, 4, 0)) == 9


def test_long_span_goes_on_and_loses_its_tail():
    rows = plan([10 * 16 + 3], 1, 16, 4)
    assert len(rows) == 10 and rows[-1][2] and sum(r[-1] for r in rows) == 160


def test_nothing():
    assert plan([], 3, 16, 4) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=40), st.integers(1, 4), st.integers(2, 40), st.integers(0, 12))
def test_rows_are_sound(lengths, b, c, m):
    rows = plan(lengths, b, c, m)
    read, places = {}, {}
    for step, lane, _, seg, _, span, ro, wo, n in rows:
        assert n > 0 and wo + n <= c
        assert read.get(span, 0) == ro
        read[span] = ro + n
        if seg:
            assert wo == places[step, lane] + 1
        else:
            assert wo == 0
        places[step, lane] = wo + n
    for span, done in read.items():
        assert done == lengths[span] or lengths[span] - done < max(m, 1)
    if m < c:
        assert sorted(read) == list(range(len(lengths)))
    steps = sorted({r[0] for r in rows})
    assert steps == list(range(len(steps)))


def drawn(shards, order):
    """Spans in the order in which walking the shard list in turn draws them."""
    left = {s: list(v) for s, v in shards.items()}
    out = []
    while any(left.values()):
        for s in order:
            if left[s]:
                out.append((s, left[s].pop(0)))
    return out


def test_interleaving_is_drawing_in_turn(spark):
    r = random.Random(2)
    sizes = {0: 1, 1: 16, 2: 17, 3: 90}
    index = spark.createDataFrame([(s, i, r.randrange(1, 9)) for s, n in sizes.items() for i in range(n)], "shard int, span long, token_count int")
    epochs = spark.range(3, 5).select(F.col("id").alias("epoch"))
    perm = epoch.permutation(index, 7, epochs).collect()
    order = epoch.shard_order(index, 7, epochs).orderBy("place").collect()
    made = epoch.interleaved(index, 7, epochs).orderBy("vt").collect()
    for e in (3, 4):
        shards = {s: [x["span"] for x in sorted((p for p in perm if p["epoch"] == e and p["shard"] == s), key=lambda p: p["pos"])] for s in sizes}
        assert all(sorted(v) == list(range(sizes[s])) for s, v in shards.items())
        assert [(m["shard"], m["span"]) for m in made if m["epoch"] == e] == drawn(shards, [o["shard"] for o in order if o["epoch"] == e])


def test_ranks_share_all_spans_and_resume_is_a_suffix(spark):
    r = random.Random(3)
    spans = spark.createDataFrame([(s, i, [r.randrange(1, 99) for _ in range(r.randrange(1, 60))]) for s in range(3) for i in range(40)], "shard int, span long, tokens array<int>").withColumn("token_count", F.size("tokens")).cache()
    epochs = spark.range(1).select(F.col("id").alias("epoch"))
    ordered = epoch.interleaved(spans.drop("tokens"), 1, epochs, 7)
    assert ordered.select("shard", "span").distinct().count() == ordered.count() == 120
    own = pack.segments(ordered, 3, 32, 4).cache()
    whole = {(x["rank"], x["step"], x["lane"]): x for x in batch.assemble(own, spans, -1).collect()}
    later = batch.assemble(pack.resumed(own, 3), spans, -1).collect()
    assert later and {(x["rank"], x["step"], x["lane"]): x for x in later} == {k: v for k, v in whole.items() if k[1] >= 3}
    totals = {x["rank"]: x["total_steps"] for x in pack.total_steps(own).collect()}
    assert totals == {k: max(s for q, s, _ in whole if q == k) + 1 for k in totals}
    tokens = {(x["shard"], x["span"]): x["tokens"] for x in spans.collect()}
    for x in own.collect():
        got = whole[x["rank"], x["step"], x["lane"]]
        assert got["tokens"][x["write_off"] : x["write_off"] + x["write_count"]] == tokens[x["shard"], x["span"]][x["read_off"] : x["read_off"] + x["write_count"]]
        assert len(got["tokens"]) == got["num_tokens"] and got["is_continuation"] == x["is_continuation"]
    for k, got in whole.items():
        covered = sum(x["write_count"] for x in own.where(f"rank = {k[0]} and step = {k[1]} and lane = {k[2]}").collect()) if k[1] == 0 else None
        assert covered is None or sum(t != -1 for t in got["tokens"]) == covered


def test_config_guards():
    with pytest.raises(ValueError):
        EpochConfig(local_rank=2, local_rank_count=2)
    assert EpochConfig() == EpochConfig(0, 0, 0, 1, -1, 4, 4096, 64, 0)
