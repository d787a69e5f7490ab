"""Writing, verifying, loading, listings and the holdout split."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from quern.api import CorpusConfig, CorpusLoader, CorpusWriter, EpochConfig, verify_corpus
from quern.operators import metrics, split, store
from quern.sources import listing, read_table
from quern.streaming import ingest


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").union(spark.createDataFrame([(900, None), (901, ""), (902, " ")], "doc_id long, text string"))
    rejected = CorpusWriter(path, CorpusConfig(holdout_rate=10, num_shards=3)).write(docs).first()
    assert (rejected["n_null"], rejected["n_empty"]) == (1, 1)
    return path


def test_write_then_verify_is_clean(spark, corpus):
    assert verify_corpus(spark, corpus).isEmpty() and verify_corpus(spark, corpus, "holdout").isEmpty()
    train, held = (store.read_spans(spark, corpus, s) for s in store.SPLITS)
    assert train.count() + held.count() == 201 and held.count() > 0
    args = json.loads(store.get_text(spark, f"{corpus}/args.json"))
    assert args["n_vocab"] == 256 and args["num_shards"] == 3
    found = store.read_manifest(store.get_text(spark, f"{corpus}/train.json"), 1)
    assert found["total_tokens"] == train.agg(F.sum("token_count")).first()[0] and len(found["data_files"]) == 3


def test_loader_reads_all(spark, corpus):
    loader = CorpusLoader(spark, corpus)
    config = EpochConfig(1, 2, micro_batch_size=4, context_size=512, min_data_length=0)
    loader.begin_epoch(config)
    seen, steps, first = 0, [], {}
    while True:
        rows, continued, step, total = loader.get_micro_batch()
        if rows is None:
            break
        assert len({len(r) for r in rows}) == 1 and len(rows) == len(continued) <= 4
        seen += sum(t != -1 for r in rows for t in r)
        steps.append(step)
        first[step] = rows
    total = loader.total_steps
    assert steps == list(range(total)) and loader.get_micro_batch()[0] is None
    assert seen == store.read_spans(spark, corpus).agg(F.sum("token_count")).first()[0]
    loader.begin_epoch(EpochConfig(1, 2, micro_batch_size=4, context_size=512, min_data_length=0, start_step=total - 2))
    assert loader.get_micro_batch()[0] == first[total - 2]
    loader.destroy()


@pytest.fixture(scope="module")
def rotated(spark, tmp_path_factory):
    """A corpus of many small files."""
    tmp_path = tmp_path_factory.mktemp("rotated")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") * 37 % 91 + 1).cast("int")).alias("text"))
    CorpusWriter(str(tmp_path), CorpusConfig(byte_tokens=True, holdout_rate=20, num_shards=3, rotate_bytes=4000)).write(docs)
    return str(tmp_path), docs


def test_writers_rotate(spark, rotated):
    path, docs = rotated
    spans = [store.read_spans(spark, path, s).toPandas() for s in store.SPLITS]
    assert sorted(i for s in spans for i in s.doc_id) == list(range(3000))
    for name, frame in zip(store.SPLITS, spans):
        assert verify_corpus(spark, path, name).isEmpty()
        frame = frame.sort_values(["shard", "span"])
        sizes = frame.groupby("shard").cbytes.agg(["sum", "last", "count"])
        assert list(sizes.index) == list(range(len(sizes))) and len(sizes) > 3
        # A file ends with the write that reaches the cap; a writer's last one may be short.
        assert (sizes["sum"] - sizes["last"] < 4000).all() and (sizes["sum"] < 4000).sum() <= 3
        index = store.read_index(spark, path, name).toPandas().sort_values(["shard", "span"])
        assert (index.offset.values == (frame.groupby("shard").cbytes.cumsum() - frame.cbytes).values).all()
        assert len(store.read_manifest(store.get_text(spark, f"{path}/{name}.json"))["data_files"]) == len(sizes)
    loader = CorpusLoader(spark, path)
    batches = loader.begin_epoch(EpochConfig(1, 2, micro_batch_size=2, context_size=256, min_data_length=0))
    assert batches.select(F.sum(F.size(F.filter("tokens", lambda t: t != -1)))).first()[0] == spans[0].token_count.sum()
    loader.destroy()


def held(table):
    """A table's rows, apart from its files."""
    return table.sparkSession.createDataFrame(table.collect(), table.schema)


@pytest.mark.parametrize(("change", "rules"), [("offset", {"V4", "V5", "size"}), ("token_count", {"V5"}), ("lost record", {"V5", "size"}), ("tokens", {"V6"}), ("longer", {"V3", "V6", "size"}), ("footer", {"V1", "V2", "V3", "V5", "V6", "count", "size"})])
def test_damage_to_what_is_stored(spark, rotated, tmp_path, change, rules):
    path = str(tmp_path / "corpus")
    shutil.copytree(rotated[0], path)
    here = (F.col("split") == "train") & (F.col("shard") == 1) & (F.col("span") == 5)
    table, new = {
        "offset": ("index", lambda t: t.withColumn("offset", F.when(here, F.lit(3).cast("long")).otherwise(F.col("offset")))),
        "token_count": ("index", lambda t: t.withColumn("token_count", F.when(here, F.lit(3)).otherwise(F.col("token_count")))),
        "lost record": ("index", lambda t: t.where(~here)),
        "tokens": ("spans", lambda t: t.withColumn("tokens", F.when(here, F.transform("tokens", lambda x: x + 1)).otherwise(F.col("tokens")))),
        "longer": ("spans", lambda t: t.withColumn("tokens", F.when(here, F.concat("tokens", "tokens")).otherwise(F.col("tokens")))),
        "footer": ("footers/train", lambda t: t.where("shard <> 1")),
    }[change]
    frame = new(held(spark.read.parquet(f"{path}/{table}")))
    writer = frame.write.mode("overwrite")
    (writer if change == "footer" else writer.partitionBy("split", "shard")).parquet(f"{path}/{table}")
    found = {(r["shard"], r["rule"]) for r in verify_corpus(spark, path).collect()}
    assert {s for s, _ in found} == {1} and {r for _, r in found} <= rules and found, found
    assert len({r for _, r in found} & rules) >= len(rules) - 1


def test_manifest_errors():
    good = store.manifest([], 4)
    assert store.read_manifest(json.dumps(good), 4)["data_files"] == []
    for bad in ({"version": 13}, {"token_bytes": 2}, {"data_files": ["a"]}, {"index_files": None}):
        with pytest.raises(ValueError):
            store.read_manifest(json.dumps(good | bad), 4)


def test_holdout_is_greedy(spark):
    import random

    r = random.Random(1)
    sizes = [r.randrange(1, 400) for _ in range(700)]
    got = {x["doc_id"]: x["held_out"] for x in split.holdout(spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n long"), 2.5).collect()}
    seen = held = 0
    for i, n in enumerate(sizes):
        seen += n
        out = held < int(seen * 0.025)
        held += n * out
        assert got[i] == out


def test_listings(spark, tmp_path):
    hosts = tmp_path / "hosts"
    hosts.write_text("# machines\n\nalpha 2\n  beta   3\n#gamma 4\ndelta 1\n")
    made = listing.rank_starts(listing.read_hosts(spark, str(hosts))).orderBy("ord").collect()
    assert [(r["hostname"], r["rank_start"], r["world"]) for r in made] == [("alpha", 0, 6), ("beta", 2, 6), ("delta", 5, 6)]
    bodies = spark.createDataFrame([(200, '{"siblings": [{"rfilename": "data/a"}, {"rfilename": "b"}]}'), (500, '{"siblings": [{"rfilename": "data/c"}]}')], "status int, body string")
    assert [r["file"] for r in listing.files_of_listing(bodies, status="status").collect()] == ["data/a"]
    assert [r["bytes"] for r in listing.list_folder(spark, str(tmp_path)).collect()] == [hosts.stat().st_size]
    assert listing.read_whole(spark, str(hosts)).first()["content"] == hosts.read_bytes()
    numbered = listing.with_ordinal(spark.range(1000).selectExpr("id * 7 % 1000 as x"), "x").collect()
    assert all(r["x"] == r["ord"] for r in numbered)
    assert {r[0] for r in spark.range(10).select(listing.contiguous(F.col("id"), 10, 4)).collect()} == {0, 1, 2, 3}


def test_checkpoints(spark):
    made = spark.createDataFrame([(f"step_{s}.pth", 0, s, 5.0) for s in (200, 1000, 1100)], "name string, epoch int, step int, loss double")
    assert metrics.to_delete(made, 2).first()["name"] == "step_1000.pth"
    assert metrics.to_delete(made, 2, by_name=False).first()["name"] == "step_200.pth"
    assert metrics.to_delete(made, 3).isEmpty()
    state = metrics.resume_state(made)
    assert state.first()["start_step"] == 1101 and metrics.next_epoch(state).first()["start_step"] == 0
    assert metrics.resume_state(made.where("false")).isEmpty()


def test_streaming_ingest_is_the_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    docs.repartition(6).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest(spark, source, target, str(tmp_path / "check"), 2).awaitTermination()
    got = spark.read.parquet(target).drop("shard")
    want = ingest.tokenized(docs)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_live_registry(spark, tmp_path):
    events = read_table(spark, "/root/testdata/sf0.001", "events").select("event_id", "ts", "user_id", "event_type")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    ingest.live_registry(stream, "user_id", ["ts", "event_id"], "live", str(tmp_path / "check"), "event_id", "event_type").awaitTermination()
    from quern.operators.average import registry

    want = registry(events, "user_id", ["ts", "event_id"], "event_id", "event_type")
    assert spark.table("live").exceptAll(want).isEmpty() and spark.table("live").count() == want.count()
