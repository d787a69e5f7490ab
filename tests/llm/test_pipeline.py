"""The pipeline's stages, each against a plain version of its decision."""

import random
import re

import pytest

import corpus_pipeline
from quern.sources import read_table
from tests.llm.test_linededup import plain_runs
from tests.llm.test_neardup import check

SF = "/root/testdata/sf0.001"
rng = random.Random(12)
WORDS = [f"{a}{b}" for a in ("ban", "ker", "lom", "tis", "vor") for b in ("a", "el", "ing", "o", "um", "ys")]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "r", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents of each stage: its input and its output, as rows."""
    base = read_table(spark, SF, "documents")
    long = prose(600)
    words = long.split()
    near = " ".join([*words[:300], "changed", *words[301:]])
    bench = read_table(spark, SF, "benchmark").first()["text"]
    block = "\n".join(prose(12) for _ in range(30))
    own = [(None, 5000), ("", 5001), ("12 34 !!", 5002), (long, 5003), (near, 5004), (long, 5005), (prose(50) + " " + bench + " " + prose(50), 5006), (prose(80) + "\n" + block, 5007), (prose(81) + "\n" + block, 5008), (prose(300), 5009), (prose(300), 5010)]
    rows = spark.createDataFrame([(i, t, None, "own", len(t or "")) for t, i in own], base.schema)
    docs = base.unionByName(rows)
    folder = tmp_path_factory.mktemp("stages")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], SF)
        made.write.parquet(f"{folder}/{name}")
        out.append(spark.read.parquet(f"{folder}/{name}"))
    return out


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontaminate", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert corpus_pipeline.ORACLE_SQL is None


def test_language(stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    assert set(after) == {i for i, r in before.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert all(after[i] == before[i] for i in after)


def test_lines(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    ids = sorted(before)
    want = {i: t for i, (t, _) in zip(ids, plain_runs([before[i]["text"] for i in ids])) if t}
    assert {i: r["text"] for i, r in after.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert len(after[5008]["text"]) < len(after[5007]["text"]) / 2


def test_near_duplicates(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    check({i: r["text"] for i, r in before.items()}, {i: r["text"] for i, r in after.items()}, 0.9, 0.85)
    # 5003 and 5005 have one text, 5004 one word more.
    assert len({5003, 5004} & set(after)) == 1 and 5005 not in after and {5009, 5010} <= set(after)
    assert all(after[i] == before[i] for i in after)


def test_benchmark(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def windows(text):
        w = word.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
        return {tuple(w[i : i + 10]) for i in range(len(w) - 9)}

    items = set().union(*(windows(r["text"]) for r in read_table(stages[0].sparkSession, SF, "benchmark").collect()))
    assert set(after) == {i for i, r in before.items() if not windows(r["text"]) & items}
    assert 5006 in before and 5006 not in after and 5009 in after


def test_packing(stages):
    from tokenizers import Tokenizer

    from quern.llm.queries import public_byte_bpe

    tok = Tokenizer.from_file(public_byte_bpe()[0])
    docs, pieces = by_id(stages[4]), stages[5].collect()
    sizes = {}
    for p in pieces:
        sizes[p["doc_id"]] = sizes.get(p["doc_id"], 0) + p["length"]
    assert sizes == {i: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in docs.items()}


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5].columns and 0 < got.count() <= stages[5].count()


def test_empty(spark):
    docs = read_table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
