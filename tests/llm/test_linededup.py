"""Line dedup against brute force over all repeated runs of lines."""

import random

from pyspark.sql.functions import lit as docs_lit

import corpus_pipeline
from quern.llm import linededup, queries
from quern.sources import read_table

SF = "/root/testdata/sf0.001"


def plain_runs(texts):
    """Texts of ascending ids without the lines of later copies of runs of two or more lines; runs of every length are looked at."""
    first, out = {}, []
    for at, text in enumerate(texts):
        lines = (text or "").split("\n")
        n = len(lines) - (lines[-1] == "")
        gone = set()
        for size in range(2, n + 1):
            for s in range(n - size + 1):
                run = tuple(lines[s : s + size])
                if any(c.isalnum() for line in run for c in line):
                    where, begin = first.setdefault(run, (at, s))
                    if (where, begin) != (at, s):
                        gone |= set(range(max(s, begin + size) if where == at else s, s + size))
        last = len(lines) - 1
        out.append((None if text is None else "".join(x + "\n" * (i < last) for i, x in enumerate(lines) if i not in gone), len(gone)))
    return out


def test_all_repeated_runs(spark):
    r = random.Random(9)
    # Few different lines: runs of all lengths, overlapping ones, and stretches without a letter.
    texts = ["\n".join(r.choice(["ab", "cd", "ef", "gh", "", "--", "=="] + [f"own {i} {k}" for k in range(4)]) for _ in range(r.randrange(1, 14))) + "\n" * r.randrange(2) for i in range(150)]
    texts += ["x\nx\nx\nx\nx", "p\nq\np\nq\np", "p\nq\np\nq\np\n", "one", "one", None, "", "\n\n\n", "f\n--\n==\n--\n\ng", "h\n--\n==\n--\n\ng", "f\n--\n==\n--\n!\nk"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: (x["text"], x["n_lines_removed"]) for x in linededup.drop_runs(docs).collect()}
    assert got == dict(enumerate(plain_runs(texts)))


def test_a_short_run_between_other_lines(spark):
    """Two shared lines go with their edges, whatever hashes the lines around them have."""
    texts = [f"before {i}\nshared one\nshared two\nbehind {i}" for i in range(20)]
    got = {x["doc_id"]: x["text"] for x in linededup.drop_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: texts[0], **{i: f"before {i}\nbehind {i}" for i in range(1, 20)}}


def test_long_stretches_stay_linear():
    text = "a\n" + "\n" * 20000 + "b"
    assert sum(len(key) for _, _, key in linededup.seeds(text)) < 100 * 41000


def test_query_and_stage(spark):
    docs = read_table(spark, SF, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").where("length(text) < 50000").collect())
    ids = {i for i, _ in rows}
    assert len(ids) == docs.count()
    want = dict(zip([i for i, _ in rows], plain_runs([t for _, t in rows])))
    assert {r["doc_id"]: r["n_lines_removed"] for r in queries.op5_line_dedup(spark, SF).collect()} == {i: n for i, (_, n) in want.items()}
    kept = corpus_pipeline.line_dedup(spark, docs, SF)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()} == {i: (t, len(t)) for i, (t, _) in want.items() if t}


def test_null_ids_and_repeated_rows(spark):
    """Rows without a doc_id are documents of their own text; repeated rows of one doc_id count as one document."""
    rows = [(None, "k\nl\nown 1", "x"), (None, "k\nl\nown 2", "y"), (5, "k\nl\nown 3", "x"), (6, "k\nl\nown 4", "x"), (5, "k\nl\nown 3", "z"), (None, None, "x"), (7, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, low string").withColumns({"n_lines_removed": docs_lit(0), "t1": docs_lit(1), "id": docs_lit(2)})
    got = sorted((str(r["doc_id"]), str(r["text"]), r["low"], r["n_lines_removed"]) for r in linededup.drop_runs(docs).collect())
    assert got == sorted([("None", "own 1", "x", 2), ("None", "own 2", "y", 2), ("5", "k\nl\nown 3", "x", 0), ("6", "own 4", "x", 2), ("5", "k\nl\nown 3", "z", 0), ("None", "None", "x", 0), ("7", "", "x", 0)])
    assert linededup.drop_runs(docs.where("false")).count() == 0


def test_different_bytes_of_one_hash_stay(spark, monkeypatch):
    lists = spark.createDataFrame([(0, [(1, 2, True)]), (1, [(1, 2, False)])], "i long, r array<struct<low:long,high:long,first:boolean>>")
    docs = spark.createDataFrame([(0, "a\nb"), (1, "c\nd")], "doc_id long, text string")
    keyed = docs.join(lists, docs["doc_id"] == lists["i"]).select("i", *linededup.text_key(docs["text"]), "r").toDF("__quern_id", "__quern_t1", "__quern_t2", "__quern_repeats")

    monkeypatch.setattr(linededup, "name", lambda key: (1, 2))
    assert [tuple(r) for r in linededup.unequal(docs, keyed, linededup.seed_keys).collect()] == [(1, 2)]
    assert {r["text"] for r in linededup.drop_runs(docs).collect()} == {"a\nb", "c\nd"}


def test_chunks_go_first(spark, monkeypatch):
    """The stage's copies are found by content-defined chunks; seeds name only what these leave open, and no line of a run is lost."""
    r = random.Random(31)
    block = [f"shared line {i} {r.random()}" for i in range(60)]
    texts = ["\n".join([f"own {i} {k}" for k in range(i % 5)] + block[i : 60 - i] + [f"end {i}"]) + "\n" * (i % 2) for i in range(12)]
    texts += ["\n".join(["ab", "cd"] * 20), "x\nx\nx\nx\nx\nx\nx\nx\n", "x\n", "x\n\n", "x\n\n\n", None, ""]
    calls, whole = [], linededup.repeated

    def watched(docs, keys=linededup.chunk_keys, settled=None):
        lists = whole(docs, keys, settled)
        calls.append((keys, settled is not None, linededup.places(docs, keys, settled).agg({"copies": "sum"}).first()[0], lists))
        return lists

    monkeypatch.setattr(linededup, "repeated", watched)
    docs = spark.createDataFrame([(i, t, None, "own", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["text"] for x in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {i: t for i, (t, _) in enumerate(plain_runs(texts)) if t}
    assert [c[:2] for c in calls] == [(linededup.passage_keys, False), (linededup.seed_keys, True)]
    # Which chunks repeat, by a plain count.
    own = {i: [tuple(c.rstrip("\n").split("\n")) for c, n in linededup.chunks(t or "") if n > 1 and len(c.rstrip("\n").split("\n")) > 1 and any(map(str.isalnum, c))] for i, t in enumerate(texts[:12])}
    count = [c for chunks in own.values() for c in chunks]
    lists = {x["__quern_id"]: len(x["__quern_repeats"]) for x in calls[0][3].where("__quern_id < 12").collect()}
    assert lists == {i: n for i, chunks in own.items() if (n := len({c for c in chunks if count.count(c) > 1}))} and sum(lists.values()) > 50
    assert calls[1][2] < 0.6 * sum(len(linededup.seeds(t)) for t in texts if t)
