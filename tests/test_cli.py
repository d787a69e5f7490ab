"""The command line, end to end."""

import json

from quern.__main__ import main
from quern.operators import interchange, store


def test_write_verify_plan_export(spark, tmp_path, capsys):
    source, corpus, binary = (str(tmp_path / n) for n in ("in", "corpus", "bin"))
    spark.createDataFrame([(f"text number {i} " * (i % 7), i) for i in range(60)], "text string, other int").repartition(3).write.parquet(source)
    assert main(["write", "--input", source, "--output", corpus, "--byte-tokens", "--holdout-rate", "10", "--shards", "2"], spark) == 0
    assert json.loads(capsys.readouterr().out)["n_empty"] == 9
    assert main(["verify", "--corpus", corpus], spark) == 0 and json.loads(capsys.readouterr().out)["ok"]
    assert main(["plan", "--corpus", corpus, "--ranks", "2", "--context", "64", "--min-data-length", "4"], spark) == 0
    steps = json.loads(capsys.readouterr().out)
    assert [s["rank"] for s in steps] == [0, 1] and all(s["total_steps"] > 0 for s in steps)
    assert main(["export", "--corpus", corpus, "--output", binary], spark) == 0
    assert interchange.verify_shards(spark, binary).isEmpty()
    want = sorted((r["shard"], r["span"], list(r["tokens"])) for r in store.read_spans(spark, corpus).collect())
    assert sorted((r["shard"], r["span"], list(r["tokens"])) for r in interchange.import_shards(spark, binary).collect()) == want


def test_damage_and_arguments(spark, tmp_path, capsys):
    source, corpus = str(tmp_path / "in"), str(tmp_path / "corpus")
    spark.createDataFrame([(i, "words and more " * 5) for i in range(20)], "doc_id long, text string").write.parquet(source)
    main(["write", "--input", source, "--output", corpus, "--byte-tokens", "--just-args"], spark)
    assert json.loads(store.get_text(spark, f"{corpus}/args.json"))["padded_vocab"] == 384
    main(["write", "--input", source, "--output", corpus, "--byte-tokens", "--world-size", "2", "--rank-start", "0"], spark)
    claimed = spark.read.parquet(f"{corpus}/footers/train").toPandas()
    claimed["data_hash"] ^= 1
    spark.createDataFrame(claimed).write.mode("overwrite").parquet(f"{corpus}/footers/train")
    capsys.readouterr()
    assert main(["verify", "--corpus", corpus], spark) == 1
    assert {v["rule"] for v in json.loads(capsys.readouterr().out)["violations"]} == {"V6"}
