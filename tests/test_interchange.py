"""The binary format: a round trip, and every rule fires on its own damage."""

import random
import struct

import pytest

from quern.functions import codec
from quern.operators import interchange


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(6)
    spans = [(s, i, [r.randrange(1, 128_000) for _ in range(r.randrange(1, 200))]) for s in range(3) for i in range(20)]
    made = interchange.export_shards(spark.createDataFrame(spans, "shard int, span long, tokens array<long>"), str(tmp_path))
    assert made["total_tokens"] == sum(len(t) for *_, t in spans) and len(made["data_files"]) == 3
    return str(tmp_path), spans


def test_round_trip(spark, folder):
    path, spans = folder
    got = interchange.import_shards(spark, path).collect()
    assert sorted((r["shard"], r["span"], r["tokens"]) for r in got) == spans
    assert all(r["token_count"] == len(r["tokens"]) for r in got)
    assert interchange.verify_shards(spark, path).isEmpty()


def damage(path, name, at, new):
    with open(f"{path}/{name}", "r+b") as f:
        f.seek(at, 2 if at < 0 else 0)
        f.write(new)


@pytest.mark.parametrize(
    ("name", "at", "new", "rule"),
    [
        ("index_1.bin", -10, b"\x0d", "V2"),
        ("data_1.bin", -9, b"\x02", "V2"),
        ("index_1.bin", -14, b"\x01\x00\x00\x00", "V3"),
        ("index_1.bin", 8, struct.pack("<I", 0), "V4"),
        ("index_1.bin", 4, b"\xff", "V5"),
        ("data_1.bin", 30, b"\xff\xfe\xfd", "V6"),
    ],
)
def test_damage_is_found(spark, folder, name, at, new, rule):
    path, _ = folder
    damage(path, name, at, new)
    found = {(r["shard"], r["rule"]) for r in interchange.verify_shards(spark, path).collect()}
    assert (1, rule) in found and {s for s, _ in found} == {1}


def test_manifest(spark, tmp_path):
    assert interchange.export_shards(spark.createDataFrame([], "shard int, span long, tokens array<long>"), str(tmp_path))["data_files"] == []
    assert interchange.verify_shards(spark, str(tmp_path)).isEmpty()
    (tmp_path / "index.yaml").write_text("version: 13\ndata_files: []\nindex_files: []\n")
    with pytest.raises(ValueError, match="version"):
        interchange.verify_shards(spark, str(tmp_path))
    (tmp_path / "index.yaml").write_text("version: 14\ndata_files:\n- a\nindex_files: []\n")
    with pytest.raises(ValueError, match="one length"):
        interchange.read_index_yaml(str(tmp_path))


def test_equal_records_cancel_in_a_xor():
    """Why verification counts spans as well."""
    frame = codec.compress(b"abcd" * 5)
    assert codec.city64(frame) ^ codec.city64(frame) == 0 and interchange.signed_city(b"") == codec.signed(0x9AE16A3B2F90404F)
