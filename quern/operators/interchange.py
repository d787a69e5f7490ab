"""The binary shard format, for exchange with other loaders: export, import as a data source, verification.

    index_N.bin   (offset u32, token_count u32) per span, then bytes u32, version u8, token_bytes u8, hash u64
    data_N.bin    a frame (zstd of byte planes) per span, then version u8, token_bytes u8, hash u64
    index.yaml    version, token_bytes, total_tokens, data_files, index_files

Little-endian. A hash is the XOR of CityHash64 over all records and over what of
the footer precedes it. Files lie in a folder that all executors mount. A shard is
written to a temporary name by one task and renamed when whole, so a task that is
run again leaves no part of a file behind.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.config import FORMAT_VERSION
from quern.functions.codec import city64, city64_rows, compress, decompress, signed
from quern.operators.folds import ordered_fold

SPANS = "shard int, span long, token_count int, tokens array<long>"
INDEX_END, DATA_END = 14, 10


#: Bytes whose hashes are taken at once.
HASHED = 8 << 20


def xor_of(values: list[bytes]) -> int:
    """The XOR of their hashes; empties the list."""
    import numpy as np

    found = int(np.bitwise_xor.reduce(city64_rows(values).view(np.uint64))) if values else 0
    values.clear()
    return found


def packed(tokens: list[int], width: int) -> bytes:
    """Tokens as little-endian words of `width` bytes."""
    import numpy as np

    words = np.array(tokens, "<u8")
    if len(words) and int(words.max()) >> (8 * min(width, 8)) and width < 8:
        raise ValueError(f"a token doesn't fit {width} bytes")
    return words.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes, width: int) -> list[int]:
    """The tokens of such words; of wider ones the first four bytes."""
    import numpy as np

    words = np.zeros((len(raw) // width, 4), np.uint8)
    words[:, : min(width, 4)] = np.frombuffer(raw, np.uint8).reshape(-1, width)[:, :4]
    return words.view("<u4").ravel().tolist()


def export_shards(spans: DataFrame, path: str, token_bytes: int = 4) -> dict:
    """Write spans (shard, span, tokens) as binary shards; returns the manifest.

    A shard is streamed by one task, span by span. Shards beyond 4 GB don't fit the
    format's offsets and are an error: make more of them.
    """
    os.makedirs(path, exist_ok=True)

    def fold(key: tuple, rows: Iterator[tuple]):
        shard = key[0]
        mark = f".{uuid.uuid4().hex}"
        names = [os.path.join(path, f"{kind}_{shard}.bin") for kind in ("data", "index")]
        offset = spans_seen = tokens_seen = data_hash = index_hash = held = 0
        records_held: list[bytes] = []
        frames_held: list[bytes] = []
        with open(names[0] + mark, "wb") as data, open(names[1] + mark, "wb") as index:
            for _, _, tokens in rows:
                if not tokens:
                    raise ValueError("a span without tokens")
                frame = compress(packed(tokens, token_bytes), token_bytes)
                record = struct.pack("<II", offset, len(tokens))
                index.write(record)
                data.write(frame)
                records_held.append(record)
                frames_held.append(frame)
                held += len(frame)
                if held > HASHED:
                    index_hash, data_hash, held = index_hash ^ xor_of(records_held), data_hash ^ xor_of(frames_held), 0
                offset += len(frame)
                if offset >= 1 << 32:
                    raise ValueError(f"shard {shard} is too large for the format")
                spans_seen, tokens_seen = spans_seen + 1, tokens_seen + len(tokens)
            index_hash, data_hash = index_hash ^ xor_of(records_held), data_hash ^ xor_of(frames_held)
            head = struct.pack("<IBB", offset, FORMAT_VERSION, token_bytes)
            index.write(head + struct.pack("<Q", index_hash ^ city64(head)))
            head = struct.pack("<BB", FORMAT_VERSION, token_bytes)
            data.write(head + struct.pack("<Q", data_hash ^ city64(head)))
        for name in names:
            os.replace(name + mark, name)
        yield shard, spans_seen, tokens_seen, offset

    narrow = spans.select(F.col("shard").cast("int"), F.col("span").cast("long"), F.col("tokens").cast("array<long>"))
    made = ordered_fold(narrow, ["shard"], ["span"], fold, "shard int, n_spans long, n_tokens long, data_bytes long")
    shards = sorted(made.collect())
    found = {"version": FORMAT_VERSION, "token_bytes": token_bytes, "total_tokens": sum(s["n_tokens"] for s in shards)}
    found |= {f"{kind}_files": [f"{kind}_{s['shard']}.bin" for s in shards] for kind in ("data", "index")}
    with open(os.path.join(path, "index.yaml"), "w") as out:
        out.write(to_yaml(found))
    return found


def to_yaml(found: dict) -> str:
    lines = []
    for key, value in found.items():
        if isinstance(value, list):
            lines += [f"{key}:", *[f"- {v}" for v in value]] if value else [f"{key}: []"]
        else:
            lines.append(f"{key}: {value}")
    return "\n".join(lines) + "\n"


def from_yaml(text: str) -> dict:
    """A manifest's YAML: scalars and lists of scalars."""
    found: dict = {}
    key = None
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key:
            found[key] = [*(found[key] or []), line.lstrip()[2:].strip()]
            continue
        key, _, value = line.partition(":")
        value = value.strip()
        found[key] = [] if value == "[]" else None if not value else int(value) if value.lstrip("-").isdigit() else value
    return found


def read_index_yaml(path: str) -> dict:
    with open(os.path.join(path, "index.yaml")) as source:
        found = from_yaml(source.read())
    data, index = found.get("data_files"), found.get("index_files")
    if found.get("version") != FORMAT_VERSION:
        raise ValueError(f"version {found.get('version')} where {FORMAT_VERSION} was expected")
    if not isinstance(data, list) or not isinstance(index, list) or len(data) != len(index):
        raise ValueError("data_files and index_files must be lists of one length")
    return found


def records(index: bytes) -> list[tuple[int, int, int]]:
    """(offset, size, token_count) of each span; the last one's size comes from the footer."""
    end = struct.unpack_from("<I", index, len(index) - INDEX_END)[0]
    found = list(struct.iter_unpack("<II", index[:-INDEX_END]))
    return [(at, (found[i + 1][0] if i + 1 < len(found) else end) - at, n) for i, (at, n) in enumerate(found)]


class ShardPartition(InputPartition):
    def __init__(self, shard: int, data: str, index: str) -> None:
        self.shard, self.data, self.index = shard, data, index


class ShardReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.manifest = read_index_yaml(path)

    def partitions(self) -> list[InputPartition]:
        return [ShardPartition(i, *pair) for i, pair in enumerate(zip(self.manifest["data_files"], self.manifest["index_files"]))]

    def read(self, partition: ShardPartition) -> Iterator[tuple]:
        width = self.manifest["token_bytes"]
        with open(os.path.join(self.path, partition.index), "rb") as source:
            spans = records(source.read())
        with open(os.path.join(self.path, partition.data), "rb") as source:
            for span, (at, size, count) in enumerate(spans):
                source.seek(at)
                raw = decompress(source.read(size), count * width, width)
                yield partition.shard, span, count, unpacked(raw, width)


class ShardSource(DataSource):
    """spark.read.format("quern_shards").load(folder); a partition per shard."""

    @classmethod
    def name(cls) -> str:
        return "quern_shards"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options["path"])


def import_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of SPANS of a folder of binary shards."""
    spark.dataSource.register(ShardSource)
    return spark.read.format("quern_shards").load(path)


def verify_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, rule) of every rule that fails, shards in parallel. A manifest that can't be read is an error.

    V2: versions and widths; V3: bytes; V4: offsets rise; V5, V6: hashes of index and data.
    """
    found = read_index_yaml(path)
    rows = list(enumerate(zip(found["data_files"], found["index_files"])))
    if not rows:
        return spark.createDataFrame([], "shard int, rule string")
    shards = spark.createDataFrame([(i, d, x) for i, (d, x) in rows], "shard int, data string, index string")
    width = found["token_bytes"]

    def fold(key: tuple, group: Iterator[tuple]):
        for shard, data_name, index_name in group:
            with open(os.path.join(path, index_name), "rb") as source:
                index = source.read()
            size = os.path.getsize(os.path.join(path, data_name))
            if len(index) < INDEX_END or (len(index) - INDEX_END) % 8 or size < DATA_END:
                yield shard, "V3"
                continue
            end, version, wide = struct.unpack_from("<IBB", index, len(index) - INDEX_END)
            rules = set()
            if end + DATA_END != size:
                rules.add("V3")
            spans = records(index)
            if any(n <= 0 for _, n, _ in spans):
                rules.add("V4")
            total = city64(index[-INDEX_END:-8]) ^ xor_of([index[at : at + 8] for at in range(0, len(index) - INDEX_END, 8)])
            if total != struct.unpack("<Q", index[-8:])[0]:
                rules.add("V5")
            with open(os.path.join(path, data_name), "rb") as source:
                total, held = 0, []
                for at, n, _ in spans:
                    source.seek(at)
                    held.append(source.read(max(0, n)))
                    if sum(map(len, held[-1:])) > HASHED or len(held) >= 1024:
                        total ^= xor_of(held)
                total ^= xor_of(held)
                source.seek(size - DATA_END)
                foot = source.read(DATA_END)
            if total ^ city64(foot[:2]) != struct.unpack("<Q", foot[2:])[0]:
                rules.add("V6")
            if (version, wide) != (FORMAT_VERSION, width) or (foot[0], foot[1]) != (FORMAT_VERSION, width):
                rules.add("V2")
            yield from ((shard, r) for r in sorted(rules))

    return ordered_fold(shards, ["shard"], ["data"], fold, "shard int, rule string")


def signed_city(value: bytes) -> int:
    """CityHash64 as a BIGINT holds it."""
    return signed(city64(value))
