"""Quality scores by Bradley-Terry ranking.

A document's strength is linear in features of its text; the chance that a is
preferred to b is the logistic of their strengths' difference. Preference pairs
are drawn from labelled rows, one of label 1 over one of label 0, and the weights
minimise the logistic loss of the pairs' feature differences. The threshold is the
quantile of the training rows' strengths below which lies the share of rows with
label 0; a score is the logistic of what a strength exceeds it by.

Fitted on a bounded sample: at most `sample` labelled rows, those of the least
hash of doc_id, and `pairs` pairs of them. Everything else is scored only.

Null and empty texts have the features of an empty text and a score as any other.
Without rows of both labels every score is 0.5. A doc_id with several labels has
the highest; rows with a null doc_id or label teach nothing. Repeated rows each
get a row. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.langid import part
from quern.shipping import ship

CLASSES = 16


def byte_classes() -> bytes:
    """A class, 0 to 15, of each byte of UTF-8."""
    out = bytearray(256)
    for b in range(256):
        c = chr(b)
        if b >= 128 or "a" <= c <= "z":
            k = 0
        elif "A" <= c <= "Z":
            k = 1
        elif c.isdigit():
            k = 2
        else:
            k = {" ": 3, "\n": 4, ".": 5, ",": 6, "!": 7, "?": 7, "|": 8, "#": 9, "$": 9, "%": 9, "&": 9, "*": 9, "(": 10, ")": 10, "[": 10, "]": 10, "{": 10, "}": 10, "-": 11, "_": 11, "'": 12, '"': 12, ":": 13, ";": 13, "/": 14, "=": 14, "<": 14, ">": 14, "@": 14}.get(c, 15)
        out[b] = k
    return bytes(out)


def features(texts: list[str | None]):
    """A row for each text: shares of class bigrams of all its bytes, and statistics of all its words and lines."""
    import operator

    import numpy as np

    table = byte_classes()
    out = np.zeros((len(texts), CLASSES * CLASSES + 12), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass").translate(table)
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for a in range(0, len(data) - 1, 1 << 20):
            k = np.frombuffer(data, np.uint8, min(len(data) - a, (1 << 20) + 1), a).astype(np.int64)
            counts += np.bincount(k[:-1] * CLASSES + k[1:], minlength=CLASSES * CLASSES)
        out[i, : CLASSES * CLASSES] = np.sqrt(counts / max(1, len(data) - 1))
        words = text.split()
        lines = text.split("\n")
        n, m = len(words), len(lines)
        different = len(set(words))
        twice = sum(map(operator.eq, words, words[1:]))
        lengths = sorted(map(len, lines))
        out[i, CLASSES * CLASSES :] = (
            np.log1p(n), np.log1p(m), len(text) / max(1, n) / 10, different / np.sqrt(max(1, n)) / 10, twice / max(1, n), len(set(lines)) / m,
            np.log1p(n / m), np.log1p(lengths[-1]), np.log1p(lengths[m // 2]), sum(map(str.isupper, words)) / max(1, n), sum(map(str.isalpha, words)) / max(1, n), 1.0,
        )
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, pairs: int = 30000) -> dict:
    """A model from the rows of `docs` that `labels` (doc_id and `label`) names, all of which may be learnt from."""
    import numpy as np

    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                made = features(batch.column(0)[a : a + 256].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(1)[a : a + 256], pa.array([r.tobytes() for r in made], pa.binary())], names=["y", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "_y").mapInArrow(run, "y int, x binary").collect()
    rows.sort(key=lambda r: (r["y"], bytes(r["x"])))
    y = np.array([r["y"] for r in rows], int)
    if not (0 < y.sum() < len(y)):
        return {}
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-2
    z = (x - mean) / scale
    rng = np.random.default_rng(11)
    better, worse = rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)
    w = np.zeros(z.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 401):
        batch = rng.integers(0, pairs, 2048)
        d = z[better[batch]] - z[worse[batch]]
        gradient = -(d * (1 / (1 + np.exp(np.clip(d @ w, -30, 30))))[:, None]).mean(axis=0) + 1e-3 * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w -= 0.03 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    strength = z @ w
    return {"mean": mean, "scale": scale, "w": w, "at": float(np.quantile(strength, float((y == 0).mean())))}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 256):
                texts = batch.column(1)[a : a + 256].to_pylist()
                if model:
                    strength = ((features(texts) - model["mean"]) / model["scale"]) @ model["w"] - model["at"]
                    found += (1 / (1 + np.exp(-np.clip(strength, -500, 500)))).tolist()
                else:
                    found += [0.5] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def rank(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; learns from labels of the rows that aren't held out."""
    held = part(F.col("doc_id"), 3, 1)
    scored = score(docs, fit(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
