"""Language ID by hierarchical discrimination.

A text's hashed letter trigrams (of its lower-cased UTF-8, all else one blank) are
weighed by the root of their counts, at unit length. One linear support vector
machine per family against the rest picks the language family; within it one per
pair of languages votes, ties going to the larger sum of margins. A language that
FAMILIES doesn't name is a family of its own.

The machines are fitted on a bounded sample of labelled rows: `sample` rows shared
evenly by all languages, but LEAST of a language at least, those of the least hash
of doc_id. Every language is learnt, however many there are. The rest of the corpus
is only scored.

A text that is null or has no letter is `und`, score 0, as is every text where
there are no rows to learn from. Rows with a null lang or doc_id teach nothing;
repeated rows each get a row. Columns beyond doc_id, text and lang are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import trimmed
from quern.shipping import ship

DIM = 4096
#: Rows that a language is learnt from, if it has them, however many languages share the sample.
LEAST = 30
UNKNOWN = "und"
FAMILIES = {
    **dict.fromkeys("en de nl sv da no nb nn is af fy lb yi".split(), "germanic"),
    **dict.fromkeys("fr es it pt ro ca gl oc la".split(), "romance"),
    **dict.fromkeys("ru uk be pl cs sk sl hr sr bs bg mk".split(), "slavic"),
    **dict.fromkeys("fi et".split(), "finnic"),
    **dict.fromkeys("hi ur bn mr gu pa ne".split(), "indic"),
}


def part(doc_id: Column, n: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod n is `rest`; a null doc_id is in no such part."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n == rest, F.lit(False))


def has_letter(text: str | None) -> bool:
    import re

    return any(m.group().isalpha() for m in re.finditer(r"[^\W\d_]", text or ""))


def features(texts: list[str | None]):
    """A row of DIM weights, of unit length or zero, for each text."""
    import numpy as np

    blank = np.arange(256, dtype=np.uint32)
    for b in range(128):
        if not chr(b).isalpha():
            blank[b] = 32
    out = np.zeros((len(texts), DIM), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        row = np.zeros(DIM, np.int64)
        # Whole texts, in pieces that overlap by two bytes, so memory doesn't follow the longest.
        data = (" " + text.lower() + " ").encode("utf-8", "surrogatepass")
        for a in range(0, len(data) - 2, 1 << 20):
            b = blank[np.frombuffer(data, np.uint8, min(len(data) - a, (1 << 20) + 2), a)]
            h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
            row += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=DIM)
        row = np.sqrt(row)
        out[i] = row / np.sqrt((row * row).sum())
    return out


def svm(x, y, c: float = 4.0, rounds: int = 20):
    """Weights of a linear SVM (squared hinge) by dual coordinate descent; y is +1 or -1, the last feature is constant."""
    import numpy as np

    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(x))
    square = np.einsum("ij,ij->i", x, x) + 0.5 / c
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * float(w @ x[i]) - 1 + alpha[i] * 0.5 / c
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


def fit(labelled: DataFrame, sample: int = 3000) -> dict:
    """A model of all languages, from rows of doc_id, text and lang, all of which may be learnt from."""
    import numpy as np

    known = labelled.where("lang is not null and text is not null and doc_id is not null")
    counted = known.groupBy("lang").agg(F.count("*").alias("_n")).orderBy("lang").collect()
    if not counted:
        return {"langs": [], "families": []}
    each = max(LEAST, sample // len(counted))
    # Few rows pass the hash filter, so that ranks are made of these only.
    counts = labelled.sparkSession.createDataFrame([(r["lang"], r["_n"]) for r in counted], "lang string, _n long")
    order = F.xxhash64("doc_id")
    thin = known.select("doc_id", "lang").join(F.broadcast(counts), "lang").where((F.pmod(order, F.lit(1 << 20)) * F.col("_n")) <= F.lit(4 * each * (1 << 20)))
    ranked = thin.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(order, "doc_id"))).where(F.col("_r") <= each)
    chosen = ranked.select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            texts, langs = batch.column(0), batch.column(1)
            for a in range(0, len(texts), 256):
                made = features(texts[a : a + 256].to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([langs[a : a + 256], pa.array([r.tobytes() for r in made], pa.binary())], names=["lang", "x"])

    rows = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "lang").mapInArrow(trimmed(run), "lang string, x binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    lang = np.array([r["lang"] for r in rows])
    x = np.ones((len(rows), DIM + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, :DIM] = np.frombuffer(r["x"], np.float16)
    del rows
    langs = sorted(set(lang.tolist()))
    family = {v: FAMILIES.get(v.split("-")[0].split("_")[0].lower(), v) for v in langs}
    families = sorted(set(family.values()))
    own = np.array([family[v] for v in lang])
    tops = [svm(x, np.where(own == f, 1.0, -1.0)) for f in families] if len(families) > 1 else [np.zeros(DIM + 1, np.float32)]
    pairs = [(a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if family[a] == family[b]]
    low = []
    for a, b in pairs:
        here = (lang == a) | (lang == b)
        low.append(svm(x[here], np.where(lang[here] == a, 1.0, -1.0)))
    return {"langs": langs, "families": families, "family": family, "pairs": pairs, "weights": np.stack([*tops, *low], axis=1).astype(np.float32)}


def predict(model: dict, texts: list[str | None]) -> list[tuple[str, str | None, float]]:
    """(language, family, score) of each text."""
    import numpy as np

    if not model["langs"]:
        return [(UNKNOWN, None, 0.0)] * len(texts)
    margins = features(texts) @ model["weights"][:-1] + model["weights"][-1]
    n = len(model["families"])
    inside = {f: [v for v in model["langs"] if model["family"][v] == f] for f in model["families"]}
    out = []
    for text, row in zip(texts, margins.tolist()):
        if not has_letter(text):
            out.append((UNKNOWN, None, 0.0))
            continue
        top = max(range(n), key=lambda k: row[k])
        family = model["families"][top]
        votes = {v: [0, 0.0] for v in inside[family]}
        for k, (a, b) in enumerate(model["pairs"], n):
            if a in votes:
                for v, m in ((a, row[k]), (b, -row[k])):
                    votes[v][0] += m >= 0 if v == a else m > 0
                    votes[v][1] += m
        best = max(votes, key=lambda v: votes[v])
        least = min([row[top] if n > 1 else 3.0, votes[best][1] / max(1, len(votes) - 1) if len(votes) > 1 else 3.0])
        out.append((best, family, float(1 / (1 + np.exp(-2 * least)))))
    return out


def annotate(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with lang_pred, family and score, instead of columns of those names."""
    docs = docs.drop("lang_pred", "family", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("family", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at), []
            for a in range(0, len(texts), 256):
                found += predict(model, texts[a : a + 256].to_pylist())
            extra = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "family", "score"])

    ship(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), schema)


def keep_known(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of `docs`, as they are, that have a letter, whether or not there was a language to learn; no score rejects any."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, known = batch.column(at), []
            for a in range(0, len(texts), 256):
                some = texts[a : a + 256].to_pylist()
                known += [f[0] != UNKNOWN for f in predict(model, some)] if model["langs"] else [has_letter(t) for t in some]
            yield batch.filter(pa.array(known, pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and family of each row; learns from the rows that aren't held out."""
    held = part(F.col("doc_id"), 4, 2)
    model = fit(docs.select("doc_id", "text", "lang").where(~held), sample)
    return annotate(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "family")
