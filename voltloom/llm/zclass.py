"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed in pieces of PIECE bytes with either dictionary; all pieces count, so the dictionary's
effect does not fade with length. With g and b the summed compressed sizes, its measure is the normalised
compressed-size difference (b - g) / (b + g): above 0, the text is more like good text. A logistic curve,
fitted to the measures of labelled texts that no dictionary was trained on, makes it the probability of quality where
good and bad texts are equally many. Below even odds (LIMIT = 0.5) a text is rejected.

Training reads at most TRAIN_DOCS different labelled texts of each class, those of LEAST_CHARS to TRAIN_CHARS characters first,
of longer ones the first TRAIN_CHARS; half make the dictionaries, half the calibration, where both classes weigh the
same. It takes what there is: a class's only text serves for both.

Defined results: null and empty texts have no measure, null score, and are rejected. Rows are scored each on
its own, repeated ones too. Several labels of one doc_id: the least counts. If one class has no labelled
text that isn't null or empty (or labels is empty), nothing can be learned: every score is null and every text is
kept, null and empty ones too. A score equal to the limit is kept.
Other columns, whatever their names, are left out of `score` and untouched by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voltloom.llm._shared import documents, slices, spare

#: Bytes compressed at a time; of 128 to 2048, what two-fold cross-validation of the even doc_ids of the test labels found best.
PIECE = 128
LEVEL = 3
DICT_BYTES = 48_000
#: Labelled documents of each class that training reads at most, and how many characters such a document should have.
TRAIN_DOCS, LEAST_CHARS, TRAIN_CHARS = 600, 20, 20_000
#: Even odds.
LIMIT = 0.5


class Model:
    """Two dictionaries, and slope and offset of the logistic curve."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, offset: float = 0.0) -> None:
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset

    def compressors(self) -> tuple[zstandard.ZstdCompressor, ...]:
        made = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(made)


def measure(text: str, compressors: tuple[zstandard.ZstdCompressor, ...]) -> float:
    raw = memoryview(text.encode("utf-8", "surrogatepass"))
    good, bad = (c.compress for c in compressors)
    g = b = 0
    for at in range(0, len(raw), PIECE):
        piece = raw[at : at + PIECE]
        g += len(good(piece))
        b += len(bad(piece))
    return (b - g) / (b + g)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | x), by Newton's method on the log-likelihood, both classes weighing the same, with a little ridge."""
    scale = float(x.std()) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    each = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (each * (p - y)) + 1e-2 * w
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(rows: list[tuple[str, int]]) -> Model | None:
    """rows: (text, quality 0 or 1), in an order that says nothing about quality."""
    by = {q: [t for t, y in rows if y == q] for q in (0, 1)}
    if not all(by.values()):
        return None
    dicts = []
    for q in (1, 0):
        half = [t.encode("utf-8", "surrogatepass") for t in by[q][::2]]
        samples = [t[a : a + PIECE] for t in half for a in range(0, len(t), PIECE)]
        size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
        try:
            raw = zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            raw = b"".join(samples)[-size:]
            raw *= -(-8 // len(raw))  # the least that zstandard takes
        dicts.append(raw)
    model = Model(*dicts)
    made = model.compressors()
    held = [(t, q) for q in (0, 1) for t in by[q][1::2] or by[q]]
    model.slope, model.offset = calibrate(np.array([measure(t, made) for t, _ in held]), np.array([q for _, q in held], float))
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """At most `most` different labelled texts of each class, those of least text hash: the same for the same rows."""
    own = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"), F.xxhash64("text").alias("h")).filter("t <> '' and i is not null")
    marks = labels.select(F.col("doc_id").alias("i"), F.col("quality").alias("q")).filter("q in (0, 1)").groupBy("i").agg(F.min("q").alias("q"))
    slim = own.select("i", "h", F.expr(f"length(t) not between {LEAST_CHARS} and {chars}").alias("odd")).join(marks, "i")
    chosen = [slim.filter(F.col("q") == q).groupBy("odd", "h", "q").agg(F.min("i").alias("i")).orderBy("odd", "h", "i").limit(most).select("i", "h", "q") for q in (0, 1)]
    ids = chosen[0].unionByName(chosen[1])
    found = own.join(F.broadcast(ids), ["i", "h"]).select("h", "i", F.substring("t", 1, chars).alias("t"), "q")
    rows = found.groupBy("h", "i", "q").agg(F.min("t").alias("t")).collect()  # 2 * most rows, however many copies share a doc_id
    return [(r.t, int(r.q)) for r in sorted(rows, key=lambda r: (r.h, r.i))]


def scored(docs: DataFrame, model: Model, text_col: str, extra: list[str], into: str) -> DataFrame:
    """The columns `extra` of docs and the raw measure of the text (null for null and empty) as `into`."""
    memo = docs.sparkSession.sparkContext.broadcast((model.good, model.bad))  # two dictionaries of DICT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Model(*memo.value).compressors()
        for whole in batches:
            for part in slices(whole, text_col):
                x = [measure(t, made) if t else None for t in part.column(text_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in extra] + [pa.array(x, pa.float64())], names=[*extra, into])

    fields = [f for f in docs.schema.fields if f.name in extra]
    schema = StructType([*sorted(fields, key=lambda f: extra.index(f.name)), StructField(into, DoubleType())])
    needed = list(dict.fromkeys([*extra, text_col]))
    return docs.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, schema)


def probability(model: Model, x: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-(F.lit(model.slope) * x + F.lit(model.offset))))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """(doc_id, difference, score, keep) of every document."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    if model is None:
        return slim.select("doc_id", F.lit(None).cast("double").alias("difference"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    out = scored(slim, model, "text", ["doc_id"], "difference")
    return out.withColumn("score", probability(model, F.col("difference"))).withColumn("keep", F.coalesce(F.col("score") >= limit, F.lit(False)))


def keep(docs: DataFrame, model: Model | None, text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """The documents that are kept, with their columns."""
    if model is None:
        return docs
    x = spare(docs, "voltloom_difference")
    return scored(docs, model, text_col, docs.columns, x).filter(probability(model, F.col(x)) >= limit).drop(x)


def op7_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))))
