"""Exact top-k search by inner product, with norm-bucketed retrieval, of a stated set of queries against all rows.

Vectors are written once to the shared folder, longest first, and read in buckets of similar length (the
shortest has at least RATIO of the longest, or the bucket is small). A task holds a block of queries and walks
the buckets of their dimension, longest first, keeping each query's k best so far. With the k-th best score s, a
bucket with longest vector l can only matter where the cosine reaches the local threshold t = s / (|q| l):

  t > 1         no vector of this bucket or of any later one can enter: the query is done,
  t >= COSINE   coordinate pruning: with f the query's largest coordinate, a unit vector p at cosine t or more
                has p_f in [q_f t - r, q_f t + r], r = sqrt((1 - t^2) (1 - q_f^2)); only that range is multiplied,
  otherwise     length pruning: only vectors of length s / |q| or more are multiplied.

Products are first taken in single precision with a bound on their error; what can still enter is verified in double
precision. The result is exact: nothing is capped, and equal scores go to the least id, then the first row.

`search` takes every row as a query, or those that a condition names; all rows can be answers. The registered query
searches for the rows whose id is divisible by 100.

Defined results: null and empty vectors, those with null or non-finite elements and those whose squared length no double
can hold are neither queries nor answers.
Vectors are compared with those of their own dimension only. A row is never its own answer; repeated rows (also of
one id) are each a query and answer one another. With fewer than k others, all are given; an empty table gives an
empty result, so does a condition that no row meets. Null ids come last among equal scores. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.llm._shared import shared_dir

K = 10
RATIO, COSINE = 0.9, 0.6
#: Vectors in a bucket at most and (unless it holds them all) at least; queries multiplied at a time and held by a task.
BUCKET, LEAST, CHUNK, BLOCK = 4096, 256, 1024, 16_384
#: Bytes of vectors in one written file, about.
FILE_BYTES = 64 << 20
#: Names that Hadoop has for what pyarrow calls s3.
S3 = re.compile(r"^s3[an]:")


class Bucket:
    """Vectors of similar length, longest first, with lazily sorted coordinates."""

    def __init__(self, x: np.ndarray, norm: np.ndarray, pos: np.ndarray, ids: np.ndarray, lacks: np.ndarray) -> None:
        self.x, self.norm, self.pos, self.ids, self.lacks = x, norm, pos, ids, lacks
        self.single, self.sorted = x.astype(np.float32), {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Order and sorted values of coordinate f of the unit vectors."""
        if f not in self.sorted:
            unit = self.x[:, f] / np.where(self.norm > 0, self.norm, 1)
            order = np.argsort(unit, kind="stable")
            self.sorted[f] = order, unit[order]
        return self.sorted[f]


def buckets(x: np.ndarray, norm: np.ndarray, pos: np.ndarray, ids: np.ndarray, lacks: np.ndarray) -> Iterator[Bucket]:
    at = 0
    while at < len(norm):
        alike = int(np.searchsorted(-norm, -RATIO * norm[at], side="right"))
        to = min(at + BUCKET, len(norm), max(alike, at + LEAST))
        yield Bucket(x[at:to], norm[at:to], pos[at:to], ids[at:to], lacks[at:to])
        at = to


class Best:
    """The k best answers of each query of a chunk."""

    def __init__(self, x: np.ndarray, norm: np.ndarray, pos: np.ndarray, k: int) -> None:
        self.x, self.norm, self.pos, self.k = x, norm, pos, k
        self.single, self.done = x.astype(np.float32), np.zeros(len(x), bool)
        self.score, self.id, self.at = np.full((len(x), k), -np.inf), np.zeros((len(x), k), np.int64), np.full((len(x), k), -1, np.int64)
        self.lacks = np.ones((len(x), k), bool)  # whether the answer has no id
        self.focus = np.abs(x).argmax(1)
        self.lead = x[np.arange(len(x)), self.focus] / np.where(norm > 0, norm, 1)
        #: bound on a single precision product's error, for vectors of length 1
        self.slack = (x.shape[1] + 4) * 2.0**-23

    def see(self, b: Bucket) -> None:
        least = self.score[:, -1]
        reach = self.norm * b.norm[0]
        self.done |= reach * (1 + 1e-9) < least
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(reach > 0, least / reach, -np.inf) - 1e-9
            need = np.where(self.norm > 0, least / self.norm, -np.inf) * (1 - 1e-9)
        near = ~self.done & (t >= COSINE)
        for f in np.unique(self.focus[near]):
            order, value = b.coordinate(int(f))
            for sign in (True, False):  # ranges of one sign lie close together
                own = np.flatnonzero(near & (self.focus == f) & ((self.lead > 0) == sign))
                if len(own):
                    r = np.sqrt(np.maximum(0, 1 - t[own] ** 2) * np.maximum(0, 1 - self.lead[own] ** 2)) + 1e-9
                    top = np.where(np.abs(self.lead[own]) >= t[own], 1.0, np.abs(self.lead[own]) * t[own] + r)
                    if sign:
                        hi = np.searchsorted(value, top.max() + 1e-9, side="right")
                        lo = np.searchsorted(value, (self.lead[own] * t[own] - r).min(), side="left")
                    else:
                        lo = np.searchsorted(value, -top.max() - 1e-9, side="left")
                        hi = np.searchsorted(value, (self.lead[own] * t[own] + r).max(), side="right")
                    self.multiply(own, b, np.sort(order[lo:hi]))
        far = np.flatnonzero(~self.done & (t < COSINE))
        if len(far):
            self.multiply(far, b, slice(0, int(np.searchsorted(-b.norm, -need[far].min(), side="right"))))

    def multiply(self, own: np.ndarray, b: Bucket, some: np.ndarray | slice) -> None:
        single, pos = b.single[some], b.pos[some]
        if not len(pos):
            return
        s = self.single[own] @ single.T
        s[self.pos[own][:, None] == pos] = -np.inf
        least = self.score[own, -1]
        slack = self.slack * self.norm[own] * b.norm[0]
        if s.shape[1] > self.k and (new := np.flatnonzero(least == -np.inf)).size:
            least[new] = np.partition(s[new], s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - slack[new]
        row, col = np.nonzero(s >= np.nextafter((least - slack).astype(np.float32), np.float32(-np.inf))[:, None])
        ok = s[row, col] > -np.inf
        row, col = row[ok], col[ok]
        if not len(row):
            return
        x, ids, lacks = b.x[some], b.ids[some], b.lacks[some]
        score = np.concatenate([np.einsum("ij,ij->i", self.x[own[row[a : a + 100_000]]], x[col[a : a + 100_000]]) for a in range(0, len(row), 100_000)])
        hit = np.unique(row)
        q = np.concatenate([np.repeat(hit, self.k), row])
        score = np.concatenate([self.score[own[hit]].ravel(), score])
        ids = np.concatenate([self.id[own[hit]].ravel(), ids[col]])
        lacks = np.concatenate([self.lacks[own[hit]].ravel(), lacks[col]])
        at = np.concatenate([self.at[own[hit]].ravel(), pos[col]])
        order = np.lexsort((at, ids, lacks, -score, q))
        begin = np.searchsorted(q[order], hit)
        take = order[begin[:, None] + np.arange(self.k)]
        self.score[own[hit]], self.id[own[hit]], self.at[own[hit]], self.lacks[own[hit]] = score[take], ids[take], at[take], lacks[take]


def arrays(part: pa.RecordBatch | pa.Table, dim: int) -> tuple[np.ndarray, ...]:
    own = part.filter(pc.equal(part.column("dim"), dim))
    flat = own.column("v").combine_chunks() if isinstance(own.column("v"), pa.ChunkedArray) else own.column("v")
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    ids = own.column("id")
    return x, np.sqrt((x * x).sum(1)), np.asarray(own.column("pos")), np.asarray(pc.fill_null(ids, 0)), np.asarray(pc.is_null(ids)), own


def written(vectors: DataFrame, id_col: str, vector_col: str, asked: str) -> tuple[str, int]:
    """Folder with (id, dim, norm, pos, v, asked), longest first within a dimension, and its number of queries."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.coalesce(F.expr(asked), F.lit(False)).alias("asked")).filter("v is not null and size(v) > 0")
    slim = slim.withColumn("norm", F.expr("aggregate(v, 0D, (s, e) -> s + cast(e as double) * e)"))  # null where an element is
    slim = slim.filter("norm is not null and not isnan(norm) and norm < double('infinity')").withColumn("norm", F.sqrt("norm")).withColumn("dim", F.size("v"))
    at = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    slim.write.parquet(f"{at}/rows")
    slim = spark.read.parquet(f"{at}/rows")
    total = slim.agg(F.count_if("asked").alias("n"), F.sum("dim").alias("cells")).first()
    files = max(1, (total.cells or 0) * 8 // FILE_BYTES)
    spread = slim.repartitionByRange(files, "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id")
    spread.withColumn("pos", F.monotonically_increasing_id()).write.option("parquet.block.size", 8 << 20).parquet(f"{at}/sorted")
    return f"{at}/sorted", total.n


def search(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", asked: str = "true") -> DataFrame:
    """(vec_id, rank, neighbor_id, score) of the k best answers of every row that meets the condition `asked`. Ids are whole numbers."""
    spark = vectors.sparkSession
    path, n = written(vectors, id_col, vector_col, asked)
    table = spark.read.parquet(path)
    dims = table.groupBy("dim", F.col("_metadata.file_path").alias("file")).agg(F.max("norm").alias("longest"), F.min("pos").alias("first")).collect() if n else []  # a row for each file
    where: dict[int, list[tuple[str, float]]] = {}
    for r in sorted(dims, key=lambda r: (r.dim, -r.longest, r.first)):
        where.setdefault(r.dim, []).append((r.file, r.longest))

    def answer(held: pa.Table) -> Iterator[pa.RecordBatch]:
        for dim in np.unique(np.asarray(held.column("dim"))).tolist():
            x, norm, pos, _, _, own = arrays(held, dim)
            chunks = [Best(x[a : a + CHUNK], norm[a : a + CHUNK], pos[a : a + CHUNK], k) for a in range(0, len(x), CHUNK)]
            for file, longest in where[dim]:
                if all((c.done | (c.norm * longest * (1 + 1e-9) < c.score[:, -1])).all() for c in chunks):
                    break
                system, name = fs.FileSystem.from_uri(S3.sub("s3:", file))
                with system.open_input_file(name) as f:
                    for group in pq.ParquetFile(f).iter_batches(batch_size=8 * BUCKET, columns=["id", "dim", "pos", "v"]):
                        px, pnorm, ppos, pids, plack, _ = arrays(group, dim)
                        for b in buckets(px, pnorm, ppos, pids, plack):
                            for c in chunks:
                                if not c.done.all():
                                    c.see(b)
            score, at, ids, lacks = (np.concatenate([getattr(c, a) for c in chunks]) for a in ("score", "at", "id", "lacks"))
            row, col = np.nonzero(at >= 0)
            yield pa.RecordBatch.from_arrays(
                [own.column("id").combine_chunks().take(pa.array(row)), pa.array(col + 1), pa.array(ids[row, col], mask=lacks[row, col]), pa.array(score[row, col])], names=["vec_id", "rank", "neighbor_id", "score"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in batches:
            held.append(part)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from answer(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield from answer(pa.Table.from_batches(held))

    parts = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-n // BLOCK))))
    queries = table.filter("asked").select("id", "dim", "pos", "v").repartition(parts, "pos")
    return queries.mapInArrow(run, "vec_id long, rank long, neighbor_id long, score double").withColumn("score", F.round("score", 6))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), asked="vec_id % 100 = 0")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_inner_product(a.v, b.v) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbor_id) AS rank, neighbor_id, score FROM s)
SELECT vec_id, rank, neighbor_id, round(score, 6) AS score FROM r WHERE rank <= 10
"""
