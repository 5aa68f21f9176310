"""Clusters of profiles: k-means, nearest centroids, silhouette, choice of k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit(profiles: DataFrame, k: int, seed: int = 42, n_init: int = 3, vector_col: str = "profile") -> KMeansModel:
    """The best of n_init starts by cost over all rows."""
    own = profiles.select(array_to_vector(F.col(vector_col)).alias("features")).persist()
    try:
        return _best(own, k, seed, n_init)
    finally:
        own.unpersist()


def _best(own: DataFrame, k: int, seed: int, n_init: int) -> KMeansModel:
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(own) for i in range(n_init)]
    return min(models, key=lambda m: m.summary.trainingCost)


def centroids(model: KMeansModel, spark) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(profiles: DataFrame, centers: list[list[float]], vector_col: str = "profile") -> DataFrame:
    """profiles with cluster and squared distance: the nearest of a few centers, the first one of equals."""
    v = F.col(vector_col).cast("array<double>")
    best = F.least(*[F.struct(squared(v, F.array(*map(F.lit, c))).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centers)])
    return profiles.withColumn("_best", best).withColumns({"cluster": F.col("_best.c"), "distance": F.col("_best.d")}).drop("_best")


def sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"))


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("distance").alias("inertia"))


def silhouette(assigned: DataFrame, most: int = 5000, key: str | None = None, seed: int = 42, vector_col: str = "profile") -> float | None:
    """Mean Euclidean silhouette of a sample of at most `most` rows; null for fewer than two rows or a single cluster.

    The sample is what the operator is defined on; distances to it are blocks of a matrix product on the executors.
    """
    own = assigned.select(F.col(vector_col).cast("array<double>").alias("v"), "cluster", (F.col(key) if key else F.lit(0)).alias("key"))
    own = own.orderBy(F.xxhash64("key", "v", F.lit(seed))).limit(most)
    rows = own.select("v", "cluster").collect()
    label = np.array([r.cluster for r in rows])
    if len(rows) < 2 or len(set(label.tolist())) < 2:
        return None
    x = np.array([r.v for r in rows])
    spark = assigned.sparkSession
    memo = spark.sparkContext.broadcast((x, label))

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, label = memo.value
        kinds = np.unique(label)
        for f in frames:
            at = f["id"].to_numpy()
            d = np.sqrt(np.maximum(0, (x[at] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x[at] @ x.T))
            d[np.arange(len(at)), at] = 0
            sums = np.stack([d[:, label == k].sum(1) for k in kinds], 1)
            n = np.array([(label == k).sum() for k in kinds])
            own = np.searchsorted(kinds, label[at])
            a = sums[np.arange(len(at)), own] / np.maximum(n[own] - 1, 1)
            other = sums / n
            other[np.arange(len(at)), own] = np.inf
            b = other.min(1)
            top = np.maximum(a, b)
            yield pd.DataFrame({"s": np.where((n[own] == 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1, top))})

    return float(spark.range(len(rows)).mapInPandas(part, "s double").agg(F.avg("s")).first()[0])


def choose_k(found: list[tuple[int, float, float | None]]) -> int:
    """Of (k, inertia, silhouette): greatest silhouette, ties to the larger k; without any, least inertia, ties to the smaller k."""
    scored = [f for f in found if f[2] is not None]
    return max(scored, key=lambda f: (f[2], f[0]))[0] if scored else min(found, key=lambda f: (f[1], f[0]))[0]


def search_k(profiles: DataFrame, ks: range, seed: int = 42, most: int = 5000, vector_col: str = "profile", n_init: int = 3) -> tuple[int, DataFrame]:
    """(best k, table of k, inertia, silhouette), each k fitted from n_init starts."""
    own = profiles.withColumn("features", array_to_vector(F.col(vector_col))).persist()  # read once for all k
    found = []
    try:
        for k in ks:
            model = _best(own, k, seed, n_init)
            assigned = model.transform(own).withColumnRenamed("prediction", "cluster")
            found.append((k, float(model.summary.trainingCost), silhouette(assigned, most, None, seed, vector_col)))
    finally:
        own.unpersist()
    return choose_k(found), profiles.sparkSession.createDataFrame(found, "k int, inertia double, silhouette double")


