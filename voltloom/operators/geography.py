"""From postal codes to block groups, and clusters by block group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltloom.functions import numbers, strings


def crosswalk(raw: DataFrame, zip_col: str = "Zip", zip4_col: str = "Zip4", key_col: str = "CensusKey2023") -> DataFrame:
    """(zip_code, GEOID), each once, from the raw columns; rows without either are left out."""
    code = F.concat_ws("-", strings.digits_zfill(F.col(zip_col), 5), strings.digits_zfill(F.col(zip4_col), 4))
    return raw.select(strings.zip4(code).alias("zip_code"), strings.block_group(F.col(key_col)).alias("GEOID")).filter("zip_code is not null and GEOID is not null").distinct()


def first_group(walk: DataFrame) -> DataFrame:
    """The least GEOID of each zip code."""
    return walk.groupBy("zip_code").agg(F.min("GEOID").alias("GEOID"))


def attach(df: DataFrame, walk: DataFrame) -> DataFrame:
    """df with the GEOID; rows whose zip code is unknown go (see unmatched)."""
    return df.join(walk, "zip_code")


def unmatched(df: DataFrame, walk: DataFrame) -> DataFrame:
    return df.join(walk, "zip_code", "left_anti")


def fan_out(walk: DataFrame) -> DataFrame:
    """One row: zip codes, those of several groups, their percentage, and the most groups of one."""
    by = walk.groupBy("zip_code").agg(F.countDistinct("GEOID").alias("n"))
    return by.agg(F.count("*").alias("n_zip_codes"), F.count_if(F.col("n") > 1).alias("n_fan_out"), (F.avg((F.col("n") > 1).cast("double")) * 100).alias("pct_fan_out"), F.max("n").alias("most_groups"))


def cluster_counts(assigned: DataFrame, walk: DataFrame, clusters: list[int]) -> DataFrame:
    """(GEOID, total_household_days, cluster_0, ...): counts are made by zip code first, so the join is small."""
    small = assigned.groupBy("zip_code", "cluster").agg(F.count("*").alias("n"))
    wide = attach(small, walk).groupBy("GEOID").pivot("cluster", clusters).agg(F.sum("n"))
    named = wide.select("GEOID", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"cluster_{k}") for k in clusters])
    return named.withColumn("total_household_days", sum((F.col(f"cluster_{k}") for k in clusters), F.lit(0)).cast("long"))


def shares(assigned: DataFrame, group: str = "GEOID") -> DataFrame:
    """(group, cluster, n, share)."""
    by = assigned.groupBy(group, "cluster").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def bucket(c: Column) -> Column:
    return F.when(c == 1, "1").when(c == 2, "2").when(c <= 5, "3-5").when(c <= 10, "6-10").when(c <= 20, "11-20").otherwise("20+")


def density(households: DataFrame, group: str = "GEOID", unit: str = "account_identifier") -> DataFrame:
    """(group, n_households, bucket)."""
    return households.groupBy(group).agg(F.countDistinct(unit).alias("n_households")).withColumn("bucket", bucket(F.col("n_households")))


def density_summary(by: DataFrame, least: int = 50) -> DataFrame:
    """One row: mean, median, 10th and 90th percentile of households a group, and groups with at least `least`."""
    p = F.percentile("n_households", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return by.agg(F.count("*").alias("n_groups"), F.avg("n_households").alias("mean_households"), p.alias("p"), F.count_if(F.col("n_households") >= least).alias("n_enough")).select("n_groups", "mean_households", F.col("p")[1].alias("median_households"), F.col("p")[0].alias("p10"), F.col("p")[2].alias("p90"), "n_enough")


def share_variance(own: DataFrame, clusters: list[int], group: str = "GEOID") -> DataFrame:
    """(cluster, variance, verdict) of the shares over groups; a cluster that a group lacks counts as 0."""
    wide = own.groupBy(group).pivot("cluster", clusters).agg(F.sum("share")).na.fill(0.0)
    names = [str(k) for k in clusters]
    long = wide.agg(*[F.var_samp(n).alias(n) for n in names]).unpivot([], names, "cluster", "variance")
    return long.select(F.col("cluster").cast("int").alias("cluster"), "variance", F.when(F.col("variance") < 0.01, "low").when(F.col("variance") < 0.02, "moderate").otherwise("good").alias("verdict"))


def zero_cells(wide: DataFrame, clusters: list[int]) -> DataFrame:
    """(cluster, n_zeros, pct_zeros) over block groups."""
    names = [f"cluster_{k}" for k in clusters]
    long = wide.unpivot(["GEOID"], names, "cluster", "n")
    return long.groupBy("cluster").agg(F.count_if(F.col("n") == 0).alias("n_zeros"), numbers.safe_percent(F.count_if(F.col("n") == 0), F.count("*")).alias("pct_zeros"))
