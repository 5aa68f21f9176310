"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import csv
import json
import os
import platform
import re
import subprocess
import sys
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltloom.functions import strings, times
from voltloom.operators import intervals, sets

MANIFEST = ("s3_key", "status", "timestamp")


def headers(spark: SparkSession, paths: str | list[str], recursive: bool = True) -> list[tuple[str, list[str]]]:
    """(first line, files that begin with it) of all files with a first line; executors read no more than the lines' blocks."""

    def first_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            lines = []
            for path in f["path"]:
                system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
                with system.open_input_stream(name) as stream:
                    line = b""
                    while b"\n" not in line and (more := stream.read(1 << 16)):
                        line += more
                lines.append(line.split(b"\n")[0].decode("utf-8-sig", "replace").rstrip("\r"))
            yield pd.DataFrame({"path": f["path"], "line": lines})

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths).select("path")
    found = listed.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(first_lines, "path string, line string")
    by = found.filter("line <> ''").groupBy("line").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [(r.line, r.paths) for r in by.orderBy("line").collect()]  # the listing, which Spark's driver holds anyway


def csv_by_name(spark: SparkSession, paths: str | list[str], types: dict[str, str] | None = None, sep: str = ",", strict: bool = False, recursive: bool = True, known: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """CSV with a header. Columns in types are cast by name, where they are there; others stay text.

    Every file is read by its own header, so columns may be in another order or missing (null) in some files.
    Values that don't fit become null, or raise if strict is set. known: what headers() found, if that is there already.
    """
    tables = []
    for line, some in headers(spark, paths, recursive) if known is None else known:
        names = [n.strip() for n in next(csv.reader([line], delimiter=sep))]
        reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST" if strict else "PERMISSIVE")
        own = reader.schema(", ".join(f"`{n}` string" for n in names)).csv(some)
        tables.append(own.withColumn("source_key", F.col("_metadata.file_path")))
    if not tables:
        raise ValueError(f"no file with a header in {paths}")
    df = sets.union_diagonal(tables)
    cast = {c: (F.col(f"`{c}`").cast(k) if strict else F.col(f"`{c}`").try_cast(k)) for c, k in (types or {}).items() if c in df.columns}
    df = df.withColumns(cast) if cast else df
    return df.select(*[c for c in df.columns if c != "source_key"], "source_key")


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """For small tables such as flat rates."""
    return spark.read.csv(path, header=True, inferSchema=True)


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return csv_by_name(spark, path, sep="\t")


def wide_csv(spark: SparkSession, paths: str | list[str], refused: list[tuple[str, str]] | None = None) -> DataFrame:
    """Wide interval files of any header: id columns, 50 intervals (null where a file lacks one), source key, and month (from the file name).

    A file without one of the id columns, or without any interval, raises; where a list `refused` is given, it is left out
    and added there with the reason.
    """
    known = []
    for line, some in headers(spark, paths):
        names = {n.strip() for n in next(csv.reader([line]))}
        missing = sorted(set(intervals.IDS) - names) or ([] if names & set(intervals.INTERVALS) else ["intervals"])
        if not missing:
            known.append((line, some))
        elif refused is None:
            raise ValueError(f"{some[0]} lacks {missing}")
        else:
            refused += [(path, f"lacks {', '.join(missing)}") for path in some]
    df = csv_by_name(spark, paths, {c: "double" for c in intervals.INTERVALS}, known=known)
    own = intervals.canonical(df, [*intervals.IDS, "source_key"])
    own = df.withColumns({c: F.lit(None).cast("double") for c in intervals.INTERVALS if c not in df.columns}).select(*own.columns[:-1], *intervals.INTERVALS, "source_key")
    return own.withColumn("sample_month", strings.year_month(F.element_at(F.split("source_key", "/"), -1)))


def ingest(spark: SparkSession, paths: str | list[str], to: str, day_mode: str = "calendar", most_errors: int = 0) -> DataFrame:
    """Wide CSV files to one long interval table with time columns, written as Parquet; returns (source_key, status, n_rows, error) of every file.

    Files that can't be interval files are left out with the status error, up to most_errors; more raise.
    """
    refused: list[tuple[str, str]] = []
    wide = wide_csv(spark, paths, refused)
    if len(refused) > most_errors:
        raise ValueError(f"{len(refused)} files can't be read, {most_errors} may: {refused[0]}")
    long = intervals.wide_to_long(wide, ("source_key", "sample_month"))
    own = intervals.add_time_columns(long, day_mode).select("zip_code", "account_identifier", "datetime", "kwh", "date", "hour", "weekday", "is_weekend", "sample_month", "source_key")
    write_parquet(own, to, mode="overwrite")
    done = spark.read.parquet(to).groupBy("source_key").agg(F.count("*").alias("n_rows"))
    done = done.select("source_key", F.lit("success").alias("status"), "n_rows", F.lit(None).cast("string").alias("error"))
    return done.unionByName(spark.createDataFrame([(p, "error", 0, e) for p, e in refused], "source_key string, status string, n_rows long, error string"))


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 50_000) -> DataFrame:
    """f over Arrow batches of `rows` rows each (the last of a partition may have fewer), on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            while n + batch.num_rows >= rows:
                held.append(batch.slice(0, rows - n))
                yield from map(f, pa.Table.from_batches(held).combine_chunks().to_batches())
                batch, held, n = batch.slice(rows - n), [], 0
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if held:
            yield from map(f, pa.Table.from_batches(held).combine_chunks().to_batches())

    return df.mapInArrow(run, schema)


def parquet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def row_count(spark: SparkSession, path: str) -> int:
    """From the files' footers."""
    return spark.read.parquet(path).count()


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def jsonl_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = MANIFEST) -> tuple[DataFrame, DataFrame]:
    """(good, bad) lines: bad ones are no JSON or lack a required value."""
    raw = spark.read.text(path).filter("trim(value) <> ''").withColumn("m", F.from_json("value", "map<string,string>"))
    bad = F.col("m").isNull()
    for k in required:
        bad = bad | F.col("m")[k].isNull()
    bad = F.coalesce(bad, F.lit(True))
    return raw.filter(~bad).select("m"), raw.filter(bad).select("value")


def append_jsonl(path: str, records: list[dict]) -> None:
    with open(path, "a") as f:
        f.writelines(json.dumps(r, sort_keys=True, default=str) + "\n" for r in records)


def write_json(path: str, value: dict) -> None:
    Path(path).write_text(json.dumps(value, sort_keys=True, indent=2, default=str) + "\n")


def listing(spark: SparkSession, folder: str, pattern: str = "*.csv", most: int | None = None) -> DataFrame:
    """(path, bytes, modified), sorted by path before any limit; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    out = df.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).orderBy("path")
    return out.limit(most) if most is not None else out


def storage_by_month(files: DataFrame) -> DataFrame:
    """(month, n_files, bytes, gib) with a TOTAL row; months come from the file names."""
    own = files.withColumn("month", F.coalesce(strings.year_month(F.element_at(F.split("path", "/"), -1)), F.lit("unknown")))
    out = own.rollup("month").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return out.select(F.coalesce("month", F.lit("TOTAL")).alias("month"), "n_files", "bytes", (F.col("bytes") / 1024**3).alias("gib"))


def uris(spark: SparkSession, path: str, bucket: str | None = None) -> DataFrame:
    """Lines of a list of files without blanks and comments; the bucket is put before relative ones."""
    own = spark.read.text(path).select(F.trim("value").alias("uri")).filter("uri <> '' and not startswith(uri, '#')")
    return own.withColumn("uri", F.when(F.col("uri").contains("://"), F.col("uri")).otherwise(F.concat(F.lit(f"{bucket.rstrip('/')}/"), "uri"))) if bucket else own


def with_month(files: DataFrame, first: str = "200001", last: str = "209912", column: str = "path") -> DataFrame:
    """Files whose name has a valid YYYYMM within the range, with the month and a key month/name."""
    name = F.element_at(F.split(column, "/"), -1)
    out = files.withColumn("month", strings.year_month(name)).filter(F.col("month").between(first, last))
    return out.withColumn("key", F.concat_ws("/", "month", name))


def price_feed(spark: SparkSession, path: str, zone: str = "America/Chicago") -> DataFrame:
    """(datetime_utc, datetime_local, price_cents) from JSON of millisUTC and price as text; malformed records are left out."""
    raw = spark.read.schema("millisUTC string, price string").option("multiLine", True).json(path)
    own = raw.select(F.col("millisUTC").try_cast("long").alias("ms"), F.col("price").try_cast("double").alias("price_cents")).filter("ms is not null and price_cents is not null")
    utc, local = times.local_from_millis(F.col("ms"), zone)
    return own.select(utc.alias("datetime_utc"), local.alias("datetime_local"), "price_cents")


def header_rows(spark: SparkSession, path: str) -> DataFrame:
    """A table from JSON [[names], [values], ...], as statistics services give it; all text."""
    rows = json.loads("".join(r.value for r in spark.read.text(path).collect()))  # one response, some thousand places at most
    return spark.createDataFrame([[None if v is None else str(v) for v in r] for r in rows[1:]], ", ".join(f"`{c}` string" for c in rows[0]))


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; made and written there first if it isn't."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        write_parquet(make(), path, mode="overwrite")
    return spark.read.parquet(path)


def with_environment(value):
    """A configuration with ${NAME} and ${NAME:-default} replaced in all its texts; unknown names stay as they are."""
    if isinstance(value, dict):
        return {k: with_environment(v) for k, v in value.items()}
    if isinstance(value, list):
        return [with_environment(v) for v in value]
    if not isinstance(value, str):
        return value

    def one(m: re.Match) -> str:
        found = os.environ.get(m[1], m[2])
        return m[0] if found is None else found

    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", one, value)


def load_config(path: str) -> dict:
    """A YAML file (or JSON, if YAML can't be read here) with environment variables filled in; it must hold a mapping, or nothing."""
    raw = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        value = json.loads(raw or "null")
    else:
        value = yaml.safe_load(raw)
    if value is not None and not isinstance(value, dict):
        raise ValueError(f"{path} holds a {type(value).__name__}, not a mapping")
    return with_environment(value or {})


def configured_month(config: dict, year: int = 2023, month: int = 7) -> tuple[int, int]:
    """(year, month) of a configuration."""
    found = int(config.get("year", year)), int(config.get("month", month))
    if not 1 <= found[1] <= 12:
        raise ValueError(f"a month is 1 to 12, not {found[1]}")
    return found


def run_manifest(folder: str, name: str, lists: dict[str, list[str]] | None = None, **values) -> str:
    """Writes name.json with values, time, Python, platform and commit, and each list as its own text file; returns the path."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        commit = None
    lists = {k: sorted(set(v)) for k, v in (lists or {}).items()}
    for k, v in lists.items():
        (at / f"{k}.txt").write_text("".join(f"{x}\n" for x in v))
    made = {"created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "python": sys.version, "platform": platform.platform(), "git_commit": commit}
    write_json(str(at / f"{name}.json"), made | lists | values)
    return str(at / f"{name}.json")


def listed(folder: str, name: str = "predictors_used") -> list[str] | None:
    """A list that an earlier run wrote beside its manifest, or None."""
    at = Path(folder) / f"{name}.txt"
    return [x for x in at.read_text().splitlines() if x.strip()] if at.exists() else None


def synthetic_wide(spark: SparkSession, accounts: int, first_day: str, days: int, seed: int = 42) -> DataFrame:
    """Wide interval rows of made-up accounts: 0.15 kWh, more in the mornings and evenings, a little noise.

    Every value depends on account, day and slot only, so the table is the same however it is partitioned.
    """
    base = spark.range(accounts * days).select(F.expr(f"id div {days}").alias("a"), F.expr(f"date_add(date'{first_day}', cast(id % {days} as int))").alias("d"))

    def kwh(slot: int):
        hour = slot // 2
        noise = (F.pmod(F.xxhash64("a", "d", F.lit(slot), F.lit(seed)), F.lit(60001)) / 60000 - 0.5) * 0.06
        return F.round(F.greatest(F.lit(0.02), F.lit(0.15 + 0.25 * (6 <= hour <= 8) + 0.5 * (17 <= hour <= 20)) + noise), 3)

    made = [kwh(i).alias(c) for i, c in enumerate(intervals.INTERVALS[:48])]
    return base.select(
        F.format_string("606%02d", F.col("a") % 20).alias("ZIP_CODE"), F.lit("R").alias("DELIVERY_SERVICE_CLASS"), F.lit("Residential").alias("DELIVERY_SERVICE_NAME"),
        F.col("a").cast("string").alias("ACCOUNT_IDENTIFIER"), F.date_format("d", "MM/dd/yyyy").alias("INTERVAL_READING_DATE"), *made,
    )
