"""Cases that the given tables don't have: days that clocks change, odd files, models with known answers."""

from __future__ import annotations

import datetime as dt
import json

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltloom.functions import numbers, strings, times
from voltloom.operators import census, clusters, geography, intervals, quality, reports, sampling, sets, stage2, tariffs
from voltloom.plans import interval_queries, registry
from voltloom.sources import files
from voltloom.streaming import tables


def wide(spark, rows):
    ids = "ZIP_CODE string, DELIVERY_SERVICE_CLASS string, DELIVERY_SERVICE_NAME string, ACCOUNT_IDENTIFIER string, INTERVAL_READING_DATE string"
    return spark.createDataFrame([("606010001", "R", "Residential", "a1", day, *own) for day, own in rows], ids + "".join(f", {c} double" for c in intervals.INTERVALS))


def test_wide_to_long_end_stamps(spark):
    df = wide(spark, [("08/01/2023", [float(i) for i in range(48)] + [None, None]), ("11/05/2023", [1.0] * 50), ("03/12/2023", [1.0] * 46 + [None] * 4), ("junk", [None] * 50)])
    rows = intervals.wide_to_long(df).collect()
    assert len(rows) == 48 + 50 + 46
    at = {r.datetime: r.kwh for r in rows}
    assert at[dt.datetime(2023, 8, 1, 0, 30)] == 0.0 and at[dt.datetime(2023, 8, 2)] == 47.0
    assert dt.datetime(2023, 11, 6, 1, 0) in at  # HR2500
    billing = intervals.add_time_columns(intervals.wide_to_long(df), "billing")
    days = {(str(r.date), r.day_type) for r in quality.interval_day_qc(billing.filter("date <> '2023-11-06'")).collect()}
    assert ("2023-08-01", "normal") in days and ("2023-03-12", "spring_forward") in days
    friday = intervals.add_time_columns(intervals.wide_to_long(wide(spark, [("08/04/2023", [1.0] * 50)]))).first()
    assert friday.weekday == 5 and friday.is_weekend  # 5 and more, as in interval tables


def test_wide_to_long_refuses(spark):
    with pytest.raises(ValueError, match="missing"):
        intervals.wide_to_long(spark.createDataFrame([(1,)], "x int"))
    with pytest.raises(ValueError, match="interval"):
        intervals.wide_to_long(wide(spark, []).drop(*intervals.INTERVALS))
    with pytest.raises(ValueError, match="day_mode"):
        intervals.add_time_columns(wide(spark, []), "x")


def test_strings(spark):
    df = spark.createDataFrame([("123", "601011234", "usage_202013.csv"), ("12345", "60101-1234", "file_123456_202405_data.csv"), (None, " ", None)], "a string, z string, f string")
    rows = df.select(strings.zfill(F.col("a"), 4), strings.zip4(F.col("z")), strings.year_month(F.col("f"))).collect()
    assert [tuple(r) for r in rows] == [("0123", "60101-1234", None), ("12345", "60101-1234", "202405"), (None, None, None)]
    one = spark.createDataFrame([("17", "31", "839102", "1")], "a string, b string, c string, d string")
    assert one.select(strings.geoid(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] == "170318391021"
    assert strings.detect(["Zip_4", "x"], ["zip4"]) == "Zip_4" and strings.detect(["x"], ["y"]) is None
    assert strings.chosen(["a", "b"], "b, a,b") == ["b", "a"]


def test_numbers(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([5.0, 5.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(numbers.min_max(F.col("v"))).collect()] == [[0.0, 1.0, 0.5], [0.0, 0.0], []]
    z = df.select(numbers.z_scores(F.col("v"))).first()[0]
    assert np.allclose(z, (np.array([1, 3, 2]) - 2) / np.std([1, 3, 2]))
    codes = spark.createDataFrame([(5, 7, -666666666)], "A int, B int, C int")
    row = codes.select(numbers.total("A + B").alias("x"), numbers.total("A + C").alias("y"), numbers.safe_percent(F.lit(1.0), F.lit(0.0)).alias("z"), numbers.log_count(F.lit(-1)).alias("w")).first()
    assert row.x == 12 and row.y is None and row.z is None and row.w is None
    with pytest.raises(ValueError, match="sum"):
        numbers.total("A * B")


def test_census(spark):
    assert len(census.FEATURES) == 47 == len({f.name for f in census.FEATURES})
    assert len(census.raw_codes(census.FEATURES)) > 120 and {f.category for f in census.FEATURES} == {"economic", "housing", "household", "demographic", "spatial"}
    raw = spark.createDataFrame([("17", "31", "839102", "1", 70.0, 100.0)], "state string, county string, tract string, `block group` string, B25003_002E double, B25003_001E double")
    row = census.build(census.with_geoid(raw), census.FEATURES).first()
    assert row.GEOID == "170318391021" and row.pct_owner_occupied == 70 and row.median_age is None
    report = {r.metric: r.value for r in census.validate(census.build(census.with_geoid(raw), census.FEATURES)).collect()}
    assert report["rows"] == 1 and report["bad_id_length"] == 0
    incomes = spark.createDataFrame([("170318391021", "Block Group 1", 75000.0, 250), ("170318391022", "Block Group 2", None, 180)], "GEOID string, NAME string, Median_Household_Income double, Total_Households long")
    report = {r.metric: r.value for r in census.validate(incomes).collect()}
    assert report == {"rows": 2, "unique_ids": 2, "bad_id_length": 0}
    assert {r.column_name: r.n_nulls for r in quality.null_profile(incomes).collect()}["Median_Household_Income"] == 1


def test_crosswalk(spark):
    raw = spark.createDataFrame([("60101", "12", "170310001001999"), ("60101", "0012", "170310001000111"), ("60101", "", "x")], "Zip string, Zip4 string, CensusKey2023 string")
    assert [tuple(r) for r in geography.first_group(geography.crosswalk(raw)).collect()] == [("60101-0012", "170310001000")]


def test_tariffs(spark):
    feed = spark.createDataFrame([(dt.datetime(2023, 11, 5, 1, 0), dt.datetime(2023, 11, 5, 6, 0), 2.0), (dt.datetime(2023, 11, 5, 1, 5), dt.datetime(2023, 11, 5, 7, 5), -4.0)], "datetime_local timestamp_ntz, datetime_utc timestamp_ntz, price_cents double")
    hourly = tariffs.hourly_prices(feed, utc="datetime_utc")
    row = hourly.first()
    assert row.price_cents == -1 and row.n_intervals == 2 and row.datetime_utc == dt.datetime(2023, 11, 5, 6)
    flat = spark.createDataFrame([(2023, 11, 7.0)], "year int, month int, flat_price_cents double")
    spread = tariffs.spreads(hourly, flat)
    assert spread.first().spread_cents == 8
    with pytest.raises(ValueError, match="no flat price"):
        tariffs.spreads(hourly, flat.filter("month = 1"))
    load = spark.createDataFrame([("a", "z", dt.datetime(2023, 11, 5, 1), 10.0)], "account_identifier string, zip_code string, hour_local timestamp_ntz, kwh_hour double")
    bill = tariffs.net_bills(tariffs.bills(load, spread), 0.05, 0.1).first()
    assert bill.flat_dollars == pytest.approx(0.7) and bill.diff_dollars == pytest.approx(0.8) and bill.net_diff_dollars == pytest.approx(0.2)
    free = tariffs.bills(load, tariffs.spreads(hourly, flat.withColumn("flat_price_cents", F.lit(0.0)))).first()
    assert free.pct_savings is None


def test_millis(spark):
    utc, local = times.local_from_millis(F.col("id"))
    row = spark.range(1699167600000, 1699167600001).select(utc.alias("u"), local.alias("l")).first()
    assert row.u == dt.datetime(2023, 11, 5, 7) and row.l == dt.datetime(2023, 11, 5, 1)


def test_samples(spark):
    days = sampling.date_manifest(spark.range(60).select(F.expr("date_add(date'2023-08-01', cast(id as int))").alias("date")))
    got = sampling.sample_dates(days, 20).collect()
    assert len(got) == 20 and sum(r.is_weekend for r in got) == 6
    assert {r.date for r in got} == {r.date for r in sampling.sample_dates(days.repartition(7), 20).collect()}
    assert not days.filter("is_weekend and weekday < 6").count()
    assert sampling.sample_dates(days.filter("is_weekend"), 10).count() == 10 and sampling.sample_dates(days.filter("not is_weekend"), 70).count() == 44


def test_sets_and_quality(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("2", 7)], "k string, w int")
    assert sets.union_diagonal([a.withColumn("k", F.col("k").cast("string")), b]).count() == 2
    assert [(r.k, r.v) for r in sets.union_relaxed([a, b.withColumnRenamed("w", "v")]).collect()] == [("1", "x"), ("2", "7")]
    numbers_ = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([(2.7,), (1e12,)], "v double"), spark.createDataFrame([(2**40,)], "v long")
    wide_ = sets.union_relaxed(list(numbers_))
    assert wide_.dtypes == [("v", "double")] and [r.v for r in wide_.collect()] == [1.0, 2.7, 1e12, 2.0**40]
    kinds = [("int", "bigint", "bigint"), ("date", "timestamp_ntz", "timestamp_ntz"), ("decimal(5,2)", "int", "decimal(22,2)"), ("decimal(5,2)", "float", "double"), ("boolean", "int", "string"), ("void", "date", "date")]
    assert all(sets._wider(a, b) == c == sets._wider(b, a) for a, b, c in kinds)
    months = spark.createDataFrame([("1", 100), ("2", 100), ("3", 20), ("4", 40)], "sample_month string, customers int")
    assert {r.sample_month: r.grade for r in quality.under_sampled(months).collect()} == {"1": "ok", "2": "ok", "3": "critical", "4": "ok"}
    empty = spark.createDataFrame([], "k int, v string")
    assert {r.pct_null for r in quality.null_profile(empty).collect()} == {None}
    assert quality.duplicate_rows(empty, ["k"]).first().n_duplicates == 0
    assert sets.missing_dates(spark.createDataFrame([], "date date")).count() == 0


def test_multinomial_recovers_and_has_no_gradient(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    truth = np.array([[0.5, 1.0, -0.5], [-0.3, 0.0, 0.8]])
    eta = np.column_stack([np.c_[np.ones(200), x] @ truth.T, np.zeros(200)])
    p = np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
    y = np.array([rng.multinomial(400, q) for q in p])
    df = spark.createDataFrame([(f"{i:012d}", *map(int, y[i]), *map(float, x[i]), float(2 * x[i, 0]), 1.0) for i in range(200)], "GEOID string, cluster_0 int, cluster_1 int, cluster_2 int, a double, b double, c double, d double")
    df = df.withColumn("total_household_days", F.lit(400))
    names = stage2.predictors(df)
    assert names == ["a", "b", "c", "d"]
    kept, dropped = stage2.independent(df, names)
    assert (kept, dropped) == (["a", "b"], ["c", "d"])
    fit = stage2.multinomial(df, kept, [0, 1, 2], 2)
    assert np.abs(fit.coef - truth).max() < 0.06
    se = np.sqrt(np.diag(fit.cov)).reshape(fit.coef.shape)
    assert (np.abs(fit.coef - truth) < 4 * se).all() and fit.null < fit.loglik
    table = stage2.coefficients(fit, spark)
    assert table.count() == 6 and table.filter("q_value is null").count() == 2
    assert stage2.two_sided(1.959963985) == pytest.approx(0.05, abs=1e-6)
    long = stage2.log_ratios(df, [0, 1, 2], 2)
    wls = stage2.weighted_regression(long.filter("cluster = 0"), "log_ratio", ["a", "b"], "total")
    assert np.abs(wls["coef"] - truth[0]).max() < 0.1 and wls["r2"] > 0.9


@pytest.mark.parametrize(("nations", "balance", "n"), [([1], "s_suppkey * 7.5", 1), ([1, 2, 3, 4], "5.0", 4), ([1, 2, 3, 4, 5], "s_suppkey * s_suppkey % 37.0", 5)])
def test_log_ratio_regression_where_nothing_is_determined(spark, tmp_path, nations, balance, n):
    ids = spark.range(400).select(F.col("id"), F.element_at(F.array(*map(F.lit, nations)), (F.col("id") % len(nations) + 1).cast("int")).alias("nation"))
    ids.selectExpr("id as c_custkey", "nation as c_nationkey").filter("c_custkey % 3 < 2 or c_nationkey > 2").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    ids.selectExpr("id as s_suppkey", "nation as s_nationkey").filter("s_suppkey % 50 >= s_nationkey").selectExpr("*", f"cast({balance} as double) as s_acctbal").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["log_ratio_regression"]).fetchall()
    got = registry.queries()["log_ratio_regression"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(got) == 24 and {r.nobs for r in got} == {n}
    assert {r.coefficient is None or r.coefficient != r.coefficient for r in got} == {n < 5}  # null or NaN, as in SQL


def test_second_stage_run(spark, tmp_path):
    from voltloom.plans import stage2_run

    rng = np.random.default_rng(5)
    rows = [(f"{i:012d}", *map(int, rng.multinomial(200, [0.5, 0.3, 0.2])), 200 if i % 9 else 3, float(x), float(2 * x), None) for i, x in enumerate(rng.normal(size=90))]
    wide_ = spark.createDataFrame(rows, "GEOID string, cluster_0 long, cluster_1 long, cluster_2 long, total_household_days long, x double, twice double, none double")
    fit = stage2_run.run(wide_, [0, 1, 2], str(tmp_path), command="test")
    made = json.loads((tmp_path / "stage2_manifest.json").read_text())
    assert made["places_total"] == 90 and made["places_with_enough"] == 80 and made["baseline_cluster"] == 0 and made["command"] == "test"
    assert files.listed(str(tmp_path)) == ["x"] == made["predictors_used"] and made["predictors_dependent"] == ["twice"] and made["predictors_without_values"] == ["none"]
    assert made["statistics"] == pytest.approx(fit.statistics()) and spark.read.parquet(str(tmp_path / "coefficients")).count() == 4
    again = stage2_run.run(wide_.withColumn("more", F.col("x") ** 2), [0, 1, 2], str(tmp_path), reuse=True)
    assert np.allclose(again.coef, fit.coef)
    with pytest.raises(ValueError, match="nothing"):
        stage2_run.run(wide_.limit(0), [0, 1, 2], str(tmp_path / "no"))


def test_clusters(spark):
    rng = np.random.default_rng(1)
    rows = [([float(v) for v in rng.normal(c, 0.1, 4)],) for c in (0, 5, 10) for _ in range(30)]
    df = spark.createDataFrame(rows, "profile array<double>")
    best, table = clusters.search_k(df, range(2, 5))
    assert best == 3 and table.count() == 3
    centers = sorted(r.centroid[0] for r in clusters.centroids(clusters.fit(df, 3), spark).collect())
    assert np.allclose(centers, [0, 5, 10], atol=0.2)
    assert clusters.choose_k([(2, 5.0, 0.5), (3, 4.0, 0.5)]) == 3 and clusters.choose_k([(2, 5.0, None), (3, 5.0, None)]) == 2
    assert clusters.silhouette(df.withColumn("cluster", F.lit(0))) is None


def test_complete_months_are_kept(spark):
    rng = np.random.default_rng(5)
    rows = [(a, dt.date(2024, m, 1) + dt.timedelta(int(d)), int(k)) for a in ("a", "b", "c", None) for m in (1, 2, 3) for d in rng.permutation(29)[: rng.integers(22, 30)] for k in range(rng.choice([1, 2, 3], p=[0.03, 0.9, 0.07]))]
    long = spark.createDataFrame([*rows, ("a", None, 1)], "account_identifier string, date date, k int")
    for days, least in ((2, 0.85), (2, 0.0), (3, 0.01), (1, 1.0)):
        want = long.withColumn("sample_month", F.date_format("date", "yyyyMM")).join(quality.complete_months(long, days, least), ["sample_month", "account_identifier"], "left_semi")
        got = quality.keep_complete_months(long, days, least)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < quality.keep_complete_months(long, 2, 0.85).count() < len(rows) * 3 // 4


def test_no_task_makes_the_readings_of_all_customers(spark, tmp_path, monkeypatch):
    spark.range(900).selectExpr("id as c_custkey", "cast(id as double) as c_acctbal").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(interval_queries, "ACCOUNTS", 100, raising=False)
    for name in ("completeness_of_full_months", "interval_day_qc_kinds"):
        made = registry.queries()[name](spark, str(tmp_path))
        sizes = sorted(r.n for r in interval_queries._made_days(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("account_identifier").alias("n")).collect())
        assert made.count() and 6 <= len(sizes) <= 9 and sizes[-1] < 200
    plan = registry.queries()["completeness_of_full_months"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "HashAggregate" not in plan


def test_quantiles(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(101)], "k string, v double")
    row = reports.quantiles(df, ["k"], "v", (0.25, 0.9)).first()
    assert (row.p25, row.p90) == (25.0, 90.0) and abs(reports.approximate_quantiles(df, ["k"], "v", (0.25,)).first().p25 - 25) <= 1


def test_files(spark, tmp_path, monkeypatch):
    made = files.synthetic_wide(spark, 3, "2023-08-01", 4)
    assert sorted(map(str, made.collect())) == sorted(map(str, files.synthetic_wide(spark, 3, "2023-08-01", 4).repartition(3).collect()))
    folder = tmp_path / "raw" / "202308"
    folder.mkdir(parents=True)
    made.toPandas().to_csv(folder / "usage_202308.csv", index=False)
    df = files.wide_csv(spark, str(tmp_path / "raw"))
    assert {r.sample_month for r in df.select("sample_month").collect()} == {"202308"}
    assert intervals.wide_to_long(df).count() == 3 * 4 * 48
    listed = files.listing(spark, str(tmp_path / "raw"))
    assert [r.month for r in files.storage_by_month(listed).orderBy("month").collect()] == ["202308", "TOTAL"]
    files.append_jsonl(str(tmp_path / "m.jsonl"), [{"s3_key": "a", "status": "ok", "timestamp": "t"}, {"s3_key": "b"}])
    good, bad = files.jsonl_manifest(spark, str(tmp_path / "m.jsonl"))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "p.json").write_text(json.dumps([{"millisUTC": "1699167600000", "price": "2.5"}, {"millisUTC": "x", "price": "1"}]))
    assert [r.price_cents for r in files.price_feed(spark, str(tmp_path / "p.json")).collect()] == [2.5]
    (tmp_path / "c.json").write_text('[["NAME", "state"],\n["x", "17"], ["y", null]]')
    assert files.header_rows(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "u.txt").write_text("# files\n\na/b.csv\ns3://other/c.csv\n")
    assert sorted(r.uri for r in files.uris(spark, str(tmp_path / "u.txt"), "s3://mine").collect()) == ["s3://mine/a/b.csv", "s3://other/c.csv"]
    monkeypatch.setenv("VOLT_X", "7")
    assert files.with_environment({"a": ["${VOLT_X}/${VOLT_Y:-z}"]}) == {"a": ["7/z"]}
    assert files.with_environment("${VOLT_NONE}") == "${VOLT_NONE}"
    (tmp_path / "c.yaml").write_text("{year: 2024, month: 5, to: '${VOLT_X}'}")
    config = files.load_config(str(tmp_path / "c.yaml"))
    assert config["to"] == "7" and files.configured_month(config) == (2024, 5)
    with pytest.raises(ValueError, match="month"):
        files.configured_month({"month": 13})
    (tmp_path / "c.yaml").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        files.load_config(str(tmp_path / "c.yaml"))
    at = files.run_manifest(str(tmp_path / "run"), "stage2_manifest", {"predictors_used": ["b", "a", "b"]}, k_min=3)
    assert json.loads(open(at).read())["k_min"] == 3 and files.listed(str(tmp_path / "run")) == ["a", "b"] and files.listed(str(tmp_path)) is None
    calls = []
    for _ in range(2):
        files.read_through(spark, str(tmp_path / "cache"), lambda: calls.append(1) or spark.range(3))
    assert len(calls) == 1 and files.row_count(spark, str(tmp_path / "cache")) == 3


def test_csv_files_are_read_by_their_own_headers(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    made = files.synthetic_wide(spark, 2, "2023-08-01", 1).toPandas()
    a, b = intervals.INTERVALS[:2]
    made[a], made[b] = 0.1, 0.2
    swapped = made.rename(columns={a: b, b: a})[[*made.columns[:5], a, b, *made.columns[7:]]]
    swapped[a], swapped[b] = 0.1, 0.2
    more = made.assign(**{intervals.INTERVALS[48]: 0.5, intervals.INTERVALS[49]: 0.6, "INTERVAL_LENGTH": 30})
    for name, f in (("a_202308", made), ("b_202309", swapped[[*reversed(swapped.columns)]]), ("c_202311", more)):
        f.to_csv(raw / f"{name}.csv", index=False)
    (raw / "empty.csv").write_text("")
    df = files.wide_csv(spark, str(raw))
    assert df.columns == [*intervals.IDS, *intervals.INTERVALS, "source_key", "sample_month"]
    rows = df.collect()
    assert len(rows) == 6 and all(r[a] == 0.1 and r[b] == 0.2 and r.ZIP_CODE.startswith("606") for r in rows)
    assert sorted((r.sample_month, r[intervals.INTERVALS[49]]) for r in rows if r.ACCOUNT_IDENTIFIER == "0") == [("202308", None), ("202309", None), ("202311", 0.6)]
    extra = {r.column_name: r for r in quality.dst_columns(df).collect()}
    assert {r.n_nulls for r in extra.values()} == {4} and quality.dst_days(df).count() == 1
    done = {r.source_key[-10:]: r.n_rows for r in files.ingest(spark, str(raw), str(tmp_path / "long")).filter("status = 'success'").collect()}
    assert done == {"202308.csv": 96, "202309.csv": 96, "202311.csv": 100}
    long = spark.read.parquet(str(tmp_path / "long"))
    assert intervals.of_sample_month(long).count() == 96 and {"date", "hour", "weekday", "is_weekend"} < set(long.columns)  # all of August's, none of the others'
    files.write_csv(spark.range(2).selectExpr("id", "id * 2 as twice"), str(tmp_path / "out"))
    assert files.inferred_csv(spark, str(tmp_path / "out")).dtypes == [("id", "int"), ("twice", "int")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "w.tsv").write_text("Zip\tZip4\n60601\t0001\n")
    assert files.tsv(spark, str(tmp_path / "t")).first().Zip4 == "0001"
    made.drop(columns="ZIP_CODE").to_csv(raw / "d_202312.csv", index=False)
    with pytest.raises(ValueError, match="ZIP_CODE"):
        files.wide_csv(spark, str(raw))
    with pytest.raises(ValueError, match="1 files"):
        files.ingest(spark, str(raw), str(tmp_path / "again"))
    (raw / "other.csv").write_text("a,b\n1,2\n")
    report = {r.source_key[-9:]: (r.status, r.n_rows, r.error) for r in files.ingest(spark, str(raw), str(tmp_path / "again"), most_errors=2).collect()}
    assert report["02312.csv"] == ("error", 0, "lacks ZIP_CODE") and report["other.csv"][0] == "error" and len(report) == 5
    batch = files.map_batches(spark.range(25).coalesce(1), lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]), "n long", 10)
    assert sorted(r.n for r in batch.collect()) == [5, 10, 10]
    with pytest.raises(ValueError, match="header"):
        (tmp_path / "no").mkdir()
        (tmp_path / "no" / "x.csv").write_text("")
        files.csv_by_name(spark, str(tmp_path / "no"))


def test_quantiles_by_search(spark):
    rng = np.random.default_rng(2)
    own = {"wide": np.exp(20 * rng.normal(size=400)) * rng.choice([-1, 1], 400), "few": rng.integers(0, 3, 400).astype(float), "ends": np.where(rng.random(400) < 0.5, 1.7e308, -1.7e308), "near": 1 + np.arange(400) * 2.0**-52}
    df = spark.createDataFrame([(*map(float, r), None, 7 if i == 3 else None) for i, r in enumerate(zip(*own.values()))], "wide double, few double, ends double, near double, none double, one int").repartition(3)
    at = (0.0, 0.25, 0.5, 1.0)
    for bins in (4096,):
        got = reports.quantiles_by_search(df, df.columns, at, bins)
        for c in ("wide", "few", "near"):
            assert np.allclose(got[c], np.quantile(own[c], at), rtol=1e-15 if c == "near" else 1e-9, atol=0), c
        assert got["none"] == [None] * 4 and got["one"] == [7.0] * 4 and got["ends"][0] == -1.7e308 and got["ends"][-1] == 1.7e308
    odd = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), -float("inf"), 0.0, -0.0)], "v double")
    assert str(reports.quantiles_by_search(odd, ["v"], (0.0, 0.25, 0.5, 0.75, 1.0))["v"]).replace("-0.0", "0.0") == "[-inf, 0.0, 0.0, inf, nan]"


def test_describe_sends_no_column_to_a_task(spark):
    df = spark.range(0, 200_000, 1, 8).selectExpr("id * 0.37D as v", "id % 5 as k")
    rows = {r.column_name: r for r in reports.describe(df, ["v", "k"]).collect()}
    assert rows["v"].p50 == pytest.approx(99_999.5 * 0.37) and (rows["k"].p25, rows["k"].p75, rows["k"].n) == (1.0, 3.0, 200_000)
    assert "percentile" not in reports.describe(df, ["v"])._jdf.queryExecution().toString()
    assert reports.describe(df.filter("k > 9"), ["v"]).first()[1:] == (0, *[None] * 7)


def test_quantiles_by_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, n in (("a", 500), ("b", 1), ("c", 40)) for v in np.round(np.exp(3 * rng.normal(size=n)), 1)] + [(None, 2.0), (None, 4.0), ("d", None), ("e", 5.0), ("e", 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    at = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {r.k: r[1:] for r in reports.quantiles_by_ranges(df, ["k"], "v", at, 16).collect()}
    assert set(got) == {"a", "b", "c", None, "e"}
    for k, own in got.items():
        assert np.allclose(own, np.quantile([v for x, v in rows if x == k and v is not None], at))
    assert np.allclose(reports.quantiles_by_ranges(df, [], "v", (0.3,)).first()[0], np.quantile([v for _, v in rows if v is not None], 0.3))


def test_streaming_hours(spark, tmp_path):
    rows = [("a", "z", dt.datetime(2023, 8, 1, h, m), 1.0) for h in range(6) for m in (0, 30)]
    df = spark.createDataFrame(rows, "account_identifier string, zip_code string, datetime timestamp, kwh double")
    df.write.parquet(str(tmp_path / "in"))
    stream = tables.hourly_load(tables.readings(spark, str(tmp_path / "in"), df.schema), "1 hour")
    tables.run_once(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() >= 4 and {r.kwh_hour for r in got.collect()} == {2.0}


def test_streaming_prices_and_repeats(spark, tmp_path):
    rows = [(dt.datetime(2023, 8, 1, h, m), float(h)) for h in range(4) for m in range(0, 60, 5)]
    prices = spark.createDataFrame(rows, "datetime_local timestamp, price_cents double")
    prices.write.parquet(str(tmp_path / "p"))
    tables.run_once(tables.hourly_prices(tables.readings(spark, str(tmp_path / "p"), prices.schema), "1 hour"), str(tmp_path / "po"), str(tmp_path / "pc"))
    got = {r.datetime_local.hour: (r.price_cents, r.n_intervals) for r in spark.read.parquet(str(tmp_path / "po")).collect()}
    assert len(got) >= 2 and all(v == (float(h), 12) for h, v in got.items())
    twice = [("a", dt.datetime(2023, 8, 1, 1), 1.0), ("a", dt.datetime(2023, 8, 1, 1), 1.0), ("b", dt.datetime(2023, 8, 1, 1), 2.0)]
    df = spark.createDataFrame(twice, "account_identifier string, datetime timestamp, kwh double")
    df.write.parquet(str(tmp_path / "r"))
    tables.run_once(tables.first_readings(tables.readings(spark, str(tmp_path / "r"), df.schema, 1)), str(tmp_path / "ro"), str(tmp_path / "rc"))
    assert sorted(r.account_identifier for r in spark.read.parquet(str(tmp_path / "ro")).collect()) == ["a", "b"]


def test_kmeans_queries_do_the_whole_job(spark, small, monkeypatch):
    from voltloom.plans import registry

    starts, samples = [], []
    fit, silhouette = clusters.KMeans, clusters.silhouette
    monkeypatch.setattr(clusters, "KMeans", lambda **a: starts.append((a["k"], a["seed"])) or fit(**a))
    monkeypatch.setattr(clusters, "silhouette", lambda df, most, *a: samples.append(most) or silhouette(df, most, *a))
    assert registry.queries()["kmeans_search"](spark, small).count() == 3
    assert starts == [(k, 42 + i) for k in (2, 3, 4) for i in range(3)] and samples == [5000] * 3
    starts.clear()
    registry.queries()["kmeans_fit"](spark, small)
    assert starts == [(8, 42 + i) for i in range(3)]
