"""Queries on codes, places, clusters and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from voltloom.functions import numbers, strings, times
from voltloom.operators import census, clusters, geography, reports, stage2
from voltloom.plans.book import query, rounded, table
from voltloom.sources import files

K = (0, 1, 2, 3, 4)


@query("SELECT c_custkey, lpad(CAST(c_nationkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || CAST(c_custkey % 10 AS VARCHAR) AS geoid FROM customer")
def geoid_build(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.geoid(F.col("c_nationkey") % 100, k % 1000, k, k % 10).alias("geoid"))


@query("""WITH z AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' ' || lpad(CAST(c_custkey AS VARCHAR), 9, '6') WHEN 1 THEN '60601-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 2 THEN '  ' ELSE '60601 ' END AS raw FROM customer)
    SELECT c_custkey, CASE WHEN trim(raw) = '' THEN NULL WHEN regexp_full_match(trim(raw), '[0-9]{9}') THEN substr(trim(raw), 1, 5) || '-' || substr(trim(raw), 6) ELSE trim(raw) END AS zip4 FROM z""")
def zip4_normalise(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), F.lpad(k.cast("string"), 9, "6"))).when(k % 4 == 1, F.concat(F.lit("60601-"), F.lpad((k % 10000).cast("string"), 4, "0"))).when(k % 4 == 2, "  ").otherwise("60601 ")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.zip4(raw).alias("zip4"))


@query("""WITH z AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'zip ' || s_suppkey WHEN 1 THEN '(' || s_suppkey || ')-4' ELSE 'none' END AS raw FROM supplier), d AS (SELECT s_suppkey, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM z)
    SELECT s_suppkey, CASE WHEN d = '' THEN NULL WHEN length(d) < 5 THEN lpad(d, 5, '0') ELSE d END AS zip FROM d""")
def zip_digits(spark, sf_dir):
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("zip "), k)).when(k % 3 == 1, F.concat(F.lit("("), k, F.lit(")-4"))).otherwise("none")
    return table(spark, sf_dir, "supplier").select("s_suppkey", strings.digits_zfill(raw, 5).alias("zip"))


@query("""WITH z AS (SELECT o_orderkey, ' ' || lpad(CAST(o_custkey AS VARCHAR), 10 + CAST(o_orderkey % 6 AS INTEGER), '1') || ' ' AS raw FROM orders)
    SELECT o_orderkey, CASE WHEN length(trim(raw)) >= 12 THEN substr(trim(raw), 1, 12) END AS block_group FROM z""")
def block_groups(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.lpad(F.col("o_custkey").cast("string"), (10 + F.col("o_orderkey") % 6).cast("int"), F.lit("1")), F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.block_group(raw).alias("block_group"))


@query("SELECT event_id, date_diff('hour', TIMESTAMP '2024-01-01', ts) - CASE WHEN ts < TIMESTAMP '2024-01-01' AND date_trunc('hour', ts) <> ts THEN -1 ELSE 0 END AS hours FROM events")
def hours_apart(spark, sf_dir):
    start = F.lit("2024-01-01").cast("date").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", times.hours_between(start, F.col("ts")).alias("hours"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y%m') END AS month FROM orders")
def yyyymm_extract(spark, sf_dir):
    k = F.col("o_orderkey")
    own = F.when(k % 5 > 0, F.concat(F.lit("usage_99-"), F.date_format("o_orderdate", "yyyyMM"), F.lit(".csv"))).otherwise("usage_209913.csv")
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.year_month(own, 1990).alias("month"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber * 4 AS hour, 30 AS minute, CAST(l_shipdate + to_hours(l_linenumber * 4) + to_minutes(30) AS VARCHAR) AS stamp FROM lineitem""")
def interval_stamps(spark, sf_dir):
    hour, minute = strings.interval_clock(F.format_string("INTERVAL_HR%02d30_ENERGY_QTY", F.col("l_linenumber") * 4))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", hour.alias("hour"), minute.alias("minute"), "l_shipdate")
    return own.select("l_orderkey", "l_linenumber", "hour", "minute", times.end_stamp(F.to_date("l_shipdate"), F.col("hour"), F.col("minute")).cast("string").alias("stamp"))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 3 > 0 THEN ln(o_totalprice + 1) END, 4) AS logged, CAST(CASE WHEN o_orderkey % 7 > 0 THEN o_custkey END AS DOUBLE) AS kept,
    round(CASE WHEN o_orderkey % 4 > 0 THEN o_custkey / (o_orderkey % 4) * 100 END, 4) AS pct FROM orders""")
def safe_numbers(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    signed = F.when(k % 3 > 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    code = numbers.sentinel_null(F.when(k % 7 > 0, c).otherwise(-666666666))
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", numbers.log_count(signed).alias("logged"), code.cast("double").alias("kept"), numbers.safe_percent(c, k % 4).alias("pct")))


_SPEC = [
    census.Feature("customers", "C_ALL"),
    census.Feature("urgent_pct", "C_BUILD + C_AUTO", "C_ALL", "percent"),
    census.Feature("log_customers", "C_ALL", None, "log"),
    census.Feature("balance_ratio", "BALANCE", "C_ALL", "ratio"),
    census.Feature("machine_pct", "C_MACH", "C_ODD", "percent"),
]


def _raw(spark, sf_dir):
    seg, odd = F.col("c_mktsegment"), F.col("c_custkey") % 2 == 1
    own = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("C_ALL"), F.count_if(seg == "BUILDING").alias("C_BUILD"), F.count_if(seg == "AUTOMOBILE").alias("C_AUTO"), F.count_if(seg == "MACHINERY").alias("C_MACH"), F.count_if(odd & (F.col("c_nationkey") % 3 > 0)).alias("C_ODD"), F.sum("c_acctbal").alias("BALANCE"))
    return own.withColumn("GEOID", strings.zfill(F.col("c_nationkey"), 12))


_RAW = """WITH n AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 12, '0') AS "GEOID", count(*) AS a, count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')) AS u, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m,
    count(*) FILTER (WHERE c_custkey % 2 = 1 AND c_nationkey % 3 > 0) AS o, sum(c_acctbal) AS b FROM customer GROUP BY c_nationkey),
    f AS (SELECT "GEOID", CAST(a AS DOUBLE) AS customers, u / a * 100 AS urgent_pct, ln(a + 1) AS log_customers, b / a AS balance_ratio, CASE WHEN o > 0 THEN m / o * 100 END AS machine_pct FROM n)"""


@query(f'{_RAW} SELECT "GEOID", customers, round(urgent_pct, 4) AS urgent_pct, round(log_customers, 4) AS log_customers, round(balance_ratio, 4) AS balance_ratio, round(machine_pct, 4) AS machine_pct FROM f')
def census_features(spark, sf_dir):
    return rounded(census.build(_raw(spark, sf_dir), _SPEC))


@query(f"""{_RAW} SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM f UNION ALL SELECT 'unique_ids', CAST(count(DISTINCT "GEOID") AS DOUBLE) FROM f UNION ALL SELECT 'bad_id_length', 0.0
    UNION ALL SELECT 'outside_urgent_pct', CAST(count(*) FILTER (WHERE urgent_pct NOT BETWEEN 0 AND 100) AS DOUBLE) FROM f UNION ALL SELECT 'outside_machine_pct', CAST(count(*) FILTER (WHERE machine_pct NOT BETWEEN 0 AND 100) AS DOUBLE) FROM f""")
def census_validate(spark, sf_dir):
    return census.validate(census.build(_raw(spark, sf_dir), _SPEC))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
    SELECT k, n_name AS name, customers, suppliers FROM a JOIN b USING (k) JOIN nation ON k = n_nationkey""")
def census_chunks(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return census.join_chunks([names, a, b], ["k"])


#: Made-up counts of every raw column of the 47 predictors; a few whole counts are 0, a few values a survey's codes.
_CODES = census.raw_codes(census.FEATURES)
_COUNT = "CASE WHEN (c_custkey + {0}) % 41 = 0 THEN -666666666 WHEN (c_custkey * 3 + {0}) % 37 = 0 THEN 0 ELSE (c_custkey * 131 + {0} * 977) % 503 END"


def _predictor_sql(f):
    terms = lambda e: " + ".join(f'"{c}"' for c in numbers.codes(e))
    own = f"CASE WHEN {terms(f.denominator)} > 0 THEN ({terms(f.value)}) / ({terms(f.denominator)}) * 100 END" if f.denominator else terms(f.value)
    return f'round(CAST({own} AS DOUBLE), 4) AS "{f.name}"'


@query(f"""WITH r AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS "GEOID", {", ".join(f'nullif({_COUNT.format(i)}, -666666666) AS "{c}"' for i, c in enumerate(_CODES))} FROM customer)
    SELECT "GEOID", {", ".join(map(_predictor_sql, census.FEATURES))} FROM r""")
def census_predictors(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(strings.zfill(F.col("c_custkey"), 12).alias("GEOID"), *[F.expr(_COUNT.format(i)).alias(c) for i, c in enumerate(_CODES)])
    return rounded(census.build(raw, census.FEATURES))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS balance FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
    SELECT k, customers, balance FROM a LEFT JOIN b USING (k)""")
def census_attached(spark, sf_dir):
    """Facts of some places joined to features of all."""
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    more = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("balance"))
    return rounded(census.attach(own, more, "k"))


def _walk(spark, sf_dir):
    """Suppliers' nations as zip codes, suppliers as block groups; nation 0 is unknown."""
    return table(spark, sf_dir, "supplier").filter("s_nationkey > 0").select(strings.zfill(F.col("s_nationkey"), 5).alias("zip_code"), strings.zfill(F.col("s_suppkey") % 50, 12).alias("GEOID")).distinct()


def _assigned(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("account_identifier"), strings.zfill(F.col("c_nationkey"), 5).alias("zip_code"), (F.col("c_custkey") % 5).cast("int").alias("cluster"))


_WALK = """WITH w AS (SELECT DISTINCT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zip_code, lpad(CAST(s_suppkey % 50 AS VARCHAR), 12, '0') AS "GEOID" FROM supplier WHERE s_nationkey > 0),
    a AS (SELECT CAST(c_custkey AS VARCHAR) AS account_identifier, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip_code, c_custkey % 5 AS cluster FROM customer),
    g AS (SELECT zip_code, min("GEOID") AS "GEOID" FROM w GROUP BY 1), j AS (SELECT * FROM a JOIN g USING (zip_code))"""
_COUNTS = ", ".join(f"count(*) FILTER (WHERE cluster = {k}) AS cluster_{k}" for k in K)


@query(f'{_WALK} SELECT zip_code, "GEOID" FROM g')
def crosswalk_first(spark, sf_dir):
    return geography.first_group(_walk(spark, sf_dir))


@query(f"""{_WALK}, n AS (SELECT zip_code, count(DISTINCT "GEOID") AS n FROM w GROUP BY 1) SELECT count(*) AS n_zip_codes, count(*) FILTER (WHERE n > 1) AS n_fan_out, round(avg(CASE WHEN n > 1 THEN 100.0 ELSE 0 END), 4) AS pct_fan_out, max(n) AS most_groups FROM n""")
def crosswalk_fanout(spark, sf_dir):
    return rounded(geography.fan_out(_walk(spark, sf_dir)))


@query(f"{_WALK} SELECT account_identifier, zip_code, cluster FROM a WHERE zip_code NOT IN (SELECT zip_code FROM w)")
def crosswalk_unmatched(spark, sf_dir):
    return geography.unmatched(_assigned(spark, sf_dir), _walk(spark, sf_dir)).select("account_identifier", "zip_code", "cluster")


def _joined(spark, sf_dir):
    return geography.attach(_assigned(spark, sf_dir), geography.first_group(_walk(spark, sf_dir)))


def _wide(spark, sf_dir):
    return geography.cluster_counts(_assigned(spark, sf_dir), geography.first_group(_walk(spark, sf_dir)), list(K))


@query(f'{_WALK} SELECT "GEOID", {_COUNTS}, count(*) AS total_household_days FROM j GROUP BY 1')
def bg_cluster_counts(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(f'{_WALK} SELECT "GEOID", {_COUNTS}, count(*) AS total_household_days FROM j GROUP BY 1 HAVING count(*) >= 50')
def bg_with_enough(spark, sf_dir):
    return stage2.enough(_wide(spark, sf_dir), 50)


_SHARES = f'{_WALK}, s AS (SELECT "GEOID", cluster, n, n / sum(n) OVER (PARTITION BY "GEOID") AS share FROM (SELECT "GEOID", cluster, count(*) AS n FROM j GROUP BY 1, 2))'


@query(f'{_SHARES} SELECT "GEOID", cluster, n, round(share, 4) AS share FROM s')
def bg_cluster_shares(spark, sf_dir):
    return rounded(geography.shares(_joined(spark, sf_dir)))


@query(f"""{_WALK} SELECT "GEOID", count(DISTINCT account_identifier) AS n_households, CASE WHEN count(DISTINCT account_identifier) = 1 THEN '1' WHEN count(DISTINCT account_identifier) = 2 THEN '2' WHEN count(DISTINCT account_identifier) <= 5 THEN '3-5'
    WHEN count(DISTINCT account_identifier) <= 10 THEN '6-10' WHEN count(DISTINCT account_identifier) <= 20 THEN '11-20' ELSE '20+' END AS bucket FROM j GROUP BY 1""")
def bg_density_buckets(spark, sf_dir):
    return geography.density(_joined(spark, sf_dir))


@query(f"""{_WALK}, d AS (SELECT "GEOID", count(DISTINCT account_identifier) AS n FROM j GROUP BY 1) SELECT count(*) AS n_groups, round(avg(n), 4) AS mean_households, round(quantile_cont(n, 0.5), 4) AS median_households, round(quantile_cont(n, 0.1), 4) AS p10, round(quantile_cont(n, 0.9), 4) AS p90, count(*) FILTER (WHERE n >= 50) AS n_enough FROM d""")
def density_summary(spark, sf_dir):
    return rounded(geography.density_summary(geography.density(_joined(spark, sf_dir))))


@query(f"""{_WALK}, k AS (SELECT "GEOID", {_COUNTS}, count(*) AS n FROM j GROUP BY 1), v AS ({" UNION ALL ".join(f"SELECT {k} AS cluster, var_samp(cluster_{k} / n) AS variance FROM k" for k in K)})
    SELECT cluster, round(variance, 4) AS variance, CASE WHEN variance < 0.01 THEN 'low' WHEN variance < 0.02 THEN 'moderate' ELSE 'good' END AS verdict FROM v""")
def share_variance(spark, sf_dir):
    return rounded(geography.share_variance(geography.shares(_joined(spark, sf_dir)), list(K)))


@query(f"""{_WALK}, k AS (SELECT "GEOID", {_COUNTS} FROM j GROUP BY 1) {" UNION ALL ".join(f"SELECT 'cluster_{k}' AS cluster, count(*) FILTER (WHERE cluster_{k} = 0) AS n_zeros, round(count(*) FILTER (WHERE cluster_{k} = 0) / count(*) * 100, 4) AS pct_zeros FROM k" for k in K)}""")
def zero_cells(spark, sf_dir):
    return rounded(geography.zero_cells(_wide(spark, sf_dir), list(K)))


@query(f"""{_WALK}, k AS (SELECT "GEOID", {_COUNTS}, count(*) AS n FROM j GROUP BY 1) {" UNION ALL ".join(f'SELECT "GEOID", {k} AS cluster, round((cluster_{k} + 0.5) / (n + 2.5), 4) AS share, round(ln(((cluster_{k} + 0.5) / (n + 2.5)) / ((cluster_0 + 0.5) / (n + 2.5))), 4) AS log_ratio, CAST(n AS DOUBLE) AS total FROM k' for k in K[1:])}""")
def log_ratio(spark, sf_dir):
    return rounded(stage2.log_ratios(_wide(spark, sf_dir), list(K), 0).select("GEOID", "cluster", "share", "log_ratio", "total"))


@query("""WITH p AS (SELECT o_orderkey, o_orderstatus AS cluster, CASE WHEN o_orderkey % 11 > 0 THEN (o_orderkey * 7919 % 10007) / 10007 END AS p_value FROM orders),
    n AS (SELECT *, count(p_value) OVER (PARTITION BY cluster) AS m, rank() OVER (PARTITION BY cluster, p_value IS NULL ORDER BY p_value) + count(*) OVER (PARTITION BY cluster, p_value) - 1 AS k FROM p)
    SELECT o_orderkey, cluster, round(CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / k) OVER (PARTITION BY cluster, p_value IS NULL ORDER BY p_value DESC)) END, 4) AS q_value FROM n""")
def bh_adjust(spark, sf_dir):
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("cluster"), F.when(k % 11 > 0, (k * 7919 % 10007) / 10007).alias("p_value"))
    return rounded(stage2.adjusted(own, ["cluster"]).select("o_orderkey", "cluster", "q_value"))


_CENTERS = [[1.0 / 8] * 64, [-1.0 / 8] * 64, [(1 if i % 2 else -1) / 8 for i in range(64)]]


def _near(spark, sf_dir):
    return clusters.nearest(table(spark, sf_dir, "embeddings"), _CENTERS, "embedding")


_NEAR = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), c(cluster, u) AS (VALUES {", ".join(f"({i}, {c}::DOUBLE[])" for i, c in enumerate(_CENTERS))}),
    d AS (SELECT vec_id, cluster, list_sum(list_transform(list_zip(v, u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM e, c), b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS r FROM d)"""


@query(f"{_NEAR} SELECT vec_id, cluster, round(distance, 4) AS distance FROM b WHERE r = 1")
def nearest_centroid(spark, sf_dir):
    return rounded(_near(spark, sf_dir).select("vec_id", "cluster", "distance"))


@query(f"{_NEAR} SELECT cluster, count(*) AS n FROM b WHERE r = 1 GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return clusters.sizes(_near(spark, sf_dir))


@query(f"{_NEAR} SELECT round(sum(distance), 4) AS inertia FROM b WHERE r = 1")
def cluster_inertia(spark, sf_dir):
    return rounded(clusters.inertia(_near(spark, sf_dir)))


@query("""WITH e AS (SELECT vec_id AS i, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    d AS (SELECT a.i, a.label AS own, b.label AS other, sqrt(greatest(0, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS d FROM e a JOIN e b ON a.i <> b.i),
    m AS (SELECT i, own, other, avg(d) AS m FROM d GROUP BY ALL), s AS (SELECT i, max(m) FILTER (WHERE own = other) AS a, min(m) FILTER (WHERE own <> other) AS b FROM m GROUP BY 1)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select("embedding", F.col("label").alias("cluster"))
    return spark.createDataFrame([(clusters.silhouette(own, vector_col="embedding"),)], "silhouette double").select(F.round("silhouette", 4).alias("silhouette"))


@query()
def kmeans_fit(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    model = clusters.fit(own, 8, vector_col="embedding")
    out = model.transform(own.withColumn("features", array_to_vector("embedding")))
    return out.select("vec_id", F.col("prediction").alias("cluster"))


@query()
def kmeans_search(spark, sf_dir):
    return clusters.search_k(table(spark, sf_dir, "embeddings").select("embedding"), range(2, 5), vector_col="embedding")[1]


def _predicted(spark, sf_dir):
    wide = _wide(spark, sf_dir)
    x = table(spark, sf_dir, "supplier").groupBy(strings.zfill(F.col("s_suppkey") % 50, 12).alias("GEOID")).agg(F.avg("s_acctbal").alias("balance"), F.avg((F.col("s_suppkey") % 7).cast("double")).alias("mix"))
    return wide.join(x, "GEOID")


def _model(spark, sf_dir):
    return reports.standardised(_predicted(spark, sf_dir), ["balance", "mix"])


@query()
def multinomial_fit(spark, sf_dir):
    own = stage2.complete_cases(_model(spark, sf_dir), ["balance", "mix"])
    names, _ = stage2.independent(own, ["balance", "mix"])
    return stage2.coefficients(stage2.multinomial(own, names, list(K), stage2.baseline(own, list(K))), spark)


def _fit_sql(kind, weight):
    """Least squares on an intercept and two predictors, by the inverse of the 3 x 3 matrix of normal equations."""
    return f"""SELECT cluster, '{kind}' AS kind, unnest(['(Intercept)', 'balance', 'mix']) AS predictor, round(unnest([c0, c1, c2]), 4) AS coefficient,
        round(unnest([sqrt(greatest(0, i00 * s2)), sqrt(greatest(0, i11 * s2)), sqrt(greatest(0, i22 * s2))]), 4) AS std_err, round(1 - rss / (syy - sy * sy / s), 4) AS r_squared, n AS nobs
        FROM (SELECT *, rss / greatest(n - 3, 1) AS s2 FROM (SELECT *, greatest(0, syy - c0 * sy - c1 * say - c2 * sby) AS rss
        FROM (SELECT *, i00 * sy + i01 * say + i02 * sby AS c0, i01 * sy + i11 * say + i12 * sby AS c1, i02 * sy + i12 * say + i22 * sby AS c2
        FROM (SELECT *, (saa * sbb - sab * sab) / d AS i00, (sb * sab - sa * sbb) / d AS i01, (sa * sab - sb * saa) / d AS i02, (s * sbb - sb * sb) / d AS i11, (sa * sb - s * sab) / d AS i12, (s * saa - sa * sa) / d AS i22
        FROM (SELECT *, s * (saa * sbb - sab * sab) - sa * (sa * sbb - sab * sb) + sb * (sa * sab - saa * sb) AS d
        FROM (SELECT cluster, count(*) AS n, sum(w) AS s, sum(w * a) AS sa, sum(w * b) AS sb, sum(w * a * a) AS saa, sum(w * a * b) AS sab, sum(w * b * b) AS sbb, sum(w * y) AS sy, sum(w * a * y) AS say, sum(w * b * y) AS sby, sum(w * y * y) AS syy
        FROM (SELECT *, {weight} AS w FROM l) GROUP BY cluster))))))"""


@query(f"""{_WALK}, k AS (SELECT "GEOID", {_COUNTS}, count(*) AS n FROM j GROUP BY 1), x AS (SELECT lpad(CAST(s_suppkey % 50 AS VARCHAR), 12, '0') AS "GEOID", avg(s_acctbal) AS a, avg(CAST(s_suppkey % 7 AS DOUBLE)) AS b FROM supplier GROUP BY 1),
    m AS (SELECT k.*, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b FROM k JOIN x USING ("GEOID")),
    l AS ({" UNION ALL ".join(f"SELECT {k} AS cluster, CAST(n AS DOUBLE) AS total, a, b, ln((cluster_{k} + 0.5) / (cluster_0 + 0.5)) AS y FROM m" for k in K[1:])}) {_fit_sql('wls', 'total')} UNION ALL {_fit_sql('ols', '1.0')}""")
def log_ratio_regression(spark, sf_dir):
    long = stage2.log_ratios(reports.z_scored(_predicted(spark, sf_dir), ["balance", "mix"]), list(K), 0)
    rows = stage2.plane_regressions(long, "log_ratio", "balance", "mix", {"wls": "total", "ols": None}, "cluster")
    return rounded(spark.createDataFrame(rows, "cluster int, kind string, predictor string, coefficient double, std_err double, r_squared double, nobs long"))


@query("""WITH m AS (SELECT strftime(o_orderdate + INTERVAL 10 YEAR, '%Y%m') AS month, o_orderkey * 1000 AS bytes FROM orders)
    SELECT coalesce(month, 'TOTAL') AS month, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / 1073741824.0, 4) AS gib FROM m GROUP BY ROLLUP (month)""")
def storage_report(spark, sf_dir):
    listed = table(spark, sf_dir, "orders").select(F.concat(F.lit("/data/usage_"), F.date_format(F.add_months("o_orderdate", 120), "yyyyMM"), F.lit(".csv")).alias("path"), (F.col("o_orderkey") * 1000).alias("bytes"))
    return rounded(files.storage_by_month(listed))


@query("""WITH f AS (SELECT '/data/' || CASE WHEN o_orderkey % 4 = 0 THEN 'usage' ELSE 'usage_' || strftime(o_orderdate + INTERVAL 10 YEAR, '%Y%m') END || '_' || o_orderkey % 7 || '.csv' AS path, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%Y%m') END AS month FROM orders)
    SELECT month, month || '/' || split_part(path, '/', -1) AS key, count(*) AS n FROM f WHERE month BETWEEN '200501' AND '200712' GROUP BY ALL""")
def files_of_months(spark, sf_dir):
    month = F.date_format(F.add_months("o_orderdate", 120), "yyyyMM")
    name = F.when(F.col("o_orderkey") % 4 == 0, "usage").otherwise(F.concat(F.lit("usage_"), month))
    listed = table(spark, sf_dir, "orders").select(F.concat(F.lit("/data/"), name, F.lit("_"), F.col("o_orderkey") % 7, F.lit(".csv")).alias("path"))
    return files.with_month(listed, "200501", "200712").groupBy("month", "key").agg(F.count("*").alias("n"))
