"""AGG-1..13, AGG-20 and SRT-3 queries."""

from pyspark.sql import functions as F

from crashrisk.operators import aggregates as A
from crashrisk.operators import joins as J
from crashrisk.operators import quantiles as Q
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query


@query("agg1_stats_by_year", V.with_views("crashes", then="""
SELECT year, count(*) AS crashes, CAST(coalesce(sum(numb_fatal_injr), 0) AS BIGINT) AS fatalities,
  CAST(coalesce(sum(numb_nonfatal_injr), 0) AS BIGINT) AS injuries FROM crashes GROUP BY year"""))
def _(spark, d):
    return A.stats_by_year(V.crashes(spark, d))


@query("agg2_value_counts", V.with_views("crashes", then="""
SELECT weath_cond_descr, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM crashes GROUP BY weath_cond_descr"""))
def _(spark, d):
    return A.value_counts(V.crashes(spark, d), "weath_cond_descr", normalize=True).withColumn("share", F.round("share", 6))


@query("agg3_top_cities_of_state", V.with_views("accidents", then="""
SELECT upper(trim(State)) AS state, lower(trim(City)) AS city, count(*) AS n FROM accidents
WHERE upper(trim(State)) = 'NY' GROUP BY 1, 2 ORDER BY n DESC, state, city LIMIT 10"""))
def _(spark, d):
    tidy = V.accidents(spark, d).select(F.upper(F.trim("State")).alias("state"), F.lower(F.trim("City")).alias("city"))
    return A.top_groups(tidy.where("state = 'NY'"), ["state", "city"], 10)


@query("srt3_top_groups", """
SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 10""")
def _(spark, d):
    return A.top_groups(V.table(spark, d, "part"), ["p_brand", "p_type"], 10)


@query("agg4_breakdown_map", V.with_views("crashes", then="""
SELECT CAST(year AS VARCHAR) AS year, count(*) AS n FROM crashes GROUP BY year"""))
def _(spark, d):
    return A.breakdown_map(V.crashes(spark, d), "year", "rows_per_year").select(
        F.explode("rows_per_year").alias("year", "n"))


@query("agg5_reload_check", V.with_views("crashes", then="""
SELECT coalesce(severity_3class, '(null)') AS severity, count(*) AS rows, min(year) AS min_year, max(year) AS max_year
FROM crashes GROUP BY 1"""))
def _(spark, d):
    return A.reload_check(V.crashes(spark, d))


@query("agg6_null_rates", V.with_views("crashes", then="""
SELECT column_name, round(null_rate, 6) AS null_rate FROM (
  SELECT 'weath_cond_descr' AS column_name, avg(CASE WHEN weath_cond_descr IS NULL THEN 1 ELSE 0 END) AS null_rate FROM crashes
  UNION ALL SELECT 'speed_limit', avg(CASE WHEN speed_limit IS NULL THEN 1 ELSE 0 END) FROM crashes
  UNION ALL SELECT 'ems_hotspot_flag', avg(CASE WHEN ems_hotspot_flag IS NULL THEN 1 ELSE 0 END) FROM crashes
  UNION ALL SELECT 'lat', avg(CASE WHEN lat IS NULL THEN 1 ELSE 0 END) FROM crashes)"""))
def _(spark, d):
    rates = A.null_rates(V.crashes(spark, d), ["weath_cond_descr", "speed_limit", "ems_hotspot_flag", "lat"])
    return rates.withColumn("null_rate", F.round("null_rate", 6))


@query("agg7_validation_summary", V.with_views("crashes", then="""
SELECT year, count(*) AS row_count,
  round(count(*) FILTER (WHERE lat IS NULL) * 100.0e0 / count(*), 6) AS lat_null_pct,
  round(count(*) FILTER (WHERE lon IS NULL) * 100.0e0 / count(*), 6) AS lon_null_pct,
  round(count(*) FILTER (WHERE crash_datetime_clean IS NULL) * 100.0e0 / count(*), 6) AS datetime_null_pct,
  round(count(*) FILTER (WHERE severity_3class = 'Unknown') * 100.0e0 / count(*), 6) AS severity_null_pct,
  count(*) FILTER (WHERE severity_3class = 'Fatal') AS n_fatal, count(*) FILTER (WHERE severity_3class = 'Injury') AS n_injury,
  count(*) FILTER (WHERE severity_3class = 'No Injury') AS n_no_injury,
  count(*) FILTER (WHERE severity_3class = 'Unknown') AS n_unknown FROM crashes GROUP BY year"""))
def _(spark, d):
    out = A.validation_summary(V.crashes(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("_pct") else F.col(c) for c in out.columns])


@query("agg8_column_profile", """
SELECT 'event_id' AS column_name, CAST(0 AS BIGINT) AS null_count, round(0.0e0, 6) AS null_pct, min(event_id::VARCHAR) AS low, max(event_id::VARCHAR) AS high FROM events
UNION ALL SELECT 'event_type', count(*) FILTER (WHERE event_type IS NULL), round(count(*) FILTER (WHERE event_type IS NULL) * 100.0e0 / count(*), 6), min(event_type), max(event_type) FROM events
UNION ALL SELECT 'props', count(*) FILTER (WHERE props IS NULL), round(count(*) FILTER (WHERE props IS NULL) * 100.0e0 / count(*), 6), min(props), max(props) FROM events""")
def _(spark, d):
    out = A.column_profile(V.table(spark, d, "events").select("event_id", "event_type", "props"))
    return out.select("column_name", "null_count", F.round("null_pct", 6).alias("null_pct"),
                      F.element_at("samples", 1).alias("low"), F.element_at("samples", -1).alias("high"))


@query("agg8_distinct_estimate")
def _(spark, d):
    return A.column_profile(V.table(spark, d, "events")).select("column_name", "distinct_estimate")


@query("agg9_rule_counts", V.with_views("accidents", then="""
SELECT 'duration <= 0' AS rule, count(*) FILTER (WHERE End_Time <= Start_Time) AS violations FROM accidents
UNION ALL SELECT 'distance < 0', count(*) FILTER (WHERE Distance < 0) FROM accidents
UNION ALL SELECT 'humidity outside [0,100]', count(*) FILTER (WHERE Humidity < 0 OR Humidity > 100) FROM accidents
UNION ALL SELECT 'visibility < 0', count(*) FILTER (WHERE Visibility < 0) FROM accidents
UNION ALL SELECT 'wind speed < 0', count(*) FILTER (WHERE Wind_Speed < 0) FROM accidents
UNION ALL SELECT 'precipitation < 0', count(*) FILTER (WHERE Precipitation < 0) FROM accidents"""))
def _(spark, d):
    return A.rule_counts(V.accidents(spark, d), A.accident_rules())


def _describe_sql(table, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,"
        f" min({c}) AS min, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.95), 6) AS p95,"
        f" round(quantile_cont({c}, 0.99), 6) AS p99, max({c}) AS max FROM {table}" for c in cols)


@query("agg10_describe", V.with_views("accidents", then=_describe_sql(
    "accidents", ["Distance", "Wind_Speed", "Precipitation", "Visibility"])))
def _(spark, d):
    out = Q.describe(V.accidents(spark, d), ["Distance", "Wind_Speed", "Precipitation", "Visibility"])
    return out.select("column_name", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std")], "min",
                      *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "max")


@query("agg11_exact_quantiles", """
SELECT l_returnflag, p, round(v, 6) AS value FROM (
  SELECT l_returnflag, 0.5e0 AS p, quantile_cont(l_extendedprice, 0.5) AS v FROM lineitem GROUP BY 1
  UNION ALL SELECT l_returnflag, 0.99e0, quantile_cont(l_extendedprice, 0.99) FROM lineitem GROUP BY 1)""")
def _(spark, d):
    out = Q.exact_quantiles(V.table(spark, d, "lineitem"), ["l_extendedprice"], [0.5, 0.99], by=["l_returnflag"])
    return out.select("l_returnflag", "p", F.round("value", 6).alias("value"))


@query("agg12_distinct_counts", """
SELECT 'l_partkey' AS column_name, count(DISTINCT l_partkey) AS n_distinct FROM lineitem
UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem""")
def _(spark, d):
    return A.distinct_counts(V.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey", "l_returnflag"])


@query("agg13_feature_profile", V.with_views("crashes", more="""t AS (
SELECT lat, lon, coalesce(speed_limit, 0) AS speed_limit, CASE severity_3class WHEN 'Fatal' THEN 2.0e0
  WHEN 'Injury' THEN 1.0e0 ELSE 0.0e0 END AS y FROM crashes WHERE severity_3class <> 'Unknown')""", then=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, min({c}) AS min, max({c}) AS max, round(corr({c}, y), 6) AS correlation FROM t"
    for c in ("lat", "lon", "speed_limit"))))
def _(spark, d):
    df = V.crashes(spark, d).where("severity_3class <> 'Unknown'").withColumn("speed_limit", F.coalesce("speed_limit", F.lit(0.0)))
    out = A.feature_profile(df, ["lat", "lon", "speed_limit"], J.severity_score(J.risk_class(F.col("severity_3class"))))
    return out.select("feature", F.round("mean", 6).alias("mean"), "min", "max", F.round("correlation", 6).alias("correlation"))


@query("agg20_category_sums", V.with_views("crashes", then="""
SELECT regexp_replace('weath_cond_descr_' || coalesce(weath_cond_descr, 'Unknown'), '[^A-Za-z0-9_]', '_', 'g') AS column_name,
  coalesce(weath_cond_descr, 'Unknown') AS category, count(*) AS n FROM crashes GROUP BY 1, 2 HAVING count(*) >= 50"""))
def _(spark, d):
    return A.category_sums(V.crashes(spark, d), "weath_cond_descr", "weath_cond_descr", minimum=50)
