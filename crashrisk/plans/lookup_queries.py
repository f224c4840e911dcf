"""FLT, SRT, JN-1/2 and SET queries."""

from pyspark.sql import functions as F

from crashrisk.operators import joins as J
from crashrisk.operators import lookups as L
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query

_COLS = ["id", "year", "city_town_name", "severity_3class", "weath_cond_descr", "numb_fatal_injr", "ems_hotspot_flag"]
_LIST = ", ".join(_COLS)


def _crash_sql(where="true", tail=""):
    return V.with_views("crashes", then=f"SELECT {_LIST} FROM crashes WHERE {where} {tail}")


@query("flt1_page_in_id_order", _crash_sql(tail="ORDER BY id LIMIT 100 OFFSET 200"))
def _(spark, d):
    return L.page(V.crashes(spark, d).select(*_COLS), limit=100, offset=200)


@query("flt2_by_year", _crash_sql("year = 1998"))
def _(spark, d):
    return L.by_year(V.crashes(spark, d), 1998).select(*_COLS)


@query("flt3_by_severity", _crash_sql("severity_3class ILIKE '%injury%'"))
def _(spark, d):
    return L.by_severity(V.crashes(spark, d), "injury").select(*_COLS)


@query("flt4_by_city", _crash_sql("city_town_name ILIKE '%nation_1%'"))
def _(spark, d):
    return L.by_city(V.crashes(spark, d), "nation_1").select(*_COLS)


@query("flt5_hotspots", _crash_sql("ems_hotspot_flag = 1"))
def _(spark, d):
    return L.hotspots(V.crashes(spark, d)).select(*_COLS)


@query("flt6_fatal", _crash_sql("numb_fatal_injr > 0"))
def _(spark, d):
    return L.fatal(V.crashes(spark, d)).select(*_COLS)


@query("flt7_filter_crashes", _crash_sql(
    "year = 1999 AND city_town_name ILIKE '%nation%' AND weath_cond_descr ILIKE '%SNOW%'"))
def _(spark, d):
    return L.filter_crashes(V.crashes(spark, d), year=1999, city="nation", severity="", weather="SNOW").select(*_COLS)


@query("flt8_city_guard", """
SELECT CAST(count(*) FILTER (WHERE upper(trim(c)) = 'CITY7') AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE upper(trim(c)) IS DISTINCT FROM 'CITY7') AS BIGINT) AS removed
FROM (SELECT ' City' || CAST(user_id % 37 AS VARCHAR) || ' ' AS c FROM events)""")
def _(spark, d):
    return L.city_guard_counts(V.accidents(spark, d), "City7", "City")


@query("flt8_city_guard_rows", V.with_views("accidents", then="""
SELECT ID AS id, upper(trim(City)) AS city FROM accidents WHERE upper(trim(City)) = 'CITY7'"""))
def _(spark, d):
    return L.city_guard(V.accidents(spark, d), "City7", "City").select(F.col("ID").alias("id"), F.col("City").alias("city"))


@query("flt9_tolerant_select", V.with_views("accidents", then="""
SELECT ID AS id, City AS city, Severity AS severity FROM accidents"""))
def _(spark, d):
    kept, missing = L.tolerant_select(V.accidents(spark, d), ["id", "not_there", "city", "severity"])
    assert missing == ["not_there"]
    return kept


@query("flt10_drop_missing", _crash_sql("weath_cond_descr IS NOT NULL AND ems_hotspot_flag IS NOT NULL"))
def _(spark, d):
    return L.drop_missing(V.crashes(spark, d), ["weath_cond_descr", "ems_hotspot_flag", "lat"]).select(*_COLS)


@query("flt11_route_size_check", V.with_views("routes", then="""
SELECT trip_id, route_index, CASE WHEN distance_miles < 0.3 AND duration_minutes < 2.0 THEN 'distance and duration'
  WHEN distance_miles < 0.3 THEN 'distance' WHEN duration_minutes < 2.0 THEN 'duration' END AS reject_reason
FROM routes"""))
def _(spark, d):
    return L.route_size_check(V.routes(spark, d)).select("trip_id", "route_index", "reject_reason")


@query("flt12_outlier_mask", V.with_views("accidents", then="""
SELECT count(*) FILTER (WHERE epoch(End_Time) - epoch(Start_Time) > 14400) AS n_outliers, count(*) AS n_rows,
  round(count(*) FILTER (WHERE epoch(End_Time) - epoch(Start_Time) > 14400) * 100.0e0 / count(*), 6) AS outlier_pct
FROM accidents"""))
def _(spark, d):
    from crashrisk.operators.aggregates import outlier_share
    minutes = F.timestamp_diff("SECOND", F.col("Start_Time"), F.col("End_Time")) / 60.0
    return outlier_share(V.accidents(spark, d), minutes > 240).withColumn("outlier_pct", F.round("outlier_pct", 6))


@query("flt12_outlier_severity_mix", V.with_views("accidents", then="""
SELECT Severity AS severity, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM accidents WHERE epoch(End_Time) - epoch(Start_Time) > 14400 GROUP BY Severity"""))
def _(spark, d):
    from crashrisk.operators.aggregates import value_counts
    minutes = F.timestamp_diff("SECOND", F.col("Start_Time"), F.col("End_Time")) / 60.0
    long_ones = V.accidents(spark, d).where(minutes > 240).withColumnRenamed("Severity", "severity")
    return value_counts(long_ones, "severity", normalize=True).withColumn("share", F.round("share", 6))


@query("flt13_drop_columns", V.with_views("accidents", then="SELECT ID AS id, Severity AS severity FROM accidents"))
def _(spark, d):
    df = V.accidents(spark, d)
    keep = {"ID", "Severity"}
    return df.drop(*[c for c in df.columns if c not in keep]).toDF("id", "severity")


@query("flt14_missing_features", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'lat' WHEN event_id % 3 = 1 THEN '' ELSE 'lat,hour_of_day' END AS missing
FROM events""")
def _(spark, d):
    instance = F.expr("""CASE event_id % 3 WHEN 0 THEN map('lon', value, 'hour_of_day', 1D)
        WHEN 1 THEN map('lat', value, 'lon', value, 'hour_of_day', 2D) ELSE map('lon', value, 'extra', 0D) END""")
    checked = L.incomplete_instances(V.table(spark, d, "events"), instance, ["lat", "lon", "hour_of_day"])
    return checked.select("event_id", F.array_join("missing_features", ",").alias("missing"))


@query("flt15_batch_verdict", """
WITH p AS (SELECT user_id, CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 77 = 0 THEN NULL ELSE event_type END AS risk_class,
                  CASE WHEN event_id % 91 = 0 THEN NULL ELSE value END AS confidence FROM events),
g AS (SELECT user_id, count(*) AS received,
        count(*) FILTER (WHERE risk_class IS NULL OR risk_class = '' OR confidence IS NULL) AS malformed FROM p GROUP BY 1)
SELECT user_id, received + user_id % 2 AS sent, received, malformed, (user_id % 2 = 0 AND malformed = 0) AS accepted FROM g""")
def _(spark, d):
    events = V.table(spark, d, "events")
    predictions = events.selectExpr(
        "user_id",
        "CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 77 = 0 THEN NULL ELSE event_type END AS risk_class",
        "CASE WHEN event_id % 91 = 0 THEN NULL ELSE value END AS confidence", "map('Low', value) AS probabilities")
    sent = events.groupBy("user_id").agg((F.count(F.lit(1)) + F.col("user_id") % 2).alias("sent"))
    return L.batch_verdict(predictions, "user_id", sent)


@query("srt2_limit_in_id_order", _crash_sql("severity_3class ILIKE '%fatal%'", "ORDER BY id LIMIT 50"))
def _(spark, d):
    return L.by_severity(V.crashes(spark, d), "fatal", limit=50).select(*_COLS)


@query("srt6_multi_key_sort", V.with_views("crashes", then="SELECT year, crash_numb, severity_3class FROM crashes"))
def _(spark, d):
    return V.crashes(spark, d).select("year", "crash_numb", "severity_3class").orderBy("year", "crash_numb")


@query("jn1_dictionary_lookup", V.with_views("crashes", then="""
SELECT id, CASE WHEN severity_3class = 'Fatal' THEN 'High' WHEN severity_3class = 'Injury' THEN 'Medium'
                WHEN severity_3class = 'No Injury' THEN 'Low' END AS risk_class,
  CASE WHEN severity_3class = 'Fatal' THEN 2.0e0 WHEN severity_3class = 'Injury' THEN 1.0e0
       WHEN severity_3class = 'No Injury' THEN 0.0e0 END AS severity_score FROM crashes"""))
def _(spark, d):
    risk = J.risk_class(F.col("severity_3class"))
    return V.crashes(spark, d).select("id", risk.alias("risk_class"), J.severity_score(risk).alias("severity_score"))


@query("jn2_key_lookup", """
SELECT e.event_id AS "ID", e.event_type, CASE WHEN e.event_id % 5 IN (0, 2) THEN 'highway' WHEN e.event_id % 5 = 4 THEN NULL
  ELSE 'city' END AS road_type FROM events e""")
def _(spark, d):
    roads = V.table(spark, d, "events").where("event_id % 5 <> 4").selectExpr(
        "event_id AS ID", "CASE WHEN event_id % 5 IN (0, 2) THEN 'highway' ELSE 'city' END AS road_type")
    return J.attach(V.accidents(spark, d).select("ID", "event_type"), roads, "ID", ["road_type"])


@query("set1_union_by_name", """
SELECT c_custkey AS k, c_name AS name, c_acctbal AS balance, CAST(NULL AS VARCHAR) AS brand FROM customer
UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part""")
def _(spark, d):
    return J.union_tolerant([
        V.table(spark, d, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_acctbal AS balance"),
        V.table(spark, d, "part").selectExpr("p_brand AS brand", "p_partkey AS k", "p_name AS name")])


@query("set2_rejoin_disjoint_parts", V.with_views("crashes", then="SELECT id, year FROM crashes"))
def _(spark, d):
    df = V.crashes(spark, d).select("id", "year")
    fatal = F.col("id") % 200 == 0
    return J.union_tolerant([df.where(fatal), df.where(~fatal)])


@query("set3_years_ever_seen", """
SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
UNION SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) FROM lineitem""")
def _(spark, d):
    return (V.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
            .union(V.table(spark, d, "lineitem").select(F.year("l_shipdate"))).distinct())
