"""Road-incident shaped views over the star-schema test tables.

Each view exists twice: as a DataFrame and as DuckDB text with the same rows, so
that every catalog query can be checked by an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(
        "o_orderkey AS id",
        "o_orderkey AS crash_numb",
        "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int), cast(o_orderkey * 7 % 60 AS int), 0)"
        " AS crash_datetime_clean",
        "year(o_orderdate) AS year",
        "n_name AS city_town_name",
        "42.2D + (o_orderkey * 7919 % 2000) / 10000.0D AS lat",
        "-71.2D + (o_orderkey * 104729 % 2000) / 10000.0D AS lon",
        "CASE WHEN o_orderkey % 200 = 0 THEN 'Fatal' WHEN o_orderkey % 200 < 60 THEN 'Injury'"
        " WHEN o_orderkey % 200 < 180 THEN 'No Injury' ELSE 'Unknown' END AS severity_3class",
        "CASE WHEN o_orderkey % 200 = 0 THEN 1 ELSE 0 END AS numb_fatal_injr",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 200 BETWEEN 1 AND 59"
        " THEN 1 + o_orderkey % 3 ELSE 0 END AS numb_nonfatal_injr",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Clear' WHEN '2-HIGH' THEN 'Cloudy' WHEN '3-MEDIUM' THEN 'Rain'"
        " WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Snow/Sleet, hail' END AS weath_cond_descr",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 25.0D + 5 * (o_orderkey % 7) END AS speed_limit",
        "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey % 2 AS double) END AS ems_hotspot_flag",
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("o_orderkey AS trip_id", "explode(sequence(0L, o_orderkey % 3)) AS route_index")
        .selectExpr(
            "trip_id", "route_index",
            "2 + (trip_id * 13 + route_index * 7) % 60 AS num_points",
            "0.2D + ((trip_id * 31 + route_index * 17) % 300) / 10.0D AS distance_miles",
            "1.0D + ((trip_id * 29 + route_index * 11) % 900) / 10.0D AS duration_minutes",
        )
    )


def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        routes(spark, sf_dir)
        .selectExpr("*", "explode(sequence(0L, num_points - 1)) AS point_index")
        .selectExpr(
            "trip_id", "route_index", "point_index", "num_points",
            "42.2D + ((trip_id * 7919 + point_index * 37 + route_index * 101) % 2000) / 10000.0D AS lat",
            "-71.2D + ((trip_id * 104729 + point_index * 53 + route_index * 211) % 2000) / 10000.0D AS lng",
        )
    )


def speed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        routes(spark, sf_dir)
        .selectExpr("trip_id", "route_index", "explode(sequence(0L, (trip_id + route_index) % 6)) AS interval_pos")
        .selectExpr(
            "trip_id", "route_index", "interval_pos",
            "interval_pos * 5 AS start_idx",
            "interval_pos * 5 + (trip_id + interval_pos) % 9 AS end_idx",
            "CASE (trip_id + interval_pos) % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'SLOW'"
            " WHEN 2 THEN 'TRAFFIC_JAM' ELSE 'UNKNOWN' END AS category",
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id",
        "CASE WHEN toxic = 1 THEN 'High' WHEN quality = 1 THEN 'Low' ELSE 'Medium' END AS label",
        "(doc_id * 37 % 50) / 100.0D AS p_high",
        "(doc_id * 53 % 50) / 100.0D AS p_low",
        "(100 - doc_id * 37 % 50 - doc_id * 53 % 50) / 100.0D AS p_medium",
    )


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nationwide-study shape: times, weather readings, streets, yes/no road flags."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS ID",
        "CASE WHEN event_id % 10 < 7 THEN 2 WHEN event_id % 10 = 7 THEN 1 WHEN event_id % 10 = 8 THEN 3 ELSE 4 END"
        " AS Severity",
        "ts AS Start_Time",
        "ts + make_dt_interval(0, 0, cast(event_id * 17 % 400 - 5 AS int), 0) AS End_Time",
        "value AS Distance",
        "element_at(array('Main St', 'Park Ave N', 'Oak Rd', 'I-90 W', 'Stuart Blvd', NULL),"
        " cast(event_id % 6 AS int) + 1) AS Street",
        "concat(' City', cast(user_id % 37 AS string), ' ') AS City",
        "element_at(array('ma', ' NY', 'Ca ', 'TX'), cast(user_id % 4 AS int) + 1) AS State",
        "CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat(lpad(cast(user_id * 7 % 90000 + 1000 AS string), 5, '0'),"
        " CASE WHEN event_id % 2 = 0 THEN '-1234' ELSE '' END) END AS Zipcode",
        "CASE WHEN event_id % 13 = 0 THEN NULL ELSE 30.0D + event_id * 7 % 61 END AS Temperature",
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE 20.0D + event_id * 3 % 85 END AS Humidity",
        "CASE WHEN event_id % 8 = 0 THEN NULL ELSE (event_id * 11 % 1300) / 10.0D END AS Wind_Speed",
        "CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 5 % 17) / 10.0D END AS Precipitation",
        "CASE WHEN event_id % 19 = 0 THEN NULL ELSE (event_id * 13 % 101) / 10.0D END AS Visibility",
        "element_at(array('NNE', 'South', 'wsw ', 'CALM', 'Variable', 'NE', NULL), cast(event_id % 7 AS int) + 1)"
        " AS Wind_Direction",
        "element_at(array('Light Rain', 'Heavy Snow', 'Thunderstorms', 'Haze', 'Fair', 'Mostly Cloudy',"
        " 'Light Drizzle / Fog', 'Ice Pellets', 'Smoke', NULL), cast(event_id * 3 % 10 AS int) + 1)"
        " AS Weather_Condition",
        "element_at(array('True', 'False', 'true', NULL), cast(event_id % 4 AS int) + 1) AS Crossing",
        "event_type",
    )


# DuckDB text of the same views.
_SQL = {
    "crashes": """crashes AS (
SELECT o_orderkey AS id, o_orderkey AS crash_numb,
  o_orderdate + to_hours(o_orderkey % 24) + to_minutes(o_orderkey * 7 % 60) AS crash_datetime_clean,
  CAST(year(o_orderdate) AS INTEGER) AS year, n_name AS city_town_name,
  42.2e0 + (o_orderkey * 7919 % 2000) / 10000.0e0 AS lat,
  -71.2e0 + (o_orderkey * 104729 % 2000) / 10000.0e0 AS lon,
  CASE WHEN o_orderkey % 200 = 0 THEN 'Fatal' WHEN o_orderkey % 200 < 60 THEN 'Injury'
       WHEN o_orderkey % 200 < 180 THEN 'No Injury' ELSE 'Unknown' END AS severity_3class,
  CASE WHEN o_orderkey % 200 = 0 THEN 1 ELSE 0 END AS numb_fatal_injr,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 200 BETWEEN 1 AND 59
       THEN 1 + o_orderkey % 3 ELSE 0 END AS numb_nonfatal_injr,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Clear' WHEN '2-HIGH' THEN 'Cloudy' WHEN '3-MEDIUM' THEN 'Rain'
       WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'Snow/Sleet, hail' END AS weath_cond_descr,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 25.0e0 + 5 * (o_orderkey % 7) END AS speed_limit,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 2 AS DOUBLE) END AS ems_hotspot_flag
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "routes": """routes AS (
SELECT trip_id, route_index, 2 + (trip_id * 13 + route_index * 7) % 60 AS num_points,
  0.2e0 + ((trip_id * 31 + route_index * 17) % 300) / 10.0e0 AS distance_miles,
  1.0e0 + ((trip_id * 29 + route_index * 11) % 900) / 10.0e0 AS duration_minutes
FROM (SELECT o_orderkey AS trip_id, unnest(range(0, o_orderkey % 3 + 1)) AS route_index FROM orders))""",
    "route_points": """route_points AS (
SELECT trip_id, route_index, point_index,
  42.2e0 + ((trip_id * 7919 + point_index * 37 + route_index * 101) % 2000) / 10000.0e0 AS lat,
  -71.2e0 + ((trip_id * 104729 + point_index * 53 + route_index * 211) % 2000) / 10000.0e0 AS lng
FROM (SELECT *, unnest(range(0, num_points)) AS point_index FROM routes))""",
    "speed_intervals": """speed_intervals AS (
SELECT trip_id, route_index, interval_pos, interval_pos * 5 AS start_idx,
  interval_pos * 5 + (trip_id + interval_pos) % 9 AS end_idx,
  CASE (trip_id + interval_pos) % 4 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'SLOW' WHEN 2 THEN 'TRAFFIC_JAM'
       ELSE 'UNKNOWN' END AS category
FROM (SELECT *, unnest(range(0, (trip_id + route_index) % 6 + 1)) AS interval_pos FROM routes))""",
    "scored": """scored AS (
SELECT doc_id, CASE WHEN toxic = 1 THEN 'High' WHEN quality = 1 THEN 'Low' ELSE 'Medium' END AS label,
  (doc_id * 37 % 50) / 100.0e0 AS p_high, (doc_id * 53 % 50) / 100.0e0 AS p_low,
  (100 - doc_id * 37 % 50 - doc_id * 53 % 50) / 100.0e0 AS p_medium
FROM labels)""",
    "accidents": """accidents AS (
SELECT event_id AS ID,
  CASE WHEN event_id % 10 < 7 THEN 2 WHEN event_id % 10 = 7 THEN 1 WHEN event_id % 10 = 8 THEN 3 ELSE 4 END AS Severity,
  ts AS Start_Time, ts + to_minutes(event_id * 17 % 400 - 5) AS End_Time, value AS Distance,
  (['Main St', 'Park Ave N', 'Oak Rd', 'I-90 W', 'Stuart Blvd', NULL])[event_id % 6 + 1] AS Street,
  ' City' || CAST(user_id % 37 AS VARCHAR) || ' ' AS City,
  (['ma', ' NY', 'Ca ', 'TX'])[user_id % 4 + 1] AS State,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE lpad(CAST(user_id * 7 % 90000 + 1000 AS VARCHAR), 5, '0') ||
       CASE WHEN event_id % 2 = 0 THEN '-1234' ELSE '' END END AS Zipcode,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 30.0e0 + event_id * 7 % 61 END AS Temperature,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 20.0e0 + event_id * 3 % 85 END AS Humidity,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE (event_id * 11 % 1300) / 10.0e0 END AS Wind_Speed,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 5 % 17) / 10.0e0 END AS Precipitation,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE (event_id * 13 % 101) / 10.0e0 END AS Visibility,
  (['NNE', 'South', 'wsw ', 'CALM', 'Variable', 'NE', NULL])[event_id % 7 + 1] AS Wind_Direction,
  (['Light Rain', 'Heavy Snow', 'Thunderstorms', 'Haze', 'Fair', 'Mostly Cloudy', 'Light Drizzle / Fog',
    'Ice Pellets', 'Smoke', NULL])[event_id * 3 % 10 + 1] AS Weather_Condition,
  (['True', 'False', 'true', NULL])[event_id % 4 + 1] AS Crossing, event_type
FROM events)""",
}
_NEEDS = {"route_points": ["routes"], "speed_intervals": ["routes"]}


def with_views(*names: str, then: str, more: str = "") -> str:
    """DuckDB statement: the named views (and what they need), extra CTEs, the query."""
    ordered: list[str] = []
    for name in names:
        for need in [*_NEEDS.get(name, []), name]:
            if need not in ordered:
                ordered.append(need)
    parts = [_SQL[name] for name in ordered]
    if more:
        parts.append(more)
    return "WITH " + ",\n".join(parts) + "\n" + then
