"""FN queries."""

from pyspark.sql import functions as F

from crashrisk.functions import calendar as C
from crashrisk.functions import cleaning as T
from crashrisk.functions import roads as R
from crashrisk.operators import quantiles as Q
from crashrisk.operators.joins import by_shuffle
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query


@query("fn1_calendar_parts", V.with_views("crashes", then="""
SELECT id, CAST(hour(crash_datetime_clean) AS INTEGER) AS hour_of_day,
  CAST(isodow(crash_datetime_clean) - 1 AS INTEGER) AS day_of_week, CAST(month(crash_datetime_clean) AS INTEGER) AS month,
  CASE WHEN isodow(crash_datetime_clean) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM crashes"""))
def _(spark, d):
    parts = C.calendar_parts(F.col("crash_datetime_clean"))
    return V.crashes(spark, d).select("id", *[c.alias(n) for n, c in parts.items()])


@query("fn2_rush_hour", V.with_views("crashes", then="""
SELECT id, CASE WHEN h BETWEEN 7 AND 9 OR h BETWEEN 16 AND 18 THEN 1 ELSE 0 END AS rush_v1,
  CASE WHEN h BETWEEN 7 AND 9 OR h BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS rush_v2,
  CASE WHEN (h BETWEEN 7 AND 9 OR h BETWEEN 16 AND 19) AND w <= 5 THEN 1 ELSE 0 END AS rush_live
FROM (SELECT id, hour(crash_datetime_clean) AS h, isodow(crash_datetime_clean) AS w FROM crashes)"""))
def _(spark, d):
    hour, dow = F.hour("crash_datetime_clean"), F.weekday("crash_datetime_clean")
    return V.crashes(spark, d).select("id", C.rush_hour(hour, 18).alias("rush_v1"), C.rush_hour(hour).alias("rush_v2"),
                                      C.rush_hour(hour, weekday_only=dow).alias("rush_live"))


@query("fn3_light_phase", V.with_views("crashes", then="""
SELECT id, CASE WHEN h < 6 OR h >= 20 THEN 'Dark' WHEN h IN (6, 19) THEN 'Dawn_Dusk' ELSE 'Daylight' END AS phase_training,
  CASE WHEN h BETWEEN 7 AND 18 THEN 'Daylight' WHEN h IN (5, 6, 19, 20) THEN 'Dawn_Dusk' ELSE 'Dark' END AS phase_live
FROM (SELECT id, hour(crash_datetime_clean) AS h FROM crashes)"""))
def _(spark, d):
    hour = F.hour("crash_datetime_clean")
    return V.crashes(spark, d).select("id", C.light_phase(hour).alias("phase_training"),
                                      C.light_phase(hour, live=True).alias("phase_live"))


@query("fn4_epoch_ms_text", """
SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE
  strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' END AS time_text,
  CASE WHEN event_id % 10 = 3 THEN NULL ELSE CAST(year(ts) AS INTEGER) END AS year FROM events""")
def _(spark, d):
    ms = F.expr("CASE WHEN event_id % 10 = 3 THEN 'n/a' ELSE cast(timestampdiff(MILLISECOND,"
                " timestamp_ntz'1970-01-01 00:00:00', ts) AS string) END")
    text = C.epoch_ms_to_text(F.col("ms"))
    return V.table(spark, d, "events").select("event_id", ms.alias("ms")).select(
        "event_id", text.alias("time_text"), C.year_of(text).alias("year"))


@query("fn5_zone_resolve", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime((t AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S')
  ELSE strftime(((t - INTERVAL 150 MINUTE) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') END AS local_time
FROM (SELECT event_id, date_trunc('second', ts) + to_days(CAST(event_id % 365 AS INTEGER)) AS t FROM events)""")
def _(spark, d):
    text = F.expr("""concat(replace(cast(date_trunc('SECOND', ts) + make_dt_interval(cast(event_id % 365 AS int)) AS string), ' ', 'T'),
        CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:30' END)""")
    return V.table(spark, d, "events").select("event_id", text.alias("text")).select(
        "event_id", C.local_timestamp(F.col("text")).cast("string").alias("local_time"))


@query("fn6_run_stamp", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'not a stamp' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS run_iso,
  CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') || 'T00:00:00+00:00' END AS date_iso FROM events""")
def _(spark, d):
    cols = V.table(spark, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 4 = 0 THEN 'not a stamp' ELSE"
        " translate(replace(substring(cast(ts AS string), 1, 19), ' ', '_'), ':', '-') END AS stamp",
        "CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE cast(cast(ts AS date) AS string) END AS day")
    return cols.select("event_id", C.run_stamp_to_iso(F.col("stamp")).alias("run_iso"), C.date_to_iso(F.col("day")).alias("date_iso"))


@query("fn7_iso_week", """
SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders""")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", C.iso_week_key(F.col("o_orderdate")).alias("week"))


@query("fn8_durations_and_bins", V.with_views("accidents", then="""
SELECT ID AS id, CAST(date_diff('second', Start_Time, End_Time) AS BIGINT) AS seconds,
  date_diff('second', Start_Time, End_Time) / 60.0e0 AS minutes,
  CAST(hour(Start_Time) * 4 + minute(Start_Time) // 15 AS INTEGER) AS time_bin,
  CAST(hour(Start_Time) // 3 AS INTEGER) AS hour_bin FROM accidents"""))
def _(spark, d):
    start, end = F.col("Start_Time"), F.col("End_Time")
    return V.accidents(spark, d).select(
        F.col("ID").alias("id"), C.duration_seconds(start, end).alias("seconds"), C.duration_minutes(start, end).alias("minutes"),
        C.quarter_hour_bin(start).alias("time_bin"), C.three_hour_bin(F.hour(start)).alias("hour_bin"))


@query("fn9_fn10_speeds", V.with_views("routes", "speed_intervals", then="""
SELECT trip_id, route_index, interval_pos, base, CASE category WHEN 'SLOW' THEN greatest(15.0e0, base - 10) WHEN 'TRAFFIC_JAM'
  THEN greatest(10.0e0, base - 20) ELSE base END AS speed FROM (SELECT *, CASE WHEN distance_miles < 2 THEN 25.0e0
  WHEN distance_miles < 10 THEN 35.0e0 ELSE 55.0e0 END AS base FROM routes) JOIN speed_intervals USING (trip_id, route_index)"""))
def _(spark, d):
    base = V.routes(spark, d).select("trip_id", "route_index", R.speed_by_distance(F.col("distance_miles")).alias("base"))
    return V.speed_intervals(spark, d).join(by_shuffle(base), ["trip_id", "route_index"]).select(
        "trip_id", "route_index", "interval_pos", "base", R.speed_by_traffic(F.col("category"), F.col("base")).alias("speed"))


@query("fn11_live_weather_feature", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'weath_cond_descr_Clear' WHEN 1 THEN 'weath_cond_descr_Rain'
  ELSE 'weath_cond_descr_Not_Reported' END AS feature FROM events""")
def _(spark, d):
    code = F.expr("element_at(array('Clear', 'Drizzle', 'Haze', 'Squall', 'Meteors', NULL), cast(event_id % 6 AS int) + 1)")
    keep = F.array(*[F.lit(f"weath_cond_descr_{c}") for c in ("Clear", "Rain", "Not_Reported")])
    return V.table(spark, d, "events").select("event_id", T.live_weather_feature(code, keep).alias("feature"))


@query("fn12_weather_group", V.with_views("accidents", then="""
SELECT ID AS id, CASE WHEN w IS NULL THEN 'unknown' WHEN w LIKE '%rain%' OR w LIKE '%drizzle%' THEN 'rain'
  WHEN w LIKE '%snow%' OR w LIKE '%sleet%' OR w LIKE '%ice%' THEN 'snow' WHEN w LIKE '%storm%' OR w LIKE '%thunder%' THEN 'storm'
  WHEN w LIKE '%fog%' OR w LIKE '%mist%' OR w LIKE '%haze%' THEN 'fog' WHEN w LIKE '%clear%' OR w LIKE '%fair%' THEN 'clear'
  WHEN w LIKE '%cloud%' OR w LIKE '%overcast%' THEN 'cloudy' ELSE 'other' END AS weather
FROM (SELECT ID, lower(Weather_Condition) AS w FROM accidents)"""))
def _(spark, d):
    return V.accidents(spark, d).select(F.col("ID").alias("id"), T.weather_group(F.col("Weather_Condition")).alias("weather"))


@query("fn13_wind_sector", V.with_views("accidents", then="""
SELECT ID AS id, CASE WHEN w IN ('NNE') THEN 'N' WHEN w = 'SOUTH' THEN 'S' WHEN w = 'WSW' THEN 'W'
  WHEN w = 'VARIABLE' THEN 'VAR' ELSE w END AS wind FROM (SELECT ID, upper(trim(Wind_Direction)) AS w FROM accidents)"""))
def _(spark, d):
    return V.accidents(spark, d).select(F.col("ID").alias("id"), T.wind_sector(F.col("Wind_Direction")).alias("wind"))


@query("fn14_text_cleaning", V.with_views("accidents", then="""
SELECT ID AS id, trim(lower(City)) AS city, trim(upper(State)) AS state, CAST(length(Street) AS INTEGER) AS street_length,
  nullif(regexp_extract(Street, '\\b(St|Ave|Rd|Blvd|Dr|Ln|Hwy)\\b', 1), '') AS street_type,
  split_part(Zipcode, '-', 1) AS zip5, substr(split_part(Zipcode, '-', 1), 1, 3) AS zip3 FROM accidents"""))
def _(spark, d):
    return V.accidents(spark, d).select(
        F.col("ID").alias("id"), T.tidy_lower(F.col("City")).alias("city"), T.tidy_upper(F.col("State")).alias("state"),
        F.length("Street").alias("street_length"), T.street_type(F.col("Street")).alias("street_type"),
        T.zip5(F.col("Zipcode")).alias("zip5"), T.zip3(F.col("Zipcode")).alias("zip3"))


@query("fn15_yes_no", V.with_views("accidents", then="""
SELECT ID AS id, CASE WHEN lower(Crossing) = 'true' THEN 1 WHEN lower(Crossing) = 'false' THEN 0 END AS crossing FROM accidents"""))
def _(spark, d):
    return V.accidents(spark, d).select(F.col("ID").alias("id"), T.yes_no(F.col("Crossing")).alias("crossing"))


@query("fn16_to_number", """
SELECT o_orderkey, TRY_CAST(t AS BIGINT) AS whole, TRY_CAST(t AS DOUBLE) AS real FROM (
  SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'x' || o_orderkey ELSE NULL END AS t FROM orders)""")
def _(spark, d):
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN cast(o_custkey AS string) WHEN 1 THEN concat('x', o_orderkey) END")
    return V.table(spark, d, "orders").select("o_orderkey", T.to_number(text, "bigint").alias("whole"), T.to_number(text).alias("real"))


@query("fn17_clip_upper", V.with_views("accidents", then="""
SELECT ID AS id, CASE WHEN Wind_Speed > 100 THEN 100.0e0 ELSE Wind_Speed END AS wind_speed,
  round(CASE WHEN Distance > q THEN q ELSE Distance END, 6) AS distance
FROM accidents, (SELECT quantile_cont(Distance, 0.99) AS q FROM accidents)"""))
def _(spark, d):
    df = V.accidents(spark, d)
    p99 = Q.quantile_value(df, "Distance", 0.99)
    return df.select(F.col("ID").alias("id"), T.clip_upper(F.col("Wind_Speed"), 100.0).alias("wind_speed"),
                     F.round(T.clip_upper(F.col("Distance"), p99), 6).alias("distance"))


@query("fn18_fill_missing", V.with_views("accidents", then="""
SELECT ID AS id, coalesce(Temperature, mt) AS temperature, coalesce(Humidity, mh) AS humidity, coalesce(Precipitation, 0) AS precipitation,
  coalesce(Wind_Direction, 'unknown') AS wind FROM accidents,
  (SELECT quantile_cont(Temperature, 0.5) AS mt, quantile_cont(Humidity, 0.5) AS mh FROM accidents)"""))
def _(spark, d):
    from crashrisk.operators.features import fill_median
    filled = fill_median(V.accidents(spark, d), ["Temperature", "Humidity"])
    return filled.select(F.col("ID").alias("id"), F.col("Temperature").alias("temperature"), F.col("Humidity").alias("humidity"),
                         F.coalesce("Precipitation", F.lit(0.0)).alias("precipitation"),
                         F.coalesce("Wind_Direction", F.lit("unknown")).alias("wind"))


@query("fn19_safe_names", """
SELECT p_type, CASE WHEN n = 1 THEN s ELSE s || '_' || (n - 1) END AS column_name FROM (
  SELECT p_type, s, row_number() OVER (PARTITION BY s ORDER BY p_type) AS n FROM (
    SELECT DISTINCT p_type || CASE p_size % 2 WHEN 0 THEN ' /' ELSE '/ ' END AS p_type,
      regexp_replace(p_type || CASE p_size % 2 WHEN 0 THEN ' /' ELSE '/ ' END, '[^A-Za-z0-9_]', '_', 'g') AS s FROM part))""")
def _(spark, d):
    from crashrisk.operators.features import name_columns
    values = V.table(spark, d, "part").select(F.expr("concat(p_type, CASE p_size % 2 WHEN 0 THEN ' /' ELSE '/ ' END)").alias("p_type"))
    return name_columns(values.distinct(), "p_type")


@query("fn20_units", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 1609.344, 6) AS miles, round(l_extendedprice / 1000, 6) AS km,
  CAST(l_quantity AS BIGINT) AS seconds, round(CAST(l_quantity AS BIGINT) / 60.0e0, 6) AS minutes FROM lineitem""")
def _(spark, d):
    seconds = R.seconds_text(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("s")))
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(R.metres_to_miles(F.col("l_extendedprice")), 6).alias("miles"),
        F.round(R.metres_to_km(F.col("l_extendedprice")), 6).alias("km"), seconds.alias("seconds"),
        F.round(seconds / 60.0, 6).alias("minutes"))


@query("fn21_array_accessors", """
SELECT vec_id, embedding[1] AS first, embedding[len(embedding)] AS last, embedding[len(embedding) // 2 + 1] AS middle FROM embeddings""")
def _(spark, d):
    arr = F.col("embedding")
    return V.table(spark, d, "embeddings").select("vec_id", R.first_item(arr).alias("first"), R.last_item(arr).alias("last"),
                                                  R.middle_item(arr).alias("middle"))


@query("fn22_even_sampling", V.with_views("routes", then="""
SELECT trip_id, route_index, k AS segment, CASE WHEN k = n - 1 THEN num_points - 1 ELSE k * greatest(1, num_points // n) END AS polyline_index
FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, least(12, num_points) AS n FROM routes))"""))
def _(spark, d):
    return V.routes(spark, d).select("trip_id", "route_index", F.posexplode(R.sample_indices(F.col("num_points"), 12))
                                     .alias("segment", "polyline_index")).withColumn("segment", F.col("segment").cast("bigint"))


@query("fn23_weather_payload", """
SELECT event_id, CASE WHEN event_id % 20 = 0 THEN 'missing field' END AS payload_error,
  CASE WHEN event_id % 20 = 0 THEN NULL ELSE event_type END AS condition_ok,
  CASE WHEN event_id % 20 = 0 THEN NULL ELSE value END AS temperature_f, CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(event_id % 9000 AS INTEGER) END AS visibility_meters,
  CASE WHEN event_id % 3 = 0 THEN 1.5e0 ELSE 0.0e0 END AS rain_1h_mm, event_id % 3 = 0 AS is_precipitation,
  (CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id % 9000 END) < 5000 AS is_low_visibility FROM events""")
def _(spark, d):
    text = F.expr("""concat('{"weather":[{"main":"', event_type, '","description":"d"}],',
      CASE WHEN event_id % 20 = 0 THEN '"main":{"humidity":3}' ELSE concat('"main":{"temp":', value, ',"feels_like":1,"humidity":50,"pressure":1000}') END,
      CASE WHEN event_id % 2 = 0 THEN '' ELSE concat(',"visibility":', event_id % 9000) END,
      CASE WHEN event_id % 3 = 0 THEN ',"rain":{"1h":1.5}' ELSE '' END, '}')""")
    out = R.parse_weather(V.table(spark, d, "events").select("event_id", text.alias("payload")), "payload")
    return out.select("event_id", "payload_error", F.when(F.col("payload_error").isNull(), F.col("condition")).alias("condition_ok"),
                      "temperature_f", "visibility_meters", "rain_1h_mm", "is_precipitation", "is_low_visibility")


_ROUTE_JSON = """to_json(named_struct('routes', transform(sequence(0L, o_orderkey % 3), i -> named_struct(
  'duration', concat(o_orderkey * 29 % 5000 + i * 60, 's'), 'distanceMeters', o_orderkey * 31 % 40000,
  'legs', array(named_struct('travelAdvisory', named_struct('speedReadingIntervals',
    transform(sequence(0L, (o_orderkey + i) % 6), k -> named_struct('startPolylinePointIndex', k * 5,
      'endPolylinePointIndex', k * 5 + 3, 'speed', IF(k % 2 = 0, 'SLOW', 'NORMAL'))))))))))"""


@query("fn24_route_payload", """
SELECT trip_id, CAST(i AS INTEGER) AS route_index, s AS duration_seconds, round(s / 60.0e0, 6) AS duration_minutes, round(m / 1609.344, 6) AS distance_miles,
  CASE WHEN round(m / 1609.344, 3) < 2 THEN 25.0e0 WHEN round(m / 1609.344, 3) < 10 THEN 35.0e0 ELSE 55.0e0 END AS base_speed_mph,
  CAST((trip_id + i) % 6 + 1 AS INTEGER) AS n_intervals
FROM (SELECT trip_id, i, trip_id * 29 % 5000 + i * 60 AS s, trip_id * 31 % 40000 AS m
  FROM (SELECT o_orderkey AS trip_id, unnest(range(0, o_orderkey % 3 + 1)) AS i FROM orders))""")
def _(spark, d):
    payload = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.expr(_ROUTE_JSON).alias("payload"))
    return R.parse_routes(payload, "payload").select(
        "trip_id", "route_index", "duration_seconds", F.round("duration_minutes", 6).alias("duration_minutes"),
        F.round("distance_miles", 6).alias("distance_miles"), "base_speed_mph", F.size("intervals").alias("n_intervals"))


@query("fn24_rejected_routes", """
SELECT o_orderkey AS trip_id, CASE o_orderkey % 10 WHEN 0 THEN 'no payload' WHEN 1 THEN 'unreadable payload' ELSE 'no routes' END AS reason
FROM orders WHERE o_orderkey % 10 < 3""")
def _(spark, d):
    # a trip in ten has no answer, a broken one, or one without routes
    payload = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.expr(_ROUTE_JSON).alias("payload")).withColumn(
        "payload", F.expr("CASE trip_id % 10 WHEN 0 THEN NULL WHEN 1 THEN left(payload, 25) WHEN 2 THEN '{\"routes\":[]}' ELSE payload END"))
    return R.rejected_routes(payload, "payload")


@query("fn25_polyline_points")
def _(spark, d):
    text = F.expr("concat(repeat('_p~iF~ps|U', 1), repeat('_ulLnnqC', cast(o_orderkey % 4 AS int)), repeat('_mqNvxq`@', 1))")
    lines = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), text.alias("polyline"))
    return R.decode_polylines(lines, ["trip_id"], "polyline")


@query("fn26_address_label", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN 'ZERO_RESULTS' END AS geocode_error,
  CASE WHEN o_orderkey % 5 IN (0, 1) THEN 'Street ' || o_custkey END AS street_name,
  CASE WHEN o_orderkey % 5 IN (0, 2) THEN 'Area ' || o_orderstatus END AS neighborhood,
  CASE o_orderkey % 5 WHEN 0 THEN 'Street ' || o_custkey || ', Area ' || o_orderstatus WHEN 1 THEN 'Street ' || o_custkey
    WHEN 2 THEN 'Area ' || o_orderstatus WHEN 3 THEN 'Address ' || o_orderkey END AS short_label FROM orders""")
def _(spark, d):
    text = F.expr("""CASE WHEN o_orderkey % 5 = 4 THEN '{"status":"ZERO_RESULTS","results":[]}' ELSE
      concat('{"status":"OK","results":[{"formatted_address":"Address ', o_orderkey, '","address_components":[',
        '{"long_name":"7","types":["street_number"]}',
        CASE WHEN o_orderkey % 5 IN (0, 1) THEN concat(',{"long_name":"Street ', o_custkey, '","types":["route"]}') ELSE '' END,
        CASE WHEN o_orderkey % 5 IN (0, 2) THEN concat(',{"long_name":"Area ', o_orderstatus, '","types":["political","sublocality"]}') ELSE '' END,
        ']}]}') END""")
    out = R.parse_address(V.table(spark, d, "orders").select("o_orderkey", text.alias("payload")), "payload")
    return out.select("o_orderkey", "geocode_error", "street_name", "neighborhood", "short_label")


@query("fn30_json_text", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE '[' || event_id || ',' || (event_id + 1) || ']' END AS list_text,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id + 1 END AS back FROM events""")
def _(spark, d):
    df = V.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(
        F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE array(event_id, event_id + 1) END")).alias("list_text"))
    return df.withColumn("back", F.from_json("list_text", "array<bigint>")[1])
