"""WIN-3, WIN-4, AGG-18, AGG-21, FN-27..29 queries."""

from pyspark.sql import functions as F

from crashrisk.operators import routes as R
from crashrisk.operators.joins import by_shuffle
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query


def segments(spark, d):
    """Sampled points of all routes with fixed class probabilities."""
    routes = V.routes(spark, d)
    return R.sample_points(V.route_points(spark, d), routes, 12).join(by_shuffle(routes), R.ROUTE).selectExpr(
        "*", "((trip_id * 37 + point_index * 11 + route_index) % 50) / 100.0D AS p_high",
        "((trip_id * 53 + point_index * 7) % 50) / 100.0D AS p_low",
        "CASE WHEN (trip_id + point_index * 3 + route_index * 5) % 17 = 0 THEN 'High'"
        " WHEN (trip_id * 3 + point_index) % 7 < 2 THEN 'Medium' ELSE 'Low' END AS risk_class",
    ).withColumn("p_medium", 1 - F.col("p_high") - F.col("p_low"))


_SEG = """seg AS (SELECT *, ((trip_id * 37 + pi * 11 + route_index) % 50) / 100.0e0 AS p_high, ((trip_id * 53 + pi * 7) % 50) / 100.0e0 AS p_low,
  CASE WHEN (trip_id + pi * 3 + route_index * 5) % 17 = 0 THEN 'High' WHEN (trip_id * 3 + pi) % 7 < 2 THEN 'Medium' ELSE 'Low' END AS risk_class
 FROM (SELECT *, CASE WHEN k = n - 1 THEN num_points - 1 ELSE k * greatest(1, num_points // n) END AS pi
  FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, least(12, num_points) AS n FROM routes))))"""
_SUM = _SEG + """,
s AS (SELECT trip_id, route_index, max(CASE risk_class WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) AS worst, avg(p_high) AS p_high, avg(p_low) AS p_low,
  count(*) FILTER (WHERE risk_class <> 'Low') AS hot, count(*) FILTER (WHERE risk_class = 'High') AS high,
  count(*) FILTER (WHERE risk_class = 'Medium') AS medium, max(duration_minutes) AS dur, max(distance_miles) AS dist FROM seg GROUP BY 1, 2),
summary AS (SELECT *, high * 10 + medium * 3 + dur * 0.1e0 AS score FROM s)"""


@query("win3_segment_placement", V.with_views("routes", more=_SEG, then="""
SELECT trip_id, route_index, k AS segment, round(pi / greatest(num_points - 1, 1) * distance_miles, 6) AS distance_from_start_miles,
  round(pi / greatest(num_points - 1, 1) * duration_minutes, 6) AS minutes_from_start FROM seg"""))
def _(spark, d):
    return R.place_segments(segments(spark, d)).select(
        "trip_id", "route_index", F.col("segment").cast("bigint").alias("segment"),
        F.round("distance_from_start_miles", 6).alias("distance_from_start_miles"), F.round("minutes_from_start", 6).alias("minutes_from_start"))


@query("agg18_route_roll_up", V.with_views("routes", more=_SUM, then="""
SELECT trip_id, route_index, CASE worst WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS overall_risk_class,
  round(p_high, 6) AS p_high, round(p_low, 6) AS p_low, hot AS num_hotspots, high AS num_high_hotspots, medium AS num_medium_hotspots,
  round(CASE worst WHEN 2 THEN p_high WHEN 1 THEN 1 - p_high - p_low ELSE p_low END, 6) AS overall_confidence FROM summary"""))
def _(spark, d):
    return R.roll_up_routes(segments(spark, d)).select(
        "trip_id", "route_index", "overall_risk_class", F.round("p_high", 6).alias("p_high"), F.round("p_low", 6).alias("p_low"),
        "num_hotspots", "num_high_hotspots", "num_medium_hotspots", F.round("overall_confidence", 6).alias("overall_confidence"))


@query("fn27_safety_score", V.with_views("routes", more=_SUM, then="""
SELECT trip_id, route_index, round(score, 6) AS safety_score FROM summary"""))
def _(spark, d):
    return R.roll_up_routes(segments(spark, d)).select("trip_id", "route_index", F.round("safety_score", 6).alias("safety_score"))


@query("win4_safest_route", V.with_views("routes", more=_SUM, then="""
SELECT trip_id, num_routes, route_index, round(score, 6) AS safety_score FROM (SELECT *, count(*) OVER (PARTITION BY trip_id) AS num_routes,
  row_number() OVER (PARTITION BY trip_id ORDER BY score, route_index) AS r FROM summary) WHERE r = 1"""))
def _(spark, d):
    return R.safest_routes(R.roll_up_routes(segments(spark, d))).select(
        "trip_id", "num_routes", "route_index", F.round("safety_score", 6).alias("safety_score"))


@query("agg21_best_saving", V.with_views("routes", then="""
SELECT trip_id, round(coalesce(greatest(max(duration_minutes) FILTER (WHERE route_index = 0) - min(duration_minutes) FILTER (WHERE route_index > 0), 0), 0), 6) AS saving_minutes,
  count(*) FILTER (WHERE route_index > 0) AS num_alternatives FROM routes GROUP BY trip_id"""))
def _(spark, d):
    routes = V.routes(spark, d).withColumn("duration_seconds", F.col("duration_minutes") * 60)
    return R.best_saving_minutes(routes).withColumn("saving_minutes", F.round("saving_minutes", 6))


@query("fn28_recommendation", V.with_views("routes", more=_SUM + """,
r AS (SELECT trip_id, count(*) AS n, arg_min(route_index, score * 1000 + route_index) AS x, count(*) FILTER (WHERE route_index = 0) AS z FROM summary GROUP BY trip_id),
p AS (SELECT r.trip_id, n, x, b.hot AS bh, b.high AS bx, b.dur AS bd, b.score AS bs, f.hot AS fh, f.high AS fx, f.dur AS fd, f.score AS fs,
  round(b.dur - f.dur, 1) AS gap FROM r JOIN summary b ON b.trip_id = r.trip_id AND b.route_index = x JOIN summary f ON f.trip_id = r.trip_id AND f.route_index = 0)""",
    then="""SELECT trip_id, x AS recommended_route_index, CASE WHEN n = 1 THEN 'There is no other route to choose.'
  WHEN x = 0 THEN printf('Stay on route 0: hotspots %d, high %d, and nothing offered scores lower.', bh, bx)
  ELSE printf('Take route %d: hotspots %d, high %d, where route 0 has %d and %d; ', x, bh, bx, fh, fx)
    || CASE WHEN abs(gap) < 0.5 THEN 'in about the same time' WHEN gap > 0 THEN printf('%.1f min slower', gap) ELSE printf('%.1f min faster', -gap) END || '.'
  END AS reason FROM p"""))
def _(spark, d):
    return R.recommendations(R.roll_up_routes(segments(spark, d)))


# weather, hour and neighbourhood of a trip, as its order has them
_FACTS = ["o_orderkey % 24 AS hour_of_day", "CASE WHEN o_orderkey % 5 > 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Rain' ELSE 'Snow' END END AS condition",
          "CASE WHEN o_orderkey % 7 > 0 THEN CAST(20.25 AS DOUBLE) + o_orderkey % 60 END AS temperature_f", "o_orderkey % 3 > 0 AS is_precipitation",
          "o_orderkey % 11 = 0 AS is_low_visibility", "CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 50 END AS nearby_crash_count_1km",
          "CASE WHEN o_custkey % 4 > 1 THEN o_custkey % 3 END AS nearby_fatal_count_1km", "CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 20 END AS nearby_crash_count_500m"]


@query("fn29_explanation_context", V.with_views("routes", more=_SUM + f""",
best AS (SELECT * FROM summary QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY score, route_index) = 1),
spots AS (SELECT trip_id, route_index, array_to_string(list('Point ' || pi ORDER BY k)[1:3], ' | ') AS names FROM seg WHERE risk_class <> 'Low' GROUP BY ALL),
facts AS (SELECT o_orderkey AS trip_id, {", ".join(_FACTS)} FROM orders)""", then="""
SELECT trip_id, array_to_string(list_filter([printf('trip: %.1f minutes for %.2f miles', dur, dist), 'start hour: ' || hour_of_day,
  'class: ' || CASE worst WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END || printf(' at %.1f%%', 100 * CASE worst WHEN 2 THEN p_high WHEN 1 THEN p_medium ELSE p_low END),
  printf('high/medium/low: %.1f%% / %.1f%% / %.1f%%', 100 * p_high, 100 * p_medium, 100 * p_low),
  'sky: ' || array_to_string(list_filter([condition, printf('%.0f F', temperature_f), CASE WHEN is_precipitation THEN 'wet' END,
     CASE WHEN is_low_visibility THEN 'poor sight' END], lambda x: x IS NOT NULL), '; '),
  'past crashes in 1 km: ' || nearby_crash_count_1km || ', of them fatal: ' || coalesce(nearby_fatal_count_1km, 0),
  'past crashes in 500 m: ' || nearby_crash_count_500m, 'hotspots: high ' || high || ', medium ' || medium || '; ' || names],
  lambda x: x IS NOT NULL), chr(10)) AS explanation_context
FROM (SELECT * EXCLUDE (p_high, p_low), p_high + 1e-6 AS p_high, p_low + 1e-6 AS p_low, 1 - p_high - p_low + 1e-6 AS p_medium FROM best) JOIN facts USING (trip_id) LEFT JOIN spots USING (trip_id, route_index)"""))
def _(spark, d):
    spots = R.hotspots(segments(spark, d)).groupBy("trip_id", "route_index").agg(F.sort_array(F.collect_list(
        F.struct("segment", "risk_class", F.concat(F.lit("Point "), F.col("point_index")).alias("label")))).alias("hotspots"))
    best = R.safest_routes(R.roll_up_routes(segments(spark, d)))
    facts = V.table(spark, d, "orders").selectExpr("o_orderkey AS trip_id", *_FACTS)
    trips = best.join(by_shuffle(spots), ["trip_id", "route_index"], "left").join(by_shuffle(facts), "trip_id").withColumns({
        "risk_class": F.col("overall_risk_class"), "confidence": F.col("overall_confidence") + 1e-6,
        **{c: F.col(c) + 1e-6 for c in ("p_high", "p_medium", "p_low")},  # off the halves, which engines round either way
        "hotspots": F.coalesce("hotspots", F.array().cast("array<struct<segment:int,risk_class:string,label:string>>"))})
    return R.explanation_context(trips).select("trip_id", "explanation_context")
