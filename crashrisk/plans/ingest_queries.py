"""SRC-3/4, WIN-1/2/6/7, JN-6/8/9, PIPE and registry queries."""

from pyspark.sql import functions as F

from crashrisk.functions import calendar as C
from crashrisk.operators import joins as J
from crashrisk.operators import ordering as O
from crashrisk.plans import ingest as I
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query
from crashrisk.sources import readers as R

_RAW_SEVERITY = """CASE o_orderkey % 5 WHEN 0 THEN 'Fatal injury' WHEN 1 THEN 'Non-fatal injury'
  WHEN 2 THEN 'Property damage only (none injured)' WHEN 3 THEN 'Not Reported' END"""


def landed_pages(spark, d):
    """Feature pages as text, one per 100 order keys, a source per 1,000; some report errors."""
    rows = V.table(spark, d, "orders").selectExpr(
        "concat('s', o_orderkey div 1000) AS source", "o_orderkey div 100 AS page",
        f"""struct(struct(o_orderkey AS CRASH_NUMB, timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) + o_orderkey % 1000
          AS CRASH_DATETIME, IF(o_orderkey % 7 = 0, ' springfield', 'Springfield ') AS CITY_TOWN_NAME, {_RAW_SEVERITY} AS CRASH_SEVERITY_DESCR,
          IF(o_orderkey % 6 = 0, 'unknown', cast(42 + o_orderkey % 10 / 10D AS string)) AS LAT, o_orderstatus AS RDWY) AS attributes) AS f""")
    return rows.groupBy("source", "page").agg(F.collect_list("f").alias("features")).select("source", F.expr(
        "IF(page % 50 = 7, '{\"error\":{\"code\":400,\"message\":\"bad request\"}}', to_json(named_struct('features', features,"
        " 'exceededTransferLimit', true)))").alias("value"))


_ATTRIBUTES = ("CRASH_NUMB: bigint, CRASH_DATETIME: bigint, CITY_TOWN_NAME: string, CRASH_SEVERITY_DESCR: string,"
               "LAT: string, RDWY: string")
_GOOD = "o_orderkey // 1000 NOT IN (SELECT DISTINCT o_orderkey // 1000 FROM orders WHERE (o_orderkey // 100) % 50 = 7)"


@query("src3_feature_pages", f"""
SELECT o_orderkey AS crash_numb, epoch_ms(o_orderdate) + o_orderkey % 1000 AS crash_datetime, {_RAW_SEVERITY} AS severity
FROM orders WHERE {_GOOD}""")
def _(spark, d):
    rows, _rejects = R.explode_feature_pages(landed_pages(spark, d), "value", _ATTRIBUTES)
    return rows.selectExpr("CRASH_NUMB AS crash_numb", "CRASH_DATETIME AS crash_datetime", "CRASH_SEVERITY_DESCR AS severity")


@query("src3_rejected_pages", """
SELECT DISTINCT 's' || (o_orderkey // 1000) AS source, 'bad request' AS reason FROM orders WHERE (o_orderkey // 100) % 50 = 7""")
def _(spark, d):
    return R.explode_feature_pages(landed_pages(spark, d), "value", _ATTRIBUTES)[1].select("source", "reason")


@query("src4_data_pages", "SELECT c_custkey AS id, c_name AS name FROM customer")
def _(spark, d):
    pages = V.table(spark, d, "customer").groupBy(F.expr("c_custkey div 100").alias("page")).agg(F.to_json(F.struct(
        F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("data"))).alias("value"))
    return R.explode_data_pages(pages, "value", "id: bigint, name: string")[0].select("id", "name")


@query("src4_rejected_pages", """
SELECT DISTINCT c_custkey // 100 AS page, 'unreadable page' AS reason FROM customer WHERE (c_custkey // 100) % 5 = 2""")
def _(spark, d):
    pages = V.table(spark, d, "customer").groupBy(F.expr("c_custkey div 100").alias("page")).agg(F.to_json(F.struct(
        F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("data"))).alias("value"))
    # downloads that broke off, and pages that hold a message instead of data
    pages = pages.withColumn("value", F.expr("CASE WHEN page % 10 = 2 THEN left(value, 20) WHEN page % 5 = 2 THEN '{\"message\":\"gone\"}' ELSE value END"))
    return R.explode_data_pages(pages, "value", "id: bigint, name: string")[1]


@query("ingest_transform", f"""
SELECT o_orderkey AS crash_numb, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '+00:00' AS crash_datetime_clean, CAST(year(o_orderdate) AS BIGINT) AS year,
  'SPRINGFIELD' AS city_town_name, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 42 + (o_orderkey % 10) / 10.0e0 END AS lat,
  {_RAW_SEVERITY} AS crash_severity_descr, CASE o_orderkey % 5 WHEN 0 THEN 'Fatal' WHEN 1 THEN 'Injury' WHEN 2 THEN 'No Injury' ELSE 'Unknown' END AS severity_3class,
  o_orderstatus AS rdwy FROM orders WHERE {_GOOD}""")
def _(spark, d):
    rows, _rejects = R.explode_feature_pages(landed_pages(spark, d), "value", _ATTRIBUTES)
    return I.transform(rows.drop("source"), "Springfield")


def versions(spark, d):
    """Line items as row versions: a third are production, the rest two candidate runs."""
    return V.table(spark, d, "lineitem").selectExpr(
        "IF(l_partkey % 97 = 0, NULL, l_orderkey * 10 + l_linenumber) AS crash_numb", "year(l_shipdate) AS year",
        "l_partkey", "l_suppkey", "l_extendedprice",
        "IF(l_suppkey % 3 = 0, 'production', 'candidate') AS _source",
        "CASE l_suppkey % 3 WHEN 1 THEN '2026-01-05' WHEN 2 THEN '2026-02-02' END AS _run_ts")


_VERSIONS = """v AS (SELECT CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_orderkey * 10 + l_linenumber END AS crash_numb,
  CAST(year(l_shipdate) AS INTEGER) AS year, CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END AS prod,
  CASE l_suppkey % 3 WHEN 1 THEN '2026-01-05' WHEN 2 THEN '2026-02-02' ELSE '' END AS run_ts FROM lineitem)"""


def _winner_sql(order):
    return f"""WITH {_VERSIONS}
SELECT crash_numb, prod = 1 AS is_production, run_ts FROM (SELECT *, row_number() OVER (PARTITION BY crash_numb ORDER BY {order}) AS r FROM v
  WHERE crash_numb IS NOT NULL) WHERE r = 1
UNION ALL SELECT crash_numb, prod = 1, run_ts FROM v WHERE crash_numb IS NULL"""


def _winners(df):
    return df.select("crash_numb", (F.col("_source") == "production").alias("is_production"), F.coalesce("_run_ts", F.lit("")).alias("run_ts"))


@query("win1_candidate_wins", _winner_sql("prod, run_ts DESC"))
def _(spark, d):
    return _winners(O.resolve_conflicts(versions(spark, d)))


@query("win1_production_wins", _winner_sql("prod DESC, run_ts DESC"))
def _(spark, d):
    return _winners(O.resolve_conflicts(versions(spark, d), mode="production_wins"))


@query("win2_number_rows", """
SELECT row_number() OVER (ORDER BY year(o_orderdate), o_orderkey) AS id, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderkey AS crash_numb FROM orders""")
def _(spark, d):
    df = V.table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("crash_numb"))
    return O.number_rows(df, ["year", "crash_numb"])


def _merge_inputs(spark, d):
    crashes = V.crashes(spark, d)
    production = crashes.where("year <= 1999")
    candidates = crashes.where("year >= 1999").drop("ems_hotspot_flag").withColumns(
        {"_run_ts": F.lit("2026-01-05_06-00-00"), "speed_limit": F.lit(99.0)})
    return production, candidates


@query("ingest_accumulate", V.with_views("crashes", then="""
SELECT row_number() OVER (ORDER BY year, crash_numb) AS id, crash_numb, year, CASE WHEN year >= 1999 THEN 99.0e0 ELSE speed_limit END AS speed_limit,
  CASE WHEN year >= 1999 THEN NULL ELSE ems_hotspot_flag END AS ems_hotspot_flag FROM crashes"""))
def _(spark, d):
    return I.accumulate(*_merge_inputs(spark, d)).select("id", "crash_numb", "year", "speed_limit", "ems_hotspot_flag")


@query("ingest_merge_counts", V.with_views("crashes", then="""
SELECT count(*) AS merged_rows, min(year) AS min_year, max(year) AS max_year, count(*) FILTER (WHERE year <= 1999) AS production_rows,
  count(*) FILTER (WHERE year >= 1999) AS candidate_rows, count(*) FILTER (WHERE year = 1999) AS duplicates_removed FROM crashes"""))
def _(spark, d):
    production, candidates = _merge_inputs(spark, d)
    return I.merge_counts(production, candidates, I.accumulate(production, candidates))


@query("ingest_merge_manifest", V.with_views("crashes", then="""
SELECT 'year' AS kind, CAST(year AS VARCHAR) AS key, count(*) AS n FROM crashes GROUP BY 2
UNION ALL SELECT 'severity', severity_3class, count(*) FROM crashes GROUP BY 2"""))
def _(spark, d):
    manifest = I.merge_manifest(V.crashes(spark, d))
    return manifest.select(F.lit("year").alias("kind"), F.explode("rows_per_year").alias("key", "n")).unionByName(
        manifest.select(F.lit("severity").alias("kind"), F.explode("severity_breakdown").alias("key", "n")))


@query("win6_rows_since_retrain", """
WITH r AS (SELECT user_id, event_id, event_type, CAST(value * 100 AS BIGINT) AS merged_rows FROM events)
SELECT event_id, merged_rows, merged_rows - (last_value(CASE WHEN event_type = 'purchase' THEN merged_rows END IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS rows_since_retrain FROM r""")
def _(spark, d):
    runs = V.table(spark, d, "events").selectExpr("user_id AS job", "event_id AS run_ts", "event_type AS phase",
                                                  "cast(round(value * 100) AS bigint) AS merged_rows")
    out = O.rows_since_retrain(runs, retrain="purchase", period=F.expr("run_ts div 1000"))
    return out.select(F.col("run_ts").alias("event_id"), "merged_rows", "rows_since_retrain")


def alerts(spark, d):
    return V.table(spark, d, "events").selectExpr(
        "event_id", "element_at(array('no_new_data', 'merge_complete', 'retrain_complete', 'failure', 'new_data'), cast(event_id % 5 AS int) + 1) AS kind",
        "ts + make_dt_interval(cast(event_id % 900 AS int)) AS ts", "concat('merged/', user_id) AS merged_path", "concat('run', event_id div 10) AS run_ts")


@query("win7_alert_dedup", """
WITH a AS (SELECT event_id, (['no_new_data', 'merge_complete', 'retrain_complete', 'failure', 'new_data'])[event_id % 5 + 1] AS kind,
  ts + to_days(CAST(event_id % 900 AS INTEGER)) AS ts, 'merged/' || user_id AS p, 'run' || (event_id // 10) AS run_ts FROM events),
k AS (SELECT *, CASE kind WHEN 'no_new_data' THEN strftime(ts, '%G-W%V') WHEN 'merge_complete' THEN p WHEN 'retrain_complete' THEN run_ts
  ELSE CAST(event_id AS VARCHAR) END AS key FROM a)
SELECT event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY ts, run_ts) AS r FROM k) WHERE r = 1""")
def _(spark, d):
    return O.alerts_to_send(alerts(spark, d)).select("event_id", "kind")


def checks(spark, d):
    """Counts per order year; the previous check misses two years, and some counts differ."""
    per_year = V.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    current = per_year.selectExpr("year", "IF(year = 1998, 'error', 'ok') AS status", "IF(year = 1998, NULL, n) AS count")
    previous = per_year.where("year NOT IN (1995, 2001)").selectExpr("year", "IF(year = 1997, 'error', 'ok') AS status", "n - IF(year = 1999, 5, 0) AS count")
    return current, previous


_CHANGES = """c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1),
x AS (SELECT year, CASE WHEN year = 1998 THEN 'error' ELSE 'ok' END AS status, CASE WHEN year <> 1998 THEN n END AS count,
  CASE WHEN year NOT IN (1995, 1997, 2001) THEN n - CASE WHEN year = 1999 THEN 5 ELSE 0 END END AS previous_count FROM c),
y AS (SELECT *, CASE WHEN status <> 'ok' THEN 'none' WHEN previous_count IS NULL AND year > 2000 THEN 'new_endpoint_beyond_production'
  WHEN previous_count IS NULL THEN 'first_recorded' WHEN count <> previous_count THEN 'count_changed' ELSE 'unchanged' END AS change_type FROM x)"""


@query("jn6_current_vs_previous", "WITH " + _CHANGES + " SELECT year, count, previous_count FROM x")
def _(spark, d):
    return J.compare_with_previous(*checks(spark, d)).select("year", "count", "previous_count")


@query("ingest_change_detection", "WITH " + _CHANGES + " SELECT year, status, count, previous_count, year <= 2000 AS in_production, change_type FROM y")
def _(spark, d):
    return I.detect_changes(*checks(spark, d), production_years=(1995, 2000))


@query("ingest_recommended_action", "WITH " + _CHANGES + """
SELECT string_agg(year, ',' ORDER BY year) FILTER (WHERE change_type IN ('count_changed', 'new_endpoint_beyond_production')) AS new_years,
  string_agg(year, ',' ORDER BY year) FILTER (WHERE status = 'error') AS error_years, 'download_recommended' AS recommended_action FROM y""")
def _(spark, d):
    out = I.recommend_action(I.detect_changes(*checks(spark, d), production_years=(1995, 2000)), first_run=False)
    return out.select(F.array_join("years_with_new_data", ",").alias("new_years"), F.array_join("years_with_errors", ",").alias("error_years"), "recommended_action")


@query("jn8_feedback_rates", """
WITH p AS (SELECT o_orderkey AS prediction_id, o_orderpriority AS risk_class FROM orders),
f AS (SELECT l_orderkey AS prediction_id, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS ok FROM lineitem GROUP BY 1)
SELECT risk_class, count(*) AS predictions, count(n) AS with_feedback, CAST(coalesce(sum(n), 0) AS BIGINT) AS feedback_rows,
  CAST(coalesce(sum(ok), 0) AS BIGINT) AS accepted_rows, round(count(n) / count(*), 6) AS feedback_rate FROM p LEFT JOIN f USING (prediction_id) GROUP BY 1""")
def _(spark, d):
    predictions = V.table(spark, d, "orders").selectExpr("o_orderkey AS prediction_id", "o_orderpriority AS risk_class")
    feedback = V.table(spark, d, "lineitem").selectExpr("l_orderkey AS prediction_id", "l_returnflag AS feedback_type")
    return J.feedback_rates(predictions, feedback, accepted="A").withColumn("feedback_rate", F.round("feedback_rate", 6))


@query("jn8_explanation_coverage", """
WITH p AS (SELECT o_orderkey AS prediction_id, o_orderpriority AS risk_class FROM orders),
e AS (SELECT l_orderkey AS prediction_id, l_returnflag <> 'R' AS ok, l_suppkey AS latency,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '1-URGENT' ELSE '5-LOW' END AS named FROM lineitem WHERE l_linenumber < 4 AND l_suppkey % 2 = 0),
x AS (SELECT prediction_id, count(*) AS n, count(*) FILTER (WHERE ok) AS n_ok, sum(latency) FILTER (WHERE ok) AS latency FROM e GROUP BY 1)
SELECT risk_class, count(*) AS predictions, count(*) FILTER (WHERE n_ok > 0) AS explained, CAST(coalesce(sum(n), 0) AS BIGINT) AS attempts,
  CAST(coalesce(sum(n - n_ok), 0) AS BIGINT) AS failed,
  count(*) FILTER (WHERE EXISTS (SELECT 1 FROM e WHERE e.prediction_id = p.prediction_id AND e.named <> p.risk_class)) AS mismatched,
  round(sum(latency) / sum(n_ok), 6) AS mean_latency_ms, round(count(*) FILTER (WHERE n_ok > 0) / count(*), 6) AS explained_rate
FROM p LEFT JOIN x USING (prediction_id) GROUP BY 1""")
def _(spark, d):
    predictions = V.table(spark, d, "orders").selectExpr("o_orderkey AS prediction_id", "o_orderpriority AS risk_class")
    explanations = V.table(spark, d, "lineitem").where("l_linenumber < 4 AND l_suppkey % 2 = 0").selectExpr(
        "l_orderkey AS prediction_id", "l_returnflag <> 'R' AS success", "l_suppkey AS latency_ms",
        "CASE l_linenumber % 3 WHEN 1 THEN '1-URGENT' WHEN 2 THEN '5-LOW' END AS risk_class_explained")
    return J.explanation_coverage(predictions, explanations).withColumns(
        {c: F.round(c, 6) for c in ("mean_latency_ms", "explained_rate")})


@query("jn9_manifest_walk", """
WITH r AS (SELECT 'run' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS run_ts, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status,
  'p/' || o_orderpriority || '/' || CAST(o_orderdate AS DATE) AS path FROM orders WHERE o_orderstatus <> 'P')
SELECT year, path, min(run_ts) AS run_ts FROM r GROUP BY 1, 2""")
def _(spark, d):
    runs = V.table(spark, d, "orders").groupBy(F.expr("concat('run', lpad(o_custkey, 8, '0'))").alias("run_ts")).agg(F.collect_list(F.struct(
        F.year("o_orderdate").alias("year"), F.expr("IF(o_orderstatus = 'P', 'failed', 'ok')").alias("status"),
        F.expr("concat('p/', o_orderpriority, '/', cast(cast(o_orderdate AS date) AS string))").alias("path"))).alias("results"))
    return J.manifest_paths(runs)


@query("ingest_run_state", """
WITH e AS (SELECT user_id AS job, event_id, (['check', 'download', 'merge', 'retrain'])[event_id % 4 + 1] AS phase, event_id % 3 = 0 AS found, event_id % 5 = 0 AS gates FROM events),
n AS (SELECT *, CASE WHEN phase = 'check' AND found THEN 'download_new_data' WHEN phase = 'check' THEN NULL WHEN phase = 'download' THEN 'run_phase3_accumulate'
  WHEN phase = 'merge' THEN 'run_phase4_retrain' WHEN gates THEN 'promote_challenger' ELSE 'continue_accumulating' END AS next FROM e)
SELECT job, coalesce(arg_max(next, event_id) FILTER (WHERE next IS NOT NULL), 'check_for_new_data') AS recommended_next_action,
  max(event_id) FILTER (WHERE phase = 'check') AS latest_check, arg_max('m/' || event_id, event_id) FILTER (WHERE phase = 'merge') AS latest_merged_path,
  arg_max('m/' || event_id, event_id) FILTER (WHERE phase = 'retrain') AS latest_model_path, max(event_id) AS last_updated FROM n GROUP BY job""")
def _(spark, d):
    events = V.table(spark, d, "events").selectExpr(
        "user_id AS job", "event_id AS run_ts", "element_at(array('check', 'download', 'merge', 'retrain'), cast(event_id % 4 AS int) + 1) AS phase",
        "IF(event_id % 3 = 0, 'download_recommended', 'no_action') AS action", "concat('m/', event_id) AS path", "event_id % 5 = 0 AS gates_passed")
    return I.run_state(events)


@query("ingest_run_log_rows", """
SELECT strftime(ts, '%Y-%m-%d_%H-%M-%S') AS run_id, CASE WHEN event_id % 5 = 4 THEN 'phase1_failed' WHEN event_id % 2 = 0 THEN 'no_new_data'
  WHEN event_id % 3 = 0 THEN 'phase2_failed' WHEN event_id % 7 = 0 THEN 'phase3_failed' ELSE 'success' END AS outcome,
  '[' || (event_id % 10 + 2015) || ']' AS years_checked, CAST(NULL AS VARCHAR) AS candidate_years, 'cloud_scheduler' AS triggered_by, false AS is_dry_run FROM events""")
def _(spark, d):
    runs = V.table(spark, d, "events").select(
        F.expr("translate(replace(substring(cast(ts AS string), 1, 19), ' ', '_'), ':', '-')").alias("run_ts"), F.lit("weekly_phases_1_3").alias("phase"),
        I.weekly_outcome(F.expr("IF(event_id % 2 = 0, 'no_action', 'download_recommended')"), F.expr("event_id % 3 <> 0"), F.expr("event_id % 7 <> 0"),
                         F.expr("event_id % 5 <> 4")).alias("outcome"),
        F.expr("array(event_id % 10 + 2015)").alias("years_checked"))
    return I.run_log_rows(runs).select("run_id", "outcome", "years_checked", "candidate_years", "triggered_by", "is_dry_run")


@query("ml18_model_versions", """
SELECT 'm' || c_custkey AS model_id, strftime(DATE '2020-01-01' + CAST(c_custkey % 2000 AS INTEGER), '%Y-%m-%d') AS trained_on, c_custkey % 50 = 0 AS is_champion,
  CAST(CASE WHEN c_custkey % 50 = 0 THEN 100 ELSE 0 END AS BIGINT) AS traffic_pct, c_custkey % 50 = 0 AS is_promoted FROM customer""")
def _(spark, d):
    models = V.table(spark, d, "customer").selectExpr(
        "concat('m', c_custkey) AS model_id", "cast(date_add(date'2020-01-01', cast(c_custkey % 2000 AS int)) AS string) AS training_date",
        "IF(c_custkey % 50 = 0, true, NULL) AS is_champion")
    return I.model_version_rows(models).select(
        "model_id", F.date_format(F.to_utc_timestamp("training_date", F.current_timezone()), "yyyy-MM-dd").alias("trained_on"), "is_champion", "traffic_pct",
        F.col("promoted_at").isNotNull().alias("is_promoted"))


@query("ml19_backfill_with_fallback", """
SELECT run_id, 'challenger_' || strftime(d, '%Y%m%d') AS challenger_model_id, coalesce(cf, hf) AS macro_f1, cf IS NOT NULL AS has_comparison FROM (
  SELECT strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderkey AS run_id, o_orderdate AS d, round(o_totalprice / 1000000, 4) AS hf,
    CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice / 900000, 4) END AS cf FROM orders)""")
def _(spark, d):
    orders = V.table(spark, d, "orders").selectExpr("*", "concat(cast(cast(o_orderdate AS date) AS string), '_', o_orderkey) AS run_ts")
    history = orders.selectExpr("run_ts", "round(o_totalprice / 1000000, 4) AS macro_f1", "0.5D AS roc_auc", "false AS all_gates_passed", "'do_not_promote' AS recommended_action")
    comparisons = orders.where("o_orderkey % 3 = 0").selectExpr(
        "run_ts", "round(o_totalprice / 900000, 4) AS macro_f1", "0.6D AS roc_auc", "true AS all_gates_passed", "'promote' AS recommended_action",
        "1L AS merged_rows", "1L AS effective_rows")
    return I.challenger_rows(history, comparisons).select("run_id", "challenger_model_id", "macro_f1", "has_comparison")
