"""SRC-1/2/5, SNK, SCH-1 and STR queries: written under the shared folder, then read back."""

from pyspark.sql import functions as F

from crashrisk.plans import ingest as I
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query
from crashrisk.session import scratch_path
from crashrisk.sources import readers as R
from crashrisk.sources import schemas as S
from crashrisk.sources import writers as W
from crashrisk.streaming import events as E


@query("sch1_conform", V.with_views("crashes", then="""
SELECT id, crash_numb, strftime(crash_datetime_clean, '%Y-%m-%d %H:%M:%S') AS crash_datetime_clean, year, city_town_name, CAST(NULL AS VARCHAR) AS rdwy,
  CAST(speed_limit AS DOUBLE) AS speed_limit, 26 AS n_columns FROM crashes"""))
def _(spark, d):
    out = S.conform(V.crashes(spark, d), S.CRASHES)
    return out.select("id", "crash_numb", "crash_datetime_clean", F.col("year").cast("int").alias("year"), "city_town_name", "rdwy",
                      F.col("speed_limit").cast("double").alias("speed_limit"), F.lit(len(out.columns)).alias("n_columns"))


@query("src1_parquet_scan", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01' AND o_orderstatus = 'F'""")
def _(spark, d):
    return R.read_table(spark, f"{d}/orders.parquet").where(
        "o_orderdate >= timestamp_ntz'1999-06-01 00:00:00' AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("src2_csv_scan", "SELECT p_partkey, p_name, p_retailprice FROM part")
def _(spark, d):
    path = scratch_path(spark, "parts-csv")
    parts = V.table(spark, d, "part")
    parts.write.option("header", True).csv(path)
    return R.read_csv(spark, path, parts.schema, drop=["p_brand", "p_type", "p_size"])


@query("src5_run_logs", """
SELECT 'run' || event_id AS run_timestamp, event_type AS outcome, event_id % 2 = 0 AS dry_run FROM events WHERE event_id % 10 <> 3""")
def _(spark, d):
    path = scratch_path(spark, "run-logs")
    V.table(spark, d, "events").select(F.to_json(F.expr(
        "named_struct('run_timestamp', concat('run', event_id), 'outcome', IF(event_id % 10 = 3, NULL, event_type), 'dry_run', event_id % 2 = 0)"))
        .alias("value")).write.text(path)
    logs = spark.read.schema(R.RUN_LOG).json(path)
    return R.keep_complete_logs(logs).select("run_timestamp", "outcome", "dry_run")


@query("snk1_export_snapshot", "SELECT vec_id, label, len(embedding) AS n FROM embeddings")
def _(spark, d):
    path = W.export_snapshot(V.table(spark, d, "embeddings"), scratch_path(spark, "exports"), "embeddings", "2026-01-05_06-00-00")
    return spark.read.parquet(path).select("vec_id", "label", F.size(F.from_json("embedding", "array<float>")).cast("bigint").alias("n"))


@query("snk2_verified_reload", V.with_views("crashes", then="""
SELECT severity_3class AS severity, count(*) AS expected, count(*) AS loaded, true AS matches, min(year) AS min_year, max(year) AS max_year
FROM crashes GROUP BY 1"""))
def _(spark, d):
    return W.reload_table(V.crashes(spark, d), scratch_path(spark, "reload"))


def predictions(spark, d):
    return V.table(spark, d, "events").selectExpr(
        "concat('p', event_id) AS prediction_id", "cast(ts AS timestamp) AS timestamp", "event_type AS risk_class", "value AS confidence",
        "concat('v', user_id % 3) AS model_version")


@query("snk3_prediction_rows", "SELECT count(*) AS n, count(*) AS n_ids, true AS stamped, 30 AS n_columns FROM events")
def _(spark, d):
    rows = S.conform(W.prediction_events(predictions(spark, d).drop("prediction_id", "timestamp")), S.ROUTE_PREDICTIONS)
    path = scratch_path(spark, "predictions")
    rows.write.parquet(path)
    back = spark.read.parquet(path)
    return back.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prediction_id").alias("n_ids"),
                    (F.count("timestamp") == F.count(F.lit(1))).alias("stamped")).withColumn("n_columns", F.lit(len(back.columns)))


@query("snk4_day_partitioned", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS risk_class, count(*) AS n FROM events GROUP BY 1, 2""")
def _(spark, d):
    root = scratch_path(spark, "analytics")
    W.append_analytics(predictions(spark, d), root, "route_predictions")
    back = spark.read.parquet(f"{root}/route_predictions")
    return back.groupBy(F.col("day").cast("string").alias("day"), "risk_class").agg(F.count(F.lit(1)).alias("n"))


@query("snk5_stage_files", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS year, '2026-01-05_06-00-00' AS run_ts, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, d):
    rows = V.table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    path = W.write_stage(rows, scratch_path(spark, "candidate"), "processed", "2026-01-05_06-00-00")
    return spark.read.parquet(path).groupBy("year", "run_ts").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_training_null_rates", V.with_views("crashes", then="""
SELECT unnest(['lat', 'lon', 'crash_datetime_clean', 'severity_3class', 'weath_cond_descr']) AS column_name,
  unnest([0.0e0, 0.0e0, 0.0e0, 0.0e0, round(avg(CASE WHEN weath_cond_descr IS NULL THEN 1 ELSE 0 END), 6)]) AS null_rate FROM crashes"""))
def _(spark, d):
    return I.null_rates_of_training_columns(V.crashes(spark, d)).withColumn("null_rate", F.round("null_rate", 6))


def event_stream(spark, d):
    return E.read_event_stream(spark, d, V.table(spark, d, "events").schema, fmt="parquet", glob="events.parquet")


def _drain(stream_query):
    stream_query.awaitTermination()


@query("str1_event_ingest", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    path, mark = scratch_path(spark, "stream"), scratch_path(spark, "stream-mark")
    for _run in range(2):  # the second run finds nothing new
        _drain(E.append_by_day(event_stream(spark, d), "ts", path, mark))
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("str2_replay_once", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    path, mark = scratch_path(spark, "replay"), scratch_path(spark, "replay-mark")
    stream = event_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = E.once_per_key(stream.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", "1 day").drop("copy")
    _drain(E.append_by_day(once, "ts", path, mark))
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("str3_alerts_once", """
WITH a AS (SELECT event_id, (['no_new_data', 'merge_complete', 'retrain_complete', 'failure', 'new_data'])[event_id % 5 + 1] AS kind, ts,
  'merged/' || user_id AS p, 'run' || (event_id // 10) AS run_ts FROM events)
SELECT kind, count(DISTINCT CASE kind WHEN 'no_new_data' THEN strftime(ts, '%G-W%V') WHEN 'merge_complete' THEN p WHEN 'retrain_complete' THEN run_ts
  ELSE CAST(event_id AS VARCHAR) END) AS n FROM a GROUP BY kind""")
def _(spark, d):
    path, mark = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-mark")
    stream = event_stream(spark, d).selectExpr(
        "event_id", "element_at(array('no_new_data', 'merge_complete', 'retrain_complete', 'failure', 'new_data'), cast(event_id % 5 AS int) + 1) AS kind",
        "cast(ts AS timestamp) AS ts", "concat('merged/', user_id) AS merged_path", "concat('run', event_id div 10) AS run_ts")
    _drain(E.append_by_day(E.alerts_once(stream), "ts", path, mark))
    return spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
