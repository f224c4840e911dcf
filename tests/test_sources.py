"""Readers and writers on real files, and streams that are run twice."""

import json

import pytest
from pyspark.sql import functions as F

from crashrisk.sources import readers as R
from crashrisk.sources import schemas as S
from crashrisk.sources import writers as W
from crashrisk.streaming import events as E


def test_landed_pages_skip_failed_sources(spark, tmp_path):
    page = {"features": [{"attributes": {"CRASH_NUMB": 1}}, {"attributes": {"CRASH_NUMB": 2}}], "exceededTransferLimit": True}
    (tmp_path / "2023-0.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "2023-1.json").write_text(json.dumps({"features": [], "exceededTransferLimit": False}))
    (tmp_path / "2024-0.json").write_text(json.dumps(page))
    (tmp_path / "2024-1.json").write_text(json.dumps({"error": {"code": 500, "message": "down"}}))
    rows, rejects = R.read_feature_pages(spark, str(tmp_path), "CRASH_NUMB: bigint")
    assert sorted((r["source"], r["CRASH_NUMB"]) for r in rows.collect()) == [("2023", 1), ("2023", 2)]
    assert [(r["source"], r["reason"]) for r in rejects.collect()] == [("2024", "down")]


def test_run_logs_skip_the_unreadable(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"run_timestamp": "2026-01-05_06-00-00",\n "outcome": "success", "new_years": [2025]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"outcome": "success"}')
    assert [r["new_years"] for r in R.read_run_logs(spark, str(tmp_path)).collect()] == [[2025]]


def test_csv_reads_only_the_wanted_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ID,Severity,Description\nA-1,2,long text\n")
    df = R.read_csv(spark, str(tmp_path), S.layout("ID STRING, Severity INT, Description STRING"), drop=["Description"])
    assert [tuple(r) for r in df.collect()] == [("A-1", 2)]


def test_snapshot_is_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0])], "a int, b array<double>")
    W.export_snapshot(df, str(tmp_path), "t", "r1")
    assert dict(spark.read.parquet(str(tmp_path / "t" / "r1")).dtypes) == {"a": "int", "b": "string"}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        W.export_snapshot(df, str(tmp_path), "t", "r1")


def test_all_analytics_tables_take_appends(spark, tmp_path):
    for name, (schema, _time, _clusters) in S.ANALYTICS_TABLES.items():
        key = schema.fields[0].name
        row = spark.createDataFrame([("k1",)], f"{key} string").withColumns(
            {c: F.to_timestamp(F.lit("2026-01-05 06:00:00")) for c in ("timestamp", "run_timestamp") if c in schema.names})
        for _ in range(2):
            W.append_analytics(row, str(tmp_path), name)
        assert spark.read.parquet(str(tmp_path / name)).count() == 2


def test_verified_reload_reports_each_severity(spark, tmp_path):
    df = spark.createDataFrame([(2020, "Fatal"), (2021, None)], "year int, severity_3class string")
    assert all(r["matches"] for r in W.reload_table(df, str(tmp_path / "t")).collect())


def test_stream_run_twice_adds_nothing_twice(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = S.layout("prediction_id STRING, timestamp TIMESTAMP")
    for i, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(x,) for x in ids], "prediction_id string").withColumn(
            "timestamp", F.lit("2026-01-05T06:00:00").cast("timestamp")).coalesce(1).write.mode("append").json(source)
        stream = E.once_per_key(E.read_event_stream(spark, source, schema), "prediction_id", "timestamp", "1 day")
        for _ in range(2):
            E.append_by_day(stream, "timestamp", out, mark).awaitTermination()
    assert sorted(r["prediction_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_alerts_are_sent_once_ever(spark, tmp_path):
    """Late and repeated alerts over several micro-batches, weeks apart, and a restart in between: the keys of the batch rule."""
    import datetime as dt

    from pyspark.sql import functions as F

    from crashrisk.operators.ordering import alert_key, alerts_to_send
    from crashrisk.streaming.events import alerts_once, append_by_day, read_event_stream
    start = dt.datetime(2024, 3, 4, 12)
    days = [0, 1, 40, 2, 300, 41, 0, 700, 1, 301, 5, 699]  # far apart, and back again
    rows = [(i, ("no_new_data", "merge_complete", "retrain_complete", "failure")[i % 4], start + dt.timedelta(days=days[i % len(days)], hours=i % 5),
             f"merged/{i % 3}" if i % 8 else "", f"run{i % 5}") for i in range(96)]
    schema = "event_id long, kind string, ts timestamp, merged_path string, run_ts string"
    batch = spark.createDataFrame(rows, schema)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for part in range(4):
        batch.where(F.col("event_id") % 4 == (part * 3) % 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = read_event_stream(spark, str(tmp_path / "in"), batch.schema, "parquet", files_per_batch=1)
        append_by_day(alerts_once(stream), "ts", out, mark).awaitTermination()
    batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # all of them once more
    stream = read_event_stream(spark, str(tmp_path / "in"), batch.schema, "parquet", files_per_batch=1)
    append_by_day(alerts_once(stream), "ts", out, mark).awaitTermination()
    key = alert_key(F.col("kind"), F.col("ts"), F.col("merged_path"), F.col("run_ts"))
    sent = spark.read.parquet(out)
    got = sorted(r["k"] for r in sent.select(key.alias("k")).where("k IS NOT NULL").collect())
    want = sorted(r["k"] for r in alerts_to_send(batch).select(key.alias("k")).where("k IS NOT NULL").collect())
    assert got == want
    assert sent.where(key.isNull()).count() == 2 * batch.where(key.isNull()).count()
