"""Sinks: dated snapshots, verified reloads, day-partitioned tables, candidate files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crashrisk.operators.aggregates import reload_check
from crashrisk.operators.boosting import BoostedModel
from crashrisk.sources.schemas import ANALYTICS_TABLES, conform

_TEXT_AS_IS = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def export_snapshot(df: DataFrame, root: str, name: str, run_ts: str) -> str:
    """Whole table to ``root/name/run_ts``; nested and binary columns become text."""
    plain = [F.col(f.name) if isinstance(f.dataType, _TEXT_AS_IS)
             else (F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
                   else F.col(f.name).cast("string")).alias(f.name) for f in df.schema.fields]
    path = f"{root}/{name}/{run_ts}"
    df.select(*plain).write.mode("errorifexists").parquet(path)
    return path


def reload_table(df: DataFrame, path: str) -> DataFrame:
    """Replace a table and return its check rows: (severity, expected, loaded, matches, years)."""
    df.write.mode("overwrite").parquet(path)
    loaded = reload_check(df.sparkSession.read.parquet(path))
    expected = reload_check(df).select("severity", F.col("rows").alias("expected"))
    return expected.join(loaded, "severity", "full").select(
        "severity", "expected", F.col("rows").alias("loaded"),
        F.coalesce(F.col("expected") == F.col("rows"), F.lit(False)).alias("matches"), "min_year", "max_year")


def append_analytics(df: DataFrame, root: str, name: str) -> None:
    """Append to an analytics table: one folder per day, rows in cluster order inside files.

    The rebalance hint gathers the rows of a day, merges small days into one task and
    splits a heavy day over several, from measured sizes.
    """
    schema, time_column, clusters = ANALYTICS_TABLES[name]
    rows = conform(df, schema)
    if time_column is None:
        rows.write.mode("append").parquet(f"{root}/{name}")
        return
    rows = rows.withColumn("day", F.to_date(time_column)).hint("rebalance", "day").sortWithinPartitions("day", *clusters)
    rows.write.mode("append").partitionBy("day").parquet(f"{root}/{name}")


def write_stage(df: DataFrame, root: str, stage: str, run_ts: str) -> str:
    """Candidate rows of a stage, one folder per run and year."""
    path = f"{root}/{stage}"
    (df.withColumn("run_ts", F.lit(run_ts)).hint("rebalance", "year")
     .write.mode("append").partitionBy("run_ts", "year").parquet(path))
    return path


def prediction_events(df: DataFrame) -> DataFrame:
    """Prediction rows with a new id and the present UTC time, ready to append."""
    return df.withColumns({"prediction_id": F.expr("uuid()"), "timestamp": F.current_timestamp(),
                           "gemini_explanation_generated": F.lit(False)})


def save_artefacts(spark: SparkSession, root: str, run_ts: str, model, features: list[str],
                   thresholds: DataFrame, weather_keep: list[str], comparison: DataFrame) -> None:
    """Model and its small companion tables, keyed by run."""
    path = f"{root}/models/{run_ts}"
    if isinstance(model, BoostedModel):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    stamp = F.lit(run_ts).alias("run_ts")
    spark.createDataFrame(list(enumerate(features)), "position int, feature string").select(stamp, "*") \
        .write.mode("append").parquet(f"{root}/features")
    spark.createDataFrame([(c,) for c in weather_keep], "category string").select(stamp, "*") \
        .write.mode("append").parquet(f"{root}/weather_keep")
    thresholds.select(stamp, "*").write.mode("append").parquet(f"{root}/thresholds")
    comparison.select(stamp, "*").write.mode("append").parquet(f"{root}/comparison")
