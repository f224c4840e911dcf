"""Prediction and alert events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from crashrisk.operators.ordering import alert_key


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", glob: str | None = None,
                      files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def append_by_day(stream: DataFrame, time_column: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append all waiting events to a day-partitioned table; the checkpoint makes a re-run add nothing twice."""
    return (stream.withColumn("day", F.to_date(time_column)).writeStream.format("parquet").partitionBy("day")
            .option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def once_per_key(stream: DataFrame, key: str, time_column: str, delay: str) -> DataFrame:
    """Replayed events dropped by key; state is kept for ``delay`` past the newest event."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark([key])


def alerts_once(stream: DataFrame) -> DataFrame:
    """One alert per week, merged file or retrain run, ever; failures and new data always.

    The state is the set of keys that were sent. It has no watermark, so a key is never
    forgotten and no alert is too late; its size is the number of weeks, merged files and
    runs. Alerts without a key pass by it, without state.
    """
    keyed = stream.withColumn("alert_key", alert_key(F.col("kind"), F.col("ts"), F.col("merged_path"), F.col("run_ts")))
    once = keyed.where("alert_key IS NOT NULL").dropDuplicates(["alert_key"])
    return once.unionByName(keyed.where("alert_key IS NULL"))
