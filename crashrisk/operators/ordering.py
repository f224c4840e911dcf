"""Conflict resolution, numbering and run-history operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashrisk.functions.calendar import iso_week_key
from crashrisk.session import materialise


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in df.columns])


def keep_best(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the one with the largest ``order``; rows without a key all stay.

    An aggregate rather than a ranked window: the best row per key is found before the
    shuffle, so a key with very many versions costs its task no more than any other.
    """
    best = (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        .select("_row.*")
    )
    return best.unionByName(df.where(F.col(key).isNull()))


def resolve_conflicts(df: DataFrame, key: str = "crash_numb", source: str = "_source", run_ts: str = "_run_ts",
                      mode: str = "candidate_wins") -> DataFrame:
    """Merge versions of a row: candidates before production, newest run first.

    ``mode="production_wins"`` turns the source order round.
    """
    if mode not in ("candidate_wins", "production_wins"):
        raise ValueError(f"unknown mode: {mode}")
    is_production = F.col(source) == "production"
    first = ~is_production if mode == "candidate_wins" else is_production
    return keep_best(df, key, [first.cast("int"), F.coalesce(run_ts, F.lit("")), row_hash(df)])


def number_rows(df: DataFrame, order: list[str], name: str = "id", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Consecutive numbers in sort order without a global window.

    Rows are range-partitioned and sorted (a hash of the row breaks ties, so equal keys
    spread over partitions too), made durable, and numbered inside each partition from
    the sum of the partitions before it. Only one number per partition is brought
    together.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order] + [F.col("_tie").asc()]
    ordered = df.withColumn("_tie", row_hash(df)).repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("_tie")
    fixed = materialise(ordered).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_nth"))
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # at most ``partitions`` rows
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return fixed.join(before, "_part").select(
        (F.col("_before") + F.col("_nth") + start).alias(name), *[c for c in df.columns if c != name])


def best_variant(df: DataFrame, metric: str = "macro_f1", by: list[str] | None = None) -> DataFrame:
    """The row with the highest metric (per group); names decide ties."""
    score = F.struct(F.col(metric), row_hash(df))
    return df.groupBy(*(by or [])).agg(F.max_by(F.struct(*df.columns), score).alias("_row")).select("_row.*")


def rows_since_retrain(runs: DataFrame, stream: str = "job", run_ts: str = "run_ts", phase: str = "phase",
                       rows: str = "merged_rows", retrain: str = "retrain", period: Column | None = None) -> DataFrame:
    """Merged rows of every run minus those at the retrain before it (null before the first).

    ``period`` is any value that grows with ``run_ts`` (default: the month of a run
    stamp). The last retrain of earlier periods is carried over a table with one row per
    period, so that even a job with very many runs is never ordered in one task.
    """
    period = F.substring(run_ts, 1, 7) if period is None else period
    marked = runs.withColumns({"_period": period, "_kept": F.when(F.col(phase) == retrain, F.col(rows))})
    per_period = marked.groupBy(stream, "_period").agg(
        F.max_by("_kept", F.when(F.col("_kept").isNotNull(), F.col(run_ts))).alias("_kept"))
    before = [Window.unboundedPreceding, -1]
    carried = per_period.select(stream, "_period", F.last("_kept", ignorenulls=True).over(
        Window.partitionBy(stream).orderBy("_period").rowsBetween(*before)).alias("_carried"))
    inside = F.last("_kept", ignorenulls=True).over(Window.partitionBy(stream, "_period").orderBy(run_ts).rowsBetween(*before))
    return marked.withColumn("_last", inside).join(carried, [stream, "_period"]).select(
        *runs.columns, (F.col(rows) - F.coalesce("_last", "_carried")).alias("rows_since_retrain"))


def alert_key(kind: Column, ts: Column, merged_path: Column, run_ts: Column) -> Column:
    """What makes two alerts the same; null for alerts that are always sent."""
    return (F.when(kind == "no_new_data", F.concat(F.lit("week:"), iso_week_key(ts)))
            .when((kind == "merge_complete") & (merged_path != ""), F.concat(F.lit("path:"), merged_path))
            .when(kind == "retrain_complete", F.concat(F.lit("run:"), run_ts)))


def alerts_to_send(alerts: DataFrame, order: str = "ts") -> DataFrame:
    """The first alert per key, and every alert without a key."""
    keyed = alerts.withColumn("_alert", alert_key(F.col("kind"), F.col("ts"), F.col("merged_path"), F.col("run_ts")))
    first = keyed.where("_alert IS NOT NULL").groupBy("_alert").agg(
        F.min_by(F.struct(*alerts.columns), F.struct(order, "run_ts")).alias("_row")).select("_row.*")
    return first.unionByName(keyed.where("_alert IS NULL").select(*alerts.columns))
