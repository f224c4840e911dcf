"""Grouped summaries, profiles and data-quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating column."""
    test = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(column)
    return test


def stats_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy("year").agg(
        F.count(F.lit(1)).alias("crashes"),
        F.coalesce(F.sum("numb_fatal_injr"), F.lit(0)).alias("fatalities"),
        F.coalesce(F.sum("numb_nonfatal_injr"), F.lit(0)).alias("injuries"),
    ).orderBy("year")


def value_counts(df: DataFrame, column: str, dropna: bool = False, normalize: bool = False) -> DataFrame:
    """Rows per value, optionally as a share of all counted rows."""
    if dropna:
        df = df.where(F.col(column).isNotNull())
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return counts
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("share", F.col("n") / total)


def top_groups(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k largest groups; names decide ties."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(k)


def breakdown_map(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows per value as one map column, for columns with few values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col(column).isNotNull())
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct(F.col(column).cast("string").alias("key"), "n")))).alias(name))


def reload_check(df: DataFrame, year: str = "year", severity: str = "severity_3class") -> DataFrame:
    """Row count, year range and rows per severity, in one pass over the table."""
    per_severity = df.groupBy(severity).agg(
        F.count(F.lit(1)).alias("rows"), F.min(year).alias("min_year"), F.max(year).alias("max_year"))
    return per_severity.select(
        F.coalesce(severity, F.lit("(null)")).alias("severity"), "rows", "min_year", "max_year",
    )


def null_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Share of missing values per column; one scan for all columns."""
    columns = columns or df.columns
    one = df.agg(*[F.avg(missing(df, c).cast("int")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_rate")


def validation_summary(df: DataFrame) -> DataFrame:
    """Per year: rows and the share of missing coordinates, times and severities."""
    def pct(test: Column) -> Column:
        return F.count_if(test) * 100.0 / F.count(F.lit(1))

    return df.groupBy("year").agg(
        F.count(F.lit(1)).alias("row_count"),
        pct(missing(df, "lat")).alias("lat_null_pct"),
        pct(missing(df, "lon")).alias("lon_null_pct"),
        pct(missing(df, "crash_datetime_clean")).alias("datetime_null_pct"),
        pct(F.col("severity_3class") == "Unknown").alias("severity_null_pct"),
        *[F.count_if(F.col("severity_3class") == s).alias("n_" + s.lower().replace(" ", "_"))
          for s in ("Fatal", "Injury", "No Injury", "Unknown")],
    )


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: missing rows, their share, estimated distinct values, sample values.

    The samples are the lowest and highest value as text: the aggregate state stays
    constant however many rows there are.
    """
    columns = columns or df.columns
    nulls = df.agg(F.count(F.lit(1)).alias("total"),
                   *[F.count_if(missing(df, c)).alias(f"null_{i}") for i, c in enumerate(columns)],
                   *[F.approx_count_distinct(c).alias(f"distinct_{i}") for i, c in enumerate(columns)],
                   *[F.min(F.col(c).cast("string")).alias(f"low_{i}") for i, c in enumerate(columns)],
                   *[F.max(F.col(c).cast("string")).alias(f"high_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"null_{i}").alias("null_count"),
                 (F.col(f"null_{i}") * 100.0 / F.col("total")).alias("null_pct"),
                 F.col(f"distinct_{i}").alias("distinct_estimate"),
                 F.array_distinct(F.array(f"low_{i}", f"high_{i}")).alias("samples"))
        for i, c in enumerate(columns)])
    return nulls.select(F.inline(rows))


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each rule; one scan for all rules."""
    one = df.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def accident_rules() -> dict[str, Column]:
    minutes = F.timestamp_diff("SECOND", F.col("Start_Time"), F.col("End_Time")) / 60.0
    return {
        "duration <= 0": minutes <= 0,
        "distance < 0": F.col("Distance") < 0,
        "humidity outside [0,100]": (F.col("Humidity") < 0) | (F.col("Humidity") > 100),
        "visibility < 0": F.col("Visibility") < 0,
        "wind speed < 0": F.col("Wind_Speed") < 0,
        "precipitation < 0": F.col("Precipitation") < 0,
    }


def outlier_share(df: DataFrame, test: Column) -> DataFrame:
    return df.agg(F.count_if(test).alias("n_outliers"), F.count(F.lit(1)).alias("n_rows"),
                  (F.count_if(test) * 100.0 / F.count(F.lit(1))).alias("outlier_pct"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact number of distinct values per column.

    Each (column, value) pair is first reduced to one row, so no task holds the values
    of a whole column.
    """
    values = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])))
    return values.where("value IS NOT NULL").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))


def feature_profile(df: DataFrame, features: list[str], target: Column) -> DataFrame:
    """Mean, range and Pearson correlation with the target per feature, in one pass."""
    df = df.select(*features, target.cast("double").alias("_target"))
    one = df.agg(*[agg for i, c in enumerate(features) for agg in (
        F.avg(c).alias(f"mean_{i}"), F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}"),
        F.corr(F.col(c).cast("double"), F.col("_target")).alias(f"corr_{i}"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"mean_{i}").alias("mean"), F.col(f"min_{i}").alias("min"),
                 F.col(f"max_{i}").alias("max"), F.col(f"corr_{i}").alias("correlation"))
        for i, c in enumerate(features)])))


def category_sums(df: DataFrame, column: str, prefix: str, minimum: int = 0, missing_as: str = "Unknown") -> DataFrame:
    """Rows per one-hot column name without building the wide table."""
    counts = df.groupBy(F.coalesce(column, F.lit(missing_as)).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return (counts.select(F.regexp_replace(F.concat(F.lit(f"{prefix}_"), "category"), "[^A-Za-z0-9_]", "_")
                          .alias("column_name"), "category", "n").where(F.col("n") >= minimum))
