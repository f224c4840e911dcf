"""Look-ups, filters, guards and column selection over incident tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def page(df: DataFrame, limit: int = 100, offset: int = 0, order_by: str = "id") -> DataFrame:
    """One page in key order."""
    return df.orderBy(order_by).offset(offset).limit(limit)


def first_rows(df: DataFrame, limit: int | None, order_by: str = "id") -> DataFrame:
    """The first rows in key order; all rows when no limit is asked for."""
    return df if limit is None else df.orderBy(order_by).limit(limit)


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` in the text stay wildcards."""
    return F.col(column).ilike(f"%{text}%")


def by_year(df: DataFrame, year: int, limit: int | None = None) -> DataFrame:
    return first_rows(df.where(F.col("year") == year), limit)


def by_severity(df: DataFrame, severity: str, limit: int | None = None) -> DataFrame:
    return first_rows(df.where(contains_text("severity_3class", severity)), limit)


def by_city(df: DataFrame, city: str, limit: int | None = None) -> DataFrame:
    return first_rows(df.where(contains_text("city_town_name", city)), limit)


def hotspots(df: DataFrame, limit: int | None = None) -> DataFrame:
    return first_rows(df.where(F.col("ems_hotspot_flag") == 1), limit)


def fatal(df: DataFrame, limit: int | None = None) -> DataFrame:
    return first_rows(df.where(F.col("numb_fatal_injr") > 0), limit)


def filter_crashes(df: DataFrame, year: int | None = None, city: str | None = None, severity: str | None = None,
                   weather: str | None = None, limit: int | None = None) -> DataFrame:
    """All given conditions together; empty and zero arguments are left out."""
    if year:
        df = df.where(F.col("year") == year)
    for column, text in (("city_town_name", city), ("severity_3class", severity), ("weath_cond_descr", weather)):
        if text:
            df = df.where(contains_text(column, text))
    return first_rows(df, limit)


def tidy_upper(column: str) -> Column:
    return F.trim(F.upper(F.col(column)))


def city_guard(df: DataFrame, city: str, column: str = "city_town_name") -> DataFrame:
    """Tidy the city name and keep one city."""
    return df.withColumn(column, tidy_upper(column)).where(F.col(column) == city.upper())


def city_guard_counts(df: DataFrame, city: str, column: str = "city_town_name") -> DataFrame:
    """How many rows the guard keeps and removes, in one pass."""
    match = F.coalesce(tidy_upper(column) == city.upper(), F.lit(False))
    return df.agg(F.count_if(match).alias("kept"), F.count_if(~match).alias("removed"))


def tolerant_select(df: DataFrame, wanted: Iterable[str]) -> tuple[DataFrame, list[str]]:
    """Lower-case all names and keep the wanted columns that exist, in the wanted order.

    Returns the projection and the names that were missing; no job is run.
    """
    wanted = list(wanted)
    lowered = df.toDF(*[c.lower() for c in df.columns])
    present = [c for c in wanted if c in lowered.columns]
    return lowered.select(*present), [c for c in wanted if c not in lowered.columns]


def drop_missing(df: DataFrame, subset: Iterable[str]) -> DataFrame:
    """Drop rows where any of the columns is null or NaN."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keep = F.lit(True)
    for name in subset:
        keep = keep & F.col(name).isNotNull()
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            keep = keep & ~F.isnan(name)
    return df.where(keep)


# The shortest route a prediction is made for.
MIN_DISTANCE_MILES = 0.3
MIN_DURATION_MINUTES = 2.0


def route_size_check(routes: DataFrame) -> DataFrame:
    """Add ``reject_reason``: null for acceptable routes."""
    short = F.col("distance_miles") < MIN_DISTANCE_MILES
    quick = F.col("duration_minutes") < MIN_DURATION_MINUTES
    return routes.withColumn(
        "reject_reason",
        F.when(short & quick, "distance and duration").when(short, "distance").when(quick, "duration"))


def incomplete_instances(df: DataFrame, features: Column, required: list[str]) -> DataFrame:
    """Add ``missing_features`` for instances given as a name -> value map."""
    needed = F.array(*[F.lit(name) for name in required])
    return df.withColumn("missing_features", F.array_except(needed, F.coalesce(F.map_keys(features), F.array())))


def prediction_shape_errors(df: DataFrame) -> DataFrame:
    """Add ``shape_error``: class, confidence and a probability map must all be there."""
    return df.withColumn(
        "shape_error",
        F.when(F.col("risk_class").isNull() | (F.col("risk_class") == ""), "risk_class")
        .when(F.col("confidence").isNull(), "confidence")
        .when(F.col("probabilities").isNull(), "probabilities"))


def batch_verdict(df: DataFrame, batch: str, expected: DataFrame, expected_count: str = "sent") -> DataFrame:
    """Per batch: accepted only if all rows came back and all are well-formed."""
    got = prediction_shape_errors(df).groupBy(batch).agg(
        F.count(F.lit(1)).alias("received"), F.count("shape_error").alias("malformed"))
    return expected.join(got, batch, "left").select(
        batch, expected_count,
        F.coalesce("received", F.lit(0)).alias("received"),
        F.coalesce("malformed", F.lit(0)).alias("malformed"),
        ((F.coalesce("received", F.lit(0)) == F.col(expected_count)) & (F.coalesce("malformed", F.lit(0)) == 0))
        .alias("accepted"))
