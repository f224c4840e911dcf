"""Feature matrices: time, road, neighbourhood and one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashrisk.functions import calendar as C
from crashrisk.functions.cleaning import safe_name, without_nan
from crashrisk.operators.joins import risk_class
from crashrisk.operators.lookups import drop_missing
from crashrisk.operators.ordering import number_rows
from crashrisk.operators.quantiles import exact_quantiles
from crashrisk.operators.spatial import SPATIAL_COLUMNS


def medians(df: DataFrame, columns: list[str]) -> Column:
    """Struct of exact medians as a scalar subquery; 0 for a column without values."""
    long = exact_quantiles(df.select(*columns), columns, [0.5])
    return long.agg(F.struct(*[
        F.coalesce(F.max(F.when(F.col("column_name") == c, F.col("value"))), F.lit(0.0)).alias(c) for c in columns
    ]).alias("medians")).scalar()


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing numbers become the column's exact median."""
    return df.withColumn("_fills", medians(df, columns)).withColumns(
        {c: F.coalesce(without_nan(F.col(c).cast("double")), F.col("_fills")[c]) for c in columns}).drop("_fills")


def name_columns(values: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Safe column name per distinct value; names that collide get _1, _2 ... in value order."""
    named = values.withColumn("_safe", safe_name(F.concat(F.lit(prefix), F.col(column))))
    nth = F.row_number().over(Window.partitionBy("_safe").orderBy(column))
    return named.withColumn("_nth", nth).select(
        *values.columns,
        F.when(F.col("_nth") == 1, F.col("_safe")).otherwise(F.concat("_safe", F.lit("_"), F.col("_nth") - 1)).alias("column_name"))


def fit_vocabulary(df: DataFrame, column: str, missing_as: str | None = "Unknown", minimum: int = 1) -> list[str]:
    """Categories of a column in lexical order, for a wide table with a column for each.

    The names become column names of a plan, so they are held by the driver. Whether a
    column has few enough for that is the caller's choice; ``SparseEncoder`` takes any
    number of categories.
    """
    value = F.col(column) if missing_as is None else F.coalesce(column, F.lit(missing_as))
    found = df.select(value.alias("v")).where("v IS NOT NULL").groupBy("v").count().where(F.col("count") >= minimum).collect()
    return sorted(r["v"] for r in found)


def one_hot(column: str, vocabulary: list[str], prefix: str | None = None, missing_as: str | None = "Unknown") -> list[Column]:
    """0/1 columns for a fixed vocabulary; unseen values are all zeros."""
    value = F.col(column) if missing_as is None else F.coalesce(column, F.lit(missing_as))
    prefix = column if prefix is None else prefix
    seen: dict[str, int] = {}
    columns = []
    for item in vocabulary:
        name = "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else "_" for ch in f"{prefix}_{item}")
        repeats = seen.get(name, -1) + 1
        seen[name] = repeats
        columns.append(F.when(value == item, 1).otherwise(0).alias(f"{name}_{repeats}" if repeats else name))
    return columns


def _targeted(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_class", risk_class(F.col("severity_3class"))).where(F.col("severity_class").isNotNull())


def _with_time(df: DataFrame, evening_end: int) -> DataFrame:
    ts = F.col("crash_datetime_clean")
    if dict(df.dtypes)["crash_datetime_clean"] == "string":
        ts = C.utc_timestamp(ts)
    parts = C.calendar_parts(ts)
    return df.withColumns({"crash_datetime_clean": ts, **parts,
                           "is_rush_hour": C.rush_hour(parts["hour_of_day"], evening_end),
                           "light_phase": C.light_phase(parts["hour_of_day"])})


TIME_COLUMNS = ["hour_of_day", "day_of_week", "month", "is_weekend", "is_rush_hour"]
V1_NUMERIC = ["speed_limit", "numb_vehc", "ems_hotspot_flag", "ems_ped_hotspot_flag", "ems_peak_hour", "district_num", "lat", "lon"]
V1_CATEGORICAL = ["weath_cond_descr", "road_surf_cond_descr", "ambnt_light_descr", "manr_coll_descr", "rdwy_jnct_type_descr",
                  "city_town_name"]
LIGHT_PHASES = ["Dark", "Dawn_Dusk", "Daylight"]


def build_features_v1(df: DataFrame, key: str = "id") -> DataFrame:
    """First feature set: recorded numbers, time, one-hot categories; absent columns are skipped."""
    df = _with_time(_targeted(df), evening_end=18)
    numeric = [c for c in V1_NUMERIC if c in df.columns]
    filled = fill_median(df, [*numeric, *TIME_COLUMNS])
    hot = [col for c in V1_CATEGORICAL if c in df.columns for col in one_hot(c, fit_vocabulary(df, c))]
    return filled.select(key, *numeric, *TIME_COLUMNS, *hot, "severity_class")


def _forward_knowable(df: DataFrame, extra: list[str]) -> DataFrame:
    df = drop_missing(_with_time(_targeted(df), evening_end=19), ["lat", "lon", "crash_datetime_clean", *extra])
    return fill_median(df, ["speed_limit"])


def build_features_v2(df: DataFrame, key: str = "id") -> DataFrame:
    """Only what is known before a trip: place, time, speed limit, weather, light."""
    df = _forward_knowable(df, [])
    hot = one_hot("weath_cond_descr", fit_vocabulary(df, "weath_cond_descr"))
    light = one_hot("light_phase", fit_vocabulary(df, "light_phase"))
    return df.select(key, "lat", "lon", "speed_limit", *TIME_COLUMNS, *hot, *light, "severity_class")


WEATHER_MIN_SUM = 50


def build_features_v4(df: DataFrame, weather_keep: list[str] | None = None, key: str = "id",
                      minimum: int = WEATHER_MIN_SUM) -> tuple[DataFrame, list[str]]:
    """Forward-knowable columns plus the six neighbourhood columns; rare weather pruned.

    ``weather_keep`` holds weather categories fitted earlier; without it they are fitted
    here. Returns the matrix and the categories, for use on other rows.
    """
    df = _forward_knowable(df, SPATIAL_COLUMNS)
    if weather_keep is None:
        weather_keep = fit_vocabulary(df, "weath_cond_descr", minimum=minimum)
    matrix = df.select(key, "lat", "lon", "speed_limit", *TIME_COLUMNS, *SPATIAL_COLUMNS,
                       *one_hot("weath_cond_descr", weather_keep), *one_hot("light_phase", LIGHT_PHASES), "severity_class")
    return matrix, weather_keep


def feature_names(matrix: DataFrame, key: str = "id", label: str = "severity_class") -> list[str]:
    return [c for c in matrix.columns if c not in (key, label)]


def code_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values of a column and their places in lexical order, from 0.

    Values are numbered through a range partitioning, so there may be any number of them.
    """
    values = df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct()
    return number_rows(values, ["value"], "code", start=0)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Class -> 0..k-1 in sorted order, as column ``code``; null for a null class."""
    codes = code_table(df, column).select(F.col("value").alias("_value"), F.col("code").cast("int").alias("code"))
    return df.join(codes, df[column] == F.col("_value"), "left").drop("_value")


class SparseEncoder:
    """Numbers and one-hot blocks side by side as sparse rows, for columns with any number of categories.

    Fitting numbers the categories of every column; only their counts reach the driver. A
    row gets ``size``, ``indices`` and ``values``: the numbers first, then a 1 in each
    column's block. Null and unseen categories leave their block empty, null numbers are 0.
    """

    def __init__(self, train: DataFrame, categories: list[str], numbers: list[str]):
        self.numbers = numbers
        self.tables = {c: code_table(train, c) for c in categories}
        self.starts, at = {}, len(numbers)
        for c, table in self.tables.items():
            self.starts[c] = at
            at += table.count()
        self.size = at

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, (c, table) in enumerate(self.tables.items()):
            codes = table.select(F.col("value").alias(f"_value_{i}"), (F.col("code") + self.starts[c]).alias(f"_code_{i}"))
            out = out.join(codes, out[c] == F.col(f"_value_{i}"), "left").drop(f"_value_{i}")
        hot = F.array_compact(F.array(*[F.col(f"_code_{i}") for i in range(len(self.tables))]))
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.numbers]
        return out.withColumns({
            "size": F.lit(self.size).cast("bigint"),
            "indices": F.concat(F.array(*[F.lit(i).cast("bigint") for i in range(len(numbers))]).cast("array<bigint>"), hot),
            "values": F.concat(F.array(*numbers).cast("array<double>"), F.transform(hot, lambda _: F.lit(1.0))),
        }).drop(*[f"_code_{i}" for i in range(len(self.tables))])


def to_vectors(df: DataFrame, name: str = "features") -> DataFrame:
    """Sparse rows as a vector column that the fits read (one Python call a row; nothing is collected)."""
    from pyspark.ml.linalg import VectorUDT, Vectors

    vector = F.udf(lambda size, indices, values: Vectors.sparse(size, indices, values), VectorUDT())
    return df.withColumn(name, vector("size", "indices", "values")).drop("size", "indices", "values")
