"""Exact quantiles and rank selection without gathering a column in one task.

A mergeable summary of each column, made by one scan, gives a bracket of values round
every wanted rank, however the values are spread. A second scan counts what lies below a
bracket and keeps, as (value, count), only what lies inside, a few thousandths of the
rows; only those are ever ordered. Nothing else is read, so both scans are the whole cost.
Brackets of whole columns are looked up in a map, so values stay in the tasks that read
them; those of groups are joined in ``_SHARDS`` shards of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of a summary, and its accuracy: a point is at most 1 / _ACCURACY of the rows off its place.
_POINTS, _ACCURACY = 500, 5000
#: Tasks that the values of one group are dealt out to.
_SHARDS = 64


def _values(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by..., column_name, value) of the values that are there."""
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(c).cast("double") + 0.0).alias("value"))
                        for c in columns])
    return df.select(*by, F.inline(entries)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def _summary(values: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row per key: the number of values, both ends, points in between, and what else is asked for."""
    shares = [i / _POINTS for i in range(_POINTS + 1)]
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("value", shares, _ACCURACY).alias("points"), *more)


def _locate(values: DataFrame, keys: list[str], targets: Column, summary: DataFrame) -> DataFrame:
    """Values holding the wanted ranks: keys, value, target struct (with ``rank``).

    ``targets`` makes an array of structs from the columns of ``summary``; ranks count
    from zero. A point at or before the one in front of the rank's place has a smaller
    rank, the second one behind it a larger one, whatever the error of the summary.
    """
    place = lambda t: F.floor(t["rank"] * _POINTS / F.col("total"))
    bracket = lambda t, i: F.struct(
        i.alias("i"), t.alias("target"),
        F.when(place(t) < 2, F.col("low")).otherwise(F.get("points", (place(t) - 1).cast("int"))).alias("least"),
        F.when(place(t) > _POINTS - 3, F.col("high")).otherwise(F.get("points", (place(t) + 2).cast("int"))).alias("most"))
    brackets = summary.withColumn("targets", targets).select(*keys, F.transform("targets", bracket).alias("brackets"))
    # a value below a bracket only counts, one above it is not passed on
    if keys == ["column_name"]:  # one entry per column asked for
        found = brackets.agg(F.map_from_entries(F.collect_list(F.struct("column_name", "brackets")))).scalar()
        beside = values.withColumn("_found", found).withColumn("brackets", F.try_element_at("_found", "column_name")).drop("_found")
    else:
        dealt = brackets.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(_SHARDS - 1))))
        beside = values.withColumn("_shard", F.pmod(F.hash("value"), F.lit(_SHARDS))).join(dealt, [*keys, "_shard"])
    met = beside.select(*keys, "value", F.explode(
        F.filter("brackets", lambda b: F.col("value") <= b["most"])).alias("b"))
    spots = met.groupBy(*keys, F.col("b.i").alias("i"), F.col("b.target").alias("target"),
                        F.when(F.col("value") >= F.col("b.least"), F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(*keys, "i").orderBy(F.col("value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = spots.withColumn("end", F.sum("n").over(window))
    found = ranked.where((F.col("target.rank") < F.col("end")) & (F.col("target.rank") >= F.col("end") - F.col("n")))
    return found.select(*keys, "value", "target")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """Linearly interpolated quantiles: (by..., column_name, p, value), missing values left out."""
    by = by or []
    keys = [*by, "column_name"]
    values = _values(df, columns, by)
    return _interpolated(_locate(values, keys, _targets(probabilities), _summary(values, keys)), keys)


def _targets(probabilities: list[float], *more: str) -> Column:
    """Both neighbours of each position, with the weight of the upper one and ``more`` columns of the summary."""
    position = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    return F.array(*[
        F.struct(pick(position(p)).cast("long").alias("rank"), F.lit(float(p)).alias("p"), (position(p) - F.floor(position(p))).alias("weight"), *more)
        for p in probabilities for pick in (F.floor, F.ceil)])


def _interpolated(found: DataFrame, keys: list[str]) -> DataFrame:
    # both neighbours of a position carry its weight; they are equal when they coincide
    return (
        found.groupBy(*keys, "target.p", F.col("target.weight").alias("weight"))
        .agg(F.min("value").alias("lower"), F.max("value").alias("upper"))
        .select(*keys, "p", (F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("weight")).alias("value"))
    )


def kth_smallest(df: DataFrame, column: str, k: DataFrame, by: list[str]) -> DataFrame:
    """Value at a per-group rank counted from one: ``k`` has the group columns and ``k``."""
    keys = [*by, "column_name"]
    wanted = F.array(F.struct((F.col("k") - 1).alias("rank")))
    values = _values(df, [column], by)
    found = _locate(values, keys, wanted, _summary(values, keys).join(k, by))
    return found.select(*by, F.col("value").alias(column))


def quantile_value(df: DataFrame, column: str, p: float) -> Column:
    """One exact quantile of a whole column, as a scalar subquery."""
    return exact_quantiles(df.select(column), [column], [p]).select(F.max("value")).scalar()


def describe(df: DataFrame, columns: list[str], probabilities: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, sample deviation, range and exact quantiles per column, in two scans."""
    keys, facts = ["column_name"], ["total", "mean", "std", "low", "high"]
    values = _values(df, columns, [])
    summary = _summary(values, keys, F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    found = _locate(values, keys, _targets(list(probabilities), *facts), summary)  # the facts ride along, so that the summary is read once

    def quantile(p: float) -> Column:
        own = F.when(F.col("target.p") == p, F.col("value"))
        weight = F.max(F.when(F.col("target.p") == p, F.col("target.weight")))
        return (F.min(own) + (F.max(own) - F.min(own)) * weight).alias(f"p{round(p * 100)}")

    out = found.groupBy("column_name", *(F.col(f"target.{c}").alias(c) for c in facts)).agg(*map(quantile, probabilities))
    return out.withColumnsRenamed({"total": "n", "low": "min", "high": "max"})
