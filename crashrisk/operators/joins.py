"""Dictionary look-ups, key look-ups and small comparison joins.

No side is ever hinted as broadcast: adaptive execution broadcasts a side only after
it has measured it to be below the session's threshold, and joins by shuffle otherwise.
Rows that were exploded go through ``by_shuffle`` first, as their guessed size is that of
the rows they were exploded from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Raw severity text -> severity class; severity class -> risk class.
SEVERITY_3CLASS = {
    "Fatal injury": "Fatal",
    "Non-fatal injury": "Injury",
    "Property damage only (none injured)": "No Injury",
    "Not Reported": "Unknown",
    "Unknown": "Unknown",
}
RISK_CLASS = {"No Injury": "Low", "Injury": "Medium", "Fatal": "High"}
SEVERITY_SCORE = {"Low": 0.0, "Medium": 1.0, "High": 2.0}
RISK_ORDER = {"Low": 0, "Medium": 1, "High": 2}


def lookup(column: Column, mapping: dict, default: Column | None = None) -> Column:
    """Value for a key from a dictionary that is part of the code."""
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(literal, column)
    return found if default is None else F.coalesce(found, default)


def severity_3class(raw: Column) -> Column:
    return lookup(raw, SEVERITY_3CLASS, F.lit("Unknown"))


def risk_class(severity: Column) -> Column:
    return lookup(severity, RISK_CLASS)


def severity_score(risk: Column) -> Column:
    return lookup(risk, SEVERITY_SCORE)


def by_shuffle(df: DataFrame) -> DataFrame:
    """To be joined by shuffle and sort on either side, whatever size the planner guesses."""
    return df.hint("merge")


def attach(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left look-up of columns computed on another projection of the same rows."""
    return df.join(other.select(key, *columns), key, "left")


def speed_by_point(points: DataFrame, intervals: DataFrame, base_speed: Column, interval_speed: Column) -> DataFrame:
    """Speed of the last interval covering each polyline point, else the base speed.

    ``points``: trip_id, route_index, point_index; ``intervals``: start_idx, end_idx
    (inclusive), interval_pos. A route's intervals become one list, last first, which is
    joined to its points by the route alone; each point takes the first that covers it.
    So indices far outside the route cost nothing, and intervals can overlap without
    multiplying rows.
    """
    route = ["trip_id", "route_index"]
    lists = (
        intervals.where(F.col("end_idx") >= F.greatest(F.col("start_idx"), F.lit(0)))
        .groupBy(*route).agg(F.sort_array(F.collect_list(F.struct(
            "interval_pos", "start_idx", "end_idx", interval_speed.alias("speed"))), asc=False).alias("_intervals"))
    )
    covering = F.filter("_intervals", lambda i: (i["start_idx"] <= F.col("point_index")) & (i["end_idx"] >= F.col("point_index")))
    return points.join(by_shuffle(lists), route, "left").withColumn(
        "speed_limit", F.coalesce(F.get(covering, F.lit(0))["speed"], base_speed)).drop("_intervals")


def compare_with_previous(current: DataFrame, previous: DataFrame, key: str = "year") -> DataFrame:
    """Current counts next to the counts of the previous check's OK rows."""
    ok = previous.where(F.col("status") == "ok").select(key, F.col("count").alias("previous_count"))
    return current.join(ok, key, "left")


def metric_deltas(challengers: DataFrame, champions: DataFrame, metrics: list[str],
                  challenger_key: str = "champion_model_id", champion_key: str = "model_id") -> DataFrame:
    """Each challenger run next to the champion it is measured against, with deltas."""
    champion = champions.select(F.col(champion_key).alias(challenger_key),
                                *[F.col(m).alias(f"champion_{m}") for m in metrics])
    joined = challengers.join(champion, challenger_key, "left")
    return joined.select("*", *[(F.col(m) - F.col(f"champion_{m}")).alias(f"delta_{m}") for m in metrics])


def feedback_rates(predictions: DataFrame, feedback: DataFrame, accepted: str = "route_accepted") -> DataFrame:
    """Share of predictions of each class with feedback, and with positive feedback."""
    per_prediction = feedback.groupBy("prediction_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("feedback_type") == accepted).alias("n_ok"))
    return (
        predictions.join(per_prediction, "prediction_id", "left")
        .groupBy("risk_class")
        .agg(F.count(F.lit(1)).alias("predictions"), F.count("n").alias("with_feedback"),
             F.coalesce(F.sum("n"), F.lit(0)).alias("feedback_rows"),
             F.coalesce(F.sum("n_ok"), F.lit(0)).alias("accepted_rows"))
        .withColumn("feedback_rate", F.col("with_feedback") / F.col("predictions"))
    )


def explanation_coverage(predictions: DataFrame, explanations: DataFrame) -> DataFrame:
    """How the predictions of each class were explained.

    A prediction is explained if one of its explanations succeeded; one whose explanation
    names another class than it has counts as mismatched. The mean latency is that of
    successful explanations, null if there are none. Explanations without a prediction are not counted.
    """
    per_prediction = explanations.groupBy("prediction_id", "risk_class_explained").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("n_ok"),
        F.sum(F.when(F.col("success"), F.col("latency_ms"))).alias("latency")).groupBy("prediction_id").agg(
        F.sum("n").alias("n"), F.sum("n_ok").alias("n_ok"), F.sum("latency").alias("latency"),
        F.collect_set("risk_class_explained").alias("named"))
    return (
        predictions.join(per_prediction, "prediction_id", "left")
        .groupBy("risk_class")
        .agg(F.count(F.lit(1)).alias("predictions"), F.count_if(F.col("n_ok") > 0).alias("explained"),
             F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"), F.coalesce(F.sum(F.col("n") - F.col("n_ok")), F.lit(0)).alias("failed"),
             F.count_if(F.exists("named", lambda c: c != F.col("risk_class"))).alias("mismatched"),
             (F.sum("latency") / F.sum(F.when(F.col("n_ok") > 0, F.col("n_ok")))).alias("mean_latency_ms"))
        .withColumn("explained_rate", F.col("explained") / F.col("predictions"))
    )


def manifest_paths(runs: DataFrame) -> DataFrame:
    """Distinct result paths of all runs, each with the run it was first seen in.

    ``runs``: run_ts and ``results``, an array of (year, status, path).
    """
    return (
        runs.select("run_ts", F.inline("results"))
        .where((F.col("status") == "ok") & F.col("path").isNotNull())
        .groupBy("path").agg(F.min_by(F.struct("year", "run_ts"), "run_ts").alias("first"))
        .select("first.year", "path", "first.run_ts")
    )


def union_tolerant(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
