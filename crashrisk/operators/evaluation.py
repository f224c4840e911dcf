"""Classification and regression metrics, threshold tuning and promotion gates.

All metrics take an optional list of group columns, so several models or runs are
evaluated in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashrisk.session import materialise

# Class order (decides ties) and the tuned thresholds of the first model.
CLASSES = ["High", "Low", "Medium"]
THRESHOLDS = {"High": 0.15, "Low": 0.25, "Medium": 0.40}
CUT_START, CUT_STEP, CUT_COUNT = 0.10, 0.05, 17
DEFAULT_CUT = 0.5
PROBABILITIES = {"High": "p_high", "Low": "p_low", "Medium": "p_medium"}


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None,
                     classes: list[str] | None = None) -> DataFrame:
    """Rows per label and prediction; with ``classes`` empty combinations are listed too."""
    by = by or []
    counts = df.groupBy(*by, label, prediction).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        return counts
    names = F.array(*[F.lit(c) for c in classes])
    grid = counts.select(*by).distinct().select("*", F.explode(names).alias(label)).select("*", F.explode(names).alias(prediction))
    return grid.join(counts, [*by, label, prediction], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; divisions by zero give 0."""
    by = by or []
    cells = confusion_matrix(df, label, prediction, by)
    zero = F.lit(0).cast("bigint")
    parts = cells.select(*by, F.inline(F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), zero.alias("predicted"),
                 F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(zero).alias("hit")),
        F.struct(F.col(prediction).alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hit")))))
    sums = parts.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    return sums.select(
        *by, "class", _ratio(F.col("hit"), F.col("predicted")).alias("precision"), _ratio(F.col("hit"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1"), "support", "hit")


def summary_report(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy, macro and support-weighted averages from a class report."""
    total = F.sum("support")
    return report.groupBy(*(by or [])).agg(
        (F.sum("hit") / total).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        (F.sum(F.col("f1") * F.col("support")) / total).alias("weighted_f1"), total.alias("rows"))


def binary_roc_auc(df: DataFrame, score: Column, positive: Column, by: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; null when one class is absent.

    Rows are summed per distinct score first. The distinct scores are cut into ranges whose
    borders come from their own distribution (Spark samples it for a range partitioning),
    made durable, and counted on inside each range from the sums of the ranges below it. So
    no window holds more than one range, wherever the scores lie and however near to each
    other, and only one row per range and group is brought together.
    """
    by = by or []
    per_score = df.select(*by, score.alias("score"), positive.alias("positive")).groupBy(*by, "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialise(per_score.repartitionByRange(partitions, *by, "score").withColumn("range", F.spark_partition_id()))

    def before(part: list[str], order: str) -> Column:
        window = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("neg").over(window), F.lit(0))

    sums = ranges.groupBy(*by, "range").agg(F.sum("neg").alias("neg"))  # at most one row per range and group
    group = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    below = sums.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("range").alias("_range"), before(by, "range").alias("below"))
    ranked = ranges.withColumn("inside", before([*by, "range"], "score")).join(below, [*group, F.col("range") == F.col("_range")])
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2))
    return ranked.groupBy(*by).agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def elevated_score(probabilities: dict[str, str] | None = None) -> Column:
    p = probabilities or PROBABILITIES
    return F.col(p["High"]) + F.col(p["Medium"])


def regression_metrics(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    error = F.col(label) - F.col(prediction)
    n = F.count(error)
    return df.groupBy(*(by or [])).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(label) * n)).alias("r2"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.select(label, "n", (total["n"] / (total["k"] * F.col("n"))).alias("weight"))


def tune_thresholds(df: DataFrame, label: str = "label", probabilities: dict[str, str] | None = None,
                    by: list[str] | None = None) -> DataFrame:
    """Per class: the first cut with the best one-against-rest F1, or the default cut.

    One pass counts rows per class and number of cuts passed (at most 54 groups per
    model); everything after works on those counts.
    """
    by = by or []
    probabilities = probabilities or PROBABILITIES
    cuts = F.array(*[F.lit(CUT_START + i * CUT_STEP) for i in range(CUT_COUNT)])
    entries = F.array(*[F.struct(F.lit(c).alias("class"), F.col(p).alias("p"), (F.col(label) == c).alias("is_class"))
                        for c, p in probabilities.items()])
    passed = (
        df.select(*by, F.inline(entries)).withColumn("level", F.size(F.filter(cuts, lambda t: t <= F.col("p"))))
        .groupBy(*by, "class", "level").agg(F.count_if("is_class").alias("tp"), F.count(F.lit(1)).alias("predicted"))
    )
    support = passed.groupBy(*by, "class").agg(F.sum("tp").alias("support"))
    swept = (
        passed.where("level > 0")
        .select(*by, "class", "tp", "predicted", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("cut"))
        .groupBy(*by, "class", "cut").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
    )
    best = (
        support.join(swept, [*by, "class"], "left")
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
        .groupBy(*by, "class").agg(F.max(F.when(F.col("f1") > 0, F.struct(F.col("f1"), (-F.col("cut")).alias("order")))).alias("b"))
    )
    return best.select(*by, "class",
                       F.coalesce(F.round(CUT_START - F.col("b.order") * CUT_STEP, 2), F.lit(DEFAULT_CUT)).alias("threshold"),
                       F.coalesce("b.f1", F.lit(0.0)).alias("best_f1"))


def classify(probabilities: dict[str, str] | None = None, thresholds: dict[str, float | Column] | None = None) -> Column:
    """Class with the highest probability among those reaching their cut, else among all.

    Equal probabilities go to the class that comes first in ``CLASSES``.
    """
    probabilities = probabilities or PROBABILITIES
    thresholds = thresholds or THRESHOLDS

    def cut(name: str) -> Column:
        value = thresholds.get(name, DEFAULT_CUT)
        return value if isinstance(value, Column) else F.lit(float(value))

    options = F.array(*[
        F.struct(F.col(probabilities[c]).alias("p"), F.lit(-i).alias("order"), F.lit(c).alias("class"),
                 (F.col(probabilities[c]) >= cut(c)).alias("reached"))
        for i, c in enumerate(CLASSES)])
    return F.coalesce(F.array_max(F.filter(options, lambda o: o["reached"])), F.array_max(options))["class"]


def promotion_gates(runs: DataFrame) -> DataFrame:
    """Five gates per challenger run: name, required, challenger, delta, passed.

    ``runs`` holds run_id; macro_f1, roc_auc, high_f1, test_rows, total_rows of the
    challenger; champion_macro_f1, champion_roc_auc, champion_high_f1; and the limits
    min_macro_f1_improvement, min_roc_auc, max_high_f1_regression, min_test_rows,
    min_total_rows.
    """
    def gate(name: str, value: Column, required: Column, champion: Column | None = None) -> Column:
        value, required = value.cast("double"), required.cast("double")
        delta = F.lit(None).cast("double") if champion is None else value - champion
        return F.struct(F.lit(name).alias("gate"), required.alias("required"), value.alias("challenger"),
                        delta.alias("delta"), F.coalesce(value >= required, F.lit(False)).alias("passed"))

    col = F.col
    gates = F.array(
        gate("macro_f1_improvement", col("macro_f1"), col("champion_macro_f1") + col("min_macro_f1_improvement"), col("champion_macro_f1")),
        gate("binary_roc_auc_floor", col("roc_auc"), col("min_roc_auc"), col("champion_roc_auc")),
        gate("high_f1_no_regression", col("high_f1"), F.round(col("champion_high_f1") - col("max_high_f1_regression"), 4), col("champion_high_f1")),
        gate("test_set_size", col("test_rows"), col("min_test_rows")),
        gate("total_effective_rows", col("total_rows"), col("min_total_rows")),
    )
    return runs.select("run_id", F.inline(gates))


def promotion_decisions(gates: DataFrame) -> DataFrame:
    """Per run: whether all gates passed, the failed ones by name, the action and why."""
    decided = gates.groupBy("run_id").agg(
        F.bool_and("passed").alias("all_gates_passed"),
        F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))).alias("failed_gates"))
    return decided.select(
        "run_id", "all_gates_passed", "failed_gates",
        F.when(F.col("all_gates_passed"), "promote").otherwise("do_not_promote").alias("recommended_action"),
        F.when(F.col("all_gates_passed"), "All promotion gates passed.")
        .otherwise(F.concat(F.lit("Failed gates: "), F.array_join("failed_gates", ", "), F.lit("."))).alias("reason"))
