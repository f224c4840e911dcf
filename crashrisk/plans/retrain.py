"""Retraining: neighbourhood features without leakage, two variants, tuning, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashrisk.operators import evaluation as E
from crashrisk.operators import models as M
from crashrisk.operators.features import build_features_v4, feature_names
from crashrisk.operators.joins import risk_class
from crashrisk.operators.lookups import drop_missing
from crashrisk.operators.sampling import three_way_split
from crashrisk.operators.spatial import add_radius_features
from crashrisk.session import materialise


def enrich(crashes: DataFrame, key: str = "id") -> DataFrame:
    """Classified rows with a split and neighbourhood columns.

    The split is made once and carried along: training rows see the other training
    rows, all other rows see training rows only.
    """
    df = crashes.withColumn("severity_class", risk_class(F.col("severity_3class")))
    df = three_way_split(drop_missing(df, ["severity_class", "lat", "lon"]), key)
    train = df.where("split = 'train'")
    return add_radius_features(train, train, leave_one_out=True).unionByName(
        add_radius_features(df.where("split <> 'train'"), train, leave_one_out=False))


VARIANTS = {"boosted_balanced": None, "boosted_manual_weights": M.MANUAL_WEIGHTS}


def retrain(crashes: DataFrame, champion: dict[str, float], limits: dict[str, float], run_id: str, key: str = "id",
            tune_on: str = "validation", rounds: int = 300, **settings) -> dict[str, object]:
    """Fit both variants (in the same passes), tune cuts, evaluate, and decide on promotion.

    Tables in the answer: ``comparison`` (variants), ``thresholds``, ``report`` (classes),
    ``metrics`` (one row), ``gates`` and ``decision``; besides the best model, its
    features and the weather categories.
    """
    enriched = materialise(enrich(crashes, key))
    matrix, weather_keep = build_features_v4(enriched, key=key)
    data = materialise(matrix.join(enriched.select(key, "split"), key))
    features = feature_names(matrix, key)
    train, tune, test = data.where("split = 'train'"), data.where(F.col("split") == tune_on), data.where("split = 'test'")
    fitted = M.fit_variants(train, features, "severity_class", VARIANTS, rounds=rounds, **settings)
    scored = reduce(DataFrame.unionByName, [M.score(m, test).withColumn("model", F.lit(name)) for name, m in fitted.items()])
    comparison = materialise(M.compare_models(scored, "severity_class"))
    best = comparison.orderBy(F.desc("macro_f1"), "model").first()["model"]

    thresholds = materialise(E.tune_thresholds(M.score(fitted[best], tune), "severity_class"))
    cuts = {r["class"]: r["threshold"] for r in thresholds.collect()}  # three rows
    final = materialise(M.score(fitted[best], test).withColumn("tuned", E.classify(thresholds=cuts)))
    both = final.select("severity_class", F.inline(F.array(
        F.struct(F.lit("default").alias("rule"), F.col("prediction")),
        F.struct(F.lit("tuned").alias("rule"), F.col("tuned").alias("prediction")))))
    report = E.class_report(both, "severity_class", "prediction", ["rule"])
    summary = E.summary_report(report, ["rule"])
    chosen = summary.orderBy(F.desc("macro_f1"), "rule").limit(1)
    auc = E.binary_roc_auc(final, E.elevated_score(), F.col("severity_class") != "Low")
    high = report.where("class = 'High'").select("rule", F.col("f1").alias("high_f1"))
    metrics = materialise(chosen.join(high, "rule", "left").select(
        F.lit(run_id).alias("run_id"), F.lit(best).alias("variant"), "rule", "accuracy", "macro_f1",
        F.coalesce("high_f1", F.lit(0.0)).alias("high_f1"), auc.scalar().alias("roc_auc"), F.col("rows").alias("test_rows"),
        data.agg(F.count(F.lit(1))).scalar().alias("total_rows")))
    constants = {f"champion_{k}": F.lit(float(v)) for k, v in champion.items()} | {k: F.lit(float(v)) for k, v in limits.items()}
    gates = E.promotion_gates(metrics.withColumns(constants))
    return {"comparison": comparison, "thresholds": thresholds, "report": report, "metrics": metrics, "gates": gates,
            "decision": E.promotion_decisions(gates), "model": fitted[best], "features": features, "weather_keep": weather_keep}
