"""AGG-14..17, AGG-19, JN-7, ML-12, ML-13, ML-15 and WIN-5 queries."""

from pyspark.sql import functions as F

from crashrisk.operators import evaluation as E
from crashrisk.operators import joins as J
from crashrisk.operators import ordering as O
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query
from crashrisk.plans.spatial_queries import CLASSIFIED, classified

_PRED = """pred AS (SELECT *, CASE
  WHEN p_high >= 0.15e0 AND (p_low < 0.25e0 OR p_high >= p_low) AND (p_medium < 0.40e0 OR p_high >= p_medium) THEN 'High'
  WHEN p_low >= 0.25e0 AND (p_medium < 0.40e0 OR p_low >= p_medium) THEN 'Low'
  WHEN p_medium >= 0.40e0 THEN 'Medium'
  WHEN p_high >= p_low AND p_high >= p_medium THEN 'High' WHEN p_low >= p_medium THEN 'Low' ELSE 'Medium' END AS prediction FROM scored)"""
_REPORT = _PRED + """,
cls AS (SELECT unnest(['High', 'Low', 'Medium']) AS class),
rep AS (SELECT class, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE prediction = class) AS predicted,
  count(*) FILTER (WHERE label = class AND prediction = class) AS hit FROM pred, cls GROUP BY class),
report AS (SELECT class, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
  CASE WHEN support + predicted = 0 THEN 0 ELSE 2 * hit / (support + predicted) END AS f1, support, hit FROM rep)"""


def predicted(spark, d):
    return V.scored(spark, d).withColumn("prediction", E.classify())


@query("ml13_threshold_classification", V.with_views("scored", more=_PRED, then="SELECT doc_id, prediction FROM pred"))
def _(spark, d):
    return predicted(spark, d).select("doc_id", "prediction")


@query("agg14_confusion_matrix", V.with_views("scored", more=_PRED, then="""
SELECT l.c AS label, p.c AS prediction, count(doc_id) AS n FROM (SELECT unnest(['High', 'Low', 'Medium']) AS c) l
CROSS JOIN (SELECT unnest(['High', 'Low', 'Medium']) AS c) p LEFT JOIN pred ON label = l.c AND prediction = p.c GROUP BY 1, 2"""))
def _(spark, d):
    return E.confusion_matrix(predicted(spark, d), classes=E.CLASSES)


@query("agg15_class_report", V.with_views("scored", more=_REPORT, then="""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"""))
def _(spark, d):
    return E.class_report(predicted(spark, d)).select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("agg15_summary_report", V.with_views("scored", more=_REPORT, then="""
SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS rows FROM report"""))
def _(spark, d):
    out = E.summary_report(E.class_report(predicted(spark, d)))
    return out.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "rows")


@query("agg16_binary_roc_auc", V.with_views("scored", more="""
s AS (SELECT p_high + p_medium AS score, label <> 'Low' AS pos FROM scored),
g AS (SELECT score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM s GROUP BY score),
c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g)""",
    then="SELECT round(sum(p * (nb + n / 2.0e0)) / (sum(p) * sum(n)), 6) AS roc_auc FROM c"))
def _(spark, d):
    out = E.binary_roc_auc(V.scored(spark, d), E.elevated_score(), F.col("label") != "Low")
    return out.select(F.round("roc_auc", 6).alias("roc_auc"))


@query("agg17_regression_metrics", """
SELECT l_returnflag, round(avg(abs(l_extendedprice - e)), 4) AS mae, round(sqrt(avg(pow(l_extendedprice - e, 2))), 4) AS rmse,
  round(1 - sum(pow(l_extendedprice - e, 2)) / (var_pop(l_extendedprice) * count(*)), 6) AS r2
FROM (SELECT *, 1500 * l_quantity AS e FROM lineitem) GROUP BY 1""")
def _(spark, d):
    df = V.table(spark, d, "lineitem").withColumn("e", 1500 * F.col("l_quantity"))
    out = E.regression_metrics(df, "l_extendedprice", "e", ["l_returnflag"])
    return out.select("l_returnflag", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("agg19_class_weights", V.with_views("crashes", more=CLASSIFIED, then="""
SELECT severity_class, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM classified GROUP BY severity_class"""))
def _(spark, d):
    return E.class_weights(classified(spark, d), "severity_class").withColumn("weight", F.round("weight", 6))


@query("ml12_threshold_sweep", V.with_views("scored", more="""
e AS (SELECT unnest([{'c': 'High', 'p': p_high}, {'c': 'Low', 'p': p_low}, {'c': 'Medium', 'p': p_medium}], recursive := true), label FROM scored),
t AS (SELECT i, 0.1e0 + i * 0.05e0 AS cut FROM range(0, 17) r(i)),
s AS (SELECT c, i, count(*) FILTER (WHERE p >= cut AND label = c) AS tp, count(*) FILTER (WHERE p >= cut) AS pp,
  count(*) FILTER (WHERE label = c) AS pos FROM e, t GROUP BY c, i),
f AS (SELECT c, i, 2 * tp / (pos + pp) AS f1 FROM s WHERE pp > 0),
b AS (SELECT c, i, f1, row_number() OVER (PARTITION BY c ORDER BY f1 DESC, i) AS r FROM f WHERE f1 > 0)""",
    then="""SELECT k.c AS class, coalesce(round(0.1e0 + i * 0.05e0, 2), 0.5e0) AS threshold, round(coalesce(f1, 0), 6) AS best_f1
FROM (SELECT DISTINCT c FROM e) k LEFT JOIN b ON k.c = b.c AND r = 1"""))
def _(spark, d):
    return E.tune_thresholds(V.scored(spark, d)).withColumn("best_f1", F.round("best_f1", 6))


_RUNS = """runs AS (SELECT 'run' || CAST(o_custkey AS VARCHAR) AS run_id, 'champion' || CAST(o_custkey % 3 AS VARCHAR) AS champion_model_id,
  round(avg(o_totalprice) / 400000.0e0, 4) AS macro_f1, round(max(o_totalprice) / 500000.0e0, 4) AS roc_auc,
  round(min(o_totalprice) / 400000.0e0, 4) AS high_f1, count(*) AS test_rows, count(*) * 5 AS total_rows FROM orders GROUP BY 1, 2),
champions AS (SELECT 'champion' || CAST(c_nationkey % 3 AS VARCHAR) AS model_id, round(avg(c_acctbal) / 10000.0e0, 4) AS macro_f1, 0.7416e0 AS roc_auc, 0.04e0 AS high_f1
  FROM customer GROUP BY 1),
j AS (SELECT r.*, c.macro_f1 AS cm, c.roc_auc AS ca, c.high_f1 AS ch FROM runs r LEFT JOIN champions c ON r.champion_model_id = c.model_id)"""


def challenger_runs(spark, d):
    return V.table(spark, d, "orders").groupBy(
        F.expr("concat('run', o_custkey)").alias("run_id"), F.expr("concat('champion', o_custkey % 3)").alias("champion_model_id"),
    ).agg(F.expr("round(avg(o_totalprice) / 400000D, 4)").alias("macro_f1"), F.expr("round(max(o_totalprice) / 500000D, 4)").alias("roc_auc"),
          F.expr("round(min(o_totalprice) / 400000D, 4)").alias("high_f1"), F.count(F.lit(1)).alias("test_rows"),
          (F.count(F.lit(1)) * 5).alias("total_rows"))


def champions(spark, d):
    return V.table(spark, d, "customer").groupBy(F.expr("concat('champion', c_nationkey % 3)").alias("model_id")).agg(
        F.expr("round(avg(c_acctbal) / 10000D, 4)").alias("macro_f1"), F.lit(0.7416).alias("roc_auc"), F.lit(0.04).alias("high_f1"))


def compared(spark, d):
    return J.metric_deltas(challenger_runs(spark, d), champions(spark, d), ["macro_f1", "roc_auc", "high_f1"])


@query("jn7_challenger_vs_champion", "WITH " + _RUNS + """
SELECT run_id, champion_model_id, macro_f1, cm AS champion_macro_f1, round(macro_f1 - cm, 6) AS delta_macro_f1,
  round(roc_auc - ca, 6) AS delta_roc_auc, round(high_f1 - ch, 6) AS delta_high_f1 FROM j""")
def _(spark, d):
    out = compared(spark, d)
    return out.select("run_id", "champion_model_id", "macro_f1", "champion_macro_f1",
                      *[F.round(f"delta_{m}", 6).alias(f"delta_{m}") for m in ("macro_f1", "roc_auc", "high_f1")])


def gated(spark, d):
    limits = {"min_macro_f1_improvement": 0.01, "min_roc_auc": 0.6, "max_high_f1_regression": 0.01, "min_test_rows": 5, "min_total_rows": 40}
    return E.promotion_gates(compared(spark, d).withColumns({k: F.lit(v) for k, v in limits.items()}))


_GATES = _RUNS + """,
g AS (SELECT run_id, 'macro_f1_improvement' AS gate, cm + 0.01e0 AS required, macro_f1 AS challenger, macro_f1 - cm AS delta FROM j
 UNION ALL SELECT run_id, 'binary_roc_auc_floor', 0.6e0, roc_auc, roc_auc - ca FROM j
 UNION ALL SELECT run_id, 'high_f1_no_regression', round(ch - 0.01e0, 4), high_f1, high_f1 - ch FROM j
 UNION ALL SELECT run_id, 'test_set_size', 5.0e0, CAST(test_rows AS DOUBLE), NULL FROM j
 UNION ALL SELECT run_id, 'total_effective_rows', 40.0e0, CAST(total_rows AS DOUBLE), NULL FROM j)"""


@query("ml15_promotion_gates", "WITH " + _GATES + """
SELECT run_id, gate, round(required, 6) AS required, challenger, round(delta, 6) AS delta, challenger >= required AS passed FROM g""")
def _(spark, d):
    return gated(spark, d).select("run_id", "gate", F.round("required", 6).alias("required"), "challenger", F.round("delta", 6).alias("delta"), "passed")


@query("ml15_promotion_decisions", "WITH " + _GATES + """
SELECT run_id, bool_and(challenger >= required) AS all_gates_passed,
  coalesce(string_agg(gate, ', ' ORDER BY gate) FILTER (WHERE NOT challenger >= required), '') AS failed_gates,
  CASE WHEN bool_and(challenger >= required) THEN 'promote' ELSE 'do_not_promote' END AS recommended_action FROM g GROUP BY run_id""")
def _(spark, d):
    return E.promotion_decisions(gated(spark, d)).select(
        "run_id", "all_gates_passed", F.array_join("failed_gates", ", ").alias("failed_gates"), "recommended_action")


@query("win5_best_variant", "WITH " + _RUNS + """
SELECT champion_model_id, max(macro_f1) AS macro_f1 FROM runs GROUP BY 1""")
def _(spark, d):
    return O.best_variant(challenger_runs(spark, d), by=["champion_model_id"]).select("champion_model_id", "macro_f1")
