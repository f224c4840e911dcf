"""ML, SRT-4/5, SNK-6 and retraining queries."""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashrisk.functions import calendar as C
from crashrisk.functions import cleaning as T
from crashrisk.operators import evaluation as E
from crashrisk.operators import features as X
from crashrisk.operators import models as M
from crashrisk.operators import quantiles as Q
from crashrisk.operators import routes as RT
from crashrisk.operators import sampling as S
from crashrisk.operators.spatial import SPATIAL_COLUMNS, add_radius_features
from crashrisk.plans import retrain as RE
from crashrisk.plans import scoring as SC
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query
from crashrisk.plans.spatial_queries import CLASSIFIED, classified
from crashrisk.session import materialise, scratch_path

_WEATHER = ["Clear", "Cloudy", "Rain", "Snow/Sleet, hail", "Unknown"]
_TIME = """CAST(hour(crash_datetime_clean) AS INTEGER) AS hour_of_day, CAST(isodow(crash_datetime_clean) - 1 AS INTEGER) AS day_of_week,
  CAST(month(crash_datetime_clean) AS INTEGER) AS month, CASE WHEN isodow(crash_datetime_clean) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(crash_datetime_clean) BETWEEN 7 AND 9 OR hour(crash_datetime_clean) BETWEEN 16 AND {evening} THEN 1 ELSE 0 END AS is_rush_hour"""


def _name(text):
    return "".join(c if c.isalnum() or c == "_" else "_" for c in text)


def _hot(column, values, missing="Unknown"):
    return ", ".join(f"CASE WHEN coalesce({column}, '{missing}') = '{v}' THEN 1 ELSE 0 END AS {_name(column + '_' + v)}" for v in values)


_LIGHT = """CASE WHEN hour(crash_datetime_clean) < 6 OR hour(crash_datetime_clean) >= 20 THEN 1 ELSE 0 END AS light_phase_Dark,
  CASE WHEN hour(crash_datetime_clean) IN (6, 19) THEN 1 ELSE 0 END AS light_phase_Dawn_Dusk,
  CASE WHEN hour(crash_datetime_clean) BETWEEN 7 AND 18 THEN 1 ELSE 0 END AS light_phase_Daylight"""
_MEDIAN = "coalesce(speed_limit, (SELECT quantile_cont(speed_limit, 0.5) FROM classified)) AS speed_limit"


@query("ml1_features_v1", V.with_views("crashes", more=CLASSIFIED, then=f"""
SELECT id, {_MEDIAN}, coalesce(ems_hotspot_flag, (SELECT quantile_cont(ems_hotspot_flag, 0.5) FROM classified)) AS ems_hotspot_flag, lat, lon,
  CAST(hour_of_day AS DOUBLE) AS hour_of_day, CAST(day_of_week AS DOUBLE) AS day_of_week, CAST(month AS DOUBLE) AS month,
  CAST(is_weekend AS DOUBLE) AS is_weekend, CAST(is_rush_hour AS DOUBLE) AS is_rush_hour,
  {_hot('weath_cond_descr', _WEATHER)}, {_hot('city_town_name', [f'NATION_{i}' for i in range(25)])}, severity_class
FROM (SELECT *, {_TIME.format(evening=18)} FROM classified)"""))
def _(spark, d):
    return X.build_features_v1(V.crashes(spark, d))


@query("ml2_features_v2", V.with_views("crashes", more=CLASSIFIED, then=f"""
SELECT id, lat, lon, {_MEDIAN}, {_TIME.format(evening=19)}, {_hot('weath_cond_descr', _WEATHER)}, {_LIGHT}, severity_class FROM classified"""))
def _(spark, d):
    return X.build_features_v2(V.crashes(spark, d))


def enriched(spark, d):
    df = classified(spark, d)
    return materialise(add_radius_features(df, df, leave_one_out=True))


@query("ml3_features_v4", V.with_views("crashes", more=CLASSIFIED, then=f"""
SELECT id, lat, lon, {_MEDIAN}, {_TIME.format(evening=19)}, {_hot('weath_cond_descr', _WEATHER)}, {_LIGHT}, severity_class FROM classified"""))
def _(spark, d):
    matrix, _keep = X.build_features_v4(enriched(spark, d), minimum=1)
    return matrix.drop(*SPATIAL_COLUMNS)  # the neighbourhood columns are checked by jn3


@query("ml3_features_v4_keep_list", V.with_views("crashes", more=CLASSIFIED, then=f"""
SELECT id, {_hot('weath_cond_descr', ['Clear', 'Hail', 'Rain'])} FROM classified"""))
def _(spark, d):
    df = classified(spark, d).withColumns({c: F.lit(0.0) for c in SPATIAL_COLUMNS})
    matrix, _keep = X.build_features_v4(df, weather_keep=["Clear", "Hail", "Rain"])
    return matrix.select("id", "weath_cond_descr_Clear", "weath_cond_descr_Hail", "weath_cond_descr_Rain")


@query("ml4_one_hot_unseen", f"""
SELECT event_id, {_hot('event_type', ['click', 'purchase'], '')} FROM events""")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", *X.one_hot("event_type", ["click", "purchase"], missing_as=None))


_NUM = ["Temperature", "Humidity", "Wind_Speed", "Visibility"]


@query("ml5_standardise", V.with_views("accidents", more="f AS (SELECT ID, " + ", ".join(
    f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM accidents)) AS {c}" for c in _NUM) + " FROM accidents)",
    then="SELECT ID AS id, " + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM f)) / (SELECT stddev_pop({c}) FROM f), 5) AS {c.lower()}" for c in _NUM) + " FROM f"))
def _(spark, d):
    df = V.accidents(spark, d)
    out = M.standardise(df, df, _NUM)
    return out.select(F.col("ID").alias("id"), *[F.round(c, 5).alias(c.lower()) for c in _NUM])


@query("ml20_label_codes", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INTEGER) AS code FROM orders""")
def _(spark, d):
    return X.label_codes(V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer")), "customer")


@query("ml20_sparse_assembly", V.with_views("accidents", more="""
s AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM (SELECT DISTINCT State AS v FROM accidents WHERE State IS NOT NULL)),
c AS (SELECT v, row_number() OVER (ORDER BY v) + (SELECT count(*) FROM s) AS k FROM (SELECT DISTINCT City AS v FROM accidents WHERE City IS NOT NULL))""",
    then="""SELECT ID, 1 + (SELECT count(*) FROM s) + (SELECT count(*) FROM c) AS size,
  array_to_string(list_filter([0, s.k, c.k], lambda x: x IS NOT NULL), ',') AS indices, 1 + (s.k IS NOT NULL)::INTEGER + (c.k IS NOT NULL)::INTEGER AS n_values,
  coalesce(Temperature, 0.0) AS first_value FROM accidents a LEFT JOIN s ON s.v = a.State LEFT JOIN c ON c.v = a.City"""))
def _(spark, d):
    df = V.accidents(spark, d).select("ID", "State", "City", "Temperature")
    out = X.SparseEncoder(df, ["State", "City"], ["Temperature"]).transform(df)
    return out.select("ID", "size", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"),
                      F.size("values").alias("n_values"), F.col("values")[0].alias("first_value"))


def topics(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs, M.topic_pipeline("text").fit(docs)


@query("ml6_ml7_text_topics")
def _(spark, d):
    docs, model = topics(spark, d)
    return M.assign_topics(model, docs).select("doc_id", "topic", M.road_type(F.col("topic")).alias("road_type"))


@query("srt5_topic_terms")
def _(spark, d):
    return M.topic_terms(topics(spark, d)[1])


#: The studied forests grow until leaves are pure; here they stop at this depth, which bounds a fit in the memory of a small driver.
FOREST_DEPTH = 10


def study(spark, d):
    """Numeric feature table with a class and a split, made durable for the fits."""
    matrix = X.build_features_v2(V.crashes(spark, d))
    return materialise(S.hash_split(matrix, "id")), X.feature_names(matrix)


@query("ml8_ml14_crash_classifiers")
def _(spark, d):
    df, names = study(spark, d)
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    fits = {"logistic": {"iterations": 1000}, "forest": {"trees": 200, "depth": FOREST_DEPTH}, "boosted": {"rounds": 200}}
    scored = [M.score(M.fit_classifier(train, names, "severity_class", kind, **s), test).withColumn("model", F.lit(kind)) for kind, s in fits.items()]
    return M.compare_models(reduce(DataFrame.unionByName, scored), "severity_class")


def accident_study(spark, d):
    df = V.accidents(spark, d).select(
        "ID", F.col("Severity").cast("string").alias("severity_class"), *[F.col(c).cast("double").alias(c) for c in _NUM], "Distance",
        F.hour("Start_Time").cast("double").alias("hour"), T.weather_group(F.col("Weather_Condition")).alias("weather"),
        T.wind_sector(F.col("Wind_Direction")).alias("wind"), C.duration_minutes(F.col("Start_Time"), F.col("End_Time")).alias("duration_min"))
    split = S.three_way_split(df, "ID")
    return materialise(M.standardise(split.where("split = 'train'"), split, _NUM).select(
        "*", *X.one_hot("weather", X.fit_vocabulary(split, "weather")), *X.one_hot("wind", X.fit_vocabulary(split, "wind"))))


@query("ml9_nationwide_classifiers")
def _(spark, d):
    df = accident_study(spark, d)
    names = [c for c in df.columns if c not in ("ID", "severity_class", "weather", "wind", "duration_min", "split")]
    train = materialise(S.downsample_majority(df.where("split = 'train'"), "ID", "severity_class", "2"))
    rows = []
    fits = {"logistic": {"iterations": 1000}, "forest": {"trees": 30, "depth": 15},
            "boosted": {"rounds": 100, "depth": 6, "min_rows": 1, "min_hessian": 1.0, "penalty": 1.0}}
    for kind, settings in fits.items():
        model = M.fit_classifier(train, names, "severity_class", kind, **settings)
        labels = F.array(*[F.lit(x) for x in M.class_labels(model)])
        for part in ("train", "validation"):
            data = (train if part == "train" else df.where("split = 'validation'"))
            rows.append(model.transform(data).select(
                F.lit(f"{kind}:{part}").alias("model"), "severity_class", F.element_at(labels, (F.col("prediction") + 1).cast("int")).alias("prediction")))
    return M.compare_models(reduce(DataFrame.unionByName, rows), "severity_class")


@query("ml10_duration_regression")
def _(spark, d):
    df = accident_study(spark, d)
    train, test = df.where("split = 'train'"), df.where("split <> 'train'")
    upper = Q.exact_quantiles(train, ["duration_min"], [0.99]).first()["value"]
    names = [*_NUM, "Distance", "hour"]
    out = []
    clip = T.clip_upper(F.col("duration_min"), upper)
    clipped = materialise(M.spread(train.withColumn("duration_min", clip)))
    for kind in ("linear", "forest"):
        model = Pipeline(stages=[M.assemble(names), M.regressor(kind, "duration_min", trees=50, depth=20)]).fit(clipped)
        out.append(model.transform(test.withColumn("duration_min", clip)).select(F.lit(kind).alias("model"), "duration_min", "prediction"))
    return E.regression_metrics(reduce(DataFrame.unionByName, out), "duration_min", "prediction", ["model"])


@query("ml11_binary_reframing")
def _(spark, d):
    df, names = study(spark, d)
    model = M.binary_classifier(df.where("split = 'train'"), names, "severity_class")
    scored = materialise(M.score_binary(model, df.where("split = 'test'")))
    auc = E.binary_roc_auc(scored, F.col("p_elevated"), F.col("label") == "Elevated")
    report = E.class_report(scored)
    binary_f1 = report.where("class = 'Elevated'").agg(F.max("f1")).scalar()
    return E.summary_report(report).select("accuracy", "macro_f1", binary_f1.alias("binary_f1"), auc.scalar().alias("roc_auc"), "rows")


@query("srt4_feature_importances")
def _(spark, d):
    df, names = study(spark, d)
    return M.feature_importances(M.fit_classifier(df, names, "severity_class", "forest", trees=200, depth=FOREST_DEPTH), names)


_LIMITS = {"min_macro_f1_improvement": 0.005, "min_roc_auc": 0.70, "max_high_f1_regression": 0.01, "min_test_rows": 8000, "min_total_rows": 45000}
_CHAMPION = {"macro_f1": 0.4384, "roc_auc": 0.7416, "high_f1": 0.04}


def retrained(spark, d):
    return RE.retrain(V.crashes(spark, d), _CHAMPION, _LIMITS, "2026-04-21_06-00-00")


@query("retrain_gates")
def _(spark, d):
    return retrained(spark, d)["gates"]


@query("snk6_saved_artefacts")
def _(spark, d):
    from crashrisk.sources.writers import save_artefacts
    root, run = scratch_path(spark, "artefacts"), "2026-04-21_06-00-00"
    done = retrained(spark, d)
    save_artefacts(spark, root, run, done["model"], done["features"], done["thresholds"], done["weather_keep"], done["comparison"])
    return spark.read.parquet(f"{root}/features").where(F.col("run_ts") == run).select("run_ts", "position", "feature")


def _trip_inputs(spark, d):
    reference = classified(spark, d)
    data = materialise(add_radius_features(reference, reference, leave_one_out=True))
    matrix, _keep = X.build_features_v4(data)
    names = X.feature_names(matrix)
    model = M.fit_classifier(materialise(matrix), names, "severity_class", "boosted", rounds=300)
    trips = V.table(spark, d, "orders").selectExpr(
        "o_orderkey AS trip_id", "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 AS int)) AS departure",
        "element_at(array('Clear', 'Clouds', 'Rain', 'Squall'), cast(o_orderkey % 4 AS int) + 1) AS condition")
    return V.routes(spark, d), V.route_points(spark, d), trips, reference, model, names


@query("ml16_score_route_points")
def _(spark, d):
    routes, points, trips, reference, model, names = _trip_inputs(spark, d)
    speeds = points.select("trip_id", "route_index", "point_index", F.lit(None).cast("double").alias("speed_limit"))
    scored = SC.score_segments(routes, points, speeds, trips, reference, model, names, E.THRESHOLDS)
    return RT.safest_routes(RT.roll_up_routes(scored))


@query("ml17_score_midpoints")
def _(spark, d):
    routes, points, trips, reference, model, names = _trip_inputs(spark, d)
    scored = SC.score_midpoints(routes, points, trips, reference, model, names, E.THRESHOLDS)
    return scored.select("trip_id", "risk_class", "confidence", "p_high", "p_low", "p_medium")
