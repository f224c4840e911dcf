"""Fixed column layouts: the incident table, the ingest projection and six analytics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(), "STRING": T.StringType(),
          "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType()}


def layout(columns: str) -> T.StructType:
    """Schema from ``name TYPE [NOT NULL], ...``; unlike DDL parsing it needs no session."""
    fields = []
    for column in columns.split(","):
        name, kind, *rest = column.split()
        fields.append(T.StructField(name, _TYPES[kind], nullable=not rest))
    return T.StructType(fields)


# Incident table, columns in order.
CRASHES = layout("""
    id BIGINT NOT NULL, crash_numb BIGINT, crash_datetime_clean STRING, year SMALLINT, crash_hour STRING,
    city_town_name STRING, lat DOUBLE, lon DOUBLE, crash_severity_descr STRING, severity_3class STRING,
    numb_fatal_injr INT, numb_nonfatal_injr INT, numb_vehc INT, weath_cond_descr STRING,
    road_surf_cond_descr STRING, ambnt_light_descr STRING, manr_coll_descr STRING,
    rdwy_jnct_type_descr STRING, rdwy STRING, speed_limit FLOAT, hit_run_descr STRING,
    ems_hotspot_flag FLOAT, ems_ped_hotspot_flag FLOAT, ems_peak_hour FLOAT, district_num INT, cnty_name STRING
""")

# Columns kept at ingest, in order.
INGEST_COLUMNS = [
    "crash_numb", "crash_datetime_clean", "year", "crash_hour", "city_town_name", "lat", "lon",
    "crash_severity_descr", "severity_3class", "numb_fatal_injr", "numb_nonfatal_injr", "numb_vehc",
    "weath_cond_descr", "road_surf_cond_descr", "ambnt_light_descr", "manr_coll_descr",
    "rdwy_jnct_type_descr", "rdwy", "speed_limit", "hit_run_descr", "district_num", "cnty_name",
]

# Analytics tables, columns in order.
ROUTE_PREDICTIONS = layout("""
    prediction_id STRING NOT NULL, timestamp TIMESTAMP NOT NULL, endpoint STRING, origin STRING,
    destination STRING, departure_time STRING, duration_minutes DOUBLE, distance_miles DOUBLE,
    num_alternatives BIGINT, recommended_route_index BIGINT, risk_class STRING, confidence DOUBLE,
    prob_high DOUBLE, prob_medium DOUBLE, prob_low DOUBLE, safety_score DOUBLE, num_hotspots BIGINT,
    num_high_hotspots BIGINT, weather_condition STRING, temperature_f DOUBLE, is_precipitation BOOLEAN,
    is_low_visibility BOOLEAN, midpoint_lat DOUBLE, midpoint_lng DOUBLE, hour_of_day BIGINT,
    model_version STRING, vertex_model_id STRING, vertex_endpoint_id STRING, response_time_ms BIGINT,
    gemini_explanation_generated BOOLEAN
""")
PIPELINE_RUNS = layout("""
    run_id STRING NOT NULL, phase STRING, run_timestamp TIMESTAMP, outcome STRING, years_checked STRING,
    years_with_new_data STRING, years_downloaded STRING, merged_row_count BIGINT, merged_gcs_path STRING,
    candidate_years STRING, challenger_f1 DOUBLE, all_gates_passed BOOLEAN, recommended_action STRING,
    is_dry_run BOOLEAN, notification_sent BOOLEAN, duration_seconds BIGINT, triggered_by STRING
""")
MODEL_VERSIONS = layout("""
    model_id STRING NOT NULL, display_name STRING, training_date TIMESTAMP, training_dataset_gcs STRING,
    training_row_count BIGINT, year_range_min BIGINT, year_range_max BIGINT, macro_f1 DOUBLE,
    accuracy DOUBLE, binary_roc_auc DOUBLE, high_f1 DOUBLE, medium_f1 DOUBLE, low_f1 DOUBLE,
    test_set_size BIGINT, is_champion BOOLEAN, is_active BOOLEAN, vertex_model_id STRING,
    vertex_endpoint_id STRING, traffic_pct BIGINT, registered_at TIMESTAMP, promoted_at TIMESTAMP,
    deprecated_at TIMESTAMP, champion_metrics_gcs STRING, model_artifact_gcs STRING
""")
CHALLENGER_RUNS = layout("""
    run_id STRING NOT NULL, run_timestamp TIMESTAMP, merged_dataset_gcs STRING, merged_row_count BIGINT,
    effective_row_count BIGINT, candidate_years STRING, last_retrain_row_count BIGINT,
    challenger_model_id STRING, challenger_macro_f1 DOUBLE, challenger_roc_auc DOUBLE,
    challenger_high_f1 DOUBLE, challenger_medium_f1 DOUBLE, challenger_low_f1 DOUBLE,
    champion_model_id STRING, champion_macro_f1 DOUBLE, champion_roc_auc DOUBLE, all_gates_passed BOOLEAN,
    failed_gates STRING, recommended_action STRING, recommendation_reason STRING, report_gcs STRING,
    model_gcs STRING, comparison_gcs STRING
""")
USER_FEEDBACK = layout("""
    feedback_id STRING NOT NULL, prediction_id STRING, timestamp TIMESTAMP, feedback_type STRING,
    feedback_value STRING, session_id STRING, user_agent STRING
""")
EXPLANATIONS = layout("""
    explanation_id STRING NOT NULL, prediction_id STRING, timestamp TIMESTAMP, explanation_type STRING,
    gemini_model STRING, prompt_tokens BIGINT, completion_tokens BIGINT, latency_ms BIGINT, success BOOLEAN,
    failure_reason STRING, risk_class_explained STRING, explanation_preview STRING
""")

# Table -> (schema, day-partition column, cluster columns).
ANALYTICS_TABLES = {
    "route_predictions": (ROUTE_PREDICTIONS, "timestamp", ["risk_class", "model_version"]),
    "pipeline_runs": (PIPELINE_RUNS, "run_timestamp", ["phase", "outcome"]),
    "model_versions": (MODEL_VERSIONS, None, []),
    "challenger_runs": (CHALLENGER_RUNS, "run_timestamp", ["recommended_action"]),
    "user_feedback": (USER_FEEDBACK, "timestamp", []),
    "gemini_explanations": (EXPLANATIONS, "timestamp", ["explanation_type", "success"]),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in order and type; absent ones become null.

    A value missing in a NOT NULL column fails the job that writes it, naming the column.
    """
    columns = []
    for field in schema.fields:
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else F.lit(None).cast(field.dataType)
        if not field.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"missing value in required column {field.name}")).cast(field.dataType))
        columns.append(value.alias(field.name))
    return df.select(*columns)
