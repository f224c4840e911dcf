"""Incremental ingest: change detection, transform, merge, run state and registry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashrisk.functions import calendar as C
from crashrisk.functions.cleaning import to_number
from crashrisk.operators import aggregates as A
from crashrisk.operators.joins import compare_with_previous, severity_3class, union_tolerant
from crashrisk.operators.lookups import city_guard
from crashrisk.operators.ordering import number_rows, resolve_conflicts
from crashrisk.session import materialise
from crashrisk.sources.schemas import INGEST_COLUMNS


def detect_changes(current: DataFrame, previous: DataFrame, production_years: tuple[int, int]) -> DataFrame:
    """Per year: what changed since the last successful count.

    ``current`` and ``previous``: year, status (ok / error / not_found), count.
    """
    seen = compare_with_previous(current, previous)
    inside = F.col("year").between(*production_years)
    ok, first = F.col("status") == "ok", F.col("previous_count").isNull()
    return seen.select(
        "year", "status", "count", "previous_count", inside.alias("in_production"),
        F.when(~ok, "none").when(first & ~inside, "new_endpoint_beyond_production").when(first, "first_recorded")
        .when(F.col("count") != F.col("previous_count"), "count_changed").otherwise("unchanged").alias("change_type"))


def recommend_action(changes: DataFrame, first_run: bool) -> DataFrame:
    """Year lists and the next action; new data goes before errors, errors before calm."""
    def years(test: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(test, F.col("year"))))

    new = F.col("change_type").isin("new_endpoint_beyond_production", "count_changed")
    lists = changes.agg(
        years(new).alias("years_with_new_data"), years(F.col("change_type") == "count_changed").alias("years_with_count_change"),
        years(F.col("change_type") == "new_endpoint_beyond_production").alias("new_endpoints_found"),
        years(F.col("status") == "error").alias("years_with_errors"))
    return lists.withColumn(
        "recommended_action",
        F.when(F.size("years_with_new_data") > 0, "download_recommended")
        .when(F.size("years_with_errors") > 0, "retry_check")
        .otherwise("baseline_recorded" if first_run else "no_action"))


# Columns read as whole and as real numbers at ingest.
WHOLE_NUMBERS = ["numb_fatal_injr", "numb_nonfatal_injr", "numb_vehc", "district_num"]
REAL_NUMBERS = ["lat", "lon", "speed_limit"]


def transform(raw: DataFrame, city: str) -> DataFrame:
    """Raw feature rows -> the ingest columns that exist, typed, of one city."""
    df = raw.toDF(*[c.lower() for c in raw.columns])
    if "crash_datetime" in df.columns:
        text = C.epoch_ms_to_text(F.col("crash_datetime").cast("string"))
        df = df.withColumn("crash_datetime_clean", text)
        if "year" not in df.columns:
            df = df.withColumn("year", F.year(C.epoch_ms_to_timestamp(F.col("crash_datetime").cast("string"))))
    elif "crash_date_text" in df.columns and "year" not in df.columns:
        df = df.withColumn("year", C.year_of(F.col("crash_date_text")))
    if "crash_severity_descr" in df.columns:
        df = df.withColumn("severity_3class", severity_3class(F.col("crash_severity_descr")))
    numbers = {c: "bigint" for c in [*WHOLE_NUMBERS, "year"]} | {c: "double" for c in REAL_NUMBERS}
    df = df.withColumns({c: to_number(F.col(c), kind) for c, kind in numbers.items() if c in df.columns})
    df = df.select(*[c for c in INGEST_COLUMNS if c in df.columns])
    return city_guard(df, city) if "city_town_name" in df.columns else df


def accumulate(production: DataFrame, candidates: DataFrame, mode: str = "candidate_wins") -> DataFrame:
    """Merge production and candidate rows: union, conflict resolution, new ids.

    ``candidates`` carries ``_run_ts``. Rows without a crash number cannot conflict and
    all stay.
    """
    base = production.drop("id").withColumns({"_source": F.lit("production"), "_run_ts": F.lit(None).cast("string")})
    new = candidates.drop("id").withColumn("_source", F.lit("candidate"))
    merged = resolve_conflicts(union_tolerant([base, new]), mode=mode)
    return number_rows(merged.drop("_source", "_run_ts"), ["year", "crash_numb"])


def merge_counts(production: DataFrame, candidates: DataFrame, merged: DataFrame) -> DataFrame:
    """Row counts of a merge and how many duplicates it removed."""
    def total(df: DataFrame) -> Column:
        return df.agg(F.count(F.lit(1))).scalar()

    return merged.agg(
        F.count(F.lit(1)).alias("merged_rows"), F.min("year").alias("min_year"), F.max("year").alias("max_year"),
    ).select("*", total(production).alias("production_rows"), total(candidates).alias("candidate_rows")).withColumn(
        "duplicates_removed", F.col("production_rows") + F.col("candidate_rows") - F.col("merged_rows"))


def merge_manifest(merged: DataFrame) -> DataFrame:
    """Rows per year and per severity as maps."""
    fixed = materialise(merged.groupBy("year", "severity_3class").agg(F.count(F.lit(1)).alias("n")))
    def as_map(column: str) -> Column:
        return (fixed.groupBy(column).agg(F.sum("n").alias("n")).where(F.col(column).isNotNull())
                .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column).cast("string"), "n"))))).scalar())

    return fixed.agg(F.sum("n").alias("merged_rows")).select(
        "merged_rows", as_map("year").alias("rows_per_year"), as_map("severity_3class").alias("severity_breakdown"))


def run_state(events: DataFrame) -> DataFrame:
    """Present state per job from its append-only events.

    ``events``: job, run_ts, phase (check / download / merge / retrain), action, path,
    gates_passed. A check only speaks when it found something to download, or when no
    phase has spoken yet.
    """
    action = (
        F.when((F.col("phase") == "check") & (F.col("action") == "download_recommended"), "download_new_data")
        .when(F.col("phase") == "download", "run_phase3_accumulate").when(F.col("phase") == "merge", "run_phase4_retrain")
        .when((F.col("phase") == "retrain") & F.col("gates_passed"), "promote_challenger")
        .when(F.col("phase") == "retrain", "continue_accumulating"))
    order = F.struct("run_ts", F.expr("CASE phase WHEN 'check' THEN 0 WHEN 'download' THEN 1 WHEN 'merge' THEN 2 ELSE 3 END"))

    def latest(value: Column, test: Column) -> Column:
        return F.max_by(value, F.when(test, order))

    spoken = events.withColumn("_next", action)
    return spoken.groupBy("job").agg(
        F.coalesce(latest(F.col("_next"), F.col("_next").isNotNull()), F.lit("check_for_new_data")).alias("recommended_next_action"),
        latest(F.col("run_ts"), F.col("phase") == "check").alias("latest_check"),
        latest(F.col("path"), F.col("phase") == "merge").alias("latest_merged_path"),
        latest(F.col("path"), F.col("phase") == "retrain").alias("latest_model_path"),
        F.max("run_ts").alias("last_updated"))


def run_log_rows(runs: DataFrame) -> DataFrame:
    """Run-log table rows; year lists are stored as JSON text, absent ones stay null."""
    names = runs.columns

    def given(name: str, default: Column) -> Column:
        return F.col(name) if name in names else default

    def json(name: str) -> Column:
        return F.to_json(F.col(name)) if name in names else F.lit(None).cast("string")

    return runs.select(
        F.col("run_ts").alias("run_id"), "phase", C.run_stamp_to_iso(F.col("run_ts")).try_cast("timestamp").alias("run_timestamp"), "outcome",
        *[json(c).alias(c) for c in ("years_checked", "years_with_new_data", "years_downloaded")],
        given("merged_row_count", F.lit(None)).cast("bigint").alias("merged_row_count"),
        given("merged_gcs_path", F.lit(None)).cast("string").alias("merged_gcs_path"), json("candidate_years").alias("candidate_years"),
        given("challenger_f1", F.lit(None)).cast("double").alias("challenger_f1"),
        given("all_gates_passed", F.lit(None)).cast("boolean").alias("all_gates_passed"),
        given("recommended_action", F.lit(None)).cast("string").alias("recommended_action"),
        F.coalesce(given("is_dry_run", F.lit(False)), F.lit(False)).alias("is_dry_run"),
        given("notification_sent", F.lit(None)).cast("boolean").alias("notification_sent"),
        given("duration_seconds", F.lit(None)).cast("bigint").alias("duration_seconds"),
        F.coalesce(given("triggered_by", F.lit(None)), F.lit("cloud_scheduler")).alias("triggered_by"))


def weekly_outcome(check: Column, download_ok: Column, merge_ok: Column, check_ok: Column) -> Column:
    """Outcome of a weekly run from what its phases reported."""
    return (F.when(~check_ok, "phase1_failed").when(check != "download_recommended", "no_new_data")
            .when(~download_ok, "phase2_failed").when(~merge_ok, "phase3_failed").otherwise("success"))


def model_version_rows(models: DataFrame) -> DataFrame:
    """Registry rows: the champion carries all traffic and was promoted when trained."""
    trained = C.date_to_iso(F.col("training_date")).try_cast("timestamp")
    champion = F.coalesce("is_champion", F.lit(False))
    return models.withColumns({
        "training_date": trained, "is_champion": champion, "is_active": F.lit(True),
        "traffic_pct": F.when(champion, 100).otherwise(0).cast("bigint"), "registered_at": F.current_timestamp(),
        "promoted_at": F.when(champion, trained)})


def challenger_rows(history: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Challenger-run rows from the run history; a run without a full comparison keeps its summary."""
    full = comparisons.withColumn("_full", F.lit(True))
    joined = history.alias("h").join(full.alias("c"), F.col("h.run_ts") == F.col("c.run_ts"), "left")

    def either(name: str, fallback: str | None = None) -> Column:
        return F.coalesce(F.col(f"c.{name}"), F.col(f"h.{fallback or name}")).alias(name)

    return joined.select(
        F.col("h.run_ts").alias("run_id"), F.concat(F.lit("challenger_"), F.regexp_replace(F.substring("h.run_ts", 1, 10), "-", ""))
        .alias("challenger_model_id"),
        either("macro_f1"), either("roc_auc"), either("all_gates_passed"), either("recommended_action"),
        F.col("c.merged_rows").alias("merged_row_count"), F.col("c.effective_rows").alias("effective_row_count"),
        F.coalesce("c._full", F.lit(False)).alias("has_comparison"))


def null_rates_of_training_columns(df: DataFrame) -> DataFrame:
    return A.null_rates(df, ["lat", "lon", "crash_datetime_clean", "severity_3class", "weath_cond_descr"])
