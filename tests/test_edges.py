"""Edge cases on hand-made frames."""

import datetime as dt
import math

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from crashrisk.functions import calendar as C
from crashrisk.functions import cleaning as T
from crashrisk.functions import roads as R
from crashrisk.operators import aggregates as A
from crashrisk.operators import evaluation as E
from crashrisk.operators import features as X
from crashrisk.operators import joins as J
from crashrisk.operators import lookups as L
from crashrisk.operators import ordering as O
from crashrisk.operators import quantiles as Q
from crashrisk.operators import routes as RT
from crashrisk.operators import sampling as S
from crashrisk.operators.neighbours import nearest_neighbours
from crashrisk.plans import ingest as I
from crashrisk.sources import readers as RD
from crashrisk.sources import schemas as SC


def one(df):
    return df.first()


def text_frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


# --- quantiles ---------------------------------------------------------------------------

@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.0] * 50 + [9.0], list(np.random.default_rng(1).exponential(10, 999)),
                                    [0.0, 1e-12, 1e300], [-5.0, -5.0, 0.0, -0.0, 7.5]])
def test_exact_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    got = {r["p"]: r["value"] for r in Q.exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    for p, value in got.items():
        assert math.isclose(value, float(np.quantile(values, p)), rel_tol=1e-12, abs_tol=1e-12)
    assert len(got) == 5


def test_quantiles_beside_an_outlier(spark):
    """One value far out: the ranks are right, two scans are all, and only the bracket is ordered."""
    rng = np.random.default_rng(7)
    values = np.append(rng.normal(0, 1, 40_000).round(4), 1e15)
    df = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "v double, g int")
    out = Q.exact_quantiles(df, ["v"], [0.01, 0.5, 0.99, 1.0], by=["g"])
    for r in out.collect():
        assert math.isclose(r["value"], float(np.quantile(values[r["g"]::3], r["p"])), rel_tol=1e-12, abs_tol=1e-12)
    # what reaches the window of a wanted rank, the row for all values below it included
    kept = Q._values(df, ["v"], [])
    summary = Q._summary(kept, ["column_name"])
    probe = Q._locate(kept, ["column_name"], Q._targets([0.5]), summary)
    point = float(np.quantile(values, 0.5, method="lower"))
    near = np.sort(values)
    at = int(np.searchsorted(near, point))
    width = 5 * len(values) // Q._POINTS
    row = summary.first()
    place = at * Q._POINTS // len(values)
    assert near[max(0, at - width)] <= row["points"][place - 1] and row["points"][place + 2] <= near[at + width]
    assert {r["value"] for r in probe.collect()} == {point}


def test_no_task_gets_all_values_of_a_column(spark):
    df = spark.range(20000).selectExpr("cast(id * 7 % 20011 AS double) AS v", "'one' AS g")
    values = np.array(sorted(i * 7 % 20011 for i in range(20000)), dtype=float)
    for by in ([], ["g"]):
        out = Q.exact_quantiles(df, ["v"], [0.5], by=by)
        assert out.first()["value"] == float(np.quantile(values, 0.5))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        assert all("_shard" in line for line in joins) and bool(joins) == bool(by)


def test_describe_reads_its_source_twice(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id AS double) AS a", "cast(id % 7 AS double) AS b").write.parquet(str(tmp_path / "t"))
    out = Q.describe(spark.read.parquet(str(tmp_path / "t")), ["a", "b"])
    assert {r["column_name"]: (r["n"], r["p50"], r["max"]) for r in out.collect()} == {"a": (1000, 499.5, 999.0), "b": (1000, 3.0, 6.0)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    scans = [line for line in final.splitlines() if "Scan parquet" in line]
    reused = [line for line in final.splitlines() if "ReusedExchange" in line or "ReusedSubquery" in line]
    assert len(scans) <= 2, (len(scans), len(reused))


def test_quantiles_of_an_empty_column_and_median_fill(spark):
    df = spark.createDataFrame([(1, None, 4.0), (2, None, None), (3, None, float("nan"))], "id int, a double, b double")
    assert Q.exact_quantiles(df, ["a"], [0.5]).count() == 0
    rows = {r["id"]: r for r in X.fill_median(df, ["a", "b"]).collect()}
    assert rows[1]["a"] == 0.0 and rows[2]["b"] == 4.0 and rows[3]["b"] == 4.0


# --- time --------------------------------------------------------------------------------

def test_iso_week_takes_the_iso_year(spark):
    df = text_frame(spark, [dt.datetime(2027, 1, 1), dt.datetime(2026, 1, 1)], "timestamp_ntz")
    assert [r[0] for r in df.select(C.iso_week_key(F.col("v"))).collect()] == ["2026-W53", "2026-W01"]


def test_times_of_bad_or_missing_text(spark):
    df = text_frame(spark, ["x", None, "2024-03-10T08:00:00Z", "2024-07-01T08:00:00", "2024-07-01 08:00:00-04:00"])
    got = [r[0] for r in df.select(C.local_timestamp(F.col("v"))).collect()]
    assert got[:2] == [None, None]
    assert got[2:] == [dt.datetime(2024, 3, 10, 4), dt.datetime(2024, 7, 1, 8), dt.datetime(2024, 7, 1, 8)]


def test_epoch_milliseconds(spark):
    df = text_frame(spark, ["-1", "1704067200999", "soon", None, "9223372036854775807"])
    assert [r[0] for r in df.select(C.epoch_ms_to_text(F.col("v"))).collect()] == [
        "1969-12-31 23:59:59+00:00", "2024-01-01 00:00:00+00:00", None, None, None]


def test_missing_hour_is_no_rush_hour_and_daylight(spark):
    r = one(spark.range(1).select(C.rush_hour(F.lit(None).cast("int")), C.light_phase(F.lit(None).cast("int"))))
    assert (r[0], r[1]) == (0, "Daylight")


# --- text and numbers --------------------------------------------------------------------

def test_clip_keeps_null_and_street_type_needs_a_word_border(spark):
    df = spark.createDataFrame([(None, "Stone"), (7.0, "Elm St")], "x double, s string")
    assert [tuple(r) for r in df.select(T.clip_upper(F.col("x"), 5), T.street_type(F.col("s"))).collect()] == [(None, None), (5.0, "St")]


def test_column_names_that_collide_are_numbered(spark):
    df = text_frame(spark, ["A/B", "A B", "C"])
    assert {r["v"]: r["column_name"] for r in X.name_columns(df, "v").collect()} == {"A B": "A_B", "A/B": "A_B_1", "C": "C"}
    row = one(df.select(*X.one_hot("v", ["A B", "A/B"], prefix="w")))
    assert row.asDict() == {"w_A_B": 0, "w_A_B_1": 1}


def test_codes_of_any_number_of_classes(spark):
    rows = [(i, f"c{i * 7919 % 3000}" if i % 10 else None) for i in range(6000)]
    out = X.label_codes(spark.createDataFrame(rows, "id int, c string"), "c").collect()
    place = {v: k for k, v in enumerate(sorted({v for _, v in rows if v is not None}))}
    assert len(place) > 2000 and sorted((r["id"], r["code"]) for r in out if r["code"] is not None) == sorted((i, place[v]) for i, v in rows if v)
    assert sum(r["code"] is None for r in out) == 600


def test_sparse_rows(spark):
    train = spark.createDataFrame([("b", "x", 1.5), ("a", None, None), ("a", "y", 2.0)], "p string, q string, n double")
    encoder = X.SparseEncoder(train, ["p", "q"], ["n"])
    rows = spark.createDataFrame([(0, "a", "y", 3.0), (1, "new", None, None)], "id int, p string, q string, n double")
    got = {r["id"]: (r["size"], r["indices"], r["values"]) for r in encoder.transform(rows).collect()}
    assert got == {0: (5, [0, 1, 4], [3.0, 1.0, 1.0]), 1: (5, [0], [0.0])}
    vectors = {r["id"]: r["features"].toArray().tolist() for r in X.to_vectors(encoder.transform(rows)).collect()}
    assert vectors == {0: [3.0, 1.0, 0.0, 0.0, 1.0], 1: [0.0] * 5}


# --- routes ------------------------------------------------------------------------------

@pytest.mark.parametrize("total,expected", [(0, []), (1, []), (2, [0, 1]), (5, [0, 1, 2, 3, 4]), (12, list(range(12))),
                                            (25, [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 24])])
def test_even_sampling(spark, total, expected):
    df = spark.createDataFrame([(total,)], "n bigint")
    assert one(df.select(R.sample_indices(F.col("n"), 12)))[0] == expected


def test_later_interval_wins_and_outside_indices_are_ignored(spark):
    points = spark.createDataFrame([(1, 0, i) for i in range(4)], "trip_id int, route_index int, point_index int")
    intervals = spark.createDataFrame([(1, 0, 0, -3, 2, "SLOW"), (1, 0, 1, 2, 9, "TRAFFIC_JAM"), (1, 0, 2, 1, 0, "SLOW")],
                                      "trip_id int, route_index int, interval_pos int, start_idx int, end_idx int, category string")
    out = J.speed_by_point(points, intervals, F.lit(35.0), R.speed_by_traffic(F.col("category"), F.lit(35.0)))
    assert [r["speed_limit"] for r in out.orderBy("point_index").collect()] == [25.0, 25.0, 15.0, 15.0]


def test_interval_far_beyond_its_route(spark):
    points = spark.createDataFrame([(1, 0, i) for i in range(3)], "trip_id int, route_index int, point_index int")
    intervals = spark.createDataFrame([(1, 0, 0, 1, 3_000_000_000, "SLOW"), (1, 0, 1, 2_000_000_000, 3_000_000_000, "TRAFFIC_JAM")],
                                      "trip_id int, route_index int, interval_pos int, start_idx long, end_idx long, category string")
    out = J.speed_by_point(points, intervals, F.lit(35.0), R.speed_by_traffic(F.col("category"), F.lit(35.0)))
    assert [r["speed_limit"] for r in out.orderBy("point_index").collect()] == [35.0, 25.0, 25.0]
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # no index is unrolled


def test_sampled_points_are_those_of_the_index_list(spark):
    routes = spark.range(0, 60).selectExpr("id AS trip_id", "0L AS route_index", "id AS num_points")
    points = routes.where("num_points > 0").selectExpr("*", "explode(sequence(0L, num_points - 1)) AS point_index")
    listed = routes.select("trip_id", F.posexplode(R.sample_indices(F.col("num_points"), 12)).alias("segment", "point_index"))
    for given in (points, points.drop("num_points")):
        got = RT.sample_points(given, routes, 12).select("trip_id", "segment", "point_index")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, listed.collect()))


def test_known_polyline(spark):
    df = spark.createDataFrame([(1, "_p~iF~ps|U_ulLnnqC_mqNvxq`@"), (2, "")], "id int, line string")
    rows = R.decode_polylines(df, ["id"], "line").orderBy("point_index").collect()
    assert [(r["lat"], r["lng"]) for r in rows] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_equal_safety_scores_choose_the_first_route(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 0, 5.0)], "trip_id int, route_index int, safety_score double")
    assert one(RT.safest_routes(df))["route_index"] == 0


def test_route_without_length_has_no_minutes(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 9.0)], "point_index int, num_points int, distance_miles double, duration_minutes double")
    assert one(RT.place_segments(df))["minutes_from_start"] == 0.0


def test_malformed_weather_goes_to_reject(spark):
    df = text_frame(spark, ["not json", '{"weather":[],"main":{"temp":1,"feels_like":1,"humidity":1,"pressure":1}}'])
    bad, good = R.parse_weather(df, "v").collect()
    assert bad["payload_error"] and not good["payload_error"]
    assert good["condition"] == "Unknown" and good["is_low_visibility"]


# --- evaluation --------------------------------------------------------------------------

def test_auc_of_one_class_is_null_and_ties_count_half(spark):
    df = spark.createDataFrame([(0.5, True), (0.5, True)], "s double, y boolean")
    assert one(E.binary_roc_auc(df, F.col("s"), F.col("y")))["roc_auc"] is None
    df = spark.createDataFrame([(0.5, True), (0.5, False)], "s double, y boolean")
    assert one(E.binary_roc_auc(df, F.col("s"), F.col("y")))["roc_auc"] == 0.5


@pytest.mark.parametrize(("scale", "shift"), [(1e-9, 0.5), (1e12, -3e11), (1e-300, 0.0)])
def test_auc_of_scores_of_any_range(spark, scale, shift):
    """Scores that crowd in a narrow range, or lie far outside [0, 1], spread over the ranges."""
    rng = np.random.default_rng(8)
    ranks = rng.integers(0, 3000, 4000)
    labels = rng.random(4000) < 0.3 + ranks / 10_000
    df = spark.createDataFrame([(float(r * scale + shift), bool(y), None if i % 4 == 0 else "m") for i, (r, y) in enumerate(zip(ranks, labels))],
                               "s double, y boolean, m string")
    scores = ranks * scale + shift

    def area(of):
        s, y = scores[of], labels[of]
        better = (s[y][:, None] > s[~y][None]).sum() + (s[y][:, None] == s[~y][None]).sum() / 2
        return better / (y.sum() * (~y).sum())

    got = {r["m"]: r["roc_auc"] for r in E.binary_roc_auc(df, F.col("s"), F.col("y"), ["m"]).collect()}
    every_fourth = np.arange(4000) % 4 == 0
    assert math.isclose(got[None], area(every_fourth), rel_tol=1e-12) and math.isclose(got["m"], area(~every_fourth), rel_tol=1e-12)


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(5)
    s, y = np.round(rng.random(400) * 1.4 - 0.2, 2), rng.random(400) < 0.3
    wins = (s[y][:, None] > s[~y][None, :]).mean() + 0.5 * (s[y][:, None] == s[~y][None, :]).mean()
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean")
    assert math.isclose(one(E.binary_roc_auc(df, F.col("s"), F.col("y"), partitions=7))["roc_auc"], wins, rel_tol=1e-12)


def test_equal_probabilities_follow_class_order(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0.4), (0.14, 0.24, 0.39), (0.2, 0.2, 0.2)], "p_high double, p_low double, p_medium double")
    assert [r[0] for r in df.select(E.classify()).collect()] == ["Medium", "Medium", "High"]


def test_thresholds_default_when_a_class_never_scores(spark):
    df = spark.createDataFrame([("Low", 0.05, 0.9, 0.05)], "label string, p_high double, p_low double, p_medium double")
    got = {r["class"]: r["threshold"] for r in E.tune_thresholds(df).collect()}
    assert got == {"High": 0.5, "Low": 0.1, "Medium": 0.5}


def test_class_report_without_predictions_of_a_class(spark):
    df = spark.createDataFrame([("High", "Low"), ("Low", "Low")], "label string, prediction string")
    got = {r["class"]: r for r in E.class_report(df).collect()}
    assert got["High"]["precision"] == 0.0 and got["High"]["f1"] == 0.0 and got["Low"]["recall"] == 1.0


# --- ordering and ingest -----------------------------------------------------------------

def test_conflicts_and_null_keys(spark):
    rows = [(1, "a", "production", None), (1, "b", "candidate", "2026-01"), (1, "c", "candidate", "2026-02"),
            (None, "x", "production", None), (None, "x", "candidate", "2026-01")]
    df = spark.createDataFrame(rows, "crash_numb int, v string, _source string, _run_ts string")
    assert sorted(r["v"] for r in O.resolve_conflicts(df).collect()) == ["c", "x", "x"]
    assert sorted(r["v"] for r in O.resolve_conflicts(df, mode="production_wins").collect()) == ["a", "x", "x"]


def test_numbering_spreads_equal_keys_and_is_gapless(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    rows = O.number_rows(df, ["k"], partitions=7).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 501))
    assert max(r["id"] for r in rows if r["k"] == 0) == 250


def test_first_check_and_errors(spark):
    current = spark.createDataFrame([(2015, "ok", 5), (2016, "error", None)], "year int, status string, count bigint")
    none = current.limit(0)
    changes = I.detect_changes(current, none, (2015, 2016))
    assert {r["year"]: r["change_type"] for r in changes.collect()} == {2015: "first_recorded", 2016: "none"}
    assert one(I.recommend_action(changes, first_run=True))["recommended_action"] == "retry_check"
    calm = I.detect_changes(current.where("status = 'ok'"), none, (2015, 2016))
    assert one(I.recommend_action(calm, first_run=True))["recommended_action"] == "baseline_recorded"


def test_conform_fails_on_a_missing_required_value(spark):
    df = spark.createDataFrame([(None, "x")], "run_id string, phase string")
    with pytest.raises(Exception, match="run_id"):
        SC.conform(df, SC.PIPELINE_RUNS).collect()


def test_empty_filter_arguments_are_left_out(spark):
    df = spark.createDataFrame([(1, 2020, "SPRINGFIELD"), (2, 2021, "Lynn")], "id int, year int, city_town_name string")
    assert L.filter_crashes(df, year=0, city="").count() == 2
    assert [r["id"] for r in L.filter_crashes(df, city="_ynn").collect()] == [2]


def test_null_rates_count_nan(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, "x")], "a double, b string")
    assert {r["column_name"]: r["null_rate"] for r in A.null_rates(df).collect()} == {"a": 0.5, "b": 0.5}


# --- sampling ----------------------------------------------------------------------------

def test_splits_are_disjoint_complete_and_stable(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, "High").otherwise("Low").alias("c"))
    split = S.exact_stratified_split(df, "id", "c")
    counts = {(r["c"], r["split"]): r["count"] for r in split.groupBy("c", "split").count().collect()}
    assert counts == {("High", "test"): 40, ("High", "train"): 160, ("Low", "test"): 360, ("Low", "train"): 1440}
    again = S.exact_stratified_split(df.repartition(5), "id", "c")
    assert split.exceptAll(again).count() == 0


def test_smote_raises_minorities_and_stays_between_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "Low", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (300, 2)))]
    rows += [(1000 + i, "High", float(x), float(y)) for i, (x, y) in enumerate(rng.normal(10, 1, (40, 2)))]
    out = S.smote(spark.createDataFrame(rows, "id int, c string, x double, y double"), "id", "c", ["x", "y"])
    made = out.where("is_synthetic").toPandas()
    assert set(made["c"]) == {"High"} and len(made) == 260
    assert made["x"].between(6, 14).all() and out.where("NOT is_synthetic").count() == 340


def test_smote_does_not_depend_on_its_cells(spark):
    rng = np.random.default_rng(3)
    rows = [(i, str(c), float(x), float(y), float(rng.integers(3))) for i, (c, x, y) in enumerate(zip(
        rng.choice(["a", "b", "c"], 900, p=[0.6, 0.3, 0.1]), rng.normal(0, 1, 900), rng.normal(0, 1, 900)))]
    rows += [(None, "b", 0.0, 0.0, 1.0), (2000, None, 0.0, 0.0, 1.0), (2001, "single", 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, c string, x double, y double, n double")
    out = [sorted(map(str, S.smote(df.repartition(p), "id", "c", ["x", "y", "n"], leaf_points=b).collect())) for b, p in ((256, 3), (7, 5))]
    assert out[0] == out[1]
    sizes = Counter(r["c"] for r in S.smote(df, "id", "c", ["x", "y", "n"]).collect())
    assert sizes["a"] == sizes["b"] == sizes["c"] and sizes["single"] == 1


def _brute_neighbours(keys, points, k):
    squared = np.zeros((len(points), len(points)))
    for axis in points.T:
        squared += (axis[:, None] - axis[None]) ** 2
    squared = np.floor(squared * 1e9 + 0.5) / 1e9
    np.fill_diagonal(squared, np.inf)
    order = np.lexsort((np.broadcast_to(keys, squared.shape), squared), axis=1)[:, :k]
    return {int(key): [int(keys[j]) for j in row if np.isfinite(squared[i, j])] for i, (key, row) in enumerate(zip(keys, order))}


@pytest.mark.parametrize(("shape", "leaf", "probes"), [("plain", 64, 50), ("lattice", 16, 1024), ("copies", 32, 16), ("few", 64, 64)])
def test_neighbours_are_the_nearest(spark, shape, leaf, probes):
    rng = np.random.default_rng(4)
    points = {"plain": rng.normal(0, 1, (1500, 3)), "lattice": rng.integers(0, 6, (1200, 4)).astype(float),
              "copies": np.concatenate([np.zeros((300, 2)), rng.normal(0, 5, (400, 2)), np.full((5, 2), 3.0)]), "few": rng.normal(0, 1, (4, 2))}[shape]
    keys = rng.permutation(len(points)) * 3
    rows = [("a" if i % 5 else "b", int(key), [float(v) for v in p]) for i, (key, p) in enumerate(zip(keys, points))]
    got = nearest_neighbours(spark.createDataFrame(rows + [(None, -1, [0.0] * points.shape[1])], "c string, id long, z array<double>"),
                             "c", "id", "z", 5, leaf, probes)
    found = {r["id"]: [n["other"] for n in r["neighbours"]] for r in got.collect()}
    want = {}
    for c in "ab":
        at = [i for i, r in enumerate(rows) if r[0] == c]
        want |= _brute_neighbours(keys[at], points[at], 5)
    assert found == want


def test_neighbours_of_the_feature_matrix(spark):
    """5,000 rows of the scaled v2 matrix, where most features take few values, against all pairs."""
    from crashrisk.operators import features as X
    from crashrisk.plans import views as V
    from crashrisk.plans.sampling_queries import _FEATURES
    frame = X.build_features_v2(V.crashes(spark, "/root/testdata/sf0.01")).where("severity_class IS NOT NULL").orderBy("id").limit(5000).toPandas()
    points = frame[_FEATURES].to_numpy(dtype=float)
    spread = points.std(axis=0, ddof=1)
    points = np.divide(points, spread, out=np.zeros_like(points), where=spread > 0)
    keys = frame["id"].to_numpy()
    rows = spark.createDataFrame([(0, int(k), [float(v) for v in p]) for k, p in zip(keys, points)], "c int, id long, z array<double>")
    found = {r["id"]: [n["other"] for n in r["neighbours"]] for r in nearest_neighbours(rows, "c", "id", "z", 5).collect()}
    assert found == _brute_neighbours(keys, points, 5)


def test_blocks_of_probes_go_down_to_the_children_that_may_hold_a_neighbour():
    import pyarrow as pa
    from crashrisk.operators import neighbours as N
    rng = np.random.default_rng(6)
    points, pivots = rng.normal(0, 1, (40, 3)), rng.normal(0, 1, (5, 3))
    radius, bound = rng.uniform(0.1, 1, 5), np.append(rng.uniform(0.1, 1, 39), np.inf)
    probes = [{"_p": i, "_z": list(p), "bound": b, "own": 7} for i, (p, b) in enumerate(zip(points, bound))]
    children = [{"child": 16 + i, "radius": r, "pivot": list(p), "inside": i % 2 == 0} for i, (p, r) in enumerate(zip(pivots, radius))]
    batch = pa.record_batch([pa.array(["g"]), pa.array([children]), pa.array([probes])], names=["_g", "children", "probes"])
    got = [tuple(r[c] for c in ("_g", "_p", "cell", "inside", "bound")) for out in N._below([batch]) for r in out.to_pylist()]
    away = np.sqrt(((points[:, None] - pivots[None]) ** 2).sum(axis=2))
    want = [("g", i, 16 + j, j % 2 == 0, bound[i]) for i in range(40) for j in range(5)
            if away[i, j] - radius[j] <= bound[i] and (away[i, j] - away[i].min()) / 2 <= bound[i]]
    assert got == want and 5 < len(want) < 200


# --- plans -------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["fn27_safety_score", "fn28_recommendation", "fn29_explanation_context", "win3_segment_placement", "win4_safest_route",
                                  "agg18_route_roll_up", "jn5_interval_to_point", "fn9_fn10_speeds"])
def test_points_of_routes_are_never_broadcast(spark, sf_dir, name):
    # exploded rows are guessed as small as the rows they come from
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, sf_dir)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["fn28_recommendation", "fn29_explanation_context", "win3_segment_placement"])
def test_routes_are_joined_by_shuffle_whatever_the_threshold(spark, sf_dir, name):
    import __spark_entry__ as entry
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = entry.queries()[name](spark, sf_dir)
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_cross_joins_or_global_windows_in_core_plans(spark, sf_dir):
    import __spark_entry__ as entry
    for name in ("agg16_binary_roc_auc", "smp1_stratified_split", "jn5_interval_to_point", "jn4_radius_held_out", "win1_candidate_wins"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    import __spark_entry__ as entry
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = entry.queries()["src1_parquet_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderstatus,F)" in plan and "o_custkey" not in plan


def test_explanations_of_predictions_with_none_and_several(spark):
    predictions = spark.createDataFrame([(1, "high"), (2, "high"), (3, "low"), (4, None)], "prediction_id long, risk_class string")
    explanations = spark.createDataFrame(
        [(1, True, 10, "high"), (1, True, 30, "low"), (1, False, 99, None), (2, False, 5, "high"), (9, True, 1, "low"), (None, True, 1, "low")],
        "prediction_id long, success boolean, latency_ms long, risk_class_explained string")
    got = {r["risk_class"]: r for r in J.explanation_coverage(predictions, explanations).collect()}
    assert set(got) == {"high", "low", None}
    high = got["high"]
    assert (high["predictions"], high["explained"], high["attempts"], high["failed"], high["mismatched"]) == (2, 1, 4, 2, 1)
    assert high["mean_latency_ms"] == 20.0 and high["explained_rate"] == 0.5
    assert (got["low"]["attempts"], got["low"]["explained"], got["low"]["mean_latency_ms"]) == (0, 0, None)


def test_pages_and_payloads_without_content_are_named(spark):
    pages = spark.createDataFrame([(1, '{"data":[{"id":1},{"id":2}]}'), (2, '{"data":[]}'), (3, '{"dat'), (4, None), (5, "{}")], "page int, value string")
    rows, rejects = RD.explode_data_pages(pages, "value", "id: bigint")
    assert sorted(map(tuple, rows.collect())) == [(1, 1), (1, 2)]
    assert sorted(r["page"] for r in rejects.collect()) == [3, 4, 5]
    trips = spark.createDataFrame([(1, '{"routes":[{"duration":"5s"}]}'), (2, '{"routes":[]}'), (3, "{oops"), (4, None), (5, " ")], "trip int, value string")
    assert [r["trip"] for r in R.parse_routes(trips, "value").collect()] == [1]
    assert dict(map(tuple, R.rejected_routes(trips, "value").collect())) == {
        2: "no routes", 3: "unreadable payload", 4: "no payload", 5: "no payload"}
