"""SMP queries."""

from pyspark.sql import functions as F

from crashrisk.operators import features as X
from crashrisk.operators import sampling as S
from crashrisk.plans import views as V
from crashrisk.plans.catalog import query
from crashrisk.plans.model_queries import _LIGHT, _MEDIAN, _TIME, _WEATHER, _hot
from crashrisk.plans.spatial_queries import CLASSIFIED, classified

_BUCKET = "CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100"


@query("smp1_stratified_split", V.with_views("crashes", more=CLASSIFIED + """,
h AS (SELECT id, severity_class, row_number() OVER (PARTITION BY severity_class
    ORDER BY CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 13) AS BIGINT)) AS r, count(*) OVER (PARTITION BY severity_class) AS n FROM classified)""",
    then="SELECT id, severity_class, CASE WHEN r <= round(n * 0.2e0) THEN 'test' ELSE 'train' END AS split FROM h"))
def _(spark, d):
    return S.exact_stratified_split(classified(spark, d), "id", "severity_class").select("id", "severity_class", "split")


@query("smp2_three_way_split", f"""
SELECT o_orderkey, CASE WHEN {_BUCKET} < 80 THEN 'train' WHEN {_BUCKET} < 90 THEN 'validation' ELSE 'test' END AS split FROM orders""")
def _(spark, d):
    return S.three_way_split(V.table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("smp3_hash_split", f"""
SELECT o_orderkey, CASE WHEN {_BUCKET} < 20 THEN 'test' ELSE 'train' END AS split FROM orders""")
def _(spark, d):
    return S.hash_split(V.table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("smp4_downsample_majority", V.with_views("accidents", more="""
h AS (SELECT ID, Severity, row_number() OVER (PARTITION BY Severity ORDER BY CAST('0x' || substr(md5(CAST(ID AS VARCHAR)), 1, 13) AS BIGINT)) AS r,
    count(*) FILTER (WHERE Severity <> 2) OVER () AS others FROM accidents)""",
    then="SELECT ID AS id, Severity AS severity FROM h WHERE Severity <> 2 OR r <= others"))
def _(spark, d):
    return S.downsample_majority(V.accidents(spark, d), "ID", "Severity", 2).select(
        F.col("ID").alias("id"), F.col("Severity").alias("severity"))


_HASH = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 13) AS BIGINT)"
_FEATURES = ["lat", "lon", "speed_limit", "hour_of_day", "day_of_week", "month", "is_weekend", "is_rush_hour"]
_FEATURES += [c.rsplit(" AS ", 1)[1] for c in _hot("weath_cond_descr", _WEATHER).split(", CASE")]
_FEATURES += [c.split()[0].rstrip(",") for c in _LIGHT.split(" AS ")[1:]]
_AXES = f"range(1, {len(_FEATURES) + 1})"


@query("smp5_smote", V.with_views("crashes", more=CLASSIFIED + f""",
m AS (SELECT id, lat, lon, {_MEDIAN}, {_TIME.format(evening=19)}, {_hot('weath_cond_descr', _WEATHER)}, {_LIGHT}, severity_class FROM classified),
x AS (SELECT id, severity_class AS c, {_HASH.format("id")} AS h, [{", ".join(f"CAST({f} AS DOUBLE)" for f in _FEATURES)}] AS x FROM m),
s AS (SELECT [{", ".join(f"coalesce(round(stddev_samp(x[{i + 1}]), 6), 0)" for i in range(len(_FEATURES)))}] AS s FROM x),
n AS (SELECT c, count(*) AS n, (SELECT max(k) FROM (SELECT count(*) AS k FROM x GROUP BY c)) - count(*) AS missing FROM x GROUP BY c),
z AS (SELECT x.*, n, missing, list_transform({_AXES}, lambda i: CASE WHEN s[i] > 0 THEN x[i] / s[i] ELSE 0 END) AS z
      FROM x JOIN n USING (c), s WHERE missing > 0 AND n > 1),
pr AS (SELECT a.c, a.id, b.id AS other, b.x AS y, round({" + ".join(f"(a.z[{i}] - b.z[{i}]) * (a.z[{i}] - b.z[{i}])" for i in range(1, len(_FEATURES) + 1))}, 9) AS d
       FROM z a JOIN z b ON a.c = b.c AND a.id <> b.id),
nn AS (SELECT c, id, list(y ORDER BY d, other) AS ys
       FROM (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY c, id ORDER BY d, other) <= 5) GROUP BY c, id),
cp AS (SELECT c, id, x, n, missing, missing // n + CASE WHEN row_number() OVER (PARTITION BY c ORDER BY h, id) <= missing % n THEN 1 ELSE 0 END AS copies FROM z),
mk AS (SELECT c, x, ys[CAST(floor({_HASH.format("id || ':' || copy || ':nb'")} / CAST(16 AS DOUBLE) ** 13 * len(ys)) + 1 AS INTEGER)] AS y,
              {_HASH.format("id || ':' || copy || ':u'")} / CAST(16 AS DOUBLE) ** 13 AS u
       FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM cp JOIN nn USING (c, id)))""", then=f"""
SELECT id, c AS severity_class, {", ".join(f"round(x[{i + 1}], 6) AS {f}" for i, f in enumerate(_FEATURES))}, false AS is_synthetic FROM x
UNION ALL SELECT NULL, c, {", ".join(f"round(x[{i + 1}] + u * (y[{i + 1}] - x[{i + 1}]), 6)" for i in range(len(_FEATURES)))}, true FROM mk"""))
def _(spark, d):
    matrix = X.build_features_v2(V.crashes(spark, d))
    out = S.smote(matrix, "id", "severity_class", _FEATURES)
    return out.select("id", "severity_class", *[F.round(c, 6).alias(c) for c in _FEATURES], "is_synthetic")
