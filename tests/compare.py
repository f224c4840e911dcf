"""Compare catalog queries with their DuckDB text: ``python tests/compare.py SF_DIR [name ...]``."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "<null>"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir, name, fn, sql):
    """Returns (ok, message)."""
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows={len(got)} (no SQL)"
    cursor = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    types = {d[0]: str(d[1]) for d in cursor.description}
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}"
    simple = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "timestamp_ntz": "TIMESTAMP"}
    odd = [f"{c}:{t}/{types[c]}" for c, t in df.dtypes if simple.get(t) != types[c]]
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"rows {len(got)} vs {len(want)} cols={cols} first differences {diff}"
    return True, f"rows={len(got)}" + (f" TYPES {odd}" if odd else "")


def main():
    from crashrisk.session import build_session
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false"})
    con, oracle, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            ok, message = check(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as exc:  # report and go on with the other queries
            ok, message = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:45s} {time.time() - start:6.2f}s {message}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
