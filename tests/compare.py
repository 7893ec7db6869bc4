"""Compare every registered query with its SQL on one data folder: python tests/compare.py <sf_dir> [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~null"
    if isinstance(value, float) and math.isnan(value):
        return "~nan"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((str(type(v)), str(v)) for v in r))


_KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def compare(spark, con, name, function, sql, folder):
    """(ok, message) for one query."""
    started = time.time()
    df = function(spark, folder)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {seconds:.1f}s"
    result = con.execute(sql)
    kinds = {c[0]: str(c[1]) for c in result.description}
    want_names, want = rows_of([c[0] for c in result.description], result.fetchall())
    if names != want_names:
        return False, f"columns {names} != {want_names}"
    wrong_kinds = [
        f"{c}: {t} / {kinds[c]}" for c, t in df.dtypes if _KINDS.get(t, t) != kinds[c].upper().replace("STRING", "VARCHAR").replace("NUMBER", kinds[c])
    ]
    if got != want:
        extra = [r for r in got if r not in want][:3]
        lacking = [r for r in want if r not in got][:3]
        return False, f"{len(got)} rows != {len(want)}; only Spark {extra}; only SQL {lacking}"
    return True, f"{len(got)} rows, {seconds:.1f}s" + (f"  KINDS {wrong_kinds}" if wrong_kinds else "")


def main():
    from __spark_entry__ import oracle_sql, queries
    from docquarry.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql = connect(folder), oracle_sql()
    bad = 0
    for name, function in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, message = compare(spark, con, name, function, sql.get(name), folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:400]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, message, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
