"""Run a registered query on Spark and its SQL twin on DuckDB and compare the two results."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    return type(v).__name__


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v else 0.0)
    return repr(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql) -> dict:
    """``problem`` is None when row count, column names, value types and values agree."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - t0
    out = {"rows": len(got), "seconds": round(seconds, 2), "problem": None}
    if sql is None:
        return out
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        out["problem"] = f"columns {sorted(df.columns)} vs {sorted(names)}"
        return out
    kinds_g = {c: {_kind(r[i]) for r in got[:2000] if r[i] is not None} for i, c in enumerate(df.columns)}
    kinds_w = {c: {_kind(r[i]) for r in want[:2000] if r[i] is not None} for i, c in enumerate(names)}
    for c in names:
        if kinds_g[c] and kinds_w[c] and kinds_g[c] != kinds_w[c]:
            out["problem"] = f"type of {c}: {kinds_g[c]} vs {kinds_w[c]}"
            return out
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        out["problem"] = f"{len(a)} rows vs {len(b)}"
    elif a != b:
        sa, sb = set(a), set(b)
        only_a, only_b = [x for x in a if x not in sb], [x for x in b if x not in sa]
        out["problem"] = f"{len(only_a)} rows differ, e.g. {only_a[:2]} vs {only_b[:2]}"
    if len(want) == 0:
        out["problem"] = out["problem"] or "both empty"
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as e
    from plantspark import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    qs, sql = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            r = compare(spark, con, sf_dir, fn, sql.get(name))
        except Exception as ex:  # report and go on
            r = {"rows": 0, "seconds": 0, "problem": f"{type(ex).__name__}: {str(ex)[:600]}"}
        bad += r["problem"] is not None
        mark = "ok  " if r["problem"] is None else "FAIL"
        print(f"{mark} {name:28s} rows={r['rows']:<7} {r['seconds']:6.2f}s {'' if sql.get(name) else '(rows only)'} {r['problem'] or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    import sys

    sys.exit(1 if main(sys.argv[1:]) else 0)
