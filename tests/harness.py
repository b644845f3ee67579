"""Spark-vs-DuckDB comparison used by the tests and by hand while developing.

Mirrors the correctness gate: same column names, same row count, same values
(order-insensitive). Floats are compared after rounding to 9 decimals.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


EXACT = False


def _canon(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return (v + 0.0) if EXACT else round(v, 9) + 0.0
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _canon(v.item())
        except Exception:
            return v
    if isinstance(v, (list, tuple)):
        return tuple(_canon(x) for x in v)
    return v


def _rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_canon(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


_SPARK_TO_DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                  "BooleanType": "BOOLEAN", "DecimalType": "DECIMAL", "ShortType": "SMALLINT", "FloatType": "FLOAT"}


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    t = time.time()
    sdf = fn(spark, sf_dir)
    left = sdf.toPandas()
    ts = time.time() - t
    rel = con.sql(sql)
    right = rel.df()
    lc, rc = sorted(left.columns), sorted(right.columns)
    if lc != rc:
        return False, f"columns differ: spark-only {set(lc) - set(rc)} oracle-only {set(rc) - set(lc)}"
    st = {f.name: _SPARK_TO_DUCK.get(type(f.dataType).__name__, str(f.dataType)) for f in sdf.schema.fields}
    dt = {c: str(ty).split("(")[0] for c, ty in zip(rel.columns, rel.types)}
    if st != dt:
        return False, f"types differ: {{{', '.join(f'{c}: {st[c]}/{dt[c]}' for c in st if st[c] != dt.get(c))}}}"
    if len(left) != len(right):
        return False, f"rows differ: spark {len(left)} oracle {len(right)}"
    a, b = _rows(left), _rows(right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} value mismatches, first: spark={bad[0][0]} oracle={bad[0][1]} cols={lc}"
    return True, f"ok rows={len(left)} spark={ts:.2f}s"


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    from spanrisk.plans.catalog import load_all
    from spanrisk.session import get_spark

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf_dir = a.split("=", 1)[1]
        if a == "--exact":
            global EXACT
            EXACT = True
    reg = load_all()
    spark = get_spark()
    con = duck(sf_dir)
    fails = 0
    for name, e in reg.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        if e.sql is None:
            t = time.time()
            n = e.fn(spark, sf_dir).count()
            print(f"{name:32s} ROWS-ONLY rows={n} {time.time() - t:.2f}s", flush=True)
            continue
        try:
            ok, msg = compare(spark, con, name, e.fn, e.sql, sf_dir)
        except Exception as ex:  # report and continue
            ok, msg = False, f"error {type(ex).__name__}: {str(ex)[:400]}"
        fails += not ok
        print(f"{name:32s} {'PASS' if ok else 'FAIL'} {msg}", flush=True)
    print(f"failures: {fails}")
    return 1 if fails else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
