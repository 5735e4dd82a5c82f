"""Run registered queries against their DuckDB oracle (like the driver does).

usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: rows, columns and value match (exact and rounded).
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v, digits):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return repr(round(v, digits)) if digits is not None else repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x, digits) for x in v) + "]"
    if isinstance(v, pd.Timestamp):
        v = v.to_pydatetime()
    return str(v)


def nullable_integers(df: pd.DataFrame) -> pd.DataFrame:
    """Integer columns as floats where they may hold nulls, on both sides alike."""
    return df.astype({c: "float64" for c, t in df.dtypes.items() if str(t) in ("Int8", "Int16", "Int32", "Int64")})


def frame_hash(df: pd.DataFrame, digits=None) -> str:
    df = nullable_integers(df)
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c], digits) for c in cols) for r in df.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()[:16]


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from farewatch.session import build_session
    spark = build_session(os.environ.get("ORACLE_MASTER", "local[8]"))
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = E.queries(), E.oracle_sql()
    ok = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {type(exc).__name__}: {str(exc)[:300]}")
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"{name:28s} rows={len(sdf)} (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as exc:  # noqa: BLE001
            print(f"{name:28s} SQL-ERROR {str(exc)[:300]}")
            continue
        same_cols = sorted(sdf.columns) == sorted(odf.columns)
        exact = same_cols and frame_hash(sdf) == frame_hash(odf)
        approx = same_cols and frame_hash(sdf, 6) == frame_hash(odf, 6)
        ok += exact
        if not exact and os.environ.get("DIFF"):
            cols = sorted(set(sdf.columns) & set(odf.columns))
            a = sorted("|".join(_norm(r[c], 6) for c in cols) for r in sdf.to_dict("records"))
            b = sorted("|".join(_norm(r[c], 6) for c in cols) for r in odf.to_dict("records"))
            print("  cols:", cols)
            for x in [r for r in a if r not in set(b)][:4]:
                print("  spark-only:", x[:300])
            for x in [r for r in b if r not in set(a)][:4]:
                print("  oracle-only:", x[:300])
        print(f"{name:28s} rows {len(sdf)}/{len(odf)} cols={'ok' if same_cols else (sorted(sdf.columns), sorted(odf.columns))} "
              f"exact={exact} r6={approx} {ts:.1f}s")
    print(f"exact matches: {ok}")


if __name__ == "__main__":
    main(sys.argv)
