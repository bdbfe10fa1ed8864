"""Runs a query and its SQL on the same tables and compares rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = os.path.join(sf_dir, name)
            path = f"{path}/*.parquet" if os.path.isdir(path) else path
            con.execute(f"create view {name[:-8]} as select * from '{path}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, list):
        return tuple(cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return v


def differences(spark, con, name: str, run, sql: str, sf_dir: str) -> str:
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(cell(v) for v in r) for r in df.select(*cols).collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} against {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = Counter(tuple(cell(r[i]) for i in order) for r in rel.fetchall())
    if got == want:
        return ""
    only, lack = got - want, want - got
    return f"{name}: {sum(only.values())} rows too many, {sum(lack.values())} lacking, e.g. {list(only)[:2]} / {list(lack)[:2]}"
