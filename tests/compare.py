"""Runs registered queries beside their SQL: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return v


def differences(spark, name: str, query, sql: str, sf_dir: str, con=None) -> str:
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    res = (con or oracle(sf_dir)).execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    pick = [names.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in pick) for r in res.fetchall())
    a, b = ours - theirs, theirs - ours
    if a or b:
        return f"{sum(ours.values())} against {sum(theirs.values())} rows; only here {list(a.items())[:3]}; only there {list(b.items())[:3]}"
    return ""


if __name__ == "__main__":
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    import __spark_entry__ as e
    from skein.session import local_session

    spark = local_session()
    sf, names = sys.argv[1], sys.argv[2:]
    q, s = e.queries(), e.oracle_sql()
    bad = []
    for n in names or q:
        t = time.time()
        try:
            if n in s:
                said = differences(spark, n, q[n], s[n], sf) or "same"
            else:
                said = f"{q[n](spark, sf).count()} rows, no SQL"
        except Exception as x:
            said = "ERROR " + str(x)[:1500]
        if said != "same" and "no SQL" not in said:
            bad.append(n)
        print(f"{n}: {time.time() - t:.1f}s {said}", flush=True)
    print("BAD", bad)
