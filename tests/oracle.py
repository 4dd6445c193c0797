"""Runs a query and its SQL on the same tables and compares rows. Also a command: python -m tests.oracle sf0.01 NAME..."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

DATA = "/root/testdata"


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, _plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    return x


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())


def difference(spark, name: str, fn, sql: str, sf_dir: str) -> str:
    """Empty if the rows agree."""
    a, b = rows_of(fn(spark, sf_dir)), duck_rows(sql, sf_dir)
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        return f"{name}: {sum(a[1].values())} and {sum(b[1].values())} rows; only Spark {list((a[1] - b[1]).items())[:3]}, only SQL {list((b[1] - a[1]).items())[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from corpusloom.session import local_session

    spark, qs, sql = local_session(), entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or list(qs):
        t = time.time()
        try:
            said = difference(spark, n, qs[n], sql[n], f"{DATA}/{sys.argv[1]}") if n in sql else f"{qs[n](spark, f'{DATA}/{sys.argv[1]}').count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        print(f"{n}: {time.time() - t:.1f} s {said or 'same'}", flush=True)
