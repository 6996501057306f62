"""Run registered queries and their SQL side by side: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Spark type -> types the SQL side may have
TYPES = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"}, "date": {"DATE"}, "array<string>": {"VARCHAR[]"},
}


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(names, tuples) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(norm(t[i]) for i in order) for t in tuples)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    mine = df.collect()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = [f"{c}: {t} vs {kinds[c]}" for c, t in df.dtypes if kinds[c] not in TYPES.get(t, {kinds[c]})]
    if wrong:
        return f"types {wrong}"
    a, b = rows_of(df.columns, mine), rows_of(names, theirs)
    if a != b:
        return f"{len(mine)} rows vs {len(theirs)}; only here {list((a - b).items())[:3]}; only SQL {list((b - a).items())[:3]}"
    return None


def main() -> int:
    from conftest import make_session

    import __spark_entry__ as e

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.001'}"
    only = sys.argv[2:]
    spark, con, bad = make_session(), duck(sf_dir), 0
    sqls = e.oracle_sql()
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                problem = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t0:.1f}s {'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print(f"{bad} failing", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
