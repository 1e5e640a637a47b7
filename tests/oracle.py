"""Compare a registered query with its check SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        return x.date()
    return x


def _key(row):
    return tuple((v is None, str(type(v).__name__ if not isinstance(v, (int, float)) else ""), 
                  round(v, 6) if isinstance(v, float) else v if v is not None else 0) for v in row)


def compare(df, con, sql: str) -> list[str]:
    """Problems found (empty = match): columns, types, row count, values exact up to 1e-9 relative."""
    problems = []
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return [f"columns differ: {cols} vs {sorted(names)}"]
    for c, t in df.dtypes:
        if KINDS.get(t, t) != kinds[c]:
            problems.append(f"type of {c}: {t} vs {kinds[c]}")
    mine = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    order = [names.index(c) for c in cols]
    theirs = [tuple(_plain(r[i]) for i in order) for r in theirs]
    if len(mine) != len(theirs):
        problems.append(f"rows: {len(mine)} vs {len(theirs)}")
    mine.sort(key=_key)
    theirs.sort(key=_key)
    bad = 0
    for a, b in zip(mine, theirs):
        for c, x, y in zip(cols, a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, (float, int)) and y is not None
                              and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12))
            if not same:
                bad += 1
                if bad <= 6:
                    problems.append(f"{c}: {x!r} vs {y!r} in {a}"[:300])
                break
    if bad:
        problems.append(f"{bad} rows differ")
    return problems
