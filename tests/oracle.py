"""Compare a query with its SQL in DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def compare(spark, con, df, sql):
    """(message or None, rows)."""
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}", 0
    order = sorted(df.columns)
    got = [tuple(r[c] for c in order) for r in df.select(*order).collect()]
    want = [tuple(r[names.index(c)] for c in order) for r in want]
    a, b = sorted([tuple(map(norm, r)) for r in got]), sorted([tuple(map(norm, r)) for r in want])
    if a != b:
        sa, sb = set(a), set(b)
        return f"{len(a)} and {len(b)} rows; only Spark {list(sa - sb)[:3]}; only SQL {list(sb - sa)[:3]}", len(a)
    return None, len(a)
