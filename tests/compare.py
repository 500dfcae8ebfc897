"""Compares a Spark result with DuckDB's, whatever the order of rows."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def same(df, c, sql):
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    at = [names.index(k) for k in cols]
    want = sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
    assert got == want
    return len(got)
