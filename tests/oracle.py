"""Rows of a query against rows of DuckDB, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "quantize"):
        return round(float(v), 6)
    return v


def same(df, database, text):
    names = sorted(df.columns)
    got = sorted(str([plain(r[n]) for n in names]) for r in df.collect())
    found = database.execute(text)
    order = sorted(range(len(found.description)), key=lambda i: found.description[i][0])
    assert sorted(d[0] for d in found.description) == names
    want = sorted(str([plain(r[i]) for i in order]) for r in found.fetchall())
    return got == want
