"""Compares a query's rows with its SQL twin's, whatever their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def twin(sql: str, where: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    found = c.execute(sql)
    return [x[0] for x in found.description], found.fetchall()


def same(df, sql: str, where: str) -> None:
    names, rows = twin(sql, where)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    theirs = sorted((tuple(plain(r[names.index(n)]) for n in order) for r in rows), key=repr)
    ours = sorted((tuple(plain(r[n]) for n in order) for r in df.collect()), key=repr)
    assert ours == theirs
