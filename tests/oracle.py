"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def compare(df, con, sql):
    got_names = sorted(df.columns)
    rel = con.sql(sql)
    assert got_names == sorted(rel.columns), (got_names, rel.columns)
    key = lambda rows: sorted((tuple(plain(x) for x in r) for r in rows), key=repr)
    got = key([tuple(r) for r in df.select(*got_names).collect()])
    want = key(con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in got_names)} FROM ({sql})").fetchall())
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kind)
        assert same is None or kinds[name] == same, (name, kind, kinds[name])
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    for a, b in zip(got, want):
        assert a == b, (a, b)
    return len(got)
