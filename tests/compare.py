"""Order-free comparison of a Spark result with a DuckDB one."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in data)


def same(df, con, sql):
    got = df.toPandas().astype(object)
    got = got.where(got.notna(), None)
    rel = con.sql(sql)
    assert sorted(got.columns) == sorted(rel.columns)
    assert rows(list(got.columns), got.values.tolist()) == rows(list(rel.columns), rel.fetchall())
