"""Compare a query with its SQL twin on tiny tables."""

import duckdb

SF = "/root/testdata/sf0.001"


def value(x):
    if x is None:
        return "null"
    return repr(round(float(x), 9) + 0.0) if not isinstance(x, (str, bool, list, dict, bytes)) and hasattr(x, "__float__") else str(x)


def canonical(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def run_sql(sql, sf=SF):
    import os

    c = duckdb.connect()
    for t in os.listdir(sf):
        c.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    out = c.sql(sql)
    return out.fetchall(), out.columns


def same(spark, query, sql, sf=SF):
    df = query(spark, sf)
    rows, names = run_sql(sql, sf)
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rows, names)
