"""Compares a query with its SQL on the given tables, without regard to order."""

import duckdb

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows_of(found, columns):
    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, list):
            return "[" + ",".join(map(plain, v)) + "]"
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in ([row[c] for c in columns] for row in found))


def same(spark, query, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(sql)
    columns = sorted(want.columns)
    wanted = [dict(zip(want.columns, r)) for r in want.fetchall()]
    df = query(spark, sf)
    assert sorted(df.columns) == columns
    got = [r.asDict() for r in df.collect()]
    assert rows_of(got, columns) == rows_of(wanted, columns)
    return got
