"""Comparison of a query with its SQL on the smallest tables."""

import os

FOLDER = "/root/testdata/sf0.001"
HERE = os.path.isdir(FOLDER)


def connection():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.sql(f"create view {file[:-8]} as select * from '{FOLDER}/{file}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(x):
        if isinstance(x, float):
            return f"{x:.6g}"
        return "[" + ",".join(map(value, x)) + "]" if isinstance(x, (list, tuple)) else str(x)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def agrees(spark, con, query, sql):
    df, result = query(spark, FOLDER), con.sql(sql)
    return canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), result.columns)
