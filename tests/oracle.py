"""Runs a query and its SQL on the same small tables and compares rows."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return str(v)

    return sorted((tuple(one(r[i]) for i in order) for r in data), key=str)


def compare(spark, query, sql):
    df = query(spark, SF)
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as from '{SF}/{f}'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())
