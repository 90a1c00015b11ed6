"""Rows of a query against the rows of its SQL, order and column order aside."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    try:
        f = float(v) if not isinstance(v, str) else None
    except TypeError:
        f = None
    return v if f is None else (None if math.isnan(f) else round(f, 6))


def shaped(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([_plain(r[i]) for i in order]) for r in rows)


def by_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    return shaped([c[0] for c in out.description], out.fetchall())


def by_spark(df):
    return shaped(df.columns, [tuple(r) for r in df.collect()])
