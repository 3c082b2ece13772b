"""Compare a query with its check SQL the way the driver does: names, row count, values."""

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return str(int(v)) if v == int(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return str(v)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, fn, sql):
    """Empty string if equal, else what differs."""
    df = fn(spark, sf)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = table([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if not ours[1]:
        return "empty result"
    if len(ours[1]) != len(theirs[1]):
        extra = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return f"rows {len(ours[1])} != {len(theirs[1])}; only ours {list(extra[0])[:2]}; only theirs {list(extra[1])[:2]}"
    for a, b in zip(*[ours[1], theirs[1]]):
        if a != b:
            diff = [(n, x[:200], y[:200]) for n, x, y in zip(ours[0], a, b) if x != y]
            n = len(set(ours[1]) - set(theirs[1]))
            return f"{n} rows differ, first: {diff}"
    return ""
