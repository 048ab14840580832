"""Compares a Spark result with DuckDB's, as multisets of rows with columns sorted by name."""

import math
import os
from collections import Counter
from decimal import Decimal

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return db


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, Decimal):
        return round(float(x), 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(_plain(r[i]) for i in order) for r in data)


def differences(df, db, sql):
    """Texts of what differs; none if the results agree."""
    found = db.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    if want[0] != have[0]:
        return [f"columns {have[0]} for {want[0]}"]
    extra, missing = have[1] - want[1], want[1] - have[1]
    return [f"{sum(extra.values())} rows too many, as {list(extra)[:2]}; {sum(missing.values())} missing, as {list(missing)[:2]}"] if extra or missing else []
