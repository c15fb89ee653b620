"""Run registered queries against their SQL and report differences."""
from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import duckdb

ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in ALL_TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def differences(df, con, sql) -> list[str]:
    got_cols, got = normalise(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = normalise([d[0] for d in res.description], res.fetchall())
    out = []
    if got_cols != want_cols:
        out.append(f"columns {got_cols} / {want_cols}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} / {len(want)}")
    if not out and got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        out.append(f"{len(bad)} rows differ, first: {str(bad[0])[:1500]}")
    elif out:
        out.append(f"first: {str(got[:1])[:600]} / {str(want[:1])[:600]}")
    return out
