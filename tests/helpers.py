"""Comparison of a query with its oracle, and small ledgers."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


LEDGER_DEFAULTS = dict(
    row_hash="h", date="2024-01-15", time="10:00", datetime="2024-01-15T10:00:00", type_raw="지출", type_norm="expense", major_raw="식비", minor_raw="외식",
    merchant_raw="Cafe", memo_raw=None, notes_manual="", amount=-1000.0, account="Card", currency="KRW", counterparty=None, category_rule=None,
    category_final="식비", tags_rule=[], tags_ai=[], tags_manual=[], tags_final=[], confidence=1.0, needs_review=0, is_transfer_candidate=0, is_transfer=0,
    transfer_group_id=None, file_id="f1", source_row=1,
)


def ledger(spark, *rows):
    from tallyweave.schema import LEDGER_SCHEMA

    full = [LEDGER_DEFAULTS | r for r in rows]
    return spark.createDataFrame([tuple(r[c] for c in LEDGER_SCHEMA.names) for r in full], LEDGER_SCHEMA)
