"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from lakeloom import plans


def plain(v):
    """A value that compares alike from either engine; doubles to ten digits."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def differences(df, sql: str, sf: str) -> list:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(names), sorted(df.columns))]
    want = Counter(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    got = Counter(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect())
    return [("only in SQL", *x) for x in list((want - got).items())[:3]] + [("only in Spark", *x) for x in list((got - want).items())[:3]]


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_sql_twin(spark, sf, name):
    assert differences(plans.QUERIES[name](spark, sf), plans.ORACLE[name], sf) == []


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, sf, name):
    df = plans.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_chunks_of_mixed_paragraphs(spark, tmp_path):
    """Null, empty and blank texts, paragraphs under, at and over the size, and repeated rows, against the twin's fold."""
    a, b = "word " * 30, "x" * 400
    texts = [None, "", " \n\n \n\n", "one", "a\n\nb\n \t\nc", f"{a}\n\n{a}\n\n{a}\n\nend", f"{b}\n\n{b}", f"short\n\n{b}y\n\nend", f"{b}{b}{b}\n\n{a}\n\n{a}", f"{'z' * 399}\n\n1\n\n2", f"{' ' * 500}é{'ü' * 900}", f"{a}\n\n{a}\n\n{a}\n\nend"]
    rows = [(k % 11, t) for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", rows)
    con.execute(f"COPY d TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    for name in ("K1_chunks", "K1_packed_paragraphs"):
        assert differences(plans.QUERIES[name](spark, str(tmp_path)), plans.ORACLE[name], str(tmp_path)) == []


def test_payments_of_nothing(spark, tmp_path):
    """A damaged payment of zero is negative too, and an undamaged one stays."""
    con = duckdb.connect()
    con.execute("CREATE TABLE e AS SELECT range AS event_id, TIMESTAMP '2024-01-02' + to_seconds(range) AS ts, range % 7 AS user_id, 'purchase' AS event_type, CAST(range % 4 AS DOUBLE) AS value, '{\"k\": 1}' AS props FROM range(300)")
    con.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert con.execute("SELECT count(*) FROM e WHERE value = 0 AND event_id % 50 = 0").fetchall()[0][0] > 0
    for name in ("S4_land_payments", "S2_payment_stream_source"):
        assert differences(plans.QUERIES[name](spark, str(tmp_path)), plans.ORACLE[name], str(tmp_path)) == []
