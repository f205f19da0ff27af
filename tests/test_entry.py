"""The driver's contract: every query runs, and gives what its SQL gives."""
import os

import duckdb
import pytest

import __spark_entry__ as entry

COLUMNS = {"p1_found": ["line_id", "reason"], "p2_found": ["source_table", "row_id", "kind"], "p3_found": ["record_id", "field"], "p4_found": ["source_table", "record_id", "path"], "p5_found": ["record_id", "field", "defect"], "p6_found": ["source_table", "field", "row_id", "kind", "period"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"]}


def canon(v):
    if isinstance(v, float):
        return f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return "NULL" if v is None else str(v)


def test_entry(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", sorted(n for n in COLUMNS if n in entry.queries()))
def test_columns(spark, sf, name):
    assert entry.queries()[name](spark, sf).columns == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    rel = c.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = sorted("|".join(f"{k}={canon(r[k])}" for k in sorted(df.columns)) for r in (x.asDict() for x in df.collect()))
    want = sorted("|".join(f"{k}={canon(v)}" for k, v in sorted(zip(rel.columns, r))) for r in rel.fetchall())
    assert got == want
