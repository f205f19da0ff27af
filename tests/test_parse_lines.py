import re
from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameledger.operators.parse_lines import REASONS, TYPED, index_lines, reject_rows, split_lines, split_records, valid_rows

WS = " \t\r\n\v\f"


def brute(s):
    if s is None or not s.strip(WS):
        return "blank"
    fields, cur, inside = [], "", False
    for ch in s:
        if ch == '"':
            inside = not inside
        if ch == "," and not inside:
            fields.append(cur)
            cur = ""
        else:
            cur += ch
    fields.append(cur)
    if inside:
        return "quoting"
    out = []
    for f in fields:
        f = f.strip(WS)
        if '"' in f:
            if len(f) < 2 or f[0] != '"' or f[-1] != '"' or '"' in f[1:-1].replace('""', ""):
                return "quoting"
            f = f[1:-1].replace('""', '"').strip(WS)
        out.append(f)
    if len(out) != 10:
        return "column_count"
    for k, f in enumerate(out):
        if not re.fullmatch(r"\+?[0-9]+(\.0*)?|-0+(\.0*)?" if k < 2 else r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", f):
            return "value"
        if k in (4, 5) and not Decimal(f) > 0:
            return "value"
    return "valid"


CASES = ["1,2,3,4,5,6,7,8,9,10", ' 7.0 , 1 ," 3",4e2,+5,6,-1,-1,-1,-1\r', "", "  ", None, '"1,2,3,4,5,6,7,8,9,10"', '1,"2"x,3,4,5,6,7,8,9,10', '1,2,"3,4,5,6,7,8,9,10', "1,2,3", "-5,1,1,1,1,1,1,1,1,1", "1,1,1,1,0,1,1,1,1,1", "1,1,1,1,nan,1,1,1,1,1", '1,1,"1,050.5",1,1,1,1,1,1,1', '"a""b",1,1,1,1,1,1,1,1,1', "frame,id,l,t,w,h,c,x,y,z", "﻿1,2,3,4,5,6,7,8,9,10", "é,1", '""', '"""', "x" * 50_000]


def test_cases():
    code, cols = index_lines(pa.array(CASES, pa.string()))
    assert [REASONS[c] for c in code] == [brute(c) for c in CASES]
    assert all(len(c) == (code == 0).sum() for c in cols)
    assert cols[0].to_pylist()[:2] == [1, 7] and cols[3].to_pylist()[1] == 400.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet='12.,"" \t-+ex\r', max_size=30), max_size=40))
def test_against_brute_force(lines):
    assert [REASONS[c] for c in index_lines(pa.array(lines, pa.string()))[0]] == [brute(x) for x in lines]


def test_in_spark(spark):
    rows = [(i, c, "clash", "clash", 0.5) for i, c in enumerate(CASES)] + [(6, CASES[6], "again", "x", 1.0)]
    df = spark.createDataFrame(rows, "line_id long, line string, key string, reason string, frame double")
    s = split_lines(df)
    got = {r["line_id"]: r["reason"] for r in reject_rows(s).collect()}
    want = {i: brute(c) for i, c in enumerate(CASES) if brute(c) not in ("valid", "blank")}
    assert got == want
    assert valid_rows(s).count() == sum(brute(c) == "valid" for c in CASES)
    empty = split_lines(df.limit(0))
    assert empty.count() == 0 and empty.columns == s.columns


def test_values_beyond_the_types_are_valid_but_null(spark):
    lines = ["9" * 40 + ",1,1,1,1,1,1,1,1,1", "1,1,1e999,1,1,1,1,1,1,1", f"{2**63 - 1},{2**63},1,1,1,1,1,1,1,1", "000000000000000000000000000012.000,1,-1e-999,1,1e-999,1,0e999,1,1,1", "1,1,1,1,0e5,1,1,1,1,1"]
    code, cols = index_lines(pa.array(lines))
    assert [REASONS[c] for c in code] == ["valid"] * 4 + ["value"] == [brute(x) for x in lines]
    assert cols[0].to_pylist() == [None, 1, 2**63 - 1, 12] and cols[1].to_pylist() == [1, 1, None, 1]
    assert cols[2].to_pylist() == [1.0, None, 1.0, None] and cols[4].to_pylist() == [1.0, 1.0, 1.0, None] and cols[6].to_pylist()[3] == 0.0
    got = {r["line_id"]: r for r in split_lines(spark.createDataFrame(list(enumerate([*lines, CASES[0]])), "line_id long, line string")).collect()}
    assert {i: r["line"] for i, r in got.items()} == dict(enumerate([*lines, None])) and got[4]["reason"] == "value" and got[0]["reason"] is None


def test_records_of_a_whole_text():
    assert split_records(b'1,2\r\n"a\nb",3\n\nlast').to_pylist() == ["1,2\r", '"a\nb",3', "", "last"]
    assert split_records(b"").to_pylist() == [] and split_records(b'x\n"open\n1\n').to_pylist() == ["x", '"open\n1']
    assert len(TYPED) == 10


@pytest.mark.parametrize("cut", [1, 2])
def test_sliced_batches(cut):
    a = pa.array(CASES, pa.string())
    assert list(index_lines(a.slice(cut))[0]) == list(index_lines(a)[0])[cut:]
