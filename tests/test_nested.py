import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frameledger.operators import nested


def brute(v, path=""):
    """Paths of the objects below the top, recursively."""
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return []
        if isinstance(w, str):
            return brute(w, path) if w != v else []
        return brute(w, path) if isinstance(w, (dict, list)) else []
    out = []
    if isinstance(v, dict):
        if path:
            out.append(path)
        for k, x in v.items():
            out += brute(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out += brute(x, f"{path}[{i}]")
    return out


leaf = st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.text("ab{[ ", max_size=4))
value = st.recursive(leaf, lambda c: st.one_of(st.lists(c, max_size=4), st.dictionaries(st.text("abc", min_size=1, max_size=2), c, max_size=4), st.builds(json.dumps, c)), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(value)
def test_paths(v):
    got = [w[0] for w in nested.walk(json.dumps(v)) if w[0]]
    assert sorted(got) == sorted(brute(v))


def test_identities_and_links():
    rows = list(nested.walk('{"a": [{"x": 1, "y": {"z": [1, 2]}}, null, {"y": {"z": [1, 2]}, "x": 1}], "s": "{\\"q\\": {}}"}'))
    by = {r[0]: r for r in rows}
    assert by["a[0]"][4] == by["a[2]"][4] and by["a[0].y"][4] == by["a[2].y"][4]
    assert by["a[2]"][5] == 2 and by["a[0].y"][2] == "a[0]" and by["a[0].y"][3] == by["a[0]"][4]
    assert by["s"][3] == by[""][4] and by["s.q"][2] == "s" and by[""][2] is None
    assert not any(list(nested.walk(x)) for x in (None, "plain", "{", "[]{", '{"a":1,}'))
    assert {r[0] for r in nested.walk('[{"a": {}}]')} == {"[0]", "[0].a"}
    same = list(nested.walk('{"": {"b": {"": 1}}}'))
    assert {(r[0], r[2]) for r in same} == {("", None), ("", ""), ("b", "")}


def test_no_scalar_is_lost():
    top, item = sorted(nested.walk('{"a": [1, {"b": 2}, [3, {"c": [4]}], null], "d": [{"e": []}], "f": [[5]]}'))[:2]
    inner = {r[0]: r for r in nested.walk('{"b": 2}')}[""][4]
    c = {r[0]: r for r in nested.walk('{"c": [4]}')}[""][4]
    assert item[0] == "a[1]" and json.loads(top[6]) == {"a": [1, {"#": inner}, [3, {"#": c}], None], "f": [[5]]}
    rows = {r[0]: r for r in nested.walk('[7, {"b": 2}]')}
    assert json.loads(rows[""][6])[""][0] == 7 and rows["[1]"][3] == rows[""][4] and rows["[1]"][2] == ""


@pytest.mark.parametrize("depth", [400, 20_000])
def test_any_depth(depth):
    n, last = 0, None
    for n, r in enumerate(nested.walk('{"a":' * depth + "1" + "}" * depth), 1):
        assert last is None or (r[2], r[3]) == last
        last = r[0], r[4]
    assert n == depth and len(last[0]) == 2 * depth - 3
    assert [r[0] for r in nested.walk('{"a":' + "[" * depth + "2" + "]" * depth + "}")] == [""]
    assert not list(nested.walk('{"a":' * depth + "1" + "}" * (depth - 1)))


@settings(max_examples=300, deadline=None)
@given(st.one_of(value.map(json.dumps), st.text('{}[]",:1a \\\\n', max_size=14), value.map(lambda v: json.dumps(v, indent=1))))
def test_the_deep_reader_reads_as_the_shallow_one(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            nested._deep(text)
        return
    assert nested._deep(text) == want


def test_in_spark(spark):
    df = spark.createDataFrame([(1, '{"segments": [{"text": "x", "start_sampled": 1}, null]}', "p"), (2, None, "q"), (3, "", "r"), (4, '"{\\"segments\\": [{\\"text\\": \\"x\\", \\"start_sampled\\": 1}]}"', "s")], "record_id long, payload string, path string")
    b = nested.shred(df, "t", "record_id", "payload")
    assert {(r["record_id"], r["path"]) for r in nested.nested_objects(b).collect()} == {(1, "segments[0]"), (4, "segments[0]")}
    objects = sorted((r["occurrences"], r["scalars"]) for r in nested.object_table(b.unionByName(b.withColumn("kind", F.lit("again")))).collect())
    assert objects == [(2, "{}"), (2, "{}"), (4, '{"start_sampled":1,"text":"x"}')]
    flat = nested.kind_table(b, "segments", {"text": "string", "start_sampled": "bigint"}).collect()
    assert {(r["text"], r["start_sampled"], r["ordinal"]) for r in flat} == {("x", 1, 0)}
    s = spark.sql("select 1L as record_id, named_struct('objects', array(named_struct('label', 'a'), null, named_struct('label', null))) as payload")
    assert {r["path"] for r in nested.nested_objects(nested.shred(s, "t", "record_id", "payload")).collect()} == {"objects[0]", "objects[2]"}
    assert nested.shred(df.limit(0), "t", "record_id", "payload").count() == 0


def test_every_kind_has_its_table(spark, sf):
    from frameledger.plans import data_queries as q

    links = q.QUERIES["p4_links"](spark, sf).collect()
    link = ["source_table", "record_id", "path", "parent_path", "ordinal"]
    rows = {tuple(r[c] for c in link) for r in links}
    tables = {name: q.QUERIES[name](spark, sf).collect() for name in q.KINDS}
    assert {r["kind"] for r in links} == {k for k, _ in q.KINDS.values()}
    assert {tuple(r[c] for c in link) for t in tables.values() for r in t} == rows and sum(map(len, tables.values())) == len(links)
    at = {(r["source_table"], r["record_id"], r["path"]): r["object_id"] for r in links}
    assert all(r["parent_path"] is None or at[r["source_table"], r["record_id"], r["parent_path"]] == r["parent_id"] for r in links)
    # each column of each table is read with a type that holds its values
    assert all(any(r[c] is not None for r in tables[name]) for name, (_, columns) in q.KINDS.items() for c in columns)
