"""Deeply nested records into related flat tables through Merkle subtree identities.

Every object is canonicalised bottom-up (members sorted, child objects replaced by their identities) and
hashed; equal subtrees therefore share one identity wherever they occur. ``shred`` yields one row per
occurrence: parent identity, child identity, ordinal and path - the bridge between the flat tables.
``object_table`` keeps each distinct object once, ``kind_table`` is the flat table of one kind of object.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bridge handed over at once by a worker.
CHUNK, CHUNK_CHARS = 50_000, 16_000_000
BRIDGE = "source_table string, record_id bigint, path string, kind string, parent_path string, parent_id string, object_id string, ordinal int, scalars string"
_SCHEMA = pa.schema([("source_table", pa.string()), ("record_id", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("parent_path", pa.string()), ("parent_id", pa.string()), ("object_id", pa.string()), ("ordinal", pa.int32()), ("scalars", pa.string())])


_STRING = json.decoder.scanstring
_SCALAR = json.JSONDecoder().scan_once
_SPACE = re.compile(r"[ \t\n\r]*")


def _deep(s: str):
    """The JSON value of a text too deep for the recursive reader, read with a stack of its own."""
    at = _SPACE.match(s, 0).end()
    root: list = []
    stack: list = []  # open containers
    here, key, n = root, None, len(s)

    def put(v):
        if isinstance(here, dict):
            here[key] = v
        else:
            here.append(v)

    while True:
        at = _SPACE.match(s, at).end()
        if at >= n:
            raise ValueError("unfinished")
        ch = s[at]
        if isinstance(here, dict) and key is None:
            if ch == "}" and not here:
                here, key = stack.pop()
                at += 1
            elif ch == '"':
                key, at = _STRING(s, at + 1)
                at = _SPACE.match(s, at).end()
                if s[at : at + 1] != ":":
                    raise ValueError("no colon")
                at += 1
                continue
            else:
                raise ValueError("no member name")
        elif ch == "]" and stack and not here:
            here, key = stack.pop()
            at += 1
        elif ch in "{[":
            v = {} if ch == "{" else []
            put(v)
            stack.append((here, key))
            here, key = v, None
            at += 1
            continue
        else:
            try:
                v, at = _SCALAR(s, at)
            except StopIteration as e:
                raise ValueError("no value") from e
            put(v)
        # behind a value: close whatever ends here, then a comma or the end of the text
        while True:
            at = _SPACE.match(s, at).end()
            if not stack:
                if at < n:
                    raise ValueError("text behind the value")
                return root[0]
            ch = s[at : at + 1]
            if ch == ",":
                at, key = at + 1, None
                after = _SPACE.match(s, at).end()
                if s[after : after + 1] in ("]", "}"):
                    raise ValueError("comma before the end")
                break
            if ch != ("}" if isinstance(here, dict) else "]"):
                raise ValueError("no comma")
            here, key = stack.pop()
            at += 1


def _read(s: str):
    try:
        return json.loads(s)
    except RecursionError:
        return _deep(s)


def _held(text: str):
    """What a text holds: the object or list it spells in JSON (texts of texts included), else the text."""
    if text[:1] not in _OPENERS:
        return text
    while True:
        s = text.strip()
        if not s or s[0] not in '{["':
            return text
        try:
            value = _read(s)
        except ValueError:
            return text
        if isinstance(value, str):
            inner = value.strip()
            if value == text or not inner or inner[0] not in '{["':
                return text
            text = value  # shorter than before, so this ends
            continue
        return value if isinstance(value, (dict, list)) else text


#: What a text that holds JSON may begin with: an opener, or white space.
_OPENERS = {*'{["', *(chr(i) for i in range(0x3001) if chr(i).isspace())}
_quoted = json.encoder.encode_basestring
#: Paths of nodes less deep than this are kept; deeper ones are put together from the last one given.
_KEPT_DEPTH = 64


def _encode(v) -> str:
    """A scalar in JSON."""
    if isinstance(v, str):
        return _quoted(v)
    if v is None or isinstance(v, bool):
        return "null" if v is None else "true" if v else "false"
    return repr(v) if isinstance(v, int) or v - v == 0 else json.dumps(v)


class _Node:
    """An object or list on the way: its place, and what its children gave."""

    __slots__ = ("value", "parent", "step", "ordinal", "depth", "size", "path", "kind", "form", "told")

    def __init__(self, value, parent, step, ordinal):
        self.value, self.parent, self.step, self.ordinal = value, parent, step, ordinal
        self.depth = parent.depth + 1 if parent else 0
        # characters of its path
        self.size = 0 if parent is None else parent.size + (len(step) + (parent.size > 0) if ordinal is None else len(str(ordinal)) + 2)
        self.path = self.kind = self.form = None
        self.told = False  # whether a list holds scalars of its own


def _nodes(top) -> list[_Node]:
    """All objects and lists, children after parents; texts that hold some are replaced by these."""
    nodes: list[_Node] = []
    stack = [_Node(top, None, None, None)]
    while stack:
        node = stack.pop()
        nodes.append(node)
        value = node.value
        for k, v in value.items() if isinstance(value, dict) else enumerate(value):
            if isinstance(v, str):
                v = _held(v)
                if isinstance(v, str):
                    continue
                value[k] = v
            if isinstance(v, (dict, list)):
                stack.append(_Node(v, node, k, None if isinstance(value, dict) else k))
    return nodes


def _identify(nodes: list[_Node]) -> None:
    """Canonical forms from the leaves up; an object's form is its identity, and it keeps its own scalars."""
    forms: dict[int, _Node] = {id(n.value): n for n in nodes}
    for n in reversed(nodes):
        value = n.value
        if isinstance(value, list):
            parts = []
            inner = False
            for v in value:
                if isinstance(v, (dict, list)):
                    child = forms[id(v)]
                    parts.append(child.form if isinstance(v, list) else f'{{"#":"{child.form}"}}')
                    n.told |= child.told and isinstance(v, list)
                    inner = True
                    if isinstance(v, list):
                        child.form = None
                else:
                    parts.append(_encode(v))
                    n.told |= v is not None
            n.told |= not inner
            n.form = f"[{','.join(parts)}]"
            continue
        body, scalars = [], []
        for k in sorted(value):
            v = value[k]
            name = _encode(k)
            if isinstance(v, dict):
                body.append(f'{name}:{{"#":"{forms[id(v)].form}"}}')
                continue
            part = f"{name}:{forms[id(v)].form}" if isinstance(v, list) else f"{name}:{_encode(v)}"
            body.append(part)
            if not isinstance(v, list) or forms[id(v)].told:
                scalars.append(part)
            if isinstance(v, list):
                forms[id(v)].form = None
        n.form = blake2b(f"{{{','.join(body)}}}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
        n.value = f"{{{','.join(scalars)}}}"


def _place(node: _Node, last: _Node | None) -> None:
    """Path and kind of a node, from the nearest one above that has them."""
    chain = []
    up = node
    while up.path is None:
        chain.append(up)
        up = up.parent
    path, kind = up.path, up.kind
    for n in reversed(chain):
        if n.ordinal is not None:
            path = f"{path}[{n.ordinal}]"
        else:
            path, kind = f"{path}.{n.step}" if path else n.step, f"{kind}.{n.step}" if kind else n.step
        if n.depth < _KEPT_DEPTH or n is node:
            n.path, n.kind = path, kind
    if last is not None and last.depth >= _KEPT_DEPTH and last is not node:
        last.path = last.kind = None


def walk(payload: str | None) -> Iterator[tuple[str, str, str | None, str | None, str, int | None, str]]:
    """Occurrences (path, kind, parent path, parent identity, identity, ordinal, scalars) of one payload,
    the top level first. Nothing is recursive, so any depth is read.

    ``kind`` is the path without positions; ordinal is the position in the list (null elements count), null
    for a member. ``scalars`` are an object's own values: its scalar members, and its lists that hold scalars
    (in one that holds objects too, these are stood for by their identities, so every scalar keeps its place).
    The top level has path ``""``; a list at the top has such a row too if it holds scalars. A top level that is
    no object or list has no rows.
    """
    top = None if payload is None else _held(payload)
    if not isinstance(top, (dict, list)):
        return
    nodes = _nodes(top)
    is_object = [isinstance(n.value, dict) for n in nodes]
    _identify(nodes)
    root = nodes[0]
    root.path = root.kind = ""
    if not is_object[0] and root.told:
        root.value = f'{{"":{root.form}}}'
        root.form = blake2b(root.form.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
    if isinstance(root.value, str):
        yield "", "", None, None, root.form, None, root.value
    last = None
    for node, obj in zip(nodes[1:], is_object[1:]):
        if not obj:
            continue
        _place(node, last)
        last = node
        up = node.parent
        while up is not None and not isinstance(up.value, str):
            up = up.parent
        yield node.path, node.kind, up and node.path[: up.size], up and up.form, node.form, node.ordinal, node.value


def shred(records: DataFrame, source_table: str, key: str, payload: str) -> DataFrame:
    """The bridge of all object occurrences of ``records.payload`` (JSON text, or a struct).

    Columns as in BRIDGE. Nulls: a null payload and null objects have no rows; empty lists and texts that
    hold no JSON none either. JSON written as text counts as what it holds, at any level; of members named
    twice the last counts. A payload that is no JSON has no rows. Other columns are not read.
    """
    kind = records.schema[payload].dataType.typeName()
    text = F.col(payload) if kind == "string" else F.to_json(F.col(payload))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def table() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)
            rows.clear()
            return b

        for b in batches:
            for rid, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in walk(body):
                    rows.append((source_table, rid, *w))
                    held += len(w[0]) + len(w[6])
                    if len(rows) >= CHUNK or held >= CHUNK_CHARS:
                        yield table()
                        held = 0
        yield table()

    return records.select(F.col(key).cast("bigint").alias("record_id"), text.alias("payload")).mapInArrow(run, BRIDGE)


def nested_objects(bridge: DataFrame) -> DataFrame:
    """The occurrences below the top level: source_table, record_id, path."""
    return bridge.where(F.col("path") != "").select("source_table", "record_id", "path")


def object_table(bridge: DataFrame) -> DataFrame:
    """Each distinct object once, wherever it stands: object_id, scalars and its number of occurrences (its kinds,
    sources and parents are the bridge's).

    Objects that recur in a third of all records are reduced map-side before the shuffle."""
    return bridge.groupBy("object_id").agg(F.min("scalars").alias("scalars"), F.count(F.lit(1)).alias("occurrences"))


def kind_table(bridge: DataFrame, kind: str, columns: dict[str, str]) -> DataFrame:
    """The flat table of one kind of object: its parent link (record, parent path and identity, ordinal)
    and the given scalar members, typed."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    body = F.from_json("scalars", ddl)
    link = ["source_table", "record_id", "path", "parent_path", "parent_id", "object_id", "ordinal"]
    return bridge.where(F.col("kind") == kind).select(*link, *[body[c].alias(c) for c in columns])
