"""Rows that fail to parse: split raw comma-separated tracking lines into typed rows and reasoned rejects.

Structural indexing: a whole Arrow batch of lines is one byte buffer. A quote mask and the parity of its
prefix sums (restarted at each record's end) tell which commas delimit fields; all later checks are array
operations over the field table, so no Python code runs per line or per character.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUOTE, COMMA = 34, 44
N_FIELDS = 10
#: The typed columns, in the order of a line's fields.
TYPED = ["frame", "track_id", "box_left", "box_top", "box_width", "box_height", "extra_1", "extra_2", "extra_3", "extra_4"]
#: Reasons, in order of precedence.
REASONS = ["valid", "blank", "quoting", "column_count", "value"]
VALID, BLANK, QUOTING, COLUMN_COUNT, VALUE = range(5)
INTEGER = r"^\+?[0-9]+(\.0*)?$|^-0+(\.0*)?$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

#: A decimal number above 0, whatever its exponent.
POSITIVE = r"^\+?[0.]*[1-9]"
#: The largest value of the integer columns.
LARGEST = str(2**63 - 1)

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _gather(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The byte ranges as one Arrow string array."""
    length = np.maximum(stop - start, 0)
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    at = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets.tobytes()), pa.py_buffer(buf[at].tobytes()))


def record_ends(data: bytes) -> np.ndarray:
    """Ends of the records of a whole text: positions behind the line feeds outside quotes (by the parity of the
    quotes before them), and the end of the text. A quoted line break does not end a record."""
    buf = np.frombuffer(data, np.uint8)
    even = np.cumsum(buf == QUOTE) % 2 == 0
    ends = np.flatnonzero((buf == 10) & even) + 1
    return ends if len(ends) and ends[-1] == len(buf) else np.append(ends, len(buf))


def split_records(data: bytes) -> pa.Array:
    """A whole text as one record a row; carriage returns before the line feeds count as blanks."""
    ends = record_ends(data)
    start = np.concatenate([[0], ends[:-1]])
    keep = ends > start
    return _gather(np.frombuffer(data, np.uint8), start[keep], ends[keep] - (np.frombuffer(data, np.uint8)[ends[keep] - 1] == 10))


def index_lines(lines: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """Reason code of every line, and for the lines with code VALID the ten typed columns.

    A null line counts as blank. Blank lines are valid but carry no row. A valid value that its column's type
    cannot hold (an integer beyond 64 bits, a number too large or too small for a double) is null there.
    """
    arr = lines.cast(pa.string()) if lines.type != pa.string() else lines
    arr = pc.fill_null(arr, "")
    if arr.offset:
        arr = pa.concat_arrays([arr])
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.int8), [pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * 8
    off = np.frombuffer(arr.buffers()[1], np.int32, count=n + 1).astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[: off[-1]] if data is not None and off[-1] else np.zeros(0, np.uint8)
    code = np.full(n, VALID, np.int8)

    quote = buf == QUOTE
    upto = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(quote, out=upto[1:])
    # parity of the quotes before each byte within its own record
    commas = np.flatnonzero(buf == COMMA)
    rec = np.searchsorted(off, commas, side="right") - 1
    outside = ((upto[commas] - upto[off[rec]]) & 1) == 0
    commas, rec = commas[outside], rec[outside]

    # field table: a record has its delimiters + 1 fields
    n_field = np.bincount(rec, minlength=n) + 1
    first = np.zeros(n + 1, np.int64)
    np.cumsum(n_field, out=first[1:])
    start = np.empty(first[-1], np.int64)
    stop = np.empty(first[-1], np.int64)
    start[first[:-1]] = off[:-1]
    stop[first[1:] - 1] = off[1:]
    inner = np.arange(len(commas)) + rec
    stop[inner] = commas
    start[inner + 1] = commas + 1
    owner = np.repeat(np.arange(n), n_field)

    # blanks around fields: nearest non-blank byte to the right of start and to the left of stop
    solid = np.flatnonzero(~_BLANK[buf])
    lo = np.searchsorted(solid, start)
    hi = np.searchsorted(solid, stop)
    some = hi > lo
    safe = np.append(solid, 0)
    start = np.where(some, safe[np.minimum(lo, len(solid))], start)
    stop = np.where(some, safe[np.maximum(hi - 1, 0)] + 1, start)
    code[(n_field == 1) & ~some[first[:-1]]] = BLANK

    # quoting: each field is free of quotes, or one quoted text whose inner quotes are doubled
    q_in = upto[stop] - upto[start]
    quoted = q_in > 0
    pad = np.append(buf, 0)
    wrong = quoted & ~((pad[start] == QUOTE) & (pad[stop - 1] == QUOTE) & (q_in % 2 == 0) & (stop - start >= 2))
    many = np.flatnonzero(quoted & ~wrong & (q_in > 2))
    if len(many):
        q_at = np.flatnonzero(quote)
        rank0 = upto[start[many]]
        pairs = (q_in[many] - 2) // 2
        which = np.repeat(np.arange(len(many)), pairs)
        step = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        left = q_at[rank0[which] + 1 + 2 * step]
        right = q_at[rank0[which] + 2 + 2 * step]
        wrong[many[np.unique(which[right != left + 1])]] = True
    code[np.unique(owner[wrong])] = QUOTING
    code[(code == VALID) & (n_field != N_FIELDS)] = COLUMN_COUNT

    # values of the lines that still stand, quotes and the blanks inside them taken off
    live = np.flatnonzero(code == VALID)
    f = (first[live][:, None] + np.arange(N_FIELDS)).ravel()
    s, e, q = start[f], stop[f], quoted[f]
    texts = _gather(buf, s + q, e - q)
    if q.any():
        texts = pc.if_else(pa.array(q), pc.replace_substring(pc.ascii_trim_whitespace(texts), '""', '"'), texts)
    whole = pc.match_substring_regex(texts, INTEGER).to_numpy(zero_copy_only=False).reshape(-1, N_FIELDS)
    number = pc.match_substring_regex(texts, DECIMAL).to_numpy(zero_copy_only=False).reshape(-1, N_FIELDS)
    good = whole[:, :2].all(1) & number[:, 2:].all(1)
    above = pc.match_substring_regex(texts, POSITIVE).to_numpy(zero_copy_only=False).reshape(-1, N_FIELDS)
    good &= above[:, 4:6].all(1)
    code[live[~good]] = VALUE
    kept = np.flatnonzero(good)
    tidy = pc.replace_substring_regex(texts.take(pa.array((kept[:, None] * N_FIELDS + np.arange(2, N_FIELDS)).ravel())), r"^\+", "")
    value = pc.cast(tidy, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, N_FIELDS - 2)
    some = pc.match_substring_regex(tidy, r"^-?[0.]*[1-9]").to_numpy(zero_copy_only=False).reshape(-1, N_FIELDS - 2)
    lost = ~np.isfinite(value) | ((value == 0) & some)
    ints = pc.replace_substring_regex(texts.take(pa.array((kept[:, None] * N_FIELDS + np.arange(2)).ravel())), r"\..*$|^[+-]", "")
    ints = pc.utf8_ltrim(ints, "0")
    size = pc.utf8_length(ints)
    fits = pc.or_(pc.less(size, len(LARGEST)), pc.and_(pc.equal(size, len(LARGEST)), pc.less_equal(ints, LARGEST)))
    ints = pc.if_else(fits, pc.if_else(pc.equal(size, 0), "0", ints), pa.scalar(None, pa.string()))
    ids = pc.cast(ints, pa.int64())
    n_kept = len(kept)
    cols = [ids.take(pa.array(np.arange(n_kept) * 2 + k)) for k in range(2)] + [pa.array(value[:, k], mask=lost[:, k]) for k in range(N_FIELDS - 2)]
    return code, cols


def split_lines(df: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """Every non-blank line of ``df`` as one row: ``key``, ``reason`` (null for a valid line), ``line``
    (for rejects, and for valid lines with a value its type cannot hold) and the ten typed columns (for valid
    lines only). Such a value is null in its column: never infinite, never wrapped, and its text is kept in ``line``.

    Nulls: a null line counts as blank and has no row; a null key stays null. Empty tables give an empty
    result; repeated rows are parsed as often as they come; other columns of ``df`` are not read, so their
    names cannot clash. Lines of any length are handled whole.
    """
    typed = ", ".join(f"{c} {'bigint' if k < 2 else 'double'}" for k, c in enumerate(TYPED))
    key_type = df.schema[key].dataType.simpleString()
    out = pa.schema([("reason", pa.string()), ("line", pa.string()), *[(c, pa.int64() if k < 2 else pa.float64()) for k, c in enumerate(TYPED)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, cols = index_lines(b.column(1))
            rows = np.flatnonzero(code != BLANK)
            place = np.full(len(code), -1, np.int64)
            place[code == VALID] = np.arange((code == VALID).sum())
            pick = pa.array(place[rows], mask=place[rows] < 0)
            beyond = np.zeros(len(cols[0]) + 1, bool)
            beyond[:-1] = np.any([np.asarray(c.is_null()) for c in cols], axis=0)
            bad = pa.array((code[rows] != VALID) | beyond[place[rows]])
            names = pa.array([None if r == VALID else REASONS[r] for r in range(5)], pa.string())
            arrays = [names.take(pa.array(code[rows])), pc.if_else(bad, b.column(1).take(pa.array(rows)).cast(pa.string()), pa.scalar(None, pa.string()))]
            arrays += [c.take(pick) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), *arrays], schema=pa.schema([pa.field("key", b.schema.field(0).type), *out]))

    picked = df.select(F.col(key).alias("key"), F.col(line).alias("line"))
    return picked.mapInArrow(run, f"key {key_type}, reason string, line string, {typed}").withColumnRenamed("key", key)


def valid_rows(split: DataFrame, key: str = "line_id") -> DataFrame:
    """The typed rows of ``split_lines``."""
    return split.where(F.col("reason").isNull()).select(key, *TYPED)


def reject_rows(split: DataFrame, key: str = "line_id") -> DataFrame:
    """The rejects of ``split_lines``, each once per key (a repeated delivery repeats its reason)."""
    return split.where(F.col("reason").isNotNull()).groupBy(key).agg(F.min("reason").alias("reason"), F.min("line").alias("line"))
