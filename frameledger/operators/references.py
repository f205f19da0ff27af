"""References to records that do not exist (or are deleted, or arrive later).

Keys are cut into ranges of a 128-bit hash, as many as the data ask for; a task holds the parents of one range at a
time as sorted arrays and probes reference batches by vectorised binary search; misses are aggregated per table and
month. Keys that carry many references (heavy hitters of a map-side sketch) are spread over several ranges, each with
its own copy of that one parent.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameledger.session import first_delivery, trimmed, utc_month

#: The prefixes a path may carry, one of which is taken off.
PATH_PREFIX = r"^(\./data/|data/|\./dataset/|dataset/)"
#: Ranges per task at least (more ranges than tasks keep the load even), and rows of a range on average at most.
RANGES_PER_TASK, RANGE_ROWS = 8, 500_000
#: A key with more than 1/HOT_SHARE of a task's fair share of references, and HOT_LEAST of them, is spread. There are
#: at most HOT_SHARE * tasks such keys, whatever the data, which bounds the broadcast below. The sketch tracks
#: TRACKED times as many, so that it misses none.
HOT_SHARE, HOT_LEAST, TRACKED = 2, 1000, 32
KINDS = [None, "missing", "deleted", "late"]


def tidy_path(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), PATH_PREFIX, "")


def _hashed(df: DataFrame, domain: str, *key: Column) -> DataFrame:
    """h1, h2: a 128-bit identity of the key within its domain; rows without a full key are dropped."""
    parts = [F.coalesce(k, F.lit("")) for k in key]
    h1 = F.xxhash64(F.lit(domain), *parts)
    h2 = F.xxhash64(*parts, F.lit(domain + "'"))
    last = key[-1]
    return df.where(last.isNotNull() & (last != "")).withColumns({"h1": h1, "h2": h2})


def parents(df: DataFrame, domain: str, loaded: str, deleted: str, *key: Column) -> DataFrame:
    """h1, h2, loaded (first load), gone (any row deleted): one row per key, reduced before the shuffle."""
    return _hashed(df, domain, *key).groupBy("h1", "h2").agg(F.min(loaded).alias("loaded"), F.max(F.col(deleted).isNotNull()).alias("gone"))


def references(df: DataFrame, table: str, field: str, row_id: str, loaded: str, domain: str, may_be_late: bool, *key: Column) -> DataFrame:
    """source_table, field, row_id, loaded, strict, h1, h2 of the referring rows, each once."""
    picked = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(loaded).alias("loaded"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
    once = first_delivery(picked, "row_id", "loaded")
    named = once.select(F.lit(table).alias("source_table"), F.lit(field).alias("field"), "row_id", "loaded", F.lit(may_be_late).alias("strict"), *[f"k{i}" for i in range(len(key))])
    return _hashed(named, domain, *[F.col(f"k{i}") for i in range(len(key))]).select("source_table", "field", "row_id", "loaded", "strict", "h1", "h2")


_OUT = pa.schema([("source_table", pa.string()), ("field", pa.string()), ("row_id", pa.int64()), ("kind", pa.string()), ("loaded", pa.timestamp("us", tz="UTC"))])


class _Range:
    """The parents of one range: sorted arrays, probed by binary search."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.h1 = None

    def add(self, h1, h2, loaded, gone) -> None:
        self.parts.append((h1, h2, loaded, gone))
        self.h1 = None

    def build(self) -> None:
        cols = [np.concatenate(c) for c in zip(*self.parts)] if self.parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        order = np.lexsort((cols[1], cols[0]))
        self.h1, self.h2, self.loaded, self.gone = (c[order] for c in cols)
        self.parts = [(self.h1, self.h2, self.loaded, self.gone)]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where there is none."""
        if self.h1 is None:
            self.build()
        at = np.searchsorted(self.h1, h1)
        found = np.full(len(h1), -1, np.int64)
        open_ = np.arange(len(h1))
        while len(open_):
            here = at[open_]
            inside = here < len(self.h1)
            open_, here = open_[inside], here[inside]
            same = self.h1[here] == h1[open_]
            open_, here = open_[same], here[same]
            hit = self.h2[here] == h2[open_]
            found[open_[hit]] = here[hit]
            open_ = open_[~hit]
            at[open_] += 1  # equal first halves: try the next entry
        return found


def _micros(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(a.is_null())
    return a.cast(pa.timestamp("us")).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), null


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut where the range changes."""
    for b in batches:
        spot = b.column("spot").to_numpy()
        ends = [0, *(np.flatnonzero(spot[1:] != spot[:-1]) + 1).tolist(), len(spot)]
        for a, z in zip(ends, ends[1:]):
            if z > a:
                yield b.slice(a, z - a)


def _probe_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range, with its parents (side 0) first; one range is held at a time."""
    held, now = _Range(), None
    never = np.iinfo(np.int64).min
    for b in _by_range(batches):
        here = b.column("spot")[0].as_py()
        if here != now:
            held, now = _Range(), here
        side = b.column("side").to_numpy(zero_copy_only=False)
        h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
        loaded, unknown = _micros(b.column("loaded"))
        flag = b.column("flag").to_numpy(zero_copy_only=False)
        p = side == 0
        if p.any():
            held.add(h1[p], h2[p], np.where(unknown, never, loaded)[p], flag[p])
        r = np.flatnonzero(~p)
        if not len(r):
            continue
        at = held.probe(h1[r], h2[r])
        hit = at >= 0
        kind = np.where(hit, 0, 1).astype(np.int8)
        gone = np.zeros(len(r), bool)
        late = np.zeros(len(r), bool)
        gone[hit] = held.gone[at[hit]]
        late[hit] = (held.loaded[at[hit]] > loaded[r[hit]]) & flag[r[hit]] & ~unknown[r[hit]]
        kind[late] = 3
        kind[gone] = 2
        case = np.flatnonzero(kind > 0)
        rows = pa.array(r[case])
        yield pa.RecordBatch.from_arrays([b.column("source_table").take(rows), b.column("field").take(rows), b.column("row_id").take(rows), pa.array(KINDS, pa.string()).take(pa.array(kind[case])), b.column("loaded").take(rows).cast(_OUT.field("loaded").type)], schema=_OUT)


def orphans(parent_rows: DataFrame, reference_rows: DataFrame, tasks: int, rows: int = 0) -> DataFrame:
    """The broken references: source_table, field, row_id, kind, loaded. ``rows``: about how many rows both have, which
    sets the number of ranges.

    Nulls: rows without a key refer to nothing and are no parents; a parent of unknown load time is never
    late, nor is a reference of unknown load time. Ties (loaded at the same instant) are not late. Empty
    parents make every reference ``missing``. Rows repeated under one id count once.
    """
    top = HOT_SHARE * tasks
    sketch = F.call_function("approx_top_k", F.col("h1"), F.lit(min(2 * top, 500_000)), F.lit(min(2 * TRACKED * top, 1_000_000)))
    share = reference_rows.groupBy().agg(F.count(F.lit(1)).alias("total"), sketch.alias("keys")).select("total", F.explode("keys").alias("k"))
    # the hot keys: HOT_SHARE * tasks of them by construction (and the sketch's errors), so the broadcast is bounded
    hot = share.where((F.col("k.count") * top > F.col("total")) & (F.col("k.count") > HOT_LEAST)).select(F.col("k.item").alias("h1"), F.ceil(F.col("k.count") * top / F.col("total")).cast("int").alias("copies"))
    blank = F.lit(None).cast("string")
    p = parent_rows.join(F.broadcast(hot), "h1", "left").select(F.lit(0).cast("tinyint").alias("side"), "h1", "h2", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("copies"), F.lit(1)) - 1)).alias("copy"), blank.alias("source_table"), blank.alias("field"), F.lit(None).cast("bigint").alias("row_id"), "loaded", F.col("gone").alias("flag"))
    r = reference_rows.join(F.broadcast(hot), "h1", "left").select(F.lit(1).cast("tinyint").alias("side"), "h1", "h2", F.pmod(F.xxhash64("row_id"), F.coalesce(F.col("copies"), F.lit(1))).cast("int").alias("copy"), "source_table", "field", "row_id", "loaded", F.col("strict").alias("flag"))
    # range of the key: its leading bits; copies of a hot key go to other ranges
    ranges = max(tasks * RANGES_PER_TASK, rows // RANGE_ROWS)
    width = float(2**64) / ranges
    spot = F.floor((F.col("h1").cast("double") + F.lit(2.0**63)) / F.lit(width)).cast("int")
    spot = F.pmod(F.least(spot, F.lit(ranges - 1)) + F.col("copy"), F.lit(ranges)).cast("int")
    # ranges in turn over the tasks; a task's ranges one behind the other
    tasks = max(tasks, ranges // (8 * RANGES_PER_TASK))
    both = p.unionByName(r).withColumn("spot", spot).repartitionById(tasks, F.pmod(F.col("spot"), F.lit(tasks))).sortWithinPartitions("spot", "side")
    return both.select("side", "h1", "h2", "source_table", "field", "row_id", "loaded", "flag", "spot").mapInArrow(_probe_task, "source_table string, field string, row_id bigint, kind string, loaded timestamp")


def broken_references(annotations: DataFrame, tracking_files: DataFrame, prepared_samples: DataFrame, tasks: int) -> DataFrame:
    """source_table, field, row_id, kind, period of this project's broken references.

    Texts compare exactly after trimming white space (and one prefix of paths); annotation ids refer within
    their video_key. Deleted rows refer too."""
    def ann(c: str) -> tuple[Column, Column]:
        return trimmed("video_key"), trimmed(c)

    p = parents(annotations, "annotation", "loaded_at", "deleted_at", *ann("annotation_id"))
    p = p.unionByName(parents(tracking_files, "path", "loaded_at", "deleted_at", tidy_path("tracking_path")))
    r = references(annotations, "annotations", "upstream_annotation_id", "row_id", "loaded_at", "annotation", True, *ann("upstream_annotation_id"))
    r = r.unionByName(references(annotations, "annotations", "tracking_bboxes", "row_id", "loaded_at", "path", True, tidy_path("tracking_bboxes")))
    r = r.unionByName(references(prepared_samples, "prepared_samples", "annotation_id", "record_id", "written_at", "annotation", True, *ann("annotation_id")))
    r = r.unionByName(references(tracking_files, "tracking_files", "annotation_id", "file_id", "loaded_at", "annotation", False, *ann("annotation_id")))
    # row counts come from the files' footers
    found = orphans(p, r, tasks, 3 * annotations.count() + 2 * tracking_files.count() + prepared_samples.count())
    return found.select("source_table", "field", "row_id", "kind", utc_month("loaded").alias("period"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Broken references per table, field, kind and month."""
    return found.groupBy("source_table", "field", "kind", "period").agg(F.count(F.lit(1)).alias("n_rows"))
