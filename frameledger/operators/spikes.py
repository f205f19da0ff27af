"""Implausible readings: physical limits, stuck runs and spikes, judged per source.

Tracking rows: a robust autoregression per source (tracker) and box side gives its forecast and its normal
movement. Jumps beyond that movement cut a track into stretches; additive-outlier tests (a stretch leaves the
forecast and the course on both sides, and the course comes back) run until none is found, then the jumps that no
patch explains and behind which the course lasts pass as level shifts and are subtracted, and the tests run again.
Scoreboard boxes: robust centre and spread per event.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.session import spread_join

SIDES = ["box_left", "box_top", "box_width", "box_height"]
PHIS = np.array([0.0, 0.25, 0.5, 0.75, 1.0])
#: A spike's least distance from the course in units of the source's normal movement.
SPIKE_UNITS = 2.75
#: Rows over which a forecast goes on; farther ahead it stays.
HORIZON = 4
#: A jump is a level shift if so many rows stand on both sides of it.
SHIFT_ROWS = 8
#: A stretch is stuck from so many times the source's usual hold, and from so many rows, on.
STUCK_TIMES, STUCK_LEAST = 4, 5
#: Rows of one track are handled in blocks of so many frames with a margin on both sides, so that a track
#: of any length is spread over tasks; the margin exceeds every window used below.
BLOCK_FRAMES, MARGIN_FRAMES = 500_000, 25_000
#: Sources up to this number have their statistics shipped with the tasks (a few hundred bytes each);
#: beyond it they are joined to the rows.
SHIPPED_SOURCES, SOURCE_COPIES = 20_000, 32
#: Eighths of octaves: bin k of a histogram holds magnitudes around 2**((k - 80) / 8). Holds are counted exactly up
#: to EXACT rows, beyond in eighths of octaves (up to eight million rows).
BINS, EXACT = 256, 128


def impossible_box(left, top, width, height):
    """Column: a value given is not finite, a size is not within (0, 1000], or the box lies outside 0..1000."""
    def off(c):
        return F.isnan(c) | (F.abs(c) == float("inf"))

    tests = [off(c) for c in (left, top, width, height)]
    tests += [width <= 0, width > 1000, height <= 0, height > 1000, left >= 1000, top >= 1000, left + width <= 0, top + height <= 0]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _impossible(x: np.ndarray) -> np.ndarray:
    """The same test on an array of four columns, in which nulls are marked by a second array."""
    with np.errstate(invalid="ignore"):
        l, t, w, h = x.T
        return (w <= 0) | (w > 1000) | (h <= 0) | (h > 1000) | (l >= 1000) | (t >= 1000) | (l + w <= 0) | (t + h <= 0)


class Tracks:
    """Whole tracks as arrays: rows sorted by track and frame, each row id once."""

    def __init__(self, t: pa.Table):
        path = t.column("tracking_path").combine_chunks().dictionary_encode().indices
        self.path = path.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.block = t.column("block").to_numpy()
        rid = t.column("row_id").to_numpy()
        new = np.ones(len(rid), bool)
        new[1:] = (self.path[1:] != self.path[:-1]) | (self.block[1:] != self.block[:-1])
        once = new.copy()
        once[1:] |= rid[1:] != rid[:-1]
        new |= once & (self.block < 0)  # no place in a track: a row by itself
        self.take = np.flatnonzero(once)
        self.row_id, self.own = rid[once], t.column("own").to_numpy(zero_copy_only=False)[once]
        self.group = (np.cumsum(new) - 1)[once]
        source = t.column("tracker_id").combine_chunks().dictionary_encode()
        if isinstance(source, pa.ChunkedArray):
            source = source.combine_chunks()
        self.sources = source.dictionary.to_pylist() + [None]
        self.source = source.indices.fill_null(len(self.sources) - 1).to_numpy(zero_copy_only=False)[once]
        cols = [t.column(c).combine_chunks() for c in SIDES]
        null = np.stack([np.asarray(c.is_null()) for c in cols], 1)[once]
        x = np.stack([c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in cols], 1)[once]
        self.bad = (~np.isfinite(x) & ~null).any(1) | _impossible(x)
        x[self.bad] = np.nan
        self.x = x

    def side(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions with a usable value of side k, and the values."""
        at = np.flatnonzero(np.isfinite(self.x[:, k]))
        return at, self.x[at, k]

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each usable row: its run of equal left and top, and whether it repeats the row before."""
        at = np.flatnonzero(np.isfinite(self.x[:, 0]) & np.isfinite(self.x[:, 1]))
        same = np.zeros(len(at), bool)
        if len(at):
            same[1:] = (self.x[at[1:], 0] == self.x[at[:-1], 0]) & (self.x[at[1:], 1] == self.x[at[:-1], 1]) & (self.group[at[1:]] == self.group[at[:-1]])
        return at, same


def _movement(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows at which the value changes within its track, the change, and the change before (else nan)."""
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(fresh)
    d = np.full(len(at), np.nan)
    d[1:] = np.where(group[at[1:]] == group[at[:-1]], x[at[1:]] - x[at[:-1]], np.nan)
    before = np.full(len(at), np.nan)
    before[1:] = np.where(group[at[1:]] == group[at[:-1]], d[:-1], np.nan)
    return at, d, before


def _counts(t: Tracks) -> dict[tuple[int, int, int], np.ndarray]:
    """Histograms by (source, side, kind): kinds 0..4 residuals for each phi, 5 movement; side 4: holds."""
    out: dict[tuple[int, int, int], np.ndarray] = {}
    n = len(t.sources)

    def add(side: int, kind: int, source: np.ndarray, bins: np.ndarray) -> None:
        flat = np.bincount(source * BINS + np.clip(bins, 0, BINS - 1), minlength=n * BINS).reshape(n, BINS)
        for s in np.flatnonzero(flat.any(1)):
            out[int(s), side, kind] = flat[s]

    def log_bin(v: np.ndarray) -> np.ndarray:
        return np.round(8 * np.log2(np.maximum(np.abs(v), 2.0**-10))).astype(np.int64) + 80

    owned = t.own
    for k in range(4):
        at, x = t.side(k)
        pos, d, before = _movement(x, t.group[at])
        use = owned[at[pos]]
        ok = np.isfinite(d) & use
        add(k, 5, t.source[at[pos[ok]]], log_bin(d[ok]))
        ok &= np.isfinite(before)
        for j, phi in enumerate(PHIS):
            add(k, j, t.source[at[pos[ok]]], log_bin(d[ok] - phi * before[ok]))
    at, same = t.repeats()
    if len(at):
        run = np.cumsum(~same) - 1
        head = np.flatnonzero(~same)
        length = np.bincount(run, weights=same).astype(np.int64)
        use = owned[at[head]]
        add(4, 6, t.source[at[head[use]]], hold_bin(length[use]))
    return out


def hold_bin(length: np.ndarray) -> np.ndarray:
    return np.where(length < EXACT, length, EXACT + np.ceil(8 * np.log2(np.maximum(length, EXACT) / EXACT)).astype(np.int64))


def _hold(b: int) -> int:
    """The longest hold of a bin."""
    return b if b < EXACT else int(EXACT * 2 ** ((b - EXACT) / 8))


def _quantile(h: np.ndarray, q: float) -> int:
    return int(np.searchsorted(np.cumsum(h), q * h.sum(), side="left"))


def _fit(hist: dict[tuple[int, int], np.ndarray]) -> tuple[list[float], list[float], int]:
    """phi and normal movement of each side, and the usual hold, of one source.

    phi is the candidate with the least median residual (least median of squares: half of the rows may be
    outliers). The normal movement is the largest of the 95 % quantile of the changes and six times the
    median residual's quarter, so neither a still nor a steadily moving source gets a vanishing scale.
    """
    phis, units = [], []
    for k in range(4):
        med = [_quantile(hist[k, j], 0.5) if (k, j) in hist else BINS for j in range(len(PHIS))]
        best = int(np.argmin(med))
        residual = 2.0 ** ((med[best] - 80) / 8) if med[best] < BINS else 0.0
        moved = 2.0 ** ((_quantile(hist[k, 5], 0.95) - 80) / 8) if (k, 5) in hist else 0.0
        phis.append(float(PHIS[best]))
        units.append(max(moved, 1.5 * residual))
    hold = _hold(_quantile(hist[4, 6], 0.98)) if (4, 6) in hist else 0
    return phis, units, hold


def _stretches(v: np.ndarray, g: np.ndarray, u: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the stretches that no jump (of ``scale`` times the least size) cuts, and whether a stretch is the
    first of its track."""
    new = np.ones(len(v), bool)
    new[1:] = g[1:] != g[:-1]
    cut = new.copy()
    cut[1:] |= np.abs(v[1:] - v[:-1]) > scale * SPIKE_UNITS * np.maximum(u[1:], 1e-9)
    start = np.flatnonzero(cut)
    return start, new[start]


def _centres(v: np.ndarray, g: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running median around each stretch: of its rows and, on both sides, twice as many (7 at least) of its track.
    Stretches of like length are handled together."""
    out = np.full(len(start), np.nan)
    size = end - start
    span = np.maximum(7, 1 << np.ceil(np.log2(2 * size)).astype(np.int64))  # 7, 8, 16, 32 ...
    for half in np.unique(span):
        of = np.flatnonzero(span == half)
        width = 2 * int(half) + int(size[of].max())
        step = max(1, 500_000 // width)
        for k in range(0, len(of), step):
            some = of[k : k + step]
            at = start[some, None] - half + np.arange(width)
            inside = (at >= 0) & (at < np.minimum(end[some, None] + half, len(v)))
            at = np.where(inside, at, 0)
            inside &= g[at] == g[start[some], None]
            out[some] = np.nanmedian(np.where(inside, v[at], np.nan), axis=1)
    return out


def _drift(v: np.ndarray, g: np.ndarray, u: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The course's last change before row i, within twice the normal movement."""
    d = np.where((i >= 2) & (g[np.maximum(i - 2, 0)] == g[i]), v[i - 1] - v[np.maximum(i - 2, 0)], 0.0)
    return np.clip(d, -2 * u[i], 2 * u[i])


def _patches(v: np.ndarray, g: np.ndarray, u: np.ndarray, ph: np.ndarray, scale: float) -> np.ndarray | None:
    """Mask of the rows of one round's additive patches; None if no jump has the scale.

    A patch is a stretch between two jumps, of fewer rows than the stretches beside it together. All its rows lie
    beyond the hull of the row before, the row after and the autoregressive forecast by SPIKE_UNITS of normal
    movement, on one side, and farther from the running median than both anchors. Of neighbours the farthest
    (of equals the first) is taken; the other is tested again in the next round."""
    hit = np.zeros(len(v), bool)
    start, first = _stretches(v, g, u, scale)
    if first.all():
        return None
    end = np.append(start[1:], len(v))
    size = end - start
    k = np.arange(1, len(start) - 1)
    k = k[~first[k] & ~first[k + 1]] if len(k) else k
    k = k[size[k] < size[k - 1] + size[k + 1]]
    if not len(k):
        return hit
    i, z = start[k], end[k]
    a, b = v[i - 1], v[z]
    side = np.sign(v[i] - a)
    least = np.full(len(k), np.inf)
    drift = _drift(v, g, u, i)
    ahead = a.copy()
    for j in range(HORIZON + 1):
        drift = ph[i] * drift
        ahead = ahead + drift
        low, high = np.minimum(np.minimum(a, b), ahead), np.maximum(np.maximum(a, b), ahead)
        if j < HORIZON:
            live, w = size[k] > j, v[np.minimum(i + j, z - 1)]
        else:  # all later rows against the forecast as it stays
            live = size[k] > j
            w = np.where(side > 0, np.minimum.reduceat(v, start)[k], np.maximum.reduceat(v, start)[k])
        least = np.where(live, np.minimum(least, np.where(side > 0, w - high, low - w)), least)
    score = least / np.maximum(u[i], 1e-9)
    ok = score > SPIKE_UNITS
    k, i, z, a, b, side, score = (c[ok] for c in (k, i, z, a, b, side, score))
    if not len(k):
        return hit
    centre = _centres(v, g, i, z)
    near = np.where(side > 0, np.minimum.reduceat(v, start)[k], np.maximum.reduceat(v, start)[k])
    far = np.abs(near - centre) > np.maximum(np.abs(a - centre), np.abs(b - centre))
    points = np.zeros(len(start))
    points[k[far]] = score[far]
    win = k[far][(points[k[far]] > points[k[far] - 1]) & (points[k[far]] >= points[k[far] + 1])]
    return np.repeat(np.isin(np.arange(len(start)), win), size)


def additive_outliers(x: np.ndarray, group: np.ndarray, phi: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Mask of rows in patches that leave the course of their track and come back, of whatever length.

    Rows found leave the series and the rest is tested again, until nothing is found; then level shifts (jumps
    that no patch explains, with SHIFT_ROWS rows on both sides) are subtracted from all that follows, and the
    tests begin again. It ends when neither is left. A change that the end of the track cuts off does not come back,
    so it is no case (nor are rows before a track's first jump: what precedes them is not known)."""
    found = np.zeros(len(x), bool)
    if not len(x):
        return found
    start, first = _stretches(x, group, unit)
    at = np.flatnonzero(np.isin(group, np.unique(group[start[~first]])))  # tracks with a jump
    y, shifted = x.copy(), np.zeros(len(x), bool)
    while len(at):
        v, g, u, ph = y[at], group[at], unit[at], phi[at]
        hit, scale = _patches(v, g, u, ph, 1.0), 1.0
        while hit is not None and not hit.any():  # a patch may jump in itself: larger jumps alone
            scale *= 2
            hit = _patches(v, g, u, ph, scale)
        if hit is not None:
            found[at[hit]] = True
            at = at[~hit]
            continue
        start, first = _stretches(v, g, u)
        size = np.diff(np.append(start, len(v)))
        k = np.flatnonzero(~first)
        k = k[(np.minimum(size[k], size[k - 1]) >= SHIFT_ROWS) & ~shifted[at[start[k]]]]
        if not len(k):
            break
        i = start[k]
        shifted[at[i]] = True
        step = np.zeros(len(v))
        step[i] = v[i] - v[i - 1] - ph[i] * _drift(v, g, u, i)
        total = np.cumsum(step)
        head = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        base = np.where(head > 0, total[head - 1], 0.0)
        y[at] = v - (total - np.repeat(base, np.diff(np.append(head, len(v)))))
        at = at[np.isin(g, np.unique(g[start[~first]]))]
    return found


def flag_tracks(t: Tracks, fits: dict) -> np.ndarray:
    """Kind of every row: 0 none, 1 impossible, 2 stuck, 3 spike (a row has one, the first that holds)."""
    empty = ([0.0] * 4, [np.inf] * 4, 1 << 30)
    per = [fits.get(s, empty) for s in t.sources]
    kind = np.zeros(len(t.row_id), np.int8)
    for k in range(4):
        phi, unit = np.array([p[0][k] for p in per]), np.array([p[1][k] for p in per])
        at, x = t.side(k)
        s = t.source[at]
        kind[at[additive_outliers(x, t.group[at], phi[s], unit[s])]] = 3
    at, same = t.repeats()
    if len(at):
        run = np.cumsum(~same) - 1
        rows = np.bincount(run)[run]
        hold = np.array([p[2] for p in per], np.int64)[t.source[at]]
        kind[at[same & (rows >= np.maximum(STUCK_LEAST, STUCK_TIMES * (hold + 1)))]] = 2
    kind[t.bad] = 1
    return kind


def _by_track(rows: DataFrame) -> DataFrame:
    """Rows laid out by track and block (each with its margin). Rows without a track or frame have
    no course; each stands by itself, spread by its id (negative blocks)."""
    f = F.col("frame_original")
    cut = [F.greatest(F.floor((f + m) / BLOCK_FRAMES), F.lit(0)) for m in (-MARGIN_FRAMES, 0, MARGIN_FRAMES)]
    cols = [F.col(c).cast("double").alias(c) for c in SIDES]
    alone = F.col("tracking_path").isNull() | f.isNull()
    laid = rows.select("row_id", "tracking_path", "tracker_id", f.cast("bigint").alias("frame_original"), *cols)
    laid = laid.withColumn("block", F.explode(F.when(alone, F.array(-1 - F.pmod(F.xxhash64("row_id"), F.lit(1 << 20)))).otherwise(F.array_distinct(F.array(*cut)))))
    laid = laid.withColumn("own", alone | (F.col("block") == cut[1]))
    return laid.repartition("tracking_path", "block")


def _in_order(laid: DataFrame) -> DataFrame:
    return laid.sortWithinPartitions("tracking_path", "block", "frame_original", "row_id")


def _whole_groups(batches: Iterator[pa.RecordBatch], target: int = 100_000) -> Iterator[Tracks]:
    """Cuts the stream of sorted rows into tables of whole (track, block) groups."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < target:
            continue
        t = pa.Table.from_batches(held)
        path, block = t.column("tracking_path"), t.column("block")
        last_path, last_block = path[-1].as_py(), block[-1].as_py()
        same = pc.and_(pc.is_null(path) if last_path is None else pc.fill_null(pc.equal(path, last_path), False), pc.equal(block, last_block))
        cut = len(t) - pc.sum(same).as_py()
        if cut:
            yield Tracks(t.slice(0, cut).combine_chunks())
            held = t.slice(cut).combine_chunks().to_batches()
            size = len(t) - cut
    if held:
        yield Tracks(pa.Table.from_batches(held).combine_chunks())


def source_histograms(laid: DataFrame) -> DataFrame:
    """tracker_id, side, kind, bin, n: additive over partitions, a few thousand rows per task."""
    schema = pa.schema([("tracker_id", pa.string()), ("side", pa.int32()), ("kind", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            cols: list[list] = [[], [], [], [], []]
            for (s, side, kind), h in _counts(t).items():
                at = np.flatnonzero(h)
                for c, v in zip(cols, ([t.sources[s]] * len(at), [side] * len(at), [kind] * len(at), at.tolist(), h[at].tolist())):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    counts = _in_order(laid).mapInArrow(run, "tracker_id string, side int, kind int, bin int, n bigint")
    return counts.groupBy("tracker_id", "side", "kind", "bin").agg(F.sum("n").alias("n"))


def _dense(rows) -> dict[tuple[int, int], np.ndarray]:
    hist: dict[tuple[int, int], np.ndarray] = {}
    for r in rows:
        hist.setdefault((r["side"], r["kind"]), np.zeros(BINS))[r["bin"]] += r["n"]
    return hist


def _fits(hist: DataFrame) -> DataFrame:
    """``tracker_id, fit``: nine numbers a source (phi and normal movement by side, usual hold), made where the
    histograms are."""
    packed = hist.groupBy("tracker_id").agg(F.collect_list(F.struct("side", "kind", "bin", "n")).alias("h"))  # bounded: 26 histograms
    schema = pa.schema([("tracker_id", pa.string()), ("fit", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                phi, unit, hold = _fit(_dense(r["h"]))
                yield pa.RecordBatch.from_pylist([{"tracker_id": r["tracker_id"], "fit": [*phi, *unit, float(hold)]}], schema=schema)

    return packed.mapInArrow(run, "tracker_id string, fit array<double>")


def flag_tracking_rows(rows: DataFrame) -> DataFrame:
    """``row_id, kind`` of the flagged tracking rows.

    The rows are shuffled once: the histograms and the tests read the same exchange. Nulls: a null side is no
    reading (never impossible) and is skipped; rows without a track or frame have no course, so only physical
    limits apply to them; a null tracker is a source of its own. A row delivered twice counts once. Ties in
    frame keep row_id order. An empty table gives an empty result; further columns are not read.
    """
    laid = _by_track(rows)
    fits = _fits(source_histograms(laid)).withColumnRenamed("tracker_id", "source")
    few = rows.select("tracker_id").distinct().limit(SHIPPED_SOURCES + 1).count() <= SHIPPED_SOURCES  # reads one column
    if few:
        known = laid.join(F.broadcast(fits), F.col("tracker_id").eqNullSafe(F.col("source")), "left").drop("source")
    else:
        # too many sources to ship: their numbers are joined, each source's in so many copies that a hot one is spread
        part = F.pmod(F.xxhash64("row_id"), F.lit(SOURCE_COPIES)).cast("int")
        copies = fits.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SOURCE_COPIES - 1))))
        known = laid.withColumn("spread", part).join(copies, F.col("tracker_id").eqNullSafe(F.col("source")) & (F.col("spread") == F.col("part")), "left").drop("source", "part", "spread")
        known = known.repartition("tracking_path", "block")
    schema = pa.schema([("row_id", pa.int64()), ("kind", pa.string())])
    names = pa.array([None, "impossible", "stuck", "spike"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def strip() -> Iterator[pa.RecordBatch]:
            for b in batches:
                source = b.column("tracker_id").dictionary_encode()
                codes = source.indices.fill_null(len(source.dictionary)).to_numpy(zero_copy_only=False)
                for code, at in zip(*np.unique(codes, return_index=True)):
                    f = b.column("fit")[int(at)].as_py()
                    if f:
                        known[source.dictionary[int(code)].as_py() if code < len(source.dictionary) else None] = (f[:4], f[4:8], int(f[8]))
                yield b.select(["row_id", "tracking_path", "tracker_id", *SIDES, "block", "own"])

        for t in _whole_groups(strip()):
            kind = flag_tracks(t, known)
            hit = (kind > 0) & t.own
            yield pa.RecordBatch.from_arrays([pa.array(t.row_id[hit]), names.take(pa.array(kind[hit]))], schema=schema)

    return _in_order(known).mapInArrow(run, "row_id bigint, kind string")  # a join drops the order below it


#: Boxes of an event whose side differs from the event's median by more than so many median deviations
#: (of at least LEAST_SPREAD units) are spikes.
BOARD_DEVIATIONS, LEAST_SPREAD = 8.0, 1.0


def annotation_boxes(annotations: DataFrame) -> DataFrame:
    """``row_id, event, task_l2, boxes`` of the rows with a bounding_box; ``boxes`` holds one or two arrays of
    four numbers (texts that spell numbers count as numbers), null where the JSON has another shape."""
    text = F.col("bounding_box")
    corners = F.from_json(text, "array<string>")
    objects = F.from_json(text, "array<struct<label:string,box:array<string>>>")
    number = lambda b: F.transform(b, lambda v: v.try_cast("double"))
    is_objects = text.rlike(r"^\s*\[\s*\{")
    boxes = F.when(is_objects, F.transform(objects, lambda o: number(o["box"]))).otherwise(F.array(number(corners)))
    event = F.regexp_extract("video_key", r"^\s*(.*)/[^/]*$", 1)
    return annotations.where(text.isNotNull() & (F.trim(text) != "")).select("row_id", "loaded_at", event.alias("event"), "task_l2", boxes.alias("boxes"))


def flag_annotation_boxes(annotations: DataFrame) -> DataFrame:
    """``row_id, kind`` of the flagged bounding boxes: ``impossible`` on any task, ``spike`` on
    Scoreboard_Single against the usual scoreboard of its event.

    Nulls: no bounding_box, no reading; a null, non-finite or unreadable value inside one is impossible.
    Repeated deliveries count once. The event's medians come from mergeable quantile summaries, so an event
    with a third of all rows is reduced before the shuffle.
    """
    boxes = annotation_boxes(annotations)

    def bad(b):
        x1, y1, x2, y2 = (F.get(b, F.lit(i)) for i in range(4))
        return F.coalesce(F.size(b) != 4, F.lit(True)) | F.exists(b, lambda v: v.isNull()) | impossible_box(x1, y1, x2 - x1, y2 - y1)

    whole = F.coalesce(F.size("boxes"), F.lit(0))
    once = boxes.withColumn("bad", (whole < 1) | F.coalesce(F.exists("boxes", lambda b: bad(b)), F.lit(True)))
    once = once.groupBy("row_id").agg(F.min_by(F.struct("event", "task_l2", "boxes", "bad"), F.struct(F.col("loaded_at").isNull(), "loaded_at")).alias("r")).select("row_id", "r.*")
    sides = [F.col("boxes")[0][0].alias("s0"), F.col("boxes")[0][1].alias("s1"), (F.col("boxes")[0][2] - F.col("boxes")[0][0]).alias("s2"), (F.col("boxes")[0][3] - F.col("boxes")[0][1]).alias("s3")]
    board = once.where(~F.col("bad") & (F.trim("task_l2") == "Scoreboard_Single")).select("row_id", "event", *sides)
    centre = board.groupBy("event").agg(*[F.percentile_approx(f"s{k}", 0.5, 10_000).alias(f"c{k}") for k in range(4)])
    near = spread_join(board, centre, ["event"], "row_id")
    spread = near.groupBy("event").agg(*[F.percentile_approx(F.abs(F.col(f"s{k}") - F.col(f"c{k}")), 0.5, 10_000).alias(f"d{k}") for k in range(4)], *[F.first(f"c{k}").alias(f"c{k}") for k in range(4)])
    far = F.lit(False)
    for k in range(4):
        far = far | (F.abs(F.col(f"s{k}") - F.col(f"c{k}")) > BOARD_DEVIATIONS * F.greatest(f"d{k}", F.lit(LEAST_SPREAD)))
    spikes = spread_join(board, spread, ["event"], "row_id").where(far).select("row_id", F.lit("spike").alias("kind"))
    return once.where("bad").select("row_id", F.lit("impossible").alias("kind")).unionByName(spikes)


def implausible_readings(tracking_rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """``source_table, row_id, kind`` over both tables."""
    a = flag_tracking_rows(tracking_rows).select(F.lit("tracking_rows").alias("source_table"), "row_id", "kind")
    b = flag_annotation_boxes(annotations).select(F.lit("annotations").alias("source_table"), "row_id", "kind")
    return a.unionByName(b)
