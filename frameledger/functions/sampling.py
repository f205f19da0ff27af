"""Frame sampling protocols and projection between original and sampled frames, as Column expressions."""
from __future__ import annotations

import importlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from frameledger.functions.geometry import clip_index
from frameledger.schemas import FRAME_BUDGET, GROUNDING_MARGIN, SHORT_STRIDE, SHORT_WINDOW, TASKS, VIDEO_FPS


#: Budgets up to this one are spelt out as Column expressions; larger ones go to the workers' arrays.
SPELT = 16


def _uniform_arrays(budget: int):
    """Frames of whole batches at once; a list per row, without repeats."""

    @F.pandas_udf(ArrayType(LongType()))
    def spread(start: pd.Series, end: pd.Series) -> pd.Series:
        s, e = start.to_numpy(np.float64, na_value=np.nan), end.to_numpy(np.float64, na_value=np.nan)
        known = np.isfinite(s) & np.isfinite(e)
        s, e = np.where(known, s, 0), np.where(known, e, 0)
        f = np.rint(s[:, None] + np.arange(budget) / (budget - 1) * (e - s)[:, None]).astype(np.int64)
        new = np.ones(f.shape, bool)
        new[:, 1:] = f[:, 1:] != f[:, :-1]
        parts = np.split(f[new], np.cumsum(new.sum(1))[:-1])
        return pd.Series([p if k else None for p, k in zip(parts, known)], dtype=object)

    return spread


def uniform(start: Column, end: Column, budget: int) -> Column:
    """``budget`` frames spread over the closed interval, rounded half to even, without repeats."""
    if budget <= 1:
        return F.array(start)
    if budget > SPELT:
        return _uniform_arrays(budget)(start.cast("bigint"), end.cast("bigint"))
    shares = F.array(*[F.lit(k / (budget - 1)) for k in range(budget)])  # a constant, folded once
    many = F.array_distinct(F.transform(shares, lambda k: F.rint(start + k * (end - start)).cast("bigint")))
    return F.when(start.isNotNull() & end.isNotNull(), many)


def _clipped(a: Column, b: Column, total: Column) -> tuple[Column, Column]:
    x, y = clip_index(a, total), clip_index(b, total)
    return F.least(x, y), F.greatest(x, y)


def backwards(end: Column) -> Column:
    """Every fifth frame of the last 320 up to ``end``, ascending."""
    return F.reverse(F.sequence(end, F.greatest(F.lit(0).cast("bigint"), end - (SHORT_WINDOW - 1)), F.lit(-SHORT_STRIDE).cast("bigint")))


_INPUT = {t[0]: t[1] for t in TASKS}
SINGLE = [t for t, k in _INPUT.items() if k == "frame"]
GROUND = [t for t, k in _INPUT.items() if k == "grounding"]


def _short_or_uniform(s: Column, e: Column, budget: int) -> Column:
    return F.when(s.isNotNull() & (e - s + 1 <= SHORT_WINDOW), backwards(e)).when(s.isNotNull(), uniform(s, e, budget))


class Protocol:
    """A sampling protocol: an id and the sampled frames as a Column. Subclass and register to extend."""

    protocol_id = ""
    description = ""

    def frames(self, task: Column, timestamp: Column, q: tuple[Column, Column], a: tuple[Column, Column], total: Column) -> Column:
        raise NotImplementedError

    def supports(self, task: Column) -> Column:
        return F.lit(True)

    def manifest(self) -> dict:
        return {"protocol_id": self.protocol_id, "description": self.description}


class Main(Protocol):
    protocol_id, description = "main", "fixed budget of frames; short windows densely, backwards from their end"

    def frames(self, task, timestamp, q, a, total):
        gs, ge = _clipped(a[0] - GROUNDING_MARGIN, a[1] + GROUNDING_MARGIN, total)
        qs, qe = _clipped(q[0], q[1], total)
        return F.when(task.isin(SINGLE), F.when(timestamp.isNotNull(), F.array(timestamp))).when(task.isin(GROUND), F.when(gs.isNotNull(), uniform(gs, ge, FRAME_BUDGET))).otherwise(_short_or_uniform(qs, qe, FRAME_BUDGET))

    def manifest(self):
        return super().manifest() | {"frame_budget": FRAME_BUDGET, "sampling": "main_fixed_budget"}


class Uniform8(Protocol):
    protocol_id, description = "uniform8", "eight frames, evenly spread"

    def frames(self, task, timestamp, q, a, total):
        gs, ge = _clipped(a[0], a[1], total)
        qs, qe = _clipped(q[0], q[1], total)
        return F.when(task.isin(SINGLE), F.when(timestamp.isNotNull(), F.array(timestamp))).when(task.isin(GROUND), F.when(gs.isNotNull(), uniform(gs, ge, 8))).otherwise(F.when(qs.isNotNull(), uniform(qs, qe, 8)))

    def manifest(self):
        return super().manifest() | {"frame_budget": 8, "sampling": "uniform"}


PROTOCOLS: dict[str, Protocol] = {p.protocol_id: p for p in (Main(), Uniform8())}


def resolve(spec: str, kind: type = Protocol, known: dict | None = None):
    """A registered name, or ``module:Class`` of the given kind."""
    known = PROTOCOLS if known is None else known
    if spec in known:
        return known[spec]
    if ":" not in spec:
        raise ValueError(f"{spec!r} is neither registered nor of the form module:Class")
    module, name = spec.split(":", 1)
    found = getattr(importlib.import_module(module), name)()
    if not isinstance(found, kind):
        raise TypeError(f"{spec} is no {kind.__name__}")
    if kind is Protocol and not found.protocol_id:
        raise ValueError(f"{spec} has an empty protocol id")
    return found


def project(start: Column, end: Column, frames: Column) -> Column:
    """The closed original interval in positions of the (ascending) sampled frames: first and last position
    inside it; if none is, where its ends would be inserted, clamped and in order. Null for no frames."""
    n = F.size(frames)
    before = lambda x: F.size(F.filter(frames, lambda f: f < x))
    lo = before(start)
    upto = F.size(F.filter(frames, lambda f: f <= end))
    inside = upto > lo
    ins_e = F.least(before(end), n - 1)
    ins_s = F.least(lo, n - 1)
    first = F.when(inside, lo).otherwise(F.least(ins_s, ins_e))
    last = F.when(inside, upto - 1).otherwise(F.greatest(ins_s, ins_e))
    return F.when(start.isNotNull() & end.isNotNull() & (n > 0), F.struct(first.cast("bigint").alias("start"), last.cast("bigint").alias("end")))


def position_map(frames: Column) -> Column:
    """sampled position -> original frame."""
    return F.map_from_arrays(F.transform(frames, lambda f, i: i), frames)


def sampled_fps(frames: Column) -> Column:
    """Rate of the sampled video; null for at most one frame."""
    span = F.greatest(F.element_at(frames, -1) - F.get(frames, F.lit(0)), F.lit(1).cast("bigint"))
    return F.when(F.size(frames) > 1, (F.size(frames) - 1) * F.lit(VIDEO_FPS) / span)


FrameColumn = Callable[..., Column]
