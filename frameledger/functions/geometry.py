"""Boxes and intervals as Column expressions (no Python in the workers)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from frameledger.schemas import COORDINATE_MAX


def _at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def box_iou_sides(p: list[Column], g: list[Column]) -> Column:
    """IoU of two corner boxes given as four columns each. Negative extents have no area; an empty union
    gives 0; a null side gives null."""
    zero = F.lit(0.0)

    def extent(low, high):
        return F.greatest(high - low, zero)

    # each side is used as seldom as can be: the expression tree is what is compiled
    inter = extent(F.greatest(p[0], g[0]), F.least(p[2], g[2])) * extent(F.greatest(p[1], g[1]), F.least(p[3], g[3]))
    union = extent(p[0], p[2]) * extent(p[1], p[3]) + extent(g[0], g[2]) * extent(g[1], g[3]) - inter
    known = sum(p[1:] + g, p[0]).isNotNull()
    return F.when(known, F.coalesce(F.try_divide(inter, union), zero))


def box_iou(p: Column, g: Column) -> Column:
    """IoU of two corner boxes as arrays; a missing or short box gives 0."""
    return F.coalesce(box_iou_sides([_at(p, i) for i in range(4)], [_at(g, i) for i in range(4)]), F.lit(0.0))


def mot_to_corner(b: Column) -> Column:
    return F.array(_at(b, 0), _at(b, 1), _at(b, 0) + _at(b, 2), _at(b, 1) + _at(b, 3))


def temporal_iou(ps: Column, pe: Column, gs: Column, ge: Column) -> Column:
    """IoU of two closed frame intervals; reversed intervals are not repaired, an empty union gives 0."""
    inter = F.greatest(F.lit(0).cast("bigint"), F.least(pe, ge) - F.greatest(ps, gs) + 1)
    union = (pe - ps + 1) + (ge - gs + 1) - inter
    known = ps.isNotNull() & pe.isNotNull() & gs.isNotNull() & ge.isNotNull()
    return F.when(known, F.when(union > 0, inter / F.when(union > 0, union)).otherwise(0.0))


def canonical(a: Column, b: Column) -> Column:
    """The interval with its ends in order."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end")))


def parse_interval(text: Column) -> Column:
    """"a-b", cut at the first dash (so negative ends fail and give null), ends in order."""
    parts = F.split(text, "-", 2)
    whole = lambda c: F.trim(c).try_cast("bigint")
    return canonical(whole(_at(parts, 0)), whole(_at(parts, 1)))


def clip_index(i: Column, total: Column) -> Column:
    """The index within 0..total-1; null stays null."""
    return F.when(i.isNotNull() & total.isNotNull(), F.least(F.greatest(i, F.lit(0).cast("bigint")), total - 1))


def normalize_box(b: Column, width: Column, height: Column) -> Column:
    """Pixels to 0..1000; null where the frame has no positive size."""
    scaled = [_at(b, i) * COORDINATE_MAX / F.when((d := (width if i % 2 == 0 else height)) > 0, d) for i in range(4)]
    return F.when((width > 0) & (height > 0) & (F.size(b) == 4), F.array(*scaled))


def denormalize_to_pixels(b: Column, width: Column, height: Column) -> Column:
    """A normalized left-top-width-height box as pixel corners, rounded half to even and kept in the frame."""
    ends = [(_at(b, 0), width), (_at(b, 1), height), (_at(b, 0) + _at(b, 2), width), (_at(b, 1) + _at(b, 3), height)]
    px = [F.greatest(F.lit(0).cast("bigint"), F.least(d.cast("bigint") - 1, F.rint(v * d / COORDINATE_MAX).cast("bigint"))) for v, d in ends]
    return F.when((width > 0) & (height > 0), F.array(*px))
