"""Box arithmetic as column expressions (corner form x1, y1, x2, y2, in pixels)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns that together hold one box per row."""

    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "", suffix: str = "") -> "Box":
        return Box(*(F.col(f"{prefix}{c}{suffix}").cast("double") for c in ("x1", "y1", "x2", "y2")))

    def columns(self, prefix: str = "") -> list[Column]:
        return [
            self.x1.alias(prefix + "x1"),
            self.y1.alias(prefix + "y1"),
            self.x2.alias(prefix + "x2"),
            self.y2.alias(prefix + "y2"),
        ]


def from_xywh(x: Column, y: Column, w: Column, h: Column, scale: Column | float = 1.0) -> Box:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return Box(x * s, y * s, (x + w) * s, (y + h) * s)


def long_side_scale(width: Column, height: Column, max_side: int) -> Column:
    """Factor that brings the longer side down to ``max_side``; 1 when it already fits."""
    longest = F.greatest(width, height).cast("double")
    if not max_side:
        return F.lit(1.0)
    return F.when(longest > max_side, F.lit(float(max_side)) / longest).otherwise(F.lit(1.0))


def area(b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(b.x2 - b.x1, zero) * F.greatest(b.y2 - b.y1, zero)


def intersection(a: Box, b: Box) -> Column:
    return area(
        Box(
            F.greatest(a.x1, b.x1),
            F.greatest(a.y1, b.y1),
            F.least(a.x2, b.x2),
            F.least(a.y2, b.y2),
        )
    )


def iou(a: Box, b: Box) -> Column:
    """Overlap over union; the union never falls below 1e-9, so empty boxes give 0."""
    inter = intersection(a, b)
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(1e-9))


def _clamp(v: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(v, low), high)


def clip(b: Box, width: Column, height: Column) -> Box:
    zero, w, h = F.lit(0.0), width.cast("double"), height.cast("double")
    return Box(_clamp(b.x1, zero, w), _clamp(b.y1, zero, h), _clamp(b.x2, zero, w), _clamp(b.y2, zero, h))


def expand(b: Box, factor: float, width: Column, height: Column) -> Box:
    """Grow about the centre, then clip. Flipped or empty boxes count as one pixel wide."""
    right, bottom = F.greatest(b.x2, b.x1 + 1.0), F.greatest(b.y2, b.y1 + 1.0)
    cx, cy = (b.x1 + right) / 2.0, (b.y1 + bottom) / 2.0
    half_w, half_h = (right - b.x1) * (factor / 2.0), (bottom - b.y1) * (factor / 2.0)
    return clip(Box(cx - half_w, cy - half_h, cx + half_w, cy + half_h), width, height)


def crop_window(b: Box, width: Column, height: Column) -> Box:
    """Whole-pixel window, rounded half to even, inside the image and at least 1x1."""
    w, h = width.cast("long"), height.cast("long")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    r = Box(*(F.bround(c).cast("long") for c in (b.x1, b.y1, b.x2, b.y2)))
    x1, y1 = _clamp(r.x1, zero, w - one), _clamp(r.y1, zero, h - one)
    return Box(x1, y1, F.least(F.greatest(r.x2, x1 + one), w), F.least(F.greatest(r.y2, y1 + one), h))


def decode_point(px: Column, py: Column, stride: Column, left: Column, top: Column, right: Column, bottom: Column) -> Box:
    """Box from a grid point and its four side distances, given in strides."""
    return Box(px - left * stride, py - top * stride, px + right * stride, py + bottom * stride)


def tile_offsets(length: Column, tile: int, overlap: float) -> Column:
    """Start positions along one axis; the last tile ends flush with the edge."""
    step = max(1, round(tile * (1.0 - overlap)))
    n, t = length.cast("long"), F.lit(tile).cast("long")
    zero = F.lit(0).cast("long")
    regular = F.sequence(zero, n - t, F.lit(step).cast("long"))
    return F.when(n <= t, F.array(zero)).otherwise(F.array_union(regular, F.array(n - t)))


def shift(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)
