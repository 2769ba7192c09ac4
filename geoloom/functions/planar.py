"""Points and rectangles as code-generated expressions: no function call leaves the plan.

A point is a pair of double columns, a rectangle four (xmin, ymin, xmax, ymax), a ring an
array<struct<x, y>>.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


@dataclass(frozen=True)
class Box:
    """A rectangle's columns."""

    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(prefix + n) for n in ("xmin", "ymin", "xmax", "ymax")))

    @classmethod
    def of_struct(cls, column: Column | str) -> Box:
        box = _c(column)
        return cls(box["minx"], box["miny"], box["maxx"], box["maxy"])

    @classmethod
    def of_point(cls, x: Column | str, y: Column | str) -> Box:
        return cls(_c(x), _c(y), _c(x), _c(y))

    def grown(self, by: float | Column) -> Box:
        return Box(self.xmin - by, self.ymin - by, self.xmax + by, self.ymax + by)

    def area(self) -> Column:
        return (self.xmax - self.xmin) * (self.ymax - self.ymin)

    def perimeter(self) -> Column:
        return 2 * ((self.xmax - self.xmin) + (self.ymax - self.ymin))

    def intersects(self, other: Box) -> Column:
        return (self.xmin <= other.xmax) & (other.xmin <= self.xmax) & (self.ymin <= other.ymax) & (other.ymin <= self.ymax)

    def covers(self, other: Box) -> Column:
        return (self.xmin <= other.xmin) & (self.ymin <= other.ymin) & (self.xmax >= other.xmax) & (self.ymax >= other.ymax)

    def contains_point(self, x: Column | str, y: Column | str) -> Column:
        """In the interior."""
        x, y = _c(x), _c(y)
        return (x > self.xmin) & (x < self.xmax) & (y > self.ymin) & (y < self.ymax)

    def overlap_area(self, other: Box) -> Column:
        width = F.least(self.xmax, other.xmax) - F.greatest(self.xmin, other.xmin)
        height = F.least(self.ymax, other.ymax) - F.greatest(self.ymin, other.ymin)
        return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))

    def distance_to_point(self, x: Column | str, y: Column | str) -> Column:
        dx = F.greatest(self.xmin - _c(x), F.lit(0.0), _c(x) - self.xmax)
        dy = F.greatest(self.ymin - _c(y), F.lit(0.0), _c(y) - self.ymax)
        return F.sqrt(dx * dx + dy * dy)

    def columns(self) -> list[Column]:
        return [self.xmin.alias("xmin"), self.ymin.alias("ymin"), self.xmax.alias("xmax"), self.ymax.alias("ymax")]


def point_distance(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def distance_sphere(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    """Great-circle distance in metres (haversine)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = p2 - p1, F.radians(lon2 - lon1)
    h = F.pow(F.sin(dp / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def ring_area(ring: Column | str) -> Column:
    """Signed area of a closed ring; positive if it runs counter-clockwise."""
    ring = _c(ring)
    pairs = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    )
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def in_ring(x: Column | str, y: Column | str, ring: Column | str) -> Column:
    """Whether a point is inside a closed ring (crossing number; the border is undefined)."""
    ring, x, y = _c(ring), _c(x), _c(y)
    crosses = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1),
        F.slice(ring, F.lit(2), F.size(ring) - 1),
        lambda a, b: (((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])).cast("int"),
    )
    return F.aggregate(crosses, F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 2 == 1




def wkb_point(x: Column | str, y: Column | str, z: Column | str | None = None) -> Column:
    """WKB of a point; null if a coordinate is."""
    from .jts import call, numbers

    return call("Made", F.lit("point"), numbers(*(_c(v) for v in (x, y, *([] if z is None else [z])))))


def wkb_box(box: Box) -> Column:
    """WKB of a rectangle, counter-clockwise from its lower left corner."""
    from .jts import call, numbers

    return call("Made", F.lit("box"), numbers(box.xmin, box.ymin, box.xmax, box.ymax))


def wkb_line(*ends: Column | str) -> Column:
    """WKB of a line through x, y, x, y and so on."""
    from .jts import call, numbers

    return call("Made", F.lit("line"), numbers(*map(_c, ends)))


def literal_point(x: float, y: float) -> Column:
    return F.lit(bytearray(struct.pack("<BIdd", 1, 1, x, y)))


def literal_box(xmin: float, ymin: float, xmax: float, ymax: float) -> Column:
    ring = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.lit(bytearray(struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in ring)))


def hilbert(x: Column, y: Column, level: int = 16) -> Column:
    """Index on the Hilbert curve of integer coordinates below ``2**level``."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(state: Column, power: Column) -> Column:
        s = power.cast("long")
        rx = (state["x"].bitwiseAND(s) > 0).cast("long")
        ry = (state["y"].bitwiseAND(s) > 0).cast("long")
        d = state["d"] + s * s * (F.lit(3) * rx).bitwiseXOR(ry)
        low = s - 1
        px, py = state["x"].bitwiseAND(low), state["y"].bitwiseAND(low)
        fx, fy = F.when(rx == 1, low - px).otherwise(px), F.when(rx == 1, low - py).otherwise(py)
        return F.struct(
            F.when(ry == 0, fy).otherwise(px).alias("x"), F.when(ry == 0, fx).otherwise(py).alias("y"), d.alias("d")
        )

    powers = F.array(*(F.lit(1 << k) for k in range(level - 1, -1, -1)))
    return F.aggregate(powers, start, step, lambda s: s["d"])
