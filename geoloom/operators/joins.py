"""Spatial joins as equi-joins on grid cells.

Each side's bounding boxes are dealt to the cells of a grid that they touch; both sides are
joined on the cell (and on attributes, if asked for), and a pair is kept only in the cell that
holds the lower left corner of the boxes' common part, so nothing has to be made distinct.
Then the boxes and at last the exact predicate are tested. Catalyst and adaptive execution
choose the join's strategy from the sizes they see: a small side is broadcast, otherwise both
sides are shuffled by cell and skewed cells are split.

The cell size follows the wider side's median box, and no box is dealt to more than
``MAX_CELLS`` cells: larger ones are dealt on a coarser grid of their own, level by level
(each level's cells are ``LEVEL`` times as wide). A row climbs only to levels on which the other
side has boxes of its own, and there it meets only those. Joins of many rows, and those that ask for it, have a grid for
each leaf of a quadtree (``quadtree``), so dense places have narrower cells; a box is dealt to the leaves it meets.

Before a join one job takes both sides' counts, median and greatest widths and bounds; all that
follows is planned from these few numbers.

Frames have an id column and a ``bbox`` struct<minx, miny, maxx, maxy>; null and empty
geometries have a null or NaN box and are in no pair. Pairs are (left_id, right_id).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.jts import call
from ..functions.planar import Box, point_distance
from .steps import written

MAX_CELLS = 16
LEVEL = 8
GRID = 32
#: Rows of a sample that reaches the driver; a cell's block may hold so many times the wanted boxes.
SAMPLE, CROWD = 8192, 64
#: So many pairs may be tried with rows that no cell serves, before wider cells are made for them.
LEFT = 1 << 24
#: Cells that a tile of a search for near boxes has along a side at least; at most four times as many.
TILE = 8
#: A side of so few boxes goes to every task as it is.
FEW = 2048
#: Sides of so many rows are not broadcast: Spark judges them by their files, which are compressed and have no cells yet.
MANY = 1 << 18
#: Joins of so many rows have cells by place.
ADAPTIVE = 1 << 20
#: Predicates whose operands change places.
INVERSE = {"within": "contains", "contains": "within", "covers": "covered_by", "covered_by": "covers"}


_BOX = ("x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Side:
    """One side of a join: a frame, its id, its box, and its geometry for exact predicates.

    ``carry`` are columns that pairs have beside the ids, so no join has to fetch them; ``points`` says that boxes are points.
    """

    df: DataFrame
    id: str
    box: Box
    geometry: str | None = None
    keys: tuple[str, ...] = field(default=())
    carry: tuple[str, ...] = field(default=())
    points: bool = False

    def slim(self, prefix: str, more: str | None = None) -> DataFrame:
        """Id, box, geometry and keys of the rows that have a box, and one more column as ``grown``."""
        box = [c.alias(prefix + n) for c, n in zip((self.box.xmin, self.box.ymin, self.box.xmax, self.box.ymax), ("x0", "y0", "x1", "y1"))]
        geometry = [F.col(self.geometry).alias(prefix + "geom")] if self.geometry else []
        grown = [F.col(more).cast("double").alias(prefix + "grown")] if more else []
        carried = [F.col(c).alias(prefix + "of_" + c) for c in self.carry]
        rows = self.df.select(F.col(self.id).alias(prefix + "id"), *box, *geometry, *grown, *carried, *(F.col(k).alias(prefix + k) for k in self.keys))
        known = F.col(prefix + "x0").isNotNull() & ~F.isnan(prefix + "x0")
        return rows.where(known & F.col(prefix + "grown").isNotNull() if more else known)


@dataclass(frozen=True)
class Extent:
    """What a join plans by: a side's count of boxes, their median and greatest width, and bounds."""

    count: int
    median: float = 0.0
    widest: float = 0.0
    xmin: float = 0.0
    ymin: float = 0.0
    xmax: float = 0.0
    ymax: float = 0.0

    @property
    def across(self) -> float:
        return max(self.xmax - self.xmin, self.ymax - self.ymin)


def point_side(df: DataFrame, id: str, x: str, y: str, keys: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> Side:
    return Side(df, id, Box.of_point(x, y), None, keys, carry, True)


def box_side(df: DataFrame, id: str, prefix: str = "", keys: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> Side:
    return Side(df, id, Box.of(prefix), None, keys, carry)


def geometry_side(df: DataFrame, id: str, geometry: str = "geometry", keys: tuple[str, ...] = ()) -> Side:
    """Boxes are taken from the geometry, once."""
    return Side(df.withColumn("__box", G.settled(G.bounds(geometry))), id, Box.of_struct("__box"), geometry, keys)


def measure(*sides: Side, grown_by: str | None = None) -> list[Extent]:
    """The extents of sides, in one job; ``grown_by`` names a column of the first that its boxes grow by.

    Only these numbers reach the driver.
    """
    measured = []
    for i, side in enumerate(sides):
        by = grown_by if i == 0 else None
        rows = side.slim("s_", by)
        width = F.greatest(F.col("s_x1") - F.col("s_x0"), F.col("s_y1") - F.col("s_y0"))
        widest = F.max(width + 2 * F.col("s_grown")) if by else F.max(width)
        bounds = F.min("s_x0"), F.min("s_y0"), F.max("s_x1"), F.max("s_y1")
        measured.append(rows.agg(F.lit(i).alias("side"), F.count(F.lit(1)), F.percentile_approx(width, 0.5, 1000), widest, *bounds))
    found = {r[0]: r[1:] for r in reduce(DataFrame.unionAll, measured).collect()}
    return [Extent(*found[i]) if found[i][0] else Extent(0) for i in range(len(sides))]


def planned(left: Side, right: Side, grown: float = 0.0, grown_by: str | None = None) -> tuple[Extent, Extent]:
    """The extents that a join of two sides is planned by.

    Points have no widths and do not decide a cell's: where the other side has boxes with a width, it alone is
    read, and points take its bounds.
    """
    if left.points != right.points and not grown_by:
        other = measure(right if left.points else left)[0]
        if other.count and (other.median or grown):
            points = Extent(1, 0.0, 0.0, other.xmin, other.ymin, other.xmax, other.ymax)
            return (points, other) if left.points else (other, points)
    return tuple(measure(left, right, grown_by=grown_by))


def cell_size(*extents: Extent, grown: float = 0.0) -> float:
    """A cell's width: the median side of the boxes of the wider side, or what spreads points."""
    known = [e for e in extents if e.count]
    if not known:
        return 1.0
    spread = max(e.across for e in known) / max(e.count for e in known) ** 0.5
    return max(max(e.median for e in known) + 2 * grown, spread, 2 * grown) or 1.0


def _levels(rows: DataFrame, p: str, size: Column, n_levels: int) -> DataFrame:
    """The least level on which a box touches ``MAX_CELLS`` cells at most."""
    across = lambda lo, hi, s: F.floor(F.col(p + hi) / s) - F.floor(F.col(p + lo) / s) + 1
    level = F.lit(n_levels - 1)
    for i in range(n_levels - 2, -1, -1):
        s = size * float(LEVEL**i)
        level = F.when(across("a0", "a1", s) * across("b0", "b1", s) <= MAX_CELLS, F.lit(i)).otherwise(level)
    return rows.withColumn(p + "level", level)


def _top(widest: float, size: float) -> int:
    """The level of the widest box; one as wide as three cells touches four of them at most."""
    level = 0
    while widest / (size * LEVEL**level) + 1 > MAX_CELLS**0.5:
        level += 1
    return level


def _cells(rows: DataFrame, p: str, size: Column) -> DataFrame:
    span = lambda lo, hi: F.sequence(F.floor(F.col(p + lo) / size), F.floor(F.col(p + hi) / size))
    return rows.withColumn("cx", F.explode(span("a0", "a1"))).withColumn("cy", F.explode(span("b0", "b1")))


@dataclass(frozen=True)
class Leaf:
    """A place of a join's grid: its box, the width of its cells, and the levels of both sides' widest boxes."""

    box: tuple[float, float, float, float]
    size: float
    l_top: int
    r_top: int


def _sampled(side: Side, count: int, by: float) -> np.ndarray:
    """At most ``SAMPLE`` of a side's boxes, grown."""
    rows = side.slim("s_").select(*("s_" + c for c in _BOX)).sample(min(1.0, 1.2 * SAMPLE / max(count, 1)), seed=7).limit(SAMPLE)
    return rows.toPandas().to_numpy(dtype=float).reshape(-1, 4) + np.array([-by, -by, by, by])


def quadtree(left: Side, right: Side, l_extent: Extent, r_extent: Extent, grown: float = 0.0) -> tuple[bytes, list[Leaf]]:
    """A tree over both sides' bounds, cut from a bounded sample: as the helper that walks it reads it, and its leaves.

    A node is cut in four while it has enough of the sample and one of the four would have far more than its share, so places of even
    density are one leaf each. A leaf's cells are as wide as the boxes in it, or as what spreads its rows; a leaf whose cells would
    each hold a large part of all rows has cells of a third.
    """
    counts = [e.count if e.count > 1 else side.slim("s_").count() for side, e in ((left, l_extent), (right, r_extent))]
    samples = [_sampled(side, n, by) for side, n, by in zip((left, right), counts, (grown, 0.0))]
    boxes = np.concatenate(samples)
    if not len(boxes):
        return b"", []
    weight = np.concatenate([np.full(len(s), n / max(len(s), 1)) for s, n in zip(samples, counts)])
    side = np.repeat([0, 1], [len(s) for s in samples])
    at, width = (boxes[:, :2] + boxes[:, 2:]) / 2, np.maximum(boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1])
    known = [e for e in (l_extent, r_extent) if e.count]
    low = np.minimum([min(e.xmin for e in known), min(e.ymin for e in known)], at.min(0))
    high = np.maximum([max(e.xmax for e in known), max(e.ymax for e in known)], at.max(0))
    high = np.where(high > low, high, low + 1.0)
    coarse = cell_size(l_extent, r_extent, grown=grown)
    finest = float(np.abs([low, high]).max()) * 2.0**-40 or 1.0
    tree: list[float] = [*low, *high]
    leaves: list[Leaf] = []

    def cut(rows: np.ndarray, x0: float, y0: float, x1: float, y1: float, outer: tuple[bool, bool, bool, bool], depth: int) -> None:
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        quarter = (at[rows, 0] >= x) + 2 * (at[rows, 1] >= y)
        share = np.bincount(quarter, weight[rows], 4)
        across = max(x1 - x0, y1 - y0)
        if depth < 24 and len(rows) >= 64 and share.max() >= 0.4 * share.sum() and across > 8 * max(finest, float(np.median(width[rows]))):
            tree.append(1.0)
            for i, (a, b, c, d) in enumerate(((x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1))):
                cut(rows[quarter == i], a, b, c, d, (outer[0] and not i % 2, outer[1] and i < 2, outer[2] and i % 2 == 1, outer[3] and i > 1), depth + 1)
            return
        tree.append(0.0)
        own = [rows[side[rows] == s] for s in (0, 1)]
        number = [float(weight[r].sum()) for r in own]
        wide = max((float(np.median(width[r])) for r in own if len(r)), default=coarse)
        spread = ((x1 - x0) * (y1 - y0) / max(*number, 1.0)) ** 0.5
        size = max(wide, spread, finest)
        if max(number) * size * size / ((x1 - x0) * (y1 - y0)) > sum(counts) / 4096:
            size = max(wide / 3, spread, finest)
        infinite = float("inf")
        box = tuple(v if not o else s * infinite for v, o, s in zip((x0, y0, x1, y1), outer, (-1, -1, 1, 1)))
        tops = [_top(e.widest + by if any(outer) else min(e.widest + by, across), size) for e, by in ((l_extent, 2 * grown), (r_extent, 0.0))]
        leaves.append(Leaf(box, size, *tops))

    cut(np.arange(len(boxes)), *low, *high, (True,) * 4, 0)
    return np.array(tree, ">f8").tobytes(), leaves


def _of_leaf(values: list, kind: str) -> Column:
    return F.element_at(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), F.col("leaf") + 1)


def candidates(
    left: Side,
    right: Side,
    size: float | None = None,
    grown: float = 0.0,
    grown_by: str | None = None,
    extents: tuple[Extent, Extent] | None = None,
    adaptive: bool | None = None,
) -> DataFrame:
    """Pairs of rows whose boxes touch, the left boxes grown by ``grown`` (or by a left column).

    Columns l_id, l_x0.. (its own), r_id, r_x0.., and l_geom, r_geom where there are geometries.
    ``extents`` are those of the sides, or of frames that hold them, if they are known already. ``adaptive`` cells have a
    width by place, from a quadtree; by default from ``ADAPTIVE`` known rows on, where one dense place could be a task of its own.
    """
    l_extent, r_extent = extents or planned(left, right, grown, grown_by)
    if adaptive is None:
        adaptive = not size and not grown_by and max(l_extent.count, r_extent.count) >= ADAPTIVE
    packed, leaves = quadtree(left, right, l_extent, r_extent, grown) if adaptive else (b"", [])
    size = size or cell_size(l_extent, r_extent, grown=grown)
    reach = max(abs(v) for e in (l_extent, r_extent) for v in (e.xmin, e.ymin, e.xmax, e.ymax)) + 2 * grown
    size = max(size, reach * 2.0**-40)  # cells are numbered by longs
    l_rows, r_rows = left.slim("l_", grown_by), right.slim("r_")
    by = F.col("l_grown") if grown_by else F.lit(float(grown))
    # what a row is dealt by is grown, what pairs have is its own
    l_rows = l_rows.withColumns({"l_own_" + c: F.col("l_" + c) for c in _BOX} | {c: F.col(c) - by for c in ("l_x0", "l_y0")} | {c: F.col(c) + by for c in ("l_x1", "l_y1")})
    dealt_by = dict(zip(_BOX, ("a0", "b0", "a1", "b1")))
    if leaves:
        l_top, r_top = max(leaf.l_top for leaf in leaves), max(leaf.r_top for leaf in leaves)
        base, l_tops, r_tops = (_of_leaf([getattr(leaf, n) for leaf in leaves], kind) for n, kind in (("size", "double"), ("l_top", "int"), ("r_top", "int")))
        # bounds beyond all numbers are written as very large ones
        edges = [_of_leaf([min(max(leaf.box[i], -1e308), 1e308) for leaf in leaves], "double") for i in range(4)]

        def place(rows: DataFrame, p: str) -> DataFrame:
            rows = rows.withColumn("leaf", F.explode(call("Leaves", F.array(*(F.col(p + c) for c in _BOX)), F.lit(packed))))
            inner = (F.greatest, F.greatest, F.least, F.least)
            return rows.withColumns({p + n: f(F.col(p + c), e) for (c, n), f, e in zip(dealt_by.items(), inner, edges)})

    else:
        l_top, r_top = _top(l_extent.widest + 2 * grown, size), _top(r_extent.widest, size)
        base, l_tops, r_tops = F.lit(float(size)), F.lit(l_top), F.lit(r_top)

        def place(rows: DataFrame, p: str) -> DataFrame:
            return rows.withColumns({"leaf": F.lit(0)} | {p + n: F.col(p + c) for c, n in dealt_by.items()})

    l_rows, r_rows = place(l_rows, "l_"), place(r_rows, "r_")
    # A pair meets on the coarser of its levels only. Either the right row is there dealt on a
    # level that is not below its own and the left one on its own, or the left row climbs to the
    # right one's level; ``up`` tells the two apart, so that no other rows meet.
    level = F.lit(0).alias("level")
    if l_top == r_top == 0:
        l_dealt, r_dealt = l_rows.select("*", level, F.lit(False).alias("up")), r_rows.select("*", level, F.lit(False).alias("up"))
    else:
        l_rows, r_rows = _levels(l_rows, "l_", base, l_top + 1), _levels(r_rows, "r_", base, r_top + 1)
        upward = lambda own, top: F.sequence(F.col(own), F.greatest(F.col(own), top))
        l_dealt = l_rows.select("*", F.explode(upward("l_level", r_tops)).alias("level"))
        l_dealt = l_dealt.withColumn("up", F.col("level") > F.col("l_level"))
        places = F.transform(upward("r_level", l_tops), lambda v: F.struct(v.alias("level"), F.lit(False).alias("up")))
        places = F.concat(places, F.array(F.struct(F.col("r_level").alias("level"), F.lit(True).alias("up"))))
        r_dealt = r_rows.select("*", F.inline(places))
        r_dealt = r_dealt.where(F.when(F.col("up"), F.col("level") > 0).otherwise(F.col("level") <= l_tops))
    used = F.pow(F.lit(float(LEVEL)), F.col("level")) * base
    if leaves:
        l_dealt = l_dealt.withColumns({f"e{i}": e for i, e in enumerate(edges)})
    l_dealt, r_dealt = (_cells(d, p, used).withColumn("width", used) for d, p in ((l_dealt, "l_"), (r_dealt, "r_")))
    on = reduce(and_, (F.col("l." + c) == F.col("r." + c) for c in ["leaf"] * bool(leaves) + ["level", "up", "cx", "cy"]))
    for k in left.keys:
        on = on & (F.col("l.l_" + k) == F.col("r.r_" + k))
    met = r_dealt.drop("width").alias("r")
    if min(l_extent.count, r_extent.count) >= MANY:
        met = met.hint("merge")
    pairs = l_dealt.alias("l").join(met, on)
    # once: in the cell, and the leaf, of the common part's corner
    cell = F.col("l.width")
    corner = (F.floor(F.greatest("l_x0", "r_x0") / cell) == F.col("l.cx")) & (F.floor(F.greatest("l_y0", "r_y0") / cell) == F.col("l.cy"))
    if leaves:
        for x, low, high in (("x0", "e0", "e2"), ("y0", "e1", "e3")):
            corner = corner & (F.greatest("l_" + x, "r_" + x) >= F.col(low)) & (F.greatest("l_" + x, "r_" + x) < F.col(high))
    touch = (F.col("l_x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("l_x1")) & (F.col("l_y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("l_y1"))
    out = pairs.where(touch & corner)
    names = ["l_id", *(F.col("l_own_" + c).alias("l_" + c) for c in _BOX), "r_id", "r_x0", "r_y0", "r_x1", "r_y1"]
    names += ["l_of_" + c for c in left.carry] + ["r_of_" + c for c in right.carry]
    names += ["l_geom"] * bool(left.geometry) + ["r_geom"] * bool(right.geometry) + ["l_grown"] * bool(grown_by)
    return out.select(*names)


def box_distance(p: str = "l_", q: str = "r_") -> Column:
    gap = lambda lo, hi: F.greatest(F.col(q + lo) - F.col(p + hi), F.lit(0.0), F.col(p + lo) - F.col(q + hi))
    dx, dy = gap("x0", "x1"), gap("y0", "y1")
    return F.sqrt(dx * dx + dy * dy)


def _exact(left: Side, right: Side, predicate: str, distance: float | Column) -> Column | None:
    """The test of the predicate; None if the boxes decide it."""
    if left.geometry and right.geometry:
        return G.relates(predicate, "l_geom", "r_geom", distance)
    if left.geometry or right.geometry:
        raise ValueError("both sides need geometries, or neither")
    inside = (F.col("l_x0") > F.col("r_x0")) & (F.col("l_y0") > F.col("r_y0")) & (F.col("l_x1") < F.col("r_x1")) & (F.col("l_y1") < F.col("r_y1"))
    covered = (F.col("l_x0") >= F.col("r_x0")) & (F.col("l_y0") >= F.col("r_y0")) & (F.col("l_x1") <= F.col("r_x1")) & (F.col("l_y1") <= F.col("r_y1"))
    is_point = (F.col("l_x0") == F.col("l_x1")) & (F.col("l_y0") == F.col("l_y1"))
    if predicate == "intersects":
        return None
    if predicate == "covered_by":
        return covered
    if predicate == "within":
        return F.when(is_point, inside).otherwise(covered)
    raise ValueError(f"{predicate} of points and boxes needs geometries")


def pairs(
    left: Side,
    right: Side,
    predicate: str = "intersects",
    distance: float | str | None = None,
    size: float | None = None,
    with_distance: bool = False,
    extents: tuple[Extent, Extent] | None = None,
    adaptive: bool | None = None,
) -> DataFrame:
    """(left_id, right_id[, distance], carried columns) of the pairs in a relation.

    ``distance`` is that of ``dwithin``: a number, or the name of a column of the left frame.
    Points and rectangles without geometry columns are decided by expressions alone.
    """
    if predicate != "dwithin" and predicate not in G.PREDICATES:
        raise ValueError(f"no such predicate: {predicate}")
    by_column = isinstance(distance, str)
    if predicate == "dwithin":
        if distance is None:
            raise ValueError("dwithin needs a distance")
        grown = 0.0 if by_column else float(distance)
        found = candidates(left, right, size, grown, distance if by_column else None, extents, adaptive)
        limit = F.col("l_grown") if by_column else F.lit(grown)
        gap = G.distance("l_geom", "r_geom") if left.geometry else box_distance()
        found = found.withColumn("distance", gap).where(F.col("distance") <= limit)
    else:
        found = candidates(left, right, size, extents=extents, adaptive=adaptive)
        test = _exact(left, right, predicate, 0.0)
        found = found if test is None else found.where(test)
        if with_distance:
            found = found.withColumn("distance", G.distance("l_geom", "r_geom") if left.geometry else box_distance())
    more = ["distance"] if with_distance or predicate == "dwithin" else []
    carried = [F.col(p + "of_" + c).alias(c) for p, side in (("l_", left), ("r_", right)) for c in side.carry]
    return found.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), *more, *carried)


def places(side: Side, n: str) -> Side:
    """A side's different boxes, each once: its ids are structs of the box, and ``n`` names the number of rows that have it; written, as joins measure it first."""
    rows = side.slim("s_").groupBy(*(F.col("s_" + c).alias(c) for c in _BOX)).agg(F.count(F.lit(1)).alias(n))
    return Side(written(rows.withColumn("place", F.struct(*_BOX))), "place", Box(*map(F.col, _BOX)), carry=(n,), points=side.points)


def place_pairs(left: Side, right: Side, predicate: str = "intersects", distance: float | None = None) -> DataFrame:
    """(left_place, right_place[, distance], left_n, right_n): the pairs of different boxes in a relation, with the number of rows that have each.

    For sides without geometries whose pairs are only summed up: rows that share a box meet as one, so pairs do not
    grow with the square of how often boxes repeat. ``at_places`` gives the sums back to rows.
    """
    if left.geometry or right.geometry:
        raise ValueError("boxes decide for places: sides must have no geometries")
    found = pairs(places(left, "left_n"), places(right, "right_n"), predicate, distance)
    return found.withColumnsRenamed({"left_id": "left_place", "right_id": "right_place"})


def at_places(side: Side, summed: DataFrame, place: str) -> DataFrame:
    """The rows of a side with the columns of ``summed``, which has one row for each box (``place``); rows whose box is not there are left out."""
    box = F.struct(*(c.alias(n) for n, c in zip(_BOX, (side.box.xmin, side.box.ymin, side.box.xmax, side.box.ymax))))
    return side.df.withColumn("__place", box).join(summed, F.col("__place") == F.col(place)).drop("__place", place)


def numbered(side: Side) -> Side:
    """A side whose ids are the places of its rows, so that rows that share an id are told apart; written, as the numbers must not change."""
    rows = written(side.df.withColumn("__row", F.monotonically_increasing_id()))
    return replace(side, df=rows, id="__row")


def _likeness(side: Side) -> Column:
    """What rows of ``slim("s_")`` share that are alike: the geometry's digest, without one the box."""
    return F.md5("s_geom") if side.geometry else F.struct(*(F.col("s_" + c).alias(c) for c in _BOX))


def alike(side: Side) -> Side:
    """A side whose rows with the same geometry (without one, the same box) and keys are one, with that as their id; written, as joins measure it first."""
    by = {"__alike": _likeness(side)} | {k: F.col("s_" + k) for k in side.keys}
    rows = side.slim("s_").groupBy(*(c.alias(n) for n, c in by.items())).agg(F.count(F.lit(1)).alias("__n"), *(F.first("s_" + c).alias(c) for c in _BOX + ("geom",) * bool(side.geometry)))
    return Side(written(rows), "__alike", Box(*map(F.col, _BOX)), "geom" if side.geometry else None, side.keys, (), side.points)


def sjoin(
    left: Side,
    right: Side,
    how: str = "inner",
    predicate: str = "intersects",
    lsuffix: str = "left",
    rsuffix: str = "right",
    distance: float | str | None = None,
) -> DataFrame:
    """Rows of both frames that are in a relation; ``how`` inner, left, right or outer.

    Pairs are found once; outer rows are added by joins on the ids. Names that both frames have
    get the suffixes; the geometry is the left one's, for ``right`` the right one's.
    """
    if how not in ("inner", "left", "right", "outer"):
        raise ValueError(f"no such how: {how}")
    left, right = numbered(left), numbered(right)
    return _attributes(pairs(left, right, predicate, distance).select("left_id", "right_id"), left, right, how, lsuffix, rsuffix)


def _names(left: Side, right: Side, how: str, lsuffix: str, rsuffix: str) -> tuple[dict[str, str], dict[str, str]]:
    """The names that both frames' columns have in a join."""
    hidden = ("__box", "__row")
    l_names, r_names = ([c for c in s.df.columns if c not in hidden] for s in (left, right))
    geometry = {left.geometry, right.geometry} - {None}
    drop_left, drop_right = (geometry, set()) if how == "right" else (set(), geometry)
    both = (set(l_names) - drop_left) & (set(r_names) - drop_right)
    l_out = {c: f"{c}_{lsuffix}" if c in both else c for c in l_names if c not in drop_left}
    r_out = {c: f"{c}_{rsuffix}" if c in both else c for c in r_names if c not in drop_right}
    return l_out, r_out


def _attributes(found: DataFrame, left: Side, right: Side, how: str, lsuffix: str, rsuffix: str) -> DataFrame:
    """Both frames' columns beside pairs (left_id, right_id, ...), with the rows of a side that are in none if ``how`` says so."""
    more = [c for c in found.columns if c not in ("left_id", "right_id")]
    found = found.select(F.col("left_id").alias("__l"), F.col("right_id").alias("__r"), *(F.col(c).alias("m." + c) for c in more))
    l_out, r_out = _names(left, right, how, lsuffix, rsuffix)
    l_rows = left.df.select(F.col(left.id).alias("__lid"), *(F.col(c).alias("l." + c) for c in l_out))
    r_rows = right.df.select(F.col(right.id).alias("__rid"), *(F.col(c).alias("r." + c) for c in r_out))
    kind = {"inner": ("inner", "inner"), "left": ("right", "left"), "right": ("inner", "right"), "outer": ("right", "full")}[how]
    rows = found.join(l_rows, F.col("__l") == F.col("__lid"), kind[0])
    rows = rows.join(r_rows, F.col("__r") == F.col("__rid"), kind[1])
    quoted = lambda name: F.col(f"`{name}`")
    return rows.select(
        *(quoted("l." + c).alias(n) for c, n in l_out.items()), *(quoted("r." + c).alias(n) for c, n in r_out.items()), *(quoted("m." + c).alias(c) for c in more)
    )


def left_semi(left: Side, right: Side, predicate: str = "intersects", distance: float | str | None = None) -> DataFrame:
    """Left rows with a match."""
    left = numbered(left)
    ids = pairs(left, alike(right), predicate, distance).select(F.col("left_id").alias("__id")).distinct()
    return left.df.drop("__box").join(ids, F.col("__row") == F.col("__id"), "left_semi").drop("__row")


def left_anti(left: Side, right: Side, predicate: str = "intersects", distance: float | str | None = None) -> DataFrame:
    """Left rows without a match; null and empty geometries have none."""
    left = numbered(left)
    ids = pairs(left, alike(right), predicate, distance).select(F.col("left_id").alias("__id")).distinct()
    return left.df.drop("__box").join(ids, F.col("__row") == F.col("__id"), "left_anti").drop("__row")


def right_semi(left: Side, right: Side, predicate: str = "intersects", distance: float | str | None = None) -> DataFrame:
    right = numbered(right)
    ids = pairs(left, right, predicate, distance).select(F.col("right_id").alias("__id")).distinct()
    return right.df.drop("__box").join(ids, F.col("__row") == F.col("__id"), "left_semi").drop("__row")


def right_anti(left: Side, right: Side, predicate: str = "intersects", distance: float | str | None = None) -> DataFrame:
    right = numbered(right)
    ids = pairs(left, right, predicate, distance).select(F.col("right_id").alias("__id")).distinct()
    return right.df.drop("__box").join(ids, F.col("__row") == F.col("__id"), "left_anti").drop("__row")


def match_counts(left: Side, right: Side, predicate: str = "intersects", distance: float | str | None = None) -> DataFrame:
    """(left_id, matches) of every left row, 0 where there is none."""
    rows = numbered(left)
    counts = pairs(rows, right, predicate, distance).groupBy("left_id").agg(F.count(F.lit(1)).alias("matches"))
    every = rows.df.select(F.col(left.id).alias("__own"), "__row").join(counts, F.col("__row") == F.col("left_id"), "left")
    return every.select(F.col("__own").alias("left_id"), F.coalesce("matches", F.lit(0)).alias("matches"))


def query_any(left: Side, right: Side, predicate: str = "intersects", distance: float | str | None = None) -> DataFrame:
    """(left_id, matched boolean)."""
    return match_counts(left, right, predicate, distance).select("left_id", (F.col("matches") > 0).alias("matched"))


def query_aggregate(
    left: Side, right: Side, aggregates: dict[str, tuple[str, str]], predicate: str = "intersects", distance: float | str | None = None
) -> DataFrame:
    """For every left row, aggregates of its partners: out name -> (right column, reducer).

    Reducers are names of Spark aggregates; ``("*", "size")`` counts. Sums and counts of no
    partner are 0, other aggregates null.
    """
    left_rows, right_rows = numbered(left), numbered(right)
    found = pairs(left_rows, right_rows, predicate, distance)
    rows = found.join(right_rows.df.drop("__box"), found["right_id"] == F.col("__row"))
    made = [F.count(F.lit(1)).alias(n) if r == "size" else getattr(F, r)(c).alias(n) for n, (c, r) in aggregates.items()]
    summed = rows.groupBy("left_id").agg(*made)
    every = left_rows.df.select(F.col(left.id).alias("__own"), F.col("__row").alias("__at")).join(summed, F.col("__at") == F.col("left_id"), "left")
    zero = [n for n, (_, r) in aggregates.items() if r in ("size", "sum", "count")]
    return every.select(F.col("__own").alias("left_id"), *(F.coalesce(n, F.lit(0)).alias(n) if n in zero else F.col(n) for n in aggregates))


def right_reduce_left(
    left: Side, right: Side, aggregates: dict[str, tuple[str, str]], predicate: str = "intersects", distance: float | None = None
) -> DataFrame:
    """For every right row, aggregates of its left partners, as ``query_aggregate`` has them: (right_id, ...)."""
    return query_aggregate(right, left, aggregates, INVERSE.get(predicate, predicate), distance).withColumnRenamed("left_id", "right_id")


def filter_by_distance(found: DataFrame, operator: str, distance: float | Column) -> DataFrame:
    """Pairs with a ``distance`` that is ``<``, ``<=``, ``>``, ``>=`` or ``==`` another."""
    own, other = F.col("distance"), distance if isinstance(distance, Column) else F.lit(float(distance))
    tests = {"<": own < other, "<=": own <= other, ">": own > other, ">=": own >= other, "==": own == other}
    if operator not in tests:
        raise ValueError(f"no such operator: {operator}")
    return found.where(tests[operator])


def left_reduce_distances(found: DataFrame, how: str = "min") -> DataFrame:
    """(left_id, distance): a reduction of the distances of each left row's pairs."""
    return found.groupBy("left_id").agg(getattr(F, how)("distance").alias("distance"))


def pair_aggregate(first: Side, second: Side, zones: Side, predicate: str = "intersects", every: bool = True) -> DataFrame:
    """(id, left_count, right_count, shared_count) of rows whose two positions are ``first`` and
    ``second``: how many zones each is in, and how many both are in. Rows in no zone are left out unless ``every``.

    Zones are measured once, and pairs are shuffled once, by id.
    """
    extents = planned(first, zones)
    a = pairs(first, zones, predicate, extents=extents).select(F.col("left_id").alias("id"), "right_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = pairs(second, zones, predicate, extents=extents if second.points else None).select(F.col("left_id").alias("id"), "right_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    by_pair = a.unionAll(b).repartition("id").groupBy("id", "right_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    counts = by_pair.groupBy("id").agg(
        F.sum("a").alias("left_count"), F.sum("b").alias("right_count"), F.sum(F.col("a") * F.col("b")).alias("shared_count")
    )
    if not every:
        return counts
    whole = first.df.select(F.col(first.id).alias("id")).join(counts, "id", "left")
    return whole.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("left_count", "right_count", "shared_count")))


def _gap(left: Side) -> Column:
    return G.distance("l_geom", "r_geom") if left.geometry else box_distance()


def _places(right: Side, k: int | None) -> DataFrame:
    """(x0, y0, x1, y1, id): the boxes of a side, of rows that share one the first ``k`` by id; without ``k`` each box once, with no id."""
    rows = right.slim("r_").select(F.col("r_id").alias("id"), *(F.col("r_" + c).alias(c) for c in _BOX))
    if k is None:
        return rows.groupBy(*_BOX).agg(F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
    rank = F.row_number().over(Window.partitionBy(*_BOX).orderBy("id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _cell_sizes(places: DataFrame, count: int, need: int) -> list[float]:
    """Cell widths from the densest parts of a side to the sparsest, each four times the one before; by a sample of ``SAMPLE`` boxes."""
    centre = ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y")
    rows = places.sample(min(1.0, 1.2 * SAMPLE / max(count, 1)), seed=7).select(*centre).limit(SAMPLE).toPandas().to_numpy(dtype=float)
    if len(rows) < 2:
        return [1.0]
    low, high = rows.min(0), rows.max(0)
    grid = ((rows - low) / np.where(high > low, high - low, 1.0) * 65535).astype(np.int64)
    curve = np.zeros(len(rows), np.int64)
    for bit in range(16):
        curve |= ((grid[:, 0] >> bit) & 1) << (2 * bit) | ((grid[:, 1] >> bit) & 1) << (2 * bit + 1)
    rows = rows[np.argsort(curve)]
    runs = [rows[i : i + 64] for i in range(0, len(rows), 64)]
    across = [np.ptp(r, axis=0) for r in runs if len(r) > 1]
    spacing = sorted((w * h / len(r) if w * h else max(w, h) ** 2 / len(r) ** 2) ** 0.5 for (w, h), r in zip(across, runs))
    spacing = [v * (len(rows) / max(count, len(rows))) ** 0.5 for v in spacing if v > 0] or [max(float(np.ptp(rows)), 1.0)]
    # so many places a cell that a block of nine has ``need`` of them almost surely
    wide = ((need + 3 * need**0.5 + 3) / 9) ** 0.5
    first, last = (wide * spacing[int(q * (len(spacing) - 1))] for q in (0.25, 0.95))
    return [first * 4**i for i in range(1 + math.floor(math.log(last / first, 4) + 0.3))]


def _home_candidates(places: DataFrame, extent: Extent, size: float, need: int, ids: bool, mode: int, among: DataFrame | None = None) -> DataFrame:
    """(cx, cy, near, boxes): of the cells of one width whose block of nine holds ``need`` places, the places among which are
    the ``need`` nearest of every point of the cell, by id, and their boxes as packed numbers; ``near`` has ids alone or whole places.
    ``among`` names the only cells (cx, cy) that are asked for; as these are few, their blocks may be more crowded.

    Places meet tiles of many cells, as wide as boxes are, so they are not dealt to each cell they cover; in the tile each cell
    leaves out those that have ``need`` others before them from everywhere in it (``Near.Chosen``, which has the modes), so lists stay short where boxes lie on one another.
    """
    cell = lambda lo, hi: F.floor((F.col(lo) + F.col(hi)) / 2 / size)
    counts = places.groupBy(cell("x0", "x1").alias("cx"), cell("y0", "y1").alias("cy")).agg(F.count(F.lit(1)).alias("n"))
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    blocks = counts.select("n", around.alias("at")).groupBy("at.cx", "at.cy").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("at.own"), F.col("n")).otherwise(0)).alias("own"))
    # the counts bound how far the places are: inside the cell, or inside the block
    most = 2 * 2**0.5 * size * (1 + 1e-9)
    reach = F.when(F.col("own") >= need, most / 2).otherwise(most)
    cells = blocks.where((F.col("n") >= need) & (F.col("n") <= (CROWD if among is None else CROWD**2) * need)).withColumn("reach", reach)
    cells = cells.join(among, ["cx", "cy"], "left_semi") if among is not None else cells
    wide = min(max(TILE, math.ceil(extent.median / size)), 4 * TILE)
    tile = F.struct(*(F.floor(F.col(c) / wide).alias(c) for c in ("cx", "cy")))
    ends = [f(c).alias(n) for f, c, n in ((F.min, "cx", "i0"), (F.min, "cy", "j0"), (F.max, "cx", "i1"), (F.max, "cy", "j1"))]
    tiles = written(cells.groupBy(tile.alias("key")).agg(F.max("reach").alias("reach"), *ends, F.collect_list(F.struct("cx", "cy")).alias("cells")))
    box = Box(F.col("i0") * size, F.col("j0") * size, (F.col("i1") + 1) * size, (F.col("j1") + 1) * size)
    across = wide * size + 2 * most
    extents = (Extent(extent.count // wide**2 + 1, across, across, extent.xmin - across, extent.ymin - across, extent.xmax + across, extent.ymax + across), extent)
    of_place = Side(places.withColumn("key", F.struct("id", *_BOX)), "key", Box(*map(F.col, _BOX)))
    found = candidates(Side(tiles, "key", box), of_place, max(across, extent.median), grown_by="reach", extents=extents)
    near = found.groupBy("l_id").agg(F.sort_array(F.collect_list("r_id")).alias("near"))
    near = near.join(tiles.select("key", "cells"), F.col("l_id") == F.col("key"))
    packed = lambda rows, numbers: call("Pack", F.flatten(F.transform(rows, lambda c: F.array(*numbers(c)))))
    of_box = lambda c: [c[n] for n in _BOX]
    # a little wider, for quotients that are rounded
    end = lambda at, by: (at + by + (F.abs(at) + 1) * (1e-12 if by else -1e-12)) * size
    chosen = call("Chosen", packed("cells", lambda c: [end(c[n], by) for by in (0, 1) for n in ("cx", "cy")]), packed("near", of_box), F.lit(need), F.lit(mode))
    lists = F.transform(chosen, lambda places: F.transform(places, lambda i: F.col("near")[i]))
    rows = near.select(F.inline(F.arrays_zip("cells", lists.alias("near"))))
    # rows of many points carry these: ids alone where boxes have them
    return rows.select("cells.cx", "cells.cy", F.col("near.id" if ids else "near").alias("near"), packed("near", of_box).alias("boxes"))


def _all_places(places: DataFrame, ids: bool) -> dict[str, Column]:
    """``near`` and ``boxes`` of at most ``FEW`` places, as literals."""
    told = sorted(map(tuple, places.select("id", *_BOX).collect()), key=lambda r: (r[0] is not None, r))
    kind = places.schema["id"].dataType.simpleString()
    near = F.from_json(F.lit(json.dumps([r[0] for r in told], default=str)), f"array<{kind}>")
    if not ids:
        near = F.from_json(F.lit(json.dumps([dict(zip(_BOX, r[1:])) for r in told])), "array<struct<x0: double, y0: double, x1: double, y1: double>>")
    return {"near": near, "boxes": F.lit(np.array([r[1:] for r in told], ">f8").tobytes())}


def nearest(
    left: Side,
    right: Side,
    k: int | None = None,
    max_distance: float | None = None,
    exclusive: bool = False,
    tie: Callable[[], Column] | None = None,
) -> DataFrame:
    """(left_id, right_id, distance): the nearest right rows of each left row.

    Without ``k`` all that tie for the least distance; with it exactly ``k``, ties by right id.
    ``exclusive`` leaves out equal geometries (equal boxes).

    Counts come first. The right side's different boxes are counted by cell, and the counts of a cell and the eight around it bound how
    far the wanted ones can be from any point of the cell; the boxes within that bound are the cell's candidates. Each left
    row meets those of the one cell that it is in, so no left row is dealt twice, and ranks them in place. Where
    density differs much, wider cells serve the rows that narrower ones do not. Without ``k`` rows of either side that share their geometry are
    one place, and pairs of places are given back to the rows at the end. Points are done with that; of other rows the
    candidates give a reach of their own, within which exact distances are taken. Rows with too few boxes near them get
    a reach from the counts of ``GRID`` squared cells. A side of ``FEW`` boxes at most is every row's list of candidates.
    """
    if max_distance is not None and max_distance <= 0:
        raise ValueError("max_distance must be positive")
    if k is None:
        return _near_rows(left, right, max_distance, exclusive, "inner", [F.col(left.id).alias("left_id")], [F.col(right.id).alias("right_id")])
    return _nearest(left, right, k, max_distance, exclusive)


def _near_rows(left: Side, right: Side, max_distance: float | None, exclusive: bool, how: str, l_columns: list[Column], r_columns: list[Column]) -> DataFrame:
    """Columns of both sides' rows and ``distance``: each left row with all that tie for the least distance; ``how`` left or right keeps a side's rows without a partner.

    Pairs of places are found first. Rows take their columns along as they meet them, so no join sorts the pairs, which are many where places repeat.
    """
    l_alike, r_alike = alike(left), alike(right)
    near = written(_nearest(l_alike, r_alike, None, max_distance, exclusive).withColumnsRenamed({"left_id": "__l", "right_id": "__r"}))
    number = lambda side, at: side.df.select(F.col("__alike").alias(at), F.col("__n").alias("__n" + at))
    total = near.join(number(l_alike, "__l"), "__l").join(number(r_alike, "__r"), "__r").agg(F.sum(F.col("__n__l") * F.col("__n__r"))).first()[0] or 0
    parts = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 20)

    def rows(side: Side, at: str, columns: list[Column]) -> DataFrame:
        box = F.struct(*(c.alias(n) for n, c in zip(_BOX, (side.box.xmin, side.box.ymin, side.box.xmax, side.box.ymax))))
        return side.df.select((F.md5(side.geometry) if side.geometry else box).alias(at), *columns)

    l_rows, r_rows = rows(left, "__l", l_columns), rows(right, "__r", r_columns)
    first, second, at, other = (r_rows, l_rows, "__r", "__l") if how == "right" else (l_rows, r_rows, "__l", "__r")
    kind = "inner" if how == "inner" else "left"
    return first.join(near, at, kind).repartition(parts).join(second, other, kind).drop("__l", "__r")


def _nearest(left: Side, right: Side, k: int | None, max_distance: float | None, exclusive: bool) -> DataFrame:
    direct = left.points and not left.geometry and not right.geometry
    places = written(_places(right, k if direct else None))
    extent = measure(Side(places, "id", Box(*map(F.col, _BOX))))[0]
    count = extent.count
    # rows that share the own box may have to be left out
    need = min((k or 1) + ((k if direct and k else 1) if exclusive else 0), count)
    order, tied = Window.partitionBy("l_id").orderBy("distance", "r_id"), Window.partitionBy("l_id").orderBy("distance")

    def within(rows: Side) -> DataFrame:
        """By each row's ``__reach``."""
        found = candidates(rows, right, grown_by="__reach")
        found = found.withColumn("distance", _gap(left)).where(F.col("distance") <= F.col("l_grown"))
        if exclusive:
            same = G.geom_equals("l_geom", "r_geom") if left.geometry else F.lit(True)
            for c in _BOX:
                same = same & (F.col("l_" + c) == F.col("r_" + c))
            found = found.where(~same)
        rows = found.withColumn("rank", F.row_number().over(order) if k else F.rank().over(tied)).where(F.col("rank") <= (k or 1))
        return rows.select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "distance")

    own = Box(*(F.col("l_" + c) for c in _BOX))
    limit = F.lit(float(max_distance)) if max_distance is not None else F.lit(float("inf"))
    slim = left.slim("l_")
    rows = slim.select("l_id", *own_columns(own), *(["l_geom"] if left.geometry else []))
    if not count:
        return within(Side(slim.withColumn("__reach", F.lit(0.0)), "l_id", own, "l_geom" if left.geometry else None))

    def ranked() -> Column:
        """The wanted of the candidates: structs of distance and place."""
        least = call("Least", F.array(*(F.col("l_" + n) for n in _BOX)), F.col("boxes"), F.lit(0 if direct and not k else k or 1), F.lit((not direct) + 2 * exclusive))
        # the numbers in turn: a place in the list, and its distance
        distance = F.filter(least, lambda v, i: i % 2 == 1)
        place = F.transform(F.filter(least, lambda v, i: i % 2 == 0), lambda v: F.col("near")[v.cast("int")])
        return F.when(F.size(least) > 0, F.arrays_zip(distance.alias("distance"), place.alias("place")))

    served = []
    if count <= FEW:
        served.append(rows.withColumns(_all_places(places, bool(direct and k))).withColumn("near", ranked()).drop("boxes"))
    sizes = _cell_sizes(places, count, need) if count > FEW else []
    regular = len(sizes)
    for i, size in enumerate(sizes):
        at = F.floor((own.xmin + own.xmax) / 2 / size).alias("cx"), F.floor((own.ymin + own.ymax) / 2 / size).alias("cy")
        among = rows.select(*at).distinct() if i >= regular else None
        cells = written(_home_candidates(places, extent, size, need, bool(direct and k), (not direct) + 2 * (direct and not k), among))
        met = rows.select("*", *at).join(cells.hint("merge"), ["cx", "cy"], "left").drop("cx", "cy")
        met = written(met.withColumn("near", ranked()).drop("boxes"))
        served.append(met.where("near is not null"))
        rows = met.where("near is null").drop("near")
        # places may lie on lines, so that cells between them have none: many rows of such cells are served by wider ones
        if i + 1 == len(sizes) and size < extent.across / GRID and rows.count() * 9 * count > LEFT * GRID**2:
            sizes.append(4 * size)
    found = reduce(DataFrame.unionAll, served)
    side = lambda df: Side(df, "l_id", own, "l_geom" if left.geometry else None)
    bounded = lambda df, reach: side(df.withColumn("__reach", F.least(reach, limit)))
    out = []
    if count > FEW and not rows.isEmpty():
        out.append(within(bounded(rows, _enough(places, extent, need, own))))
    if direct and k:
        out.append(found.select(F.col("l_id").alias("left_id"), F.inline("near")).select("left_id", F.col("place").alias("right_id"), "distance"))
    elif direct:
        flat = found.select(F.col("l_id").alias("left_id"), F.inline("near")).select("left_id", "distance", *(F.col("place." + c).alias(c) for c in _BOX))
        ids = right.slim("r_").select("r_id", *(F.col("r_" + c).alias(c) for c in _BOX))
        out.append(flat.join(ids, list(_BOX)).select("left_id", F.col("r_id").alias("right_id"), "distance"))
    else:
        # a little more, for distances that are rounded
        out.append(within(bounded(found, F.element_at("near", -1)["distance"] * (1 + 1e-9))))
    return reduce(DataFrame.unionAll, out).where(F.col("distance") <= limit)


def own_columns(box: Box) -> list[Column]:
    return [c.alias("l_" + n) for c, n in zip((box.xmin, box.ymin, box.xmax, box.ymax), _BOX)]


def _enough(places: DataFrame, extent: Extent, need: int, box: Box) -> Column:
    """A distance from a box within which there are ``need`` of the places at least."""
    place = lambda lo, hi, low, high: F.least(F.floor(((F.col(lo) + F.col(hi)) / 2 - low) / ((high - low) or 1.0) * GRID), F.lit(GRID - 1))
    at = place("x0", "x1", extent.xmin, extent.xmax).alias("cx"), place("y0", "y1", extent.ymin, extent.ymax).alias("cy")
    # at most GRID * GRID rows
    cells = places.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("cx", "cy")
    told = np.array([[float(v) for v in r] for r in cells.collect()], ">f8").tobytes()
    # a little more, for distances that are rounded
    return call("Enough", F.array(box.xmin, box.ymin, box.xmax, box.ymax), F.lit(told), F.lit(need).cast("bigint")) * (1 + 1e-9)


def sjoin_nearest(
    left: Side,
    right: Side,
    how: str = "inner",
    max_distance: float | None = None,
    distance_col: str | None = None,
    exclusive: bool = False,
    attributes: bool = False,
    lsuffix: str = "left",
    rsuffix: str = "right",
) -> DataFrame:
    """(left_id, right_id[, distance]) with all ties; ``how`` left keeps left rows without a
    partner, right the right ones. With ``attributes`` both frames' columns, named as by ``sjoin``, in place of the ids."""
    if how not in ("inner", "left", "right"):
        raise ValueError(f"no such how: {how}")
    if attributes:
        l_out, r_out = _names(left, right, how, lsuffix, rsuffix)
        columns = ([F.col(c).alias(p + c) for c in out] for p, out in (("l.", l_out), ("r.", r_out)))
        rows, quoted = _near_rows(left, right, max_distance, exclusive, how, *columns), lambda name: F.col(f"`{name}`")
        named = [*(quoted("l." + c).alias(n) for c, n in l_out.items()), *(quoted("r." + c).alias(n) for c, n in r_out.items())]
        return rows.select(*named, *([F.col("distance").alias(distance_col)] if distance_col else []))
    found = nearest(left, right, None, max_distance, exclusive)
    if how == "left":
        found = left.df.select(F.col(left.id).alias("left_id")).join(found, "left_id", "left")
    elif how == "right":
        found = right.df.select(F.col(right.id).alias("right_id")).join(found, "right_id", "left").select("left_id", "right_id", "distance")
    return found.withColumnRenamed("distance", distance_col) if distance_col else found.drop("distance")


@dataclass(frozen=True)
class Index:
    """Questions to the boxes of one side."""

    side: Side

    def intersection(self, *at: float) -> DataFrame:
        """(id): rows whose boxes touch a box (xmin, ymin, xmax, ymax) or a place (x, y)."""
        x0, y0, x1, y1 = at if len(at) == 4 else (*at, *at)
        rows = self.side.slim("s_").where((F.col("s_x0") <= x1) & (F.col("s_x1") >= x0) & (F.col("s_y0") <= y1) & (F.col("s_y1") >= y0))
        return rows.select(F.col("s_id").alias("id"))

    def query(self, left: Side, predicate: str = "intersects", distance: float | str | None = None, sort: bool = False) -> DataFrame:
        """(left_id, right_id) of the pairs in a relation, in order if asked for."""
        found = pairs(left, self.side, predicate, distance).select("left_id", "right_id")
        return found.orderBy("left_id", "right_id") if sort else found

    def nearest(self, left: Side, **options) -> DataFrame:
        return nearest(left, self.side, **options)

    def size(self) -> int:
        """Rows that have a box."""
        return self.side.slim("s_").count()

    def is_empty(self) -> bool:
        return self.side.slim("s_").isEmpty()

    @staticmethod
    def valid_query_predicates() -> set[str]:
        return {*G.PREDICATES}


def distances(points: DataFrame, x: str, y: str, to: tuple[float, float]) -> Column:
    """Distance of a frame's points from one place."""
    return point_distance(points[x], points[y], F.lit(to[0]), F.lit(to[1]))
