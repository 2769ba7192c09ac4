"""Functions on geometry columns (WKB, planar): measures, predicates, constructions.

Null gives null, but null is not valid, not empty and in no relation. An empty geometry has
area and length 0 and bounds NaN, and is in no relation.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .crs import Crs, by_code, from_projjson
from .jts import call, numbers

ColumnOrName = Column | str
Value = float | Column

ROUND, FLAT, SQUARE = 1, 2, 3
CAPS = {"round": 1, "flat": 2, "square": 3}
JOINS = {"round": 1, "mitre": 2, "bevel": 3}
PREDICATES = ("intersects", "within", "contains", "contains_properly", "overlaps", "crosses", "touches", "covers", "covered_by", "dwithin")


def _c(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _n(value: Value) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def _number(op: str, g: ColumnOrName, *more: Value) -> Column:
    return call("Number", F.lit(op), _c(g), numbers(*more) if more else F.expr("cast(array() as array<double>)"))


def _shape(op: str, g: ColumnOrName, *more: Value) -> Column:
    return call("Shape", F.lit(op), _c(g), numbers(*more) if more else F.expr("cast(array() as array<double>)"))


# ------------------------------------------------------------------ reading and writing values


def from_wkb(data: ColumnOrName, on_invalid: str = "raise") -> Column:
    """WKB bytes, or their hexadecimal text, to a geometry; ``on_invalid`` raise, ignore (null), warn (null and
    a line in the executor's log) or fix."""
    return call("Parse", F.lit("wkb"), F.hex(_c(data)), F.lit(on_invalid))


def from_hex(data: ColumnOrName, on_invalid: str = "raise") -> Column:
    return call("Parse", F.lit("wkb"), _c(data), F.lit(on_invalid))


def from_wkt(text: ColumnOrName, on_invalid: str = "raise") -> Column:
    return call("Parse", F.lit("wkt"), _c(text), F.lit(on_invalid))


def from_geojson(text: ColumnOrName, on_invalid: str = "raise") -> Column:
    return call("Parse", F.lit("geojson"), _c(text), F.lit(on_invalid))


def to_wkb(g: ColumnOrName, hex: bool = False) -> Column:
    return F.lower(F.hex(_c(g))) if hex else _c(g)


def to_wkt(g: ColumnOrName) -> Column:
    return call("Text", F.lit("wkt"), _c(g))


def to_geojson(g: ColumnOrName) -> Column:
    return call("Text", F.lit("geojson"), _c(g))


# ------------------------------------------------------------------ measures and properties


def area(g: ColumnOrName) -> Column:
    return _number("area", g)


def length(g: ColumnOrName) -> Column:
    return _number("length", g)


def geom_type(g: ColumnOrName) -> Column:
    return call("Text", F.lit("type"), _c(g))


def settled(c: ColumnOrName) -> Column:
    """``c`` as it is, computed once: filters above are not pushed below it with a copy of ``c``.

    Filters that are pushed through projections repeat the projected expression, so a chain of
    operators on a geometry would grow without bound. Catalyst does not move filters past an
    expression that it holds to be non-deterministic, as the number of a partition is.
    """
    return F.when(F.spark_partition_id() >= 0, F.col(c) if isinstance(c, str) else c)


def bounds(g: ColumnOrName) -> Column:
    """struct<minx, miny, maxx, maxy>; NaN for an empty geometry."""
    return F.struct(*(_number(side, g).alias(side) for side in ("minx", "miny", "maxx", "maxy")))


def is_valid(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("is_valid"), _c(g))


def is_valid_reason(g: ColumnOrName) -> Column:
    return call("Text", F.lit("valid_reason"), _c(g))


def is_empty(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("is_empty"), _c(g))


def is_simple(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("is_simple"), _c(g))


def is_ring(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("is_ring"), _c(g))


def is_ccw(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("is_ccw"), _c(g))


def is_closed(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("is_closed"), _c(g))


def has_z(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("has_z"), _c(g))


def has_m(g: ColumnOrName) -> Column:
    return call("Flag", F.lit("has_m"), _c(g))


def count_coordinates(g: ColumnOrName) -> Column:
    return _number("num_coordinates", g).cast("long")


def count_geometries(g: ColumnOrName) -> Column:
    return _number("num_geometries", g).cast("long")


def count_interior_rings(g: ColumnOrName) -> Column:
    return _number("num_holes", g).cast("long")


def get_precision(g: ColumnOrName) -> Column:
    """Grid size of the coordinates: 0, floating."""
    return F.when(_c(g).isNotNull(), F.lit(0.0))


def get_geometry(g: ColumnOrName, index: Value) -> Column:
    """The part at ``index`` (negative: from the end), null out of range."""
    return _shape("part", g, index)


def x(g: ColumnOrName) -> Column:
    return _number("x", g)


def y(g: ColumnOrName) -> Column:
    return _number("y", g)


def z(g: ColumnOrName) -> Column:
    return _number("z", g)


def m(g: ColumnOrName) -> Column:
    return _number("m", g)


def minimum_bounding_radius(g: ColumnOrName) -> Column:
    return _number("bounding_radius", g)


def minimum_clearance(g: ColumnOrName) -> Column:
    return _number("clearance", g)


# ------------------------------------------------------------------ relations of two geometries


def relates(predicate: str, a: ColumnOrName, b: ColumnOrName, distance: Value = 0.0) -> Column:
    return call("Relates", F.lit(predicate), _c(a), _c(b), _n(distance))


def intersects(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("intersects", a, b)


def disjoint(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("disjoint", a, b)


def contains(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("contains", a, b)


def contains_properly(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("contains_properly", a, b)


def within(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("within", a, b)


def covers(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("covers", a, b)


def covered_by(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("covered_by", a, b)


def crosses(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("crosses", a, b)


def overlaps(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("overlaps", a, b)


def touches(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("touches", a, b)


def dwithin(a: ColumnOrName, b: ColumnOrName, distance: Value) -> Column:
    return relates("dwithin", a, b, distance)


def geom_equals(a: ColumnOrName, b: ColumnOrName) -> Column:
    return relates("equals", a, b)


def geom_equals_exact(a: ColumnOrName, b: ColumnOrName, tolerance: Value) -> Column:
    return relates("equals_exact", a, b, tolerance)


def geom_equals_identical(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.coalesce(_c(a) == _c(b), F.lit(False))


def relate(a: ColumnOrName, b: ColumnOrName) -> Column:
    """The DE-9IM matrix as text."""
    return call("Relate", _c(a), _c(b), F.lit(""))


def relate_pattern(a: ColumnOrName, b: ColumnOrName, pattern: str) -> Column:
    return F.coalesce(call("Relate", _c(a), _c(b), F.lit(pattern)).cast("boolean"), F.lit(False))


def distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return call("PairNumber", F.lit("distance"), _c(a), _c(b), F.lit(0.0))


def hausdorff_distance(a: ColumnOrName, b: ColumnOrName, densify: float = 0.0) -> Column:
    return call("PairNumber", F.lit("hausdorff"), _c(a), _c(b), F.lit(float(densify)))


def frechet_distance(a: ColumnOrName, b: ColumnOrName, densify: float = 0.0) -> Column:
    return call("PairNumber", F.lit("frechet"), _c(a), _c(b), F.lit(float(densify)))


def project(line: ColumnOrName, point: ColumnOrName, normalized: bool = False) -> Column:
    """Distance along the line of its place nearest to the point."""
    return call("PairNumber", F.lit("project"), _c(line), _c(point), F.lit(float(normalized)))


def shortest_line(a: ColumnOrName, b: ColumnOrName) -> Column:
    return call("PairShape", F.lit("shortest_line"), _c(a), _c(b), F.lit(0.0))


def interpolate(line: ColumnOrName, distance: Value, normalized: bool = False) -> Column:
    """The point at a distance along the line; negative counts from its end."""
    return _shape("interpolate", line, distance, float(normalized))


# ------------------------------------------------------------------ constructions of two geometries


def intersection(a: ColumnOrName, b: ColumnOrName, grid_size: float = 0.0) -> Column:
    return call("PairShape", F.lit("intersection"), _c(a), _c(b), F.lit(float(grid_size)))


def union(a: ColumnOrName, b: ColumnOrName, grid_size: float = 0.0) -> Column:
    return call("PairShape", F.lit("union"), _c(a), _c(b), F.lit(float(grid_size)))


def difference(a: ColumnOrName, b: ColumnOrName, grid_size: float = 0.0) -> Column:
    return call("PairShape", F.lit("difference"), _c(a), _c(b), F.lit(float(grid_size)))


def symmetric_difference(a: ColumnOrName, b: ColumnOrName, grid_size: float = 0.0) -> Column:
    return call("PairShape", F.lit("symmetric_difference"), _c(a), _c(b), F.lit(float(grid_size)))


def snap(a: ColumnOrName, b: ColumnOrName, tolerance: float) -> Column:
    return call("PairShape", F.lit("snap"), _c(a), _c(b), F.lit(float(tolerance)))


def shared_paths(a: ColumnOrName, b: ColumnOrName) -> Column:
    """A collection of two multi-lines: shared paths of the same and of opposite direction."""
    return call("PairShape", F.lit("shared_paths"), _c(a), _c(b), F.lit(0.0))


# ------------------------------------------------------------------ constructions of one geometry


def buffer(
    g: ColumnOrName,
    distance: Value,
    quad_segs: int = 16,
    cap_style: str = "round",
    join_style: str = "round",
    mitre_limit: float = 5.0,
    single_sided: bool = False,
) -> Column:
    return _shape("buffer", g, distance, quad_segs, CAPS[cap_style], JOINS[join_style], mitre_limit, float(single_sided))


def offset_curve(g: ColumnOrName, distance: Value, quad_segs: int = 8, join_style: str = "round", mitre_limit: float = 5.0) -> Column:
    return _shape("offset_curve", g, distance, quad_segs, JOINS[join_style], mitre_limit)


def boundary(g: ColumnOrName) -> Column:
    return _shape("boundary", g)


def centroid(g: ColumnOrName) -> Column:
    return _shape("centroid", g)


def representative_point(g: ColumnOrName) -> Column:
    return _shape("representative_point", g)


def convex_hull(g: ColumnOrName) -> Column:
    return _shape("convex_hull", g)


def concave_hull(g: ColumnOrName, ratio: float = 0.0, allow_holes: bool = False) -> Column:
    return _shape("concave_hull", g, ratio, float(allow_holes))


def envelope(g: ColumnOrName) -> Column:
    return _shape("envelope", g)


def minimum_rotated_rectangle(g: ColumnOrName) -> Column:
    return _shape("rotated_rectangle", g)


def minimum_bounding_circle(g: ColumnOrName) -> Column:
    return _shape("bounding_circle", g)


def maximum_inscribed_circle(g: ColumnOrName, tolerance: float = 0.0) -> Column:
    """The line from the circle's centre to the boundary."""
    return _shape("inscribed_circle", g, tolerance)


def minimum_clearance_line(g: ColumnOrName) -> Column:
    return _shape("clearance_line", g)


def exterior(g: ColumnOrName) -> Column:
    return _shape("exterior", g)


def interiors(g: ColumnOrName) -> Column:
    """array of the inner rings; null for what is no polygon."""
    return call("Parts", F.lit("interiors"), _c(g), F.lit(0.0))


def extract_unique_points(g: ColumnOrName) -> Column:
    return _shape("unique_points", g)


def remove_repeated_points(g: ColumnOrName, tolerance: float = 0.0) -> Column:
    return _shape("without_repeats", g, tolerance)


def set_precision(g: ColumnOrName, grid_size: float, mode: str = "valid_output") -> Column:
    return _shape("precision", g, grid_size, ("valid_output", "pointwise", "keep_collapsed").index(mode))


def simplify(g: ColumnOrName, tolerance: Value, preserve_topology: bool = True) -> Column:
    return _shape("simplify", g, tolerance, float(preserve_topology))


def normalize(g: ColumnOrName) -> Column:
    return _shape("normalize", g)


def orient_polygons(g: ColumnOrName, exterior_cw: bool = False) -> Column:
    return _shape("orient", g, float(exterior_cw))


def make_valid(g: ColumnOrName, method: str = "linework", keep_collapsed: bool = True) -> Column:
    return _shape("make_valid", g, float(method == "structure"), float(keep_collapsed))


def reverse(g: ColumnOrName) -> Column:
    return _shape("reverse", g)


def segmentize(g: ColumnOrName, max_segment_length: float) -> Column:
    return _shape("segmentize", g, max_segment_length)


def line_merge(g: ColumnOrName, directed: bool = False) -> Column:
    return _shape("line_merge", g, float(directed))


def force_2d(g: ColumnOrName) -> Column:
    return _shape("force_2d", g)


def force_3d(g: ColumnOrName, z: Value = 0.0) -> Column:
    return _shape("force_3d", g, z)


def constrained_delaunay_triangles(g: ColumnOrName) -> Column:
    return call("Parts", F.lit("constrained_triangles"), _c(g), F.lit(0.0))


def clip_by_rect(g: ColumnOrName, xmin: Value, ymin: Value, xmax: Value, ymax: Value) -> Column:
    return _shape("clip_rect", g, xmin, ymin, xmax, ymax)


def collection_extract(g: ColumnOrName, dimension: int) -> Column:
    """The parts of a dimension (0 points, 1 lines, 2 polygons)."""
    return _shape("extract", g, dimension)


def sample_points(g: ColumnOrName, size: Value, seed: Value = 0) -> Column:
    return _shape("sample", g, size, seed)


def dump(g: ColumnOrName) -> Column:
    """array of the parts."""
    return call("Parts", F.lit("dump"), _c(g), F.lit(0.0))


def points(g: ColumnOrName) -> Column:
    return call("Parts", F.lit("points"), _c(g), F.lit(0.0))


def coordinates(g: ColumnOrName) -> Column:
    """array<struct<x, y, z, m>> of the vertices."""
    flat = call("Vertices", F.lit("xyzm"), _c(g))
    at = lambda i, k: F.element_at(flat, (i * 4 + k + 1).cast("int"))
    one = lambda i: F.struct(at(i, 0).alias("x"), at(i, 1).alias("y"), at(i, 2).alias("z"), at(i, 3).alias("m"))
    count = F.floor(F.size(flat) / F.lit(4))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), one)).when(flat.isNotNull(), F.expr("array()"))


# ------------------------------------------------------------------ affine and CRS


def affine_transform(g: ColumnOrName, matrix: list[float]) -> Column:
    """Six coefficients a, b, d, e, xoff, yoff, or twelve: a, b, c, d, e, f, g, h, i, xoff, yoff, zoff.

    With twelve, z is 0 in the sums of a vertex without one, and that stays without one.
    """
    if len(matrix) == 12:
        return _shape("affine_3d", g, *matrix)
    if len(matrix) != 6:
        raise ValueError("six or twelve coefficients are needed")
    a, b, d, e, xoff, yoff = matrix
    return _shape("affine", g, a, b, d, e, xoff, yoff)


def translate(g: ColumnOrName, xoff: Value = 0.0, yoff: Value = 0.0, zoff: Value = 0.0) -> Column:
    if isinstance(zoff, Column) or zoff:
        return _shape("affine_3d", g, 1, 0, 0, 0, 1, 0, 0, 0, 1, xoff, yoff, zoff)
    return _shape("affine", g, 1, 0, 0, 1, xoff, yoff)


def transform(g: ColumnOrName, function: Callable[..., tuple[Column, ...]], include_z: bool = False) -> Column:
    """Vertices moved by expressions: ``function`` takes x and y (and z) and returns as many columns."""
    flat = call("Vertices", F.lit("xyzm"), _c(g))
    vertex = lambda i: [F.element_at(flat, (i * 4 + k + 1).cast("int")) for k in range(3 if include_z else 2)]
    count = F.floor(F.size(flat) / F.lit(4)).cast("int")

    def moved(i: Column) -> Column:
        made = [c.cast("double") for c in function(*vertex(i))]
        return F.array(*made, *([] if len(made) == 3 else [F.lit(None).cast("double")]))

    values = F.flatten(F.transform(F.sequence(F.lit(0), count - 1), moved))
    return F.when(count > 0, call("Moved", _c(g), F.when(count > 0, values))).otherwise(_c(g))


def _origin(origin: str | tuple[float, float]) -> tuple[float, float, float]:
    if isinstance(origin, tuple):
        return 2.0, float(origin[0]), float(origin[1])
    return float(("center", "centroid").index(origin)), 0.0, 0.0


def _radians(angle: float, use_radians: bool) -> float:
    import math

    return angle if use_radians else math.radians(angle)


def rotate(g: ColumnOrName, angle: float, origin: str | tuple[float, float] = "center", use_radians: bool = False) -> Column:
    return _shape("rotate", g, _radians(angle, use_radians), *_origin(origin))


def scale(g: ColumnOrName, xfact: float = 1.0, yfact: float = 1.0, zfact: float = 1.0, origin: str | tuple[float, float] | tuple[float, float, float] = "center") -> Column:
    """Stretched about an origin; z is stretched about the third number of a point, 0 by default."""
    flat = _shape("scale", g, xfact, yfact, *_origin(origin[:2] if isinstance(origin, tuple) else origin))
    if zfact == 1.0:
        return flat
    z = float(origin[2]) if isinstance(origin, tuple) and len(origin) > 2 else 0.0
    return _shape("affine_3d", flat, 1, 0, 0, 0, 1, 0, 0, 0, zfact, 0, 0, z - zfact * z)


def skew(g: ColumnOrName, xs: float = 0.0, ys: float = 0.0, origin: str | tuple[float, float] = "center", use_radians: bool = False) -> Column:
    return _shape("skew", g, _radians(xs, use_radians), _radians(ys, use_radians), *_origin(origin))


#: EPSG codes of projections besides Web Mercator and UTM: world Mercator, conics of France, Europe, the
#: United States and Australia, and Europe's azimuthal one. Their datums are taken as WGS 84.
PROJECTED = (3395, 2154, 3034, 5070, 3577, 3035)


def to_crs(g: ColumnOrName, source: int | dict | Crs, target: int | dict | Crs) -> Column:
    """Reproject every vertex. A system is an EPSG code (4326, 3857, UTM zones, ``PROJECTED`` and what ``crs.by_code`` knows), PROJJSON or a ``Crs``.

    Systems given by parameters are moved through the datum shifts of both. 5070 and 3577 have datums
    that are a metre or two off WGS 84, which is not corrected: a warning says so.
    """
    if source == target:
        return _c(g)
    old = lambda code: isinstance(code, int) and (code in (4326, 3857, *PROJECTED) or code // 100 in (326, 327))
    for code in (source, target):
        if code in (5070, 3577):
            warnings.warn(f"the datum of {code} is taken as WGS 84, which is a metre or two off", stacklevel=2)
    if not (old(source) and old(target)):
        known = [c if isinstance(c, Crs) else from_projjson(c) if isinstance(c, dict) else by_code(c) for c in (source, target)]
        if known[0] is None and old(source):
            return to_crs(to_crs(g, source, 4326), 4326, target)
        if known[1] is None and old(target):
            return to_crs(to_crs(g, source, 4326), 4326, target)
        if None in known:
            raise NotImplementedError(f"CRS {source if known[0] is None else target}")
        return call("Reproject", _c(g), numbers(*known[0].numbers), numbers(*known[1].numbers))

    def step(code: int, names: tuple[str, str, str], g: ColumnOrName) -> Column:
        if code == 3857:
            return _shape(names[0], g)
        if code // 100 in (326, 327) and 1 <= code % 100 <= 60:
            return _shape(names[1], g, code % 100, float(code // 100 == 327))
        if code in PROJECTED:
            return _shape(names[2], g, code)
        raise NotImplementedError(f"CRS {code}")

    if source != 4326:
        g = step(source, ("from_mercator", "from_utm", "from_projected"), g)
    return _c(g) if target == 4326 else step(target, ("mercator", "utm", "projected"), g)


# ------------------------------------------------------------------ aggregates over gathered geometries


def gathered(op: str, geometries: Column, *more: Value) -> Column:
    return call("Gathered", F.lit(op), geometries, numbers(*more) if more else F.expr("cast(array() as array<double>)"))


def gathered_parts(op: str, geometries: Column, *more: Value) -> Column:
    return call("GatheredParts", F.lit(op), geometries, numbers(*more) if more else F.expr("cast(array() as array<double>)"))
