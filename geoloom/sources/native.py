"""Geometry columns as nested lists of coordinates, as GeoParquet and Arrow name them, and back; all by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import geometry as G

#: The encodings, with the depth of their lists and the geometry types that they hold.
ENCODINGS = {
    "point": (0, ("Point",)), "linestring": (1, ("LineString",)), "polygon": (2, ("Polygon",)), "multipoint": (1, ("MultiPoint", "Point")),
    "multilinestring": (2, ("MultiLineString", "LineString")), "multipolygon": (3, ("MultiPolygon", "Polygon")),
}
NAMES = {"point": "Point", "linestring": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multilinestring": "MultiLineString", "multipolygon": "MultiPolygon"}


def encoded(geometry: str, encoding: str, with_z: bool = False) -> Column:
    """A geometry column's coordinates, structs of x, y (and z) in lists; a geometry of another type is an error.

    An empty geometry has empty lists, an empty point NaN; of a single geometry in a multi encoding there is one part.
    """
    depth, kinds = ENCODINGS[encoding]
    one = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), *[c["z"].alias("z")] * with_z)
    run = lambda g: F.transform(G.coordinates(g), one)
    rings = lambda g: F.when(G.is_empty(g), F.array().cast(_kind(2, with_z))).otherwise(F.transform(F.concat(F.array(G.exterior(g)), G.interiors(g)), run))
    g = F.col(geometry)
    made = {
        "point": lambda: F.struct(G.x(g).alias("x"), G.y(g).alias("y"), *[G.z(g).alias("z")] * with_z),
        "linestring": lambda: run(g), "polygon": lambda: rings(g), "multipoint": lambda: run(g),
        "multilinestring": lambda: F.transform(G.dump(g), run), "multipolygon": lambda: F.transform(G.dump(g), rings),
    }[encoding]().cast(_kind(depth, with_z))
    other = F.raise_error(F.concat(F.lit(f"no {encoding}: "), G.geom_type(g))).cast(_kind(depth, with_z))
    return F.when(g.isNotNull(), F.when(G.geom_type(g).isin(*kinds), made).otherwise(other))


def _kind(depth: int, with_z: bool) -> str:
    point = f"struct<x: double, y: double{', z: double' if with_z else ''}>"
    return "array<" * depth + point + ">" * depth


def has_z(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    while isinstance(kind, ArrayType):
        kind = kind.elementType
    return isinstance(kind, StructType) and "z" in kind.names


def decoded(column: str, encoding: str, with_z: bool = False) -> Column:
    """WKB of nested coordinates. Numbers are written so that they read back as they are."""
    depth, _ = ENCODINGS[encoding]
    text = lambda c: F.concat_ws(" ", *(c[n].cast("string") for n in ("x", "y", "z")[: 2 + with_z]))
    joined = lambda items, each: F.concat(F.lit("("), F.array_join(F.transform(items, each), ", "), F.lit(")"))
    value, name = F.col(column), NAMES[encoding].upper() + (" Z" if with_z else "")
    empty = F.lit(f"{name} EMPTY")
    if depth == 0:
        body = F.when(F.isnan(value["x"]), empty).otherwise(F.concat(F.lit(f"{name} ("), text(value), F.lit(")")))
    else:
        levels = [text, lambda run: joined(run, text), lambda rings: joined(rings, lambda run: joined(run, text))]
        if encoding == "multipoint":
            levels[0] = lambda c: F.concat(F.lit("("), text(c), F.lit(")"))
        body = F.when(F.size(value) == 0, empty).otherwise(F.concat(F.lit(name + " "), joined(value, levels[depth - 1])))
    return F.when(value.isNotNull(), G.from_wkt(body))
