"""Readers and writers of vector formats. Geometry is read into a WKB column.

Files are read by Spark's own sources wherever a record is a line, an element or a row;
formats of one binary container are parsed by record in a task for each file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.planar import literal_box, wkb_point
from .flatgeobuf import read_flatgeobuf
from .geopackage import read_geopackage
from .geoparquet import geo_metadata, read_feather, read_geoparquet, to_feather, to_flatgeobuf, to_geoparquet
from . import native
from .osm import read_osm_pbf
from .topojson import read_topojson

#: Column names that hold coordinates or geometry in CSV files.
LATITUDE = ("lat", "latitude", "y")
LONGITUDE = ("lon", "lng", "long", "longitude", "x")
GEOMETRY = ("geometry", "geom", "wkt", "the_geom", "shape", "wkb")
FORMATS = {
    "parquet": "geoparquet", "geoparquet": "geoparquet", "feather": "feather", "arrow": "feather", "geojson": "geojson", "json": "geojson",
    "geojsonl": "geojsonseq", "geojsons": "geojsonseq", "csv": "csv", "wkt": "wkt", "kml": "kml", "gpx": "gpx", "shp": "shapefile",
    "gpkg": "geopackage", "pbf": "osm", "fgb": "flatgeobuf", "topojson": "topojson",
}


def read_file(
    spark: SparkSession,
    path: str,
    bbox: tuple[float, float, float, float] | None = None,
    mask: Column | None = None,
    columns: list[str] | None = None,
    target: tuple[int, int] | None = None,
    rows: int | None = None,
    **options,
) -> DataFrame:
    """Read by the format of the extension. ``bbox`` and ``mask`` leave out rows that do not touch
    them; ``target`` is a pair of CRS codes to reproject from and to; ``rows`` is how many are read at most."""
    if bbox is not None and mask is not None:
        raise ValueError("bbox and mask exclude each other")
    kind = FORMATS.get(path.rstrip("/").rpartition(".")[2].lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    if kind in ("geoparquet", "flatgeobuf"):
        df = {"geoparquet": read_geoparquet, "flatgeobuf": read_flatgeobuf}[kind](spark, path, bbox=bbox, **options)
    else:
        df = {
            "feather": read_feather, "geojson": read_geojson, "geojsonseq": read_geojsonseq, "csv": read_csv, "wkt": read_wkt,
            "kml": read_kml, "gpx": read_gpx, "shapefile": read_shapefile, "geopackage": read_geopackage, "osm": read_osm_pbf, "topojson": read_topojson,
        }[kind](spark, path, **options)
    if bbox is not None:
        df = df.where(G.intersects("geometry", literal_box(*bbox)))
    if mask is not None:
        df = df.where(G.intersects("geometry", mask))
    if target:
        df = df.withColumn("geometry", G.to_crs("geometry", *target))
    df = df if rows is None else df.limit(rows)
    return df.select(*columns, *(["geometry"] if "geometry" not in columns else [])) if columns else df


def list_layers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, geometry type) of the layers of a file; a type for each kind of a mixed layer, joined by a slash."""
    kind = FORMATS.get(path.rstrip("/").rpartition(".")[2].lower())
    if kind == "geopackage":
        from .geopackage import list_layers as of_container

        return of_container(spark, path)
    name = path.rstrip("/").rpartition("/")[2].rpartition(".")[0]
    own = (geo_metadata(path, spark) or {}) if kind == "geoparquet" else {}
    types = own.get("columns", {}).get(own.get("primary_column"), {}).get("geometry_types")
    if not types:
        rows = read_file(spark, path)
        found = rows.where(F.col("geometry").isNotNull()).select(G.geom_type("geometry").alias("t")).distinct().collect()
        types = sorted(r["t"] for r in found)
    return [(name, "/".join(types) or "Unknown")]


def read_geoparquet_batches(spark: SparkSession, path: str, batch_rows: int, **options) -> Iterator:
    """pandas frames of at most ``batch_rows`` rows, one task's rows at a time on the driver."""
    import pandas as pd

    df, rows = read_geoparquet(spark, path, **options), []
    for row in df.toLocalIterator():
        rows.append(row)
        if len(rows) == batch_rows:
            yield pd.DataFrame(rows, columns=df.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=df.columns)


def from_arrow(spark: SparkSession, table) -> DataFrame:
    """An Arrow table's rows; geometry in WKB, as points of two numbers, or as lists of coordinates with x, y (and z), becomes WKB by its extension name."""
    import pyarrow as pa

    names = {f.name: (f.metadata or {}).get(b"ARROW:extension:name", b"").decode() for f in table.schema}
    plain = pa.table([c.storage if isinstance(c, pa.ExtensionArray) else c for c in table.columns], schema=pa.schema([pa.field(f.name, f.type) for f in table.schema]))
    df = spark.createDataFrame(plain)
    for name, kind in names.items():
        is_struct = isinstance(df.schema[name].dataType, T.StructType)
        if kind.removeprefix("geoarrow.") in native.ENCODINGS and (is_struct or kind != "geoarrow.point"):
            df = df.withColumn(name, native.decoded(name, kind.removeprefix("geoarrow."), native.has_z(df, name)))
            continue
        if kind == "geoarrow.point" or (name == "geometry" and is_struct):
            x, y = (F.col(f"{name}.x"), F.col(f"{name}.y")) if is_struct else (F.col(name)[0], F.col(name)[1])
            df = df.withColumn(name, wkb_point(x, y))
    return df


def to_arrow(df: DataFrame, geometry: str = "geometry", geometry_encoding: str = "WKB", interleaved: bool = True, with_z: bool = False, crs: int | None = None):
    """The rows, gathered on the driver, as an Arrow table whose geometry column has its extension name: WKB, or for
    points ``geoarrow`` (pairs of numbers, or separate x and y), or one of ``native.ENCODINGS`` with separate coordinates."""
    import pyarrow as pa

    if geometry_encoding not in ("WKB", "geoarrow", *native.ENCODINGS):
        raise ValueError(f"no such encoding: {geometry_encoding}")
    pairs = geometry_encoding == "geoarrow"
    if geometry_encoding in native.ENCODINGS:
        df = df.withColumn(geometry, native.encoded(geometry, geometry_encoding, with_z))
    if pairs:
        known = F.col(geometry).isNotNull()
        parts = F.array(G.x(geometry), G.y(geometry)) if interleaved else F.struct(G.x(geometry).alias("x"), G.y(geometry).alias("y"))
        df = df.withColumn(geometry, F.when(known & (G.geom_type(geometry) == "Point"), parts).when(known, F.raise_error(F.lit("only points have this encoding"))))
    table = df.toArrow()
    column, at = table.column(geometry), table.schema.get_field_index(geometry)
    kind = pa.list_(pa.float64(), 2) if pairs and interleaved else column.type
    meta = {"ARROW:extension:name": "geoarrow." + ("point" if pairs else geometry_encoding.lower()), "ARROW:extension:metadata": json.dumps({} if crs is None else {"crs": f"EPSG:{crs}"})}
    return table.set_column(at, pa.field(geometry, kind, metadata=meta), column.cast(kind))


def _properties(ddl: str | None) -> str:
    return f"struct<{ddl}>" if ddl else "map<string, string>"


def wkb_of(g: dict | None) -> bytes | None:
    """WKB (two dimensions) of a GeoJSON geometry."""
    if not g:
        return None
    kind, c = g["type"], g.get("coordinates")
    code = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6, "GeometryCollection": 7}[kind]
    head = struct.pack("<BI", 1, code)

    def run(points) -> bytes:
        return struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", p[0], p[1]) for p in points)

    if kind == "Point":
        return head + (struct.pack("<dd", c[0], c[1]) if c else struct.pack("<dd", float("nan"), float("nan")))
    if kind == "LineString":
        return head + run(c)
    if kind == "Polygon":
        return head + struct.pack("<I", len(c)) + b"".join(map(run, c))
    parts = g["geometries"] if kind == "GeometryCollection" else [{"type": kind[5:], "coordinates": x} for x in c]
    return head + struct.pack("<I", len(parts)) + b"".join(wkb_of(p) for p in parts)


def read_geojson(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """A FeatureCollection (a document for each file) to a row for each feature; ``properties`` is
    their DDL, by default a map of text."""
    feature = f"struct<type: string, id: string, properties: {_properties(properties)}, geometry: string>"
    files = spark.read.text(path, wholetext=True)
    parsed = files.select(F.explode(F.from_json("value", f"struct<features: array<{feature}>>")["features"]).alias("f"))
    rows = parsed.select(F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), G.from_geojson("f.geometry").alias("geometry"))
    return rows.select("id", "properties.*", "geometry") if properties else rows


def read_geojsonseq(spark: SparkSession, path: str, properties: str | None = None) -> DataFrame:
    """A feature on each line."""
    feature = f"struct<type: string, id: string, properties: {_properties(properties)}, geometry: string>"
    rows = spark.read.text(path).select(F.from_json(F.ltrim("value", F.lit("\x1e")), feature).alias("f")).where("f is not null")
    rows = rows.select(F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), G.from_geojson("f.geometry").alias("geometry"))
    return rows.select("id", "properties.*", "geometry") if properties else rows


def features(df: DataFrame, geometry: str = "geometry", na: str = "null", show_bbox: bool = False, id: str | None = None) -> DataFrame:
    """A column ``feature`` with each row's GeoJSON; ``na`` null, drop or keep for null properties."""
    names = [c for c in df.columns if c not in (geometry, id)]
    props = F.struct(*names) if names else F.struct()
    text = F.to_json(props, {"ignoreNullFields": "true" if na == "drop" else "false"})
    parts = [F.lit('{"type":"Feature",')]
    if id:
        parts += [F.lit('"id":'), F.to_json(F.struct(F.col(id).cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(id).cast("string").alias("v")))) - 6), F.lit(",")]
    parts += [F.lit('"properties":'), text, F.lit(',"geometry":'), F.coalesce(G.to_geojson(geometry), F.lit("null"))]
    if show_bbox:
        b = G.bounds(geometry)
        parts += [F.lit(',"bbox":'), F.to_json(F.array(b["minx"], b["miny"], b["maxx"], b["maxy"]))]
    return df.select(F.concat(*parts, F.lit("}")).alias("feature"))


def to_json(df: DataFrame, geometry: str = "geometry", crs: int | None = None, to_wgs84: bool = False, **options) -> str:
    """The FeatureCollection, gathered on the driver."""
    if to_wgs84:
        if crs is None:
            raise ValueError("to_wgs84 needs a CRS")
        df = df.withColumn(geometry, G.to_crs(geometry, crs, 4326))
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in features(df, geometry, **options).toLocalIterator()) + "]}"


def to_geo_dict(df: DataFrame, **options) -> dict:
    return json.loads(to_json(df, **options))


def from_features(spark: SparkSession, collection: dict | list[dict], schema: str) -> DataFrame:
    """Rows of GeoJSON features; ``schema`` is the DDL of their properties."""
    listed = collection["features"] if isinstance(collection, dict) else collection
    names = T._parse_datatype_string(schema).fieldNames()
    rows = [(*(f["properties"].get(n) for n in names), bytearray(wkb_of(f["geometry"])) if f.get("geometry") else None) for f in listed]
    return spark.createDataFrame(rows, f"{schema}, geometry binary")


def from_dict(spark: SparkSession, data: dict[str, list], schema: str) -> DataFrame:
    return spark.createDataFrame(list(zip(*data.values())), schema)


def from_xy(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    return df.withColumn("geometry", wkb_point(x, y, z))


def geometry_from_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """The geometry column of a file, alone."""
    return read_file(spark, path, **options).select("geometry")


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", lat: str | None = None, lon: str | None = None, geometry: str | None = None, schema: str | None = None) -> DataFrame:
    """Latitude and longitude columns, or one of WKT or hexadecimal WKB; found by name if not given."""
    reader = spark.read.option("header", True).option("sep", delimiter)
    df = (reader.schema(schema) if schema else reader).csv(path)
    named = {c.lower(): c for c in df.columns}
    pick = lambda given, known: given or next((named[n] for n in known if n in named), None)
    shape, y, x = pick(geometry, GEOMETRY), pick(lat, LATITUDE), pick(lon, LONGITUDE)
    if shape:
        text = F.trim(F.col(shape))
        hexed = text.rlike("^[0-9A-Fa-f]+$")
        made = F.when(hexed, G.from_hex(F.when(hexed, text))).otherwise(G.from_wkt(F.when(~hexed, text)))
        return df.withColumn("__g", made).drop(shape).withColumnRenamed("__g", "geometry")
    if x and y:
        return df.withColumn("geometry", wkb_point(F.col(x).cast("double"), F.col(y).cast("double")))
    raise ValueError("no geometry and no coordinate columns")


def read_wkt(spark: SparkSession, path: str, on_invalid: str = "raise") -> DataFrame:
    """A geometry on each line."""
    return spark.read.text(path).where("trim(value) <> ''").select(G.from_wkt(F.trim("value"), on_invalid).alias("geometry"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemarks with points, lines, polygons or several of these: (name, geometry)."""
    ring = "struct<LinearRing: struct<coordinates: string>>"
    shapes = f"Point: array<struct<coordinates: string>>, LineString: array<struct<coordinates: string>>, Polygon: array<struct<outerBoundaryIs: {ring}, innerBoundaryIs: array<{ring}>>>"
    fields = T._parse_datatype_string(f"struct<{shapes}>")
    schema = T.StructType([T.StructField("name", T.StringType()), *fields.fields, T.StructField("MultiGeometry", fields)])
    df = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)

    def run(text: Column) -> Column:
        pairs = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
        return F.array_join(F.transform(pairs, lambda t: F.concat_ws(" ", F.split(t, ",")[0], F.split(t, ",")[1])), ", ")

    def listed(column: str, wkt: Callable[[Column], Column]) -> Column:
        both = F.concat(*(F.coalesce(c, F.array().cast(fields[column].dataType)) for c in (F.col(column), F.col(f"MultiGeometry.{column}"))))
        return F.transform(both, wkt)

    def polygon(p: Column) -> Column:
        rings = F.concat(F.array(p["outerBoundaryIs"]), F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{ring}>")))
        return F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, lambda r: F.concat(F.lit("("), run(r["LinearRing"]["coordinates"]), F.lit(")"))), ", "), F.lit(")"))

    line = lambda kind: lambda p: F.concat(F.lit(kind + " ("), run(p["coordinates"]), F.lit(")"))
    parts = F.concat(listed("Point", line("POINT")), listed("LineString", line("LINESTRING")), listed("Polygon", polygon))
    # one shape stays as it is, several of a kind become a multi-geometry
    made = G.gathered("collect", F.transform(parts, lambda t: G.from_wkt(t)))
    return df.select("name", F.when(F.size(parts) > 0, made).alias("geometry"))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Way points: (name, ele, geometry)."""
    df = spark.read.format("xml").option("rowTag", "wpt").schema("_lat double, _lon double, name string, ele double").load(path)
    return df.select("name", "ele", wkb_point("_lon", "_lat").alias("geometry"))


def shapefile_records(data: bytes) -> Iterator[bytes | None]:
    """WKB of each record of a .shp file: points, multi-points, lines and polygons, Z and M left out."""

    def runs(at: int) -> list[list[tuple[float, float]]]:
        n_parts, n_points = struct.unpack_from("<2i", data, at + 36)
        starts = [*struct.unpack_from(f"<{n_parts}i", data, at + 44), n_points]
        flat = struct.unpack_from(f"<{2 * n_points}d", data, at + 44 + 4 * n_parts)
        points = list(zip(flat[::2], flat[1::2]))
        return [points[a:b] for a, b in zip(starts, starts[1:])]

    at = 100
    while at + 12 <= len(data):
        size = 2 * struct.unpack_from(">i", data, at + 4)[0]
        at += 8
        kind = struct.unpack_from("<i", data, at)[0] % 10
        if kind == 0:
            yield None
        elif kind == 1:
            yield wkb_of({"type": "Point", "coordinates": struct.unpack_from("<2d", data, at + 4)})
        elif kind == 8:
            n = struct.unpack_from("<i", data, at + 36)[0]
            flat = struct.unpack_from(f"<{2 * n}d", data, at + 40)
            yield wkb_of({"type": "MultiPoint", "coordinates": list(zip(flat[::2], flat[1::2]))})
        elif kind == 3:
            lines = runs(at)
            yield wkb_of({"type": "LineString", "coordinates": lines[0]} if len(lines) == 1 else {"type": "MultiLineString", "coordinates": lines})
        elif kind == 5:
            polygons: list[list] = []
            for ring in runs(at):
                twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
                if twice <= 0 or not polygons:  # outer rings run clockwise
                    polygons.append([ring])
                else:
                    polygons[-1].append(ring)
            yield wkb_of({"type": "Polygon", "coordinates": polygons[0]} if len(polygons) == 1 else {"type": "MultiPolygon", "coordinates": polygons})
        else:
            raise ValueError(f"shape type {kind}")
        at += size


def dbf_records(data: bytes) -> Iterator[dict[str, str | None]]:
    """Attributes of each record of a .dbf file, as text."""
    count, head, size = struct.unpack_from("<IHH", data, 4)
    fields = []
    for at in range(32, head - 1, 32):
        if data[at] == 0x0D:
            break
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), data[at + 16]))
    for i in range(count):
        at, row = head + i * size + 1, {}
        for name, width in fields:
            row[name] = data[at : at + width].decode("utf-8", "replace").strip() or None
            at += width
        yield row


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(attributes map<string, string>, geometry): a task for each .shp file, its .dbf beside it."""
    stem = path[:-4] if path.lower().endswith(".shp") else path.rstrip("/") + "/*"
    files = spark.read.format("binaryFile").load([stem + ".shp", stem + ".dbf"]).select(F.regexp_replace("path", r"\.(shp|dbf)$", "").alias("stem"), F.lower(F.right("path", F.lit(3))).alias("kind"), "content")
    both = files.groupBy("stem").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf"))

    def run(frames):
        import itertools

        import pandas as pd

        for frame in frames:
            for shp, dbf in zip(frame["shp"], frame["dbf"]):
                rows = itertools.zip_longest(shapefile_records(bytes(shp)), dbf_records(bytes(dbf)) if dbf is not None else ())
                yield pd.DataFrame([(a or {}, g) for g, a in rows], columns=["attributes", "geometry"])

    return both.mapInPandas(run, "attributes map<string, string>, geometry binary")


def read_postgis(spark: SparkSession, url: str, query: str, geometry: str = "geom", **options) -> DataFrame:
    """A query over JDBC; EWKB loses its SRID."""
    df = spark.read.format("jdbc").options(url=url, query=query, **options).load()
    return df.withColumn(geometry, strip_srid(F.col(geometry), dict(df.dtypes)[geometry] == "string"))


def strip_srid(value: Column, hex: bool = False) -> Column:
    """WKB from EWKB bytes, or from their hexadecimal text."""
    from ..functions.jts import call

    none = F.lit(None)
    return call("Plain", value if hex else none.cast("string"), none.cast("binary") if hex else value)


def to_postgis(df: DataFrame, url: str, table: str, if_exists: str = "fail", geometry: str = "geometry", **options) -> None:
    mode = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}[if_exists]
    df.withColumn(geometry, G.to_wkb(geometry, hex=True)).write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def to_file(df: DataFrame, path: str, geometry: str = "geometry", driver: str | None = None) -> None:
    """GeoParquet, GeoJSON lines, CSV with WKT, WKT lines, Feather or FlatGeobuf, by the extension or driver."""
    kind = driver or FORMATS.get(path.rpartition(".")[2].lower())
    if kind == "geoparquet":
        to_geoparquet(df, path, geometry)
    elif kind in ("geojson", "geojsonseq"):
        features(df, geometry).write.text(path)
    elif kind == "csv":
        df.withColumn(geometry, G.to_wkt(geometry)).write.option("header", True).csv(path)
    elif kind == "wkt":
        df.select(G.to_wkt(geometry)).write.text(path)
    elif kind == "feather":
        to_feather(df, path)
    elif kind == "flatgeobuf":
        to_flatgeobuf(df, path, geometry)
    else:
        raise ValueError(f"no writer for {path}")
