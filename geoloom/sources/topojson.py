"""TopoJSON: shared arcs are decoded once each and stitched into lines and rings by a join on their numbers.

Arcs of a quantised file hold whole differences; a window sums them up. A reference below zero is an arc read backwards, and an arc that follows another leaves
out its first place, which is the other's last. A document is one string in one task until its arcs and geometries are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

_DOCUMENT = "arcs array<array<array<double>>>, transform struct<scale: array<double>, translate: array<double>>, objects map<string, string>"
_SHAPE = "type string, id string, properties map<string, string>, arcs string, coordinates string, geometries array<string>"


def _text(point: Column) -> Column:
    return F.concat_ws(" ", point["x"].cast("string"), point["y"].cast("string"))


def _run(points: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(points, _text), ", "), F.lit(")"))


def _shapes(documents: DataFrame) -> DataFrame:
    """(file, layer, shape number, parsed shape, transform) of all objects; collections are taken apart, to any depth of the first two."""
    rows = documents.select("file", "doc.transform", F.explode("doc.objects").alias("layer", "json")).withColumn("o", F.from_json("json", _SHAPE))
    for _ in range(2):
        members = F.when(F.col("o.type") == "GeometryCollection", F.transform(F.coalesce("o.geometries", F.array().cast("array<string>")), lambda g: F.from_json(g, _SHAPE)))
        rows = rows.select("file", "transform", "layer", F.explode(F.coalesce(members, F.array("o"))).alias("o"))
    return rows.withColumn("shape", F.row_number().over(Window.partitionBy("file").orderBy("layer", F.to_json("o"))))


def _arcs(documents: DataFrame) -> DataFrame:
    """(file, arc, points): each arc's places in order, in the coordinates of the document."""
    own = documents.select("file", "doc.transform", F.posexplode("doc.arcs").alias("arc", "steps"))
    steps = own.select("file", "arc", "transform", F.posexplode("steps").alias("at", "step"))
    so_far = Window.partitionBy("file", "arc").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quantised = F.col("transform").isNotNull()
    place = lambda i: F.when(quantised, F.sum(F.col("step")[i]).over(so_far) * F.col("transform.scale")[i] + F.col("transform.translate")[i]).otherwise(F.col("step")[i])
    points = steps.select("file", "arc", F.struct("at", place(0).alias("x"), place(1).alias("y")).alias("point"))
    return points.groupBy("file", "arc").agg(F.sort_array(F.collect_list("point")).alias("points"))


def read_topojson(spark: SparkSession, path: str) -> DataFrame:
    """(layer, id, properties map<string, string>, geometry) of a file's or folder's objects; a document is 2 GB at most."""
    documents = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", _DOCUMENT).alias("doc"))
    shapes = _shapes(documents)
    kind = F.col("o.type")
    ints = lambda depth: F.from_json("o.arcs", "array<" * depth + "int" + ">" * depth)
    # polygons of rings of arcs, whatever the type
    nested = F.when(kind == "LineString", F.array(F.array(ints(1)))).when(kind.isin("MultiLineString", "Polygon"), F.array(ints(2))).when(kind == "MultiPolygon", ints(3))
    rings = shapes.select("file", "shape", F.posexplode(nested).alias("part", "rings")).select("file", "shape", "part", F.posexplode("rings").alias("ring", "refs"))
    refs = rings.select("file", "shape", "part", "ring", F.posexplode("refs").alias("k", "ref"))
    refs = refs.withColumn("arc", F.when(F.col("ref") < 0, F.bitwise_not("ref")).otherwise(F.col("ref")))
    met = refs.join(_arcs(documents), ["file", "arc"]).withColumn("points", F.when(F.col("ref") < 0, F.reverse("points")).otherwise(F.col("points")))
    lines = met.groupBy("file", "shape", "part", "ring").agg(F.sort_array(F.collect_list(F.struct("k", "points"))).alias("arcs"))
    whole = F.flatten(F.transform("arcs", lambda a, i: F.when(i == 0, a["points"]).otherwise(F.slice(a["points"], 2, F.greatest(F.size(a["points"]) - 1, F.lit(0))))))
    parts = lines.groupBy("file", "shape", "part").agg(F.array_sort(F.collect_list(F.struct("ring", _run(whole).alias("text")))).alias("rings"))
    parts = parts.select("file", "shape", "part", F.array_join(F.transform("rings", lambda r: r["text"]), ", ").alias("text"))
    texts = parts.groupBy("file", "shape").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    stitched = F.transform("parts", lambda p: p["text"])
    wkt = F.when(kind == "LineString", F.concat(F.lit("LINESTRING "), stitched[0])).when(kind == "MultiLineString", F.concat(F.lit("MULTILINESTRING ("), stitched[0], F.lit(")")))
    wkt = wkt.when(kind == "Polygon", F.concat(F.lit("POLYGON ("), stitched[0], F.lit(")")))
    wkt = wkt.when(kind == "MultiPolygon", F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(stitched, lambda p: F.concat(F.lit("("), p, F.lit(")"))), ", "), F.lit(")")))
    moved = lambda c: F.struct(*(F.coalesce(c[i] * F.col("transform.scale")[i] + F.col("transform.translate")[i], c[i]).alias(n) for i, n in enumerate(("x", "y"))))
    wkt = wkt.when(kind == "Point", F.concat(F.lit("POINT ("), _text(moved(F.from_json("o.coordinates", "array<double>"))), F.lit(")")))
    wkt = wkt.when(kind == "MultiPoint", F.concat(F.lit("MULTIPOINT "), _run(F.transform(F.from_json("o.coordinates", "array<array<double>>"), moved))))
    rows = shapes.join(texts, ["file", "shape"], "left")
    return rows.select("layer", F.col("o.id").alias("id"), F.col("o.properties").alias("properties"), G.from_wkt(wkt).alias("geometry"))
