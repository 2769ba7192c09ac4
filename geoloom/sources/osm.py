"""OSM PBF: nodes as points, ways as lines or polygons, multipolygon relations as areas.

A task cuts each file into its compressed blocks, which are then dealt to all tasks and decoded
one by one, so a task holds a block, not a file's elements. References to nodes and to ways are
resolved by joins. A single file is at most 2 GB, as it is one binary value; larger extracts are
read as several files in a folder.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.planar import wkb_point

NAMES = ["kind", "osm_id", "lon", "lat", "refs", "roles", "ref_kinds", "tags"]
ELEMENTS = "kind string, osm_id bigint, lon double, lat double, refs array<bigint>, roles array<string>, ref_kinds array<int>, tags map<string, string>"
#: Kinds of relation members.
NODE, WAY, RELATION = 0, 1, 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("damaged message")
        yield key >> 3, value


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in _fields(data):
        out.setdefault(number, []).append(value)
    return out


def _packed(values: list | None) -> list[int]:
    """Numbers of a repeated field, packed or one by one."""
    out = []
    for value in values or ():
        if isinstance(value, int):
            out.append(value)
            continue
        at = 0
        while at < len(value):
            number, at = _varint(value, at)
            out.append(number)
    return out


def _signed(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


def _wide(value: int) -> int:
    """A 64-bit two's complement number from its unsigned form."""
    return value - (1 << 64) if value >> 63 else value


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for value in values:
        total += _signed(value)
        out.append(total)
    return out


def blocks(data: bytes) -> Iterator[bytes]:
    """The data blocks of a file, still compressed."""
    at = 0
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0]
        head = _message(data[at + 4 : at + 4 + size])
        at += 4 + size
        body = head[3][0]
        if head[1][0] == b"OSMData":
            yield data[at : at + body]
        at += body


def elements(blob: bytes) -> Iterator[tuple]:
    """The rows (as `ELEMENTS`) of one block."""
    found = _message(blob)
    if 1 in found:
        raw = found[1][0]
    elif 3 in found:
        raw = zlib.decompress(found[3][0])
    else:
        raise ValueError("only raw and zlib blocks are read")
    block = _message(raw)
    texts = [t.decode("utf-8", "replace") for t in _message(block[1][0]).get(1, [])]
    grain = block.get(17, [100])[0]
    south, west = _wide(block.get(19, [0])[0]), _wide(block.get(20, [0])[0])
    degrees = lambda base, value: (base + grain * value) / 1e9
    tags_of = lambda m: {texts[k]: texts[v] for k, v in zip(_packed(m.get(2)), _packed(m.get(3)))}
    for group in map(_message, block.get(2, [])):
        for m in map(_message, group.get(1, [])):
            yield "node", _signed(m[1][0]), degrees(west, _signed(m[9][0])), degrees(south, _signed(m[8][0])), None, None, None, tags_of(m)
        for m in map(_message, group.get(2, [])):
            ids, lats, lons = (_running(_packed(m.get(n))) for n in (1, 8, 9))
            marks = iter(_packed(m.get(10)))
            for osm_id, lat, lon in zip(ids, lats, lons):
                tags = {}
                while key := next(marks, 0):
                    tags[texts[key]] = texts[next(marks)]
                yield "node", osm_id, degrees(west, lon), degrees(south, lat), None, None, None, tags
        for m in map(_message, group.get(3, [])):
            yield "way", _wide(m[1][0]), None, None, _running(_packed(m.get(8))), None, None, tags_of(m)
        for m in map(_message, group.get(4, [])):
            roles = [texts[i] for i in _packed(m.get(8))]
            yield "relation", _wide(m[1][0]), None, None, _running(_packed(m.get(9))), roles, _packed(m.get(10)), tags_of(m)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Every element as it is stored, references unresolved."""
    import pandas as pd

    def cut(frames):
        for frame in frames:
            for content in frame["content"]:
                for blob in blocks(bytes(content)):
                    yield pd.DataFrame({"blob": [blob]})

    def decode(frames):
        for frame in frames:
            for blob in frame["blob"]:
                rows = list(elements(bytes(blob)))
                if rows:
                    yield pd.DataFrame(rows, columns=NAMES).astype({"lon": float, "lat": float})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pbf").load(path).select("content")
    dealt = files.mapInPandas(cut, "blob binary").repartition(F.xxhash64("blob"))
    return dealt.mapInPandas(decode, ELEMENTS)


def _line(points: Column) -> Column:
    """WKB of (lon, lat) structs in order: a closed one of four points or more is a polygon."""
    listed = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", ")
    first, last = points[0], F.element_at(points, -1)
    closed = (F.size(points) >= 4) & (first["lon"] == last["lon"]) & (first["lat"] == last["lat"])
    text = F.when(closed, F.concat(F.lit("POLYGON (("), listed, F.lit("))"))).when(F.size(points) >= 2, F.concat(F.lit("LINESTRING ("), listed, F.lit(")")))
    return G.from_wkt(text)


def read_osm_pbf(spark: SparkSession, path: str, tags: bool | str = "ways", geometry_only: bool = False, layer: str | None = None) -> DataFrame:
    """(kind, osm_id, geometry[, tags]): kind is node, way or relation; ``layer`` keeps one kind.

    ``tags`` True keeps all tags, "ways" those of ways and relations, False none. Ways lose
    references to nodes that the file lacks; one with fewer than two points is left out, and so is
    a relation of another type than multipolygon or boundary, or whose ways enclose no area.
    """
    if tags not in (True, False, "ways"):
        raise ValueError(f"no such choice of tags: {tags}")
    kinds = {"nodes": "node", "ways": "way", "relations": "relation"}
    if layer is not None and layer not in kinds:
        raise ValueError(f"no such layer: {layer}")
    rows = read_elements(spark, path)
    nodes = rows.where("kind = 'node'")
    points = nodes.select(F.col("osm_id").alias("__node"), "lon", "lat").dropDuplicates(["__node"])
    spread = rows.where("kind = 'way'").select("osm_id", F.posexplode("refs").alias("at", "__node"))
    placed = spread.join(points, "__node").groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("at", "lon", "lat"))).alias("points"))
    shaped = placed.select("osm_id", G.settled(_line(F.col("points"))).alias("geometry")).where(F.col("geometry").isNotNull())
    keyed = lambda kind: rows.where(F.col("kind") == kind).select("osm_id", "tags").dropDuplicates(["osm_id"])
    parts = {"node": nodes.select("kind", "osm_id", wkb_point("lon", "lat").alias("geometry"), F.col("tags") if tags is True else F.lit(None).cast("map<string, string>").alias("tags"))}
    parts["way"] = shaped.join(keyed("way"), "osm_id").select(F.lit("way").alias("kind"), "osm_id", "geometry", "tags")
    areas = rows.where((F.col("kind") == "relation") & F.col("tags")["type"].isin("multipolygon", "boundary"))
    members = areas.select(F.col("osm_id").alias("__relation"), F.explode(F.arrays_zip("refs", "ref_kinds")).alias("m")).where(F.col("m.ref_kinds") == WAY)
    lines = shaped.select(F.col("osm_id").alias("__way"), F.when(G.geom_type("geometry") == "Polygon", G.exterior("geometry")).otherwise(F.col("geometry")).alias("line"))
    built = members.join(lines, F.col("m.refs") == F.col("__way")).groupBy(F.col("__relation").alias("osm_id"))
    built = built.agg(G.gathered("build_area", F.collect_list("line"), 1.0).alias("geometry"))
    built = built.withColumn("geometry", G.settled("geometry")).where(F.col("geometry").isNotNull() & ~G.is_empty("geometry"))
    parts["relation"] = built.join(keyed("relation"), "osm_id").select(F.lit("relation").alias("kind"), "osm_id", "geometry", "tags")
    wanted = [parts[kinds[layer]]] if layer else list(parts.values())
    out = wanted[0]
    for more in wanted[1:]:
        out = out.unionByName(more)
    return out.select("kind", "osm_id", "geometry") if geometry_only or tags is False else out
