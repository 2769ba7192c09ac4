"""Binary containers written here byte by byte and read back."""

import sqlite3
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions import planar as P
from geoloom.sources import flatgeobuf, geopackage, osm, vector


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def packed(values):
    return b"".join(map(varint, values))


def steps(values):
    return packed(zigzag(b - a) for a, b in zip([0, *values], values))


def pbf(groups, texts, compressed=True):
    raw = field(1, b"".join(field(1, t.encode()) for t in texts)) + b"".join(field(2, g) for g in groups)
    body = field(3, zlib.compress(raw)) + field(2, len(raw)) if compressed else field(1, raw)
    head = field(1, b"OSMData") + field(3, len(body))
    start = field(1, b"OSMHeader") + field(3, 2)
    return struct.pack(">I", len(start)) + start + field(1, b"") + struct.pack(">I", len(head)) + head + body


@pytest.fixture
def extract(tmp_path):
    texts = ["", "name", "spring", "highway", "path", "type", "multipolygon", "outer", "inner"]
    square = lambda x, n: [(10 + n, x, x), (11 + n, x, 10 - x), (12 + n, 10 - x, 10 - x), (13 + n, 10 - x, x)]
    points = [(1, -3, 4), *square(0, 0), *square(4, 10)]
    deg = 10_000_000
    dense = field(1, steps([p[0] for p in points])) + field(8, steps([p[2] * deg for p in points])) + field(9, steps([p[1] * deg for p in points]))
    dense += field(10, packed([1, 2, 0] + [0] * 8))
    ways = [(100, [1, 10, 999], [3], [4]), (101, [10, 11, 12, 13, 10], [], []), (102, [20, 21, 22, 23, 20], [], []), (103, [1], [], [])]
    made = b"".join(field(3, field(1, i) + field(2, packed(k)) + field(3, packed(v)) + field(8, steps(r))) for i, r, k, v in ways)
    relation = field(1, 200) + field(2, packed([5])) + field(3, packed([6])) + field(8, packed([7, 8])) + field(9, steps([101, 102])) + field(10, packed([1, 1]))
    path = tmp_path / "small.osm.pbf"
    path.write_bytes(pbf([field(2, dense), made, field(4, relation)], texts))
    return str(path)


def test_osm(spark, extract):
    rows = {(r.kind, r.osm_id): r for r in osm.read_osm_pbf(spark, extract, tags=True).withColumn("wkt", G.to_wkt("geometry")).withColumn("area", G.area("geometry")).collect()}
    assert sorted(k for k in rows if k[0] != "node") == [("relation", 200), ("way", 100), ("way", 101), ("way", 102)]
    assert len(rows) == 9 + 4
    assert rows["node", 1].wkt == "POINT (-3 4)" and rows["node", 1].tags == {"name": "spring"}
    assert rows["way", 100].wkt == "LINESTRING (-3 4, 0 0)" and rows["way", 100].tags == {"highway": "path"}
    assert rows["way", 101].area == 100 and rows["way", 102].area == 4
    assert rows["relation", 200].area == 96 and rows["relation", 200].tags == {"type": "multipolygon"}


def test_osm_options(spark, extract):
    assert vector.read_file(spark, extract, layer="nodes").count() == 9
    assert osm.read_osm_pbf(spark, extract, layer="ways", geometry_only=True).columns == ["kind", "osm_id", "geometry"]
    assert {r.tags is None for r in osm.read_osm_pbf(spark, extract, layer="nodes").collect()} == {True}
    with pytest.raises(ValueError):
        osm.read_osm_pbf(spark, extract, layer="tiles")
    with pytest.raises(ValueError):
        osm.read_osm_pbf(spark, extract, tags="nodes")


def test_raw_block():
    group = field(1, field(1, zigzag(-7)) + field(8, zigzag(-50_000_000)) + field(9, zigzag(20_000_000)))
    blob = next(osm.blocks(pbf([group], [""], compressed=False)))
    assert list(osm.elements(blob)) == [("node", -7, 2.0, -5.0, None, None, None, {})]


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT)")
    db.executemany("INSERT INTO gpkg_geometry_columns VALUES (?, ?, ?)", [("wells", "geom", "POINT"), ('odd "name"', "shape", "POINT")])
    db.execute("CREATE TABLE wells (fid INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
    db.execute('CREATE TABLE "odd ""name""" (fid INTEGER PRIMARY KEY, shape BLOB)')
    point = lambda x, y: struct.pack("<BIdd", 1, 1, x, y)
    bare = b"GP\0\x01" + struct.pack("<i", 4326)
    boxed = b"GP\0\x03" + struct.pack("<idddd", 4326, 3, 3, 4, 4)
    db.executemany("INSERT INTO wells VALUES (?, ?, ?)", [(1, "a", bare + point(1, 2)), (2, None, boxed + point(3, 4)), (3, "c", None)])
    db.commit()
    db.close()
    assert geopackage.list_layers(spark, path) == [("wells", "POINT"), ('odd "name"', "POINT")]
    rows = geopackage.read_geopackage(spark, path).withColumn("wkt", G.to_wkt("geometry")).collect()
    assert [(r.attributes["fid"], r.attributes["name"], r.wkt) for r in rows] == [("1", "a", "POINT (1 2)"), ("2", None, "POINT (3 4)"), ("3", "c", None)]
    assert vector.read_file(spark, path, layer='odd "name"').count() == 0
    assert vector.read_file(spark, path, bbox=(0, 0, 2, 2)).count() == 1
    with pytest.raises(ValueError):
        geopackage.plain_wkb(b"no")


def flatgeobuf_bytes(kind, columns, rows, node=0):
    """A file by the flatbuffers library; a row is (geometry as slots, property bytes)."""
    flatbuffers = pytest.importorskip("flatbuffers")

    def vector_of(b, values, size, add):
        b.StartVector(size, len(values), size)
        for v in reversed(values):
            add(v)
        return b.EndVector()

    def table(b, n, numbers=(), places=()):
        b.StartObject(n)
        for slot, place in places:
            b.PrependUOffsetTRelativeSlot(slot, place, 0)
        for slot, method, value in numbers:
            getattr(b, f"Prepend{method}Slot")(slot, value, None)
        return b.EndObject()

    def geometry(b, g):
        parts = [geometry(b, p) for p in g.get("parts", ())]
        places = [(7, vector_of(b, parts, 4, b.PrependUOffsetTRelative))] if parts else []
        places += [(slot, vector_of(b, g[name], 8, b.PrependFloat64)) for slot, name in ((1, "xy"), (2, "z")) if name in g]
        if "ends" in g:
            places.append((0, vector_of(b, g["ends"], 4, b.PrependUint32)))
        return table(b, 8, [(6, "Uint8", g["type"])] if "type" in g else [], places)

    def sized(b, end):
        b.FinishSizePrefixed(end)
        return bytes(b.Output())

    b = flatbuffers.Builder(0)
    made = []
    for name, code in columns:
        label = b.CreateString(name)
        made.append(table(b, 11, [(1, "Uint8", code)], [(0, label)]))
    places = [(0, b.CreateString("wells")), (7, vector_of(b, made, 4, b.PrependUOffsetTRelative))]
    out = b"fgb\x03fgb\x00" + sized(b, table(b, 14, [(2, "Uint8", kind), (8, "Uint64", len(rows)), (9, "Uint16", node)], places))
    out += bytes(flatgeobuf.index_size(len(rows), node))
    for shape, values in rows:
        b = flatbuffers.Builder(0)
        places = [(0, geometry(b, shape))] if shape else []
        out += sized(b, table(b, 3, (), places + ([(1, b.CreateByteVector(values))] if values else [])))
    return out


def test_flatgeobuf(spark, tmp_path):
    text = lambda n, s: struct.pack("<HI", n, len(s.encode())) + s.encode()
    columns = [("name", 11), ("depth", 10), ("open", 2)]
    square = {"xy": [0, 0, 10, 0, 10, 10, 0, 10, 0, 0, 2, 2, 4, 2, 4, 4, 2, 4, 2, 2], "ends": [5, 10], "type": 3}
    solid = {"xy": [0, 0, 1, 0, 1, 1, 0, 0], "z": [1, 2, 3, 1], "type": 3}
    rows = [
        ({"xy": [1, 2], "type": 1}, text(0, "Brunnen\u00e4") + struct.pack("<Hd", 1, 2.5) + struct.pack("<H?", 2, True)),
        ({"xy": [0, 0, 3, 4], "type": 2}, text(0, "")),
        (square, b""),
        ({"parts": [square, solid], "type": 6}, b""),
        ({"xy": [1, 1, 2, 2], "type": 4}, b""),
        ({"xy": [0, 0, 1, 1, 5, 5, 6, 6], "ends": [2, 4], "type": 5}, b""),
        (None, b""),
    ]
    (tmp_path / "a.fgb").write_bytes(flatgeobuf_bytes(0, columns, rows, node=2))
    found = vector.read_file(spark, str(tmp_path / "a.fgb")).withColumn("wkt", G.to_wkt("geometry")).withColumn("area", G.area("geometry"))
    got = {r.wkt: r for r in found.collect()}
    assert len(got) == 7 and {r.layer for r in got.values()} == {"wells"}
    assert got["POINT (1 2)"].attributes == {"name": "Brunnen\u00e4", "depth": "2.5", "open": "true"}
    assert got["LINESTRING (0 0, 3 4)"].attributes == {"name": "", "depth": None, "open": None}
    assert sorted(r.area for r in got.values() if r.area) == [96.0, 96.5]
    assert {"MULTIPOINT ((1 1), (2 2))", "MULTILINESTRING ((0 0, 1 1), (5 5, 6 6))", None} < set(got)


def test_flatgeobuf_blocks():
    rows = [({"xy": [i, i]}, b"") for i in range(50)]
    data = flatgeobuf_bytes(1, [], rows, node=16)
    about, start = flatgeobuf.header(data)
    cut = list(flatgeobuf.blocks(data, 300))
    assert len(cut) > 5 and b"".join(cut) == data[start:]
    found = [wkb for block in cut for _, wkb in flatgeobuf.decoded(block, about)]
    assert found == [struct.pack("<BIdd", 1, 1, i, i) for i in range(50)]
    assert list(flatgeobuf.blocks(flatgeobuf_bytes(1, [], []))) == []
    with pytest.raises(ValueError):
        flatgeobuf.header(b"no")


def test_flatgeobuf_index(spark, tmp_path):
    """What is written comes back; an area's read touches the bytes of the features that it meets and no others."""
    n = 3000
    rows = spark.range(n).select(
        "id", F.concat(F.lit("f"), F.col("id")).alias("name"), (F.col("id") / 2).alias("half"), (F.col("id") % 2 == 0).alias("even"),
        G.from_wkt(F.when(F.col("id") % 3 == 0, F.concat(F.lit("POINT ("), F.col("id") % 60, F.lit(" "), F.floor(F.col("id") / 60), F.lit(")")))
                   .when(F.col("id") % 3 == 1, F.concat(F.lit("POLYGON (("), F.array_join(F.array(*(F.concat_ws(" ", F.col("id") % 60 + a, F.floor(F.col("id") / 60) + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 0)))), ","), F.lit("))")))
                   .otherwise("MULTIPOLYGON (((100 100, 101 100, 101 101, 100 100)), ((90 90, 91 90, 91 91, 90 90)))")).alias("geometry"),
    )
    rows = rows.unionByName(rows.limit(1).withColumns({"id": F.lit(-1).cast("bigint"), "geometry": F.lit(None).cast("binary")}))
    vector.to_file(rows, str(tmp_path / "a.fgb"))
    back = vector.read_file(spark, str(tmp_path / "a.fgb")).withColumn("wkt", G.to_wkt("geometry"))
    want = {(str(r.id), r.name, str(r.half), str(r.even).lower(), r.wkt) for r in rows.withColumn("wkt", G.to_wkt("geometry")).collect()}
    assert {(a["id"], a["name"], a["half"], a["even"], w) for a, w in ((r.attributes, r.wkt) for r in back.collect())} == want
    area = (10.0, 10.0, 14.5, 12.5)
    found = flatgeobuf.ranges(spark, str(tmp_path / "a.fgb"), area).collect()
    box = G.bounds("geometry")
    met = rows.where((box["minx"] <= area[2]) & (box["maxx"] >= area[0]) & (box["miny"] <= area[3]) & (box["maxy"] >= area[1]))
    read = 0
    for r in found:
        with open(r.path.removeprefix("file:"), "rb") as file:
            file.seek(r.start)
            read += len(list(flatgeobuf.decoded(file.read(r.end - r.start), json.loads(r.about))))
    assert read == met.count() and 0 < read < n / 20
    got = vector.read_file(spark, str(tmp_path / "a.fgb"), bbox=area)
    assert {r.attributes["id"] for r in got.collect()} == {str(r.id) for r in met.where(G.intersects("geometry", P.literal_box(*area))).collect()}
    vector.to_file(rows.limit(0), str(tmp_path / "none.fgb"))
    assert vector.read_file(spark, str(tmp_path / "none.fgb")).count() == 0


SHAPES = {
    "point": ["POINT (1 2)", "POINT (0.1 -3)", "POINT EMPTY"], "linestring": ["LINESTRING (0 0, 1 0.3)", "LINESTRING EMPTY"],
    "polygon": ["POLYGON ((0 0, 4 0, 4 4, 0 0), (2 1, 3 1, 3 2, 2 1))", "POLYGON EMPTY"], "multipoint": ["MULTIPOINT ((1 1), (2 2))", "MULTIPOINT EMPTY"],
    "multilinestring": ["MULTILINESTRING ((0 0, 1 1), (5 5, 6 6))"], "multipolygon": ["MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0), (2 1, 3 1, 3 2, 2 1)), ((9 9, 10 9, 10 10, 9 9)))", "MULTIPOLYGON EMPTY"],
}


@pytest.mark.parametrize("encoding", sorted(SHAPES))
def test_native_encodings(spark, tmp_path, encoding):
    """All types come back from Parquet and from Arrow, with and without z; boxes prune; other types are refused."""
    from geoloom.sources import geoparquet

    rows = spark.createDataFrame([(i, w) for i, w in enumerate([*SHAPES[encoding], None])], "id int, wkt string").select("id", G.from_wkt("wkt").alias("geometry"))
    for z in (False, True):
        given = rows.withColumn("geometry", G.force_3d("geometry", 7.0)) if z else rows
        want = {(r.id, r.w) for r in given.select("id", G.to_wkt("geometry").alias("w")).collect()}
        path = str(tmp_path / f"{encoding}{z}.parquet")
        geoparquet.to_geoparquet(given, path, encoding=encoding, covering_bbox=True, with_z=z)
        assert geoparquet.geo_metadata(path)["columns"]["geometry"]["encoding"] == encoding
        back = geoparquet.read_geoparquet(spark, path).select("id", G.to_wkt("geometry").alias("w"))
        arrow = vector.from_arrow(spark, vector.to_arrow(given, geometry_encoding=encoding, with_z=z)).select("id", G.to_wkt("geometry").alias("w"))
        plain = lambda found: {(i, w and w.replace(" Z EMPTY", " EMPTY")) for i, w in found}
        assert plain(map(tuple, back.collect())) == plain(want) == plain(map(tuple, arrow.collect()))
    first = geoparquet.read_geoparquet(spark, path, bbox=(-50.0, -50.0, -40.0, -40.0))
    assert first.count() == 0 and "PushedFilters: [IsNotNull(bbox" in first._jdf.queryExecution().toString()
    other = spark.range(1).select(G.from_wkt(F.lit("GEOMETRYCOLLECTION EMPTY")).alias("geometry"))
    with pytest.raises(Exception, match=f"no {encoding}"):
        vector.to_arrow(other, geometry_encoding=encoding)


TOPOLOGY = {
    "type": "Topology", "transform": {"scale": [0.5, 0.25], "translate": [10, 20]},
    "arcs": [[[0, 0], [0, 4]], [[0, 4], [-4, 0], [0, -4], [4, 0]], [[0, 0], [4, 0], [0, 4], [-4, 0]], [[1, 1], [1, 0], [0, 1], [-1, -1]]],
    "objects": {
        "halves": {"type": "GeometryCollection", "geometries": [
            {"type": "Polygon", "id": "west", "properties": {"name": "w", "n": 3}, "arcs": [[0, 1]]},
            {"type": "Polygon", "id": "east", "arcs": [[2, -1], [3]]},
            {"type": "MultiPolygon", "id": "both", "arcs": [[[0, 1]], [[2, -1]]]},
            {"type": None, "id": "none"},
        ]},
        "border": {"type": "LineString", "arcs": [-1]}, "lines": {"type": "MultiLineString", "arcs": [[0], [1, 2]]},
        "place": {"type": "Point", "coordinates": [2, 4], "properties": {"name": "p"}}, "places": {"type": "MultiPoint", "coordinates": [[0, 0], [1, 1]]},
    },
}


def test_topojson(spark, tmp_path):
    """Shared and reversed arcs, a hole, quantised and plain coordinates."""
    (tmp_path / "a.topojson").write_text(json.dumps(TOPOLOGY))
    plain = json.loads(json.dumps(TOPOLOGY))
    del plain["transform"]
    for i, arc in enumerate(plain["arcs"]):
        at, out = [0, 0], []
        for step in arc:
            at = [at[0] + step[0], at[1] + step[1]]
            out.append([10 + at[0] * 0.5, 20 + at[1] * 0.25])
        plain["arcs"][i] = out
    plain["objects"]["place"]["coordinates"], plain["objects"]["places"]["coordinates"] = [11, 21], [[10, 20], [10.5, 20.25]]
    (tmp_path / "b.topojson").write_text(json.dumps(plain))
    for name in ("a", "b"):
        rows = vector.read_file(spark, str(tmp_path / f"{name}.topojson")).withColumn("wkt", G.to_wkt("geometry")).withColumn("area", G.area("geometry")).collect()
        got = {r.id or r.layer: r for r in rows}
        assert len(rows) == 8 and got["west"].area == got["west"].area == 2.0 and got["both"].area == 4.0 and got["none"].wkt is None
        assert got["west"].properties == {"name": "w", "n": "3"} and got["east"].area == pytest.approx(2.0 - 0.0625)
        assert got["border"].wkt == "LINESTRING (10 21, 10 20)" and got["place"].wkt == "POINT (11 21)" and got["places"].wkt == "MULTIPOINT ((10 20), (10.5 20.25))"
        assert got["lines"].wkt.startswith("MULTILINESTRING ((10 20, 10 21), (10 21")
