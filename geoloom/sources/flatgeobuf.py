"""FlatGeobuf: byte ranges of a file are found first, by its packed Hilbert R-tree where it has one, then read and decoded in parallel.

A file's index is walked from its root by one task, which reads the nodes that an area meets and no others; without an area, or
an index, the ranges are runs of features of about ``BLOCK`` bytes. Files may be of any size. A writer's tasks have a range of the
Hilbert curve each, and write a file with an index of its own.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.jts import call

BLOCK = 4 << 20
NODE = 40
#: The format's first bytes, geometry types by their WKB code, and column types by
#: code: name and struct format (None where a length and bytes follow).
MAGIC = b"fgb\x03fgb"
TYPES = ("Unknown", "Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")
COLUMNS = (
    ("byte", "b"), ("ubyte", "B"), ("bool", "?"), ("short", "h"), ("ushort", "H"), ("int", "i"), ("uint", "I"), ("long", "q"),
    ("ulong", "Q"), ("float", "f"), ("double", "d"), ("string", None), ("json", None), ("datetime", None), ("binary", None),
)


class Table:
    """A table of a flatbuffer: fields by their slot, with the defaults of absent ones."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.slots = at - struct.unpack_from("<i", data, at)[0]
        self.length = struct.unpack_from("<H", data, self.slots)[0]

    @classmethod
    def root(cls, data: bytes, at: int = 0) -> Table:
        return cls(data, at + struct.unpack_from("<I", data, at)[0])

    def _place(self, slot: int) -> int | None:
        entry = 4 + 2 * slot
        offset = struct.unpack_from("<H", self.data, self.slots + entry)[0] if entry < self.length else 0
        return self.at + offset if offset else None

    def _far(self, slot: int) -> int | None:
        place = self._place(slot)
        return None if place is None else place + struct.unpack_from("<I", self.data, place)[0]

    def number(self, slot: int, form: str, default: float = 0) -> float:
        place = self._place(slot)
        return default if place is None else struct.unpack_from("<" + form, self.data, place)[0]

    def numbers(self, slot: int, form: str) -> tuple:
        place = self._far(slot)
        return () if place is None else struct.unpack_from(f"<{struct.unpack_from('<I', self.data, place)[0]}{form}", self.data, place + 4)

    def raw(self, slot: int) -> bytes | None:
        place = self._far(slot)
        return None if place is None else self.data[place + 4 : place + 4 + struct.unpack_from("<I", self.data, place)[0]]

    def table(self, slot: int) -> Table | None:
        place = self._far(slot)
        return None if place is None else Table(self.data, place)

    def tables(self, slot: int) -> list[Table]:
        place = self._far(slot)
        if place is None:
            return []
        starts = range(place + 4, place + 4 + 4 * struct.unpack_from("<I", self.data, place)[0], 4)
        return [Table(self.data, s + struct.unpack_from("<I", self.data, s)[0]) for s in starts]


def index_size(features: int, node: int) -> int:
    """Bytes of the packed index: a level for the features, one above each until one node is left."""
    if not features or not node:
        return 0
    total = level = features
    while level > 1:
        level = -(-level // node)
        total += level
    return total * NODE


def header(data: bytes) -> tuple[dict, int]:
    """(name, kind, has_z, columns as (name, type code), crs) of a file, and where its features begin."""
    if data[:7] != MAGIC:
        raise ValueError("not a FlatGeobuf file")
    size = struct.unpack_from("<I", data, 8)[0]
    top = Table.root(data, 12)
    text = lambda value: (value or b"").decode()
    columns = [(text(c.raw(0)), c.number(1, "B")) for c in top.tables(7)]
    crs = top.table(10)
    index = {"index": 12 + size, "count": int(top.number(8, "Q")), "node": int(top.number(9, "H", 16))}
    about = index | {"name": text(top.raw(0)), "kind": top.number(2, "B"), "has_z": bool(top.number(3, "B")), "columns": columns, "crs": crs.number(1, "i") if crs else 0}
    return about, 12 + size + index_size(top.number(8, "Q"), top.number(9, "H", 16))


def wkb(geometry: Table, kind: int) -> bytes:
    """WKB of a geometry; ``kind`` is the layer's type, 0 if each geometry says its own."""
    kind = kind or geometry.number(6, "B")
    if not 0 < kind < len(TYPES):
        raise ValueError(f"no such geometry type: {kind}")
    xy, z = geometry.numbers(1, "d"), geometry.numbers(2, "d")
    order = struct.pack("<BI", 1, kind + 1000 * bool(z))
    if TYPES[kind] in ("MultiPolygon", "GeometryCollection"):
        parts = geometry.tables(7)
        inner = TYPES.index("Polygon") if TYPES[kind] == "MultiPolygon" else 0
        solid = any(p.numbers(2, "d") for p in parts)
        return struct.pack("<BII", 1, kind + 1000 * solid, len(parts)) + b"".join(wkb(p, inner) for p in parts)
    points = [struct.pack("<dd", *xy[i : i + 2]) + (struct.pack("<d", z[i // 2]) if z else b"") for i in range(0, len(xy), 2)]
    run = lambda part: struct.pack("<I", len(part)) + b"".join(part)
    if TYPES[kind] == "Point":
        return order + (points[0] if points else struct.pack("<dd", float("nan"), float("nan")))
    if TYPES[kind] == "LineString":
        return order + run(points)
    if TYPES[kind] == "MultiPoint":
        single = struct.pack("<BI", 1, 1 + 1000 * bool(z))
        return order + struct.pack("<I", len(points)) + b"".join(single + p for p in points)
    ends = geometry.numbers(0, "I") or ((len(points),) if points else ())
    runs = [run(points[a:b]) for a, b in zip((0, *ends), ends)]
    single = struct.pack("<BI", 1, 2 + 1000 * bool(z)) if TYPES[kind] == "MultiLineString" else b""
    return order + struct.pack("<I", len(runs)) + b"".join(single + r for r in runs)


def properties(data: bytes | None, columns: list[tuple[str, int]]) -> dict[str, str | None]:
    """A feature's attributes as text; those that it does not give are null."""
    out: dict[str, str | None] = dict.fromkeys((n for n, _ in columns))
    at = 0
    while data and at < len(data):
        number = struct.unpack_from("<H", data, at)[0]
        name, code = columns[number]
        kind, form = COLUMNS[code]
        at += 2
        if form:
            value = struct.unpack_from("<" + form, data, at)[0]
            out[name] = str(value).lower() if kind == "bool" else str(value)
            at += struct.calcsize("<" + form)
        else:
            end = at + 4 + struct.unpack_from("<I", data, at)[0]
            out[name] = data[at + 4 : end].hex() if kind == "binary" else data[at + 4 : end].decode()
            at = end
    return out


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Runs of whole features, of about ``size`` bytes each."""
    at = start = header(data)[1]
    while at < len(data):
        at += 4 + struct.unpack_from("<I", data, at)[0]
        if at - start >= size or at >= len(data):
            yield data[start:at]
            start = at


def decoded(block: bytes, about: dict) -> Iterator[tuple[dict, bytes | None]]:
    """(attributes, WKB) of a block's features."""
    at = 0
    while at < len(block):
        feature = Table.root(block, at + 4)
        own = [(c.raw(0).decode(), c.number(1, "B")) for c in feature.tables(2)]
        geometry = feature.table(0)
        yield properties(feature.raw(1), own or about["columns"]), None if geometry is None else wkb(geometry, about["kind"])
        at += 4 + struct.unpack_from("<I", block, at)[0]


def ranges(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, block: int = BLOCK) -> DataFrame:
    """(path, about, start, end): the stretches of whole features to read, of those that meet ``bbox`` in files with an index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.fgb").load(path).select("path", "length").where("length > 0")
    size = G.settled(call("Range", F.col("path"), F.lit(0).cast("bigint"), F.lit(12).cast("bigint")))
    files = files.withColumn("head", size)
    little = F.conv(F.concat(*(F.hex(F.substring("head", i, 1)) for i in (12, 11, 10, 9))), 16, 10).cast("bigint")
    files = files.withColumn("head", G.settled(call("Range", F.col("path"), F.lit(0).cast("bigint"), F.least("length", little + 12))))

    def told(frames):
        for frame in frames:
            yield frame[["path", "length"]].assign(about=[json.dumps(header(bytes(h))[0]) for h in frame["head"]])

    about = files.select("path", "length", "head").mapInPandas(told, "path string, length bigint, about string")
    own = F.from_json("about", "index bigint, count bigint, node bigint")
    area = F.array(*(F.lit(float(v)) for v in bbox)) if bbox else F.expr("cast(array() as array<double>)")
    hits = call("Hits", F.col("path"), F.array(own["index"], own["count"], own["node"], F.col("length")), area, F.lit(block).cast("bigint"))
    flat = about.select("path", "about", G.settled(hits).alias("hits")).where(F.size("hits") > 0)
    at = flat.select("path", "about", "hits", F.explode(F.sequence(F.lit(0), (F.size("hits") / 2).cast("int") - 1)).alias("i"))
    return at.select("path", "about", F.col("hits")[2 * F.col("i")].alias("start"), F.col("hits")[2 * F.col("i") + 1].alias("end"))


def read_flatgeobuf(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(layer, attributes map<string, string>, geometry) of a file or a folder; with ``bbox`` those whose boxes touch it."""
    import pandas as pd

    def decode(frames):
        for frame in frames:
            for about, block in zip(frame["about"], frame["block"]):
                layer = json.loads(about)
                rows = [(layer["name"], a, g) for a, g in decoded(bytes(block), layer)]
                yield pd.DataFrame(rows, columns=["layer", "attributes", "geometry"])

    found = ranges(spark, path, bbox).repartition(F.xxhash64("path", "start"))
    blocks = found.select("about", call("Range", F.col("path"), F.col("start"), F.col("end")).alias("block"))
    rows = blocks.mapInPandas(decode, "layer string, attributes map<string, string>, geometry binary")
    if bbox is None:
        return rows
    box = G.bounds("geometry")
    return rows.where((box["minx"] <= bbox[2]) & (box["maxx"] >= bbox[0]) & (box["miny"] <= bbox[3]) & (box["maxy"] >= bbox[1]))


# ------------------------------------------------------------------ writing


class Builder:
    """A flatbuffer written front to back: a table, then what it points to."""

    def __init__(self) -> None:
        self.data = bytearray(4)

    def align(self, size: int, ahead: int = 0) -> None:
        while (len(self.data) + ahead) % size:
            self.data.append(0)

    def table(self, fields: dict[int, tuple]) -> int:
        """Slots: (struct format, value), or (callable that writes what the slot points to and gives its place,)."""
        slots = 1 + max(fields, default=-1)
        place, at = {}, 4
        for slot, field in sorted(fields.items(), key=lambda f: -(struct.calcsize("<" + f[1][0]) if isinstance(f[1][0], str) else 4)):
            size = struct.calcsize("<" + field[0]) if isinstance(field[0], str) else 4
            at += -at % size
            place[slot], at = at, at + size
        self.align(8, 4 + 2 * slots)
        vtable = len(self.data)
        self.data += struct.pack(f"<HH{slots}H", 4 + 2 * slots, at, *(place.get(i, 0) for i in range(slots)))
        start = len(self.data)
        self.data += struct.pack("<i", start - vtable) + bytes(at - 4)
        for slot, field in fields.items():
            if isinstance(field[0], str):
                struct.pack_into("<" + field[0], self.data, start + place[slot], field[1])
            else:
                struct.pack_into("<I", self.data, start + place[slot], field[0]() - start - place[slot])
        return start

    def raw(self, value: bytes) -> int:
        self.align(4)
        at = len(self.data)
        self.data += struct.pack("<I", len(value)) + value + b"\0"
        return at

    def numbers(self, values: list, form: str) -> int:
        self.align(struct.calcsize("<" + form), 4)
        at = len(self.data)
        self.data += struct.pack(f"<I{len(values)}{form}", len(values), *values)
        return at

    def tables(self, made: list) -> int:
        self.align(4)
        at = len(self.data)
        self.data += struct.pack("<I", len(made)) + bytes(4 * len(made))
        for i, one in enumerate(made):
            place = at + 4 + 4 * i
            struct.pack_into("<I", self.data, place, one() - place)
        return at

    def finished(self, root: int) -> bytes:
        struct.pack_into("<I", self.data, 0, root)
        self.align(8, 4)
        return struct.pack("<I", len(self.data)) + bytes(self.data)


def _shape(data: bytes, at: int = 0) -> tuple[dict, int]:
    """Type code, flat coordinates, ends and parts of little-endian WKB, and where it stops."""
    kind = struct.unpack_from("<I", data, at + 1)[0]
    width, kind = (3, kind - 1000) if kind > 1000 else (2, kind)
    at += 5
    out: dict = {"type": kind, "xy": [], "z": [], "ends": [], "parts": []}

    def take(n: int) -> None:
        nonlocal at
        values = struct.unpack_from(f"<{width * n}d", data, at)
        at += 8 * width * n
        out["xy"] += [v for i, v in enumerate(values) if i % width < 2]
        out["z"] += values[2::3] if width == 3 else ()

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from("<I", data, at - 4)[0]

    if kind == 1:
        take(1)
        if out["xy"][0] != out["xy"][0]:
            out["xy"] = []
    elif kind == 2:
        take(count())
    elif kind == 3:
        for _ in range(count()):
            take(count())
            out["ends"].append(len(out["xy"]) // 2)
    else:
        for _ in range(count()):
            part, at = _shape(data, at)
            if kind in (6, 7):
                out["parts"].append(part)
            else:
                out["xy"] += part["xy"]
                out["z"] += part["z"]
                out["ends"] += [len(out["xy"]) // 2] * (kind == 5)
    return out, at


def _geometry(b: Builder, shape: dict) -> int:
    fields: dict[int, tuple] = {6: ("B", shape["type"])}
    if len(shape["ends"]) > 1:
        fields[0] = (lambda: b.numbers(shape["ends"], "I"),)
    if shape["xy"]:
        fields[1] = (lambda: b.numbers(shape["xy"], "d"),)
    if shape["z"]:
        fields[2] = (lambda: b.numbers(shape["z"], "d"),)
    if shape["parts"]:
        fields[7] = (lambda: b.tables([lambda p=p: _geometry(b, p) for p in shape["parts"]]),)
    return b.table(fields)


def feature(wkb_bytes: bytes | None, values: list, columns: list[tuple[str, int]]) -> bytes:
    """A feature with its size before it; attributes that are null are left out."""
    packed = bytearray()
    for i, (value, (_, code)) in enumerate(zip(values, columns)):
        form = COLUMNS[code][1]
        if value is not None:
            raw = value if isinstance(value, bytes) else str(value).encode()
            packed += struct.pack("<H", i) + (struct.pack("<" + form, value) if form else struct.pack("<I", len(raw)) + raw)
    b = Builder()
    fields: dict[int, tuple] = {}
    if wkb_bytes is not None:
        fields[0] = (lambda: _geometry(b, _shape(wkb_bytes)[0]),)
    if packed:
        fields[1] = (lambda: b.raw(bytes(packed)),)
    return b.finished(b.table(fields))


def packed_tree(boxes: list[tuple[float, float, float, float]], offsets: list[int], node: int = 16) -> bytes:
    """The index of features in order: leaves with their offsets, then levels of boxes around ``node`` children up to the root, which comes first."""
    levels = [[(*box, offset) for box, offset in zip(boxes, offsets)]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        groups = [below[i : i + node] for i in range(0, len(below), node)]
        levels.append([(min(c[0] for c in g), min(c[1] for c in g), max(c[2] for c in g), max(c[3] for c in g), i * node) for i, g in enumerate(groups)])
    starts, total = [], 0
    for level in reversed(levels):
        starts.append(total)
        total += len(level)
    out = bytearray()
    for depth, level in enumerate(reversed(levels)):
        shift = starts[depth + 1] if depth + 1 < len(levels) else 0  # children of a level are in the next one
        out += b"".join(struct.pack("<4dQ", *c[:4], c[4] + shift) for c in level)
    return bytes(out)


def file_bytes(name: str, columns: list[tuple[str, int]], features: list[bytes], boxes: list[tuple[float, float, float, float]], crs: int | None, node: int = 16) -> bytes:
    """A whole file of features in the order of the curve."""
    b = Builder()
    around = [f(v) for f, v in zip((min, min, max, max), zip(*boxes))] if boxes else []
    fields: dict[int, tuple] = {0: (lambda: b.raw(name.encode()),), 2: ("B", 0), 8: ("Q", len(features)), 9: ("H", node if features else 0)}
    if around:
        fields[1] = (lambda: b.numbers(around, "d"),)
    fields[7] = (lambda: b.tables([lambda c=c: b.table({0: (lambda: b.raw(c[0].encode()),), 1: ("B", c[1])}) for c in columns]),)
    if crs:
        fields[10] = (lambda: b.table({1: ("i", crs)}),)
    offsets, at = [], 0
    for one in features:
        offsets.append(at)
        at += len(one)
    return MAGIC + b"\x00" + b.finished(b.table(fields)) + (packed_tree(boxes, offsets, node) if features else b"") + b"".join(features)
