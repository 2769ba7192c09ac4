"""GeoPackage: the feature tables of SQLite containers, opened in memory by a task for each file."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the envelope that follows a geometry's header, by its code.
ENVELOPE = (0, 32, 48, 48, 64)


def _open(content: bytes) -> sqlite3.Connection:
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def plain_wkb(value: bytes | None) -> bytes | None:
    """WKB without the container's header; null stays null."""
    if value is None:
        return None
    if value[:2] != b"GP":
        raise ValueError("not a geometry of a GeoPackage")
    return value[8 + ENVELOPE[value[3] >> 1 & 7] :]


def layers(content: bytes) -> list[tuple[str, str, str]]:
    """(table, geometry column, geometry type) of a container."""
    db = _open(content)
    try:
        return db.execute("SELECT table_name, column_name, geometry_type_name FROM gpkg_geometry_columns ORDER BY rowid").fetchall()
    finally:
        db.close()


def features(content: bytes, layer: str | None = None) -> Iterator[tuple[str, dict, bytes | None]]:
    """(layer, attributes, WKB) of a container's rows, of the first layer if none is named."""
    known = layers(content)
    chosen = [row for row in known if row[0] == layer] if layer else known[:1]
    if layer and not chosen:
        raise ValueError(f"no such layer: {layer}")
    quoted = lambda name: '"' + name.replace('"', '""') + '"'
    db = _open(content)
    try:
        for table, column, _ in chosen:
            found = db.execute(f"SELECT * FROM {quoted(table)}")
            names = [c[0] for c in found.description]
            at = names.index(column)
            for row in found:
                yield table, {n: None if v is None else str(v) for i, (n, v) in enumerate(zip(names, row)) if i != at and not isinstance(v, bytes)}, plain_wkb(row[at])
    finally:
        db.close()


def list_layers(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, geometry type) of one container's layers."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    return [(name, kind) for name, _, kind in layers(bytes(content[0]))] if content else []


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, batch_rows: int = 4096) -> DataFrame:
    """(layer, attributes map<string, string>, geometry); a container is at most 2 GB."""
    import itertools

    import pandas as pd

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = features(bytes(content), layer)
                while batch := list(itertools.islice(rows, batch_rows)):
                    yield pd.DataFrame(batch, columns=["layer", "attributes", "geometry"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(path).select("content")
    return files.mapInPandas(run, "layer string, attributes map<string, string>, geometry binary")
