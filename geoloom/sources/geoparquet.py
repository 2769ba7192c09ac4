"""GeoParquet files, Parquet with a ``geo`` key in each footer, and Feather files, Arrow's own, with the same key.

Spark's own writer cannot add a key to a footer and knows no Feather, so files are written from Arrow batches by a Python
data source, one file for each task: into a folder of the write's own, from where they are moved when all
tasks have ended. A footer has the geometry types and, with a covering, the bounds of its own file. Reading is Spark's.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import geometry as G
from ..functions.crs import by_code, to_projjson
from ..functions.planar import Box, literal_box
from . import native

VERSION = "1.1.0"
#: The names of WKB's type codes.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def crs_json(code: int | None) -> dict | None:
    """PROJJSON of a CRS by its EPSG code; None is unknown, and so is a code whose parameters are not known."""
    known = None if code is None else by_code(code)
    if code is not None and known is None:
        warnings.warn(f"the parameters of CRS {code} are not known: the footer has none", stacklevel=2)
    return None if known is None else to_projjson(known)


def crs_code(column: dict) -> int | None:
    """The EPSG code of a footer's column; one without a CRS is in longitudes and latitudes."""
    crs = column.get("crs", crs_json(4326))
    return int(crs["id"]["code"]) if crs and crs.get("id", {}).get("authority") == "EPSG" else None


def _type_names(column: pa.ChunkedArray | pa.Array) -> set[str]:
    heads = pc.unique(pc.binary_slice(column.drop_null(), 0, 5)).to_pylist()
    names = set()
    for head in heads:
        code = int.from_bytes(head[1:5], "little" if head[0] == 1 else "big")
        flat = code & 0xFFFF
        names.add(TYPES[flat % 1000] + (" Z" if code & 0x80000000 or flat // 1000 in (1, 3) else ""))
    return names


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: pa.Schema) -> None:
        self.schema = schema
        self.path, self.geometry, self.encoding = options["path"].rstrip("/"), options["geometry"], options["encoding"]
        self.compression, self.crs, self.covering = options["compression"], json.loads(options["crs"]), options["covering"] == "true"
        self.kind, self.layer, self.code = options["kind"], options.get("layer", ""), int(options.get("code", 0))
        self.name_rows = True
        self.folder = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def _at(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq

        if self.kind == "feather":
            return self._feather(iterator)
        if self.kind == "flatgeobuf":
            return self._flatgeobuf(iterator)
        name, writer, types, bounds = f"part-{uuid.uuid4().hex}.parquet", None, set(), None
        for batch in iterator:
            if writer is None:
                store, folder = self._at(self.folder)
                store.create_dir(folder)
                writer = pq.ParquetWriter(f"{folder}/{name}", batch.schema, compression=self.compression, filesystem=store)
            column = batch.column(self.geometry)
            types |= _type_names(column) if self.encoding == "WKB" else {native.NAMES[self.encoding] + (" Z" if "z: double" in str(column.type) else "")}
            if self.covering and batch.num_rows:
                box = batch.column("bbox")
                ends = [pc.min(pc.struct_field(box, k)).as_py() for k in ("xmin", "ymin")] + [pc.max(pc.struct_field(box, k)).as_py() for k in ("xmax", "ymax")]
                if None not in ends:
                    bounds = ends if bounds is None else [*map(min, bounds[:2], ends[:2]), *map(max, bounds[2:], ends[2:])]
            writer.write_batch(batch)
        if writer is None:
            return Written(None)
        own: dict = {"encoding": self.encoding, "geometry_types": sorted(types), "crs": self.crs}
        if self.covering:
            own["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
            if bounds:
                own["bbox"] = bounds
        writer.add_key_value_metadata({"geo": json.dumps({"version": VERSION, "primary_column": self.geometry, "columns": {self.geometry: own}})})
        writer.close()
        return Written(name)

    def _feather(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, writer = f"part-{uuid.uuid4().hex}.feather", None
        for batch in iterator:
            if writer is None:
                store, folder = self._at(self.folder)
                store.create_dir(folder)
                own = {"version": VERSION, "primary_column": self.geometry, "columns": {self.geometry: {"encoding": "WKB", "geometry_types": [], "crs": self.crs}}}
                sink = store.open_output_stream(f"{folder}/{name}")
                # known before the first row, so without types and bounds
                schema = batch.schema.with_metadata({"geo": json.dumps(own)})
                writer = pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression=self.compression))
            writer.write_batch(batch.replace_schema_metadata(schema.metadata))
        if writer is None:
            return Written(None)
        writer.close()
        sink.close()
        return Written(name)

    def _flatgeobuf(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """A task's rows in one file; its index stands before its features, so they are held until their sizes are known."""
        from . import flatgeobuf as fgb

        codes = {"bool": 2, "int32": 5, "int64": 7, "double": 10, "string": 11, "binary": 14}
        rest = [i for i, f in enumerate(self.schema) if f.name not in (self.geometry, "__box")]
        columns = [(self.schema.field(i).name, codes[str(self.schema.field(i).type)]) for i in rest]
        features, boxes = [], []
        for batch in iterator:
            values = [batch.column(i).to_pylist() for i in rest]
            for row, (wkb, box) in enumerate(zip(batch.column(self.geometry).to_pylist(), batch.column("__box").to_pylist())):
                features.append(fgb.feature(wkb, [v[row] for v in values], columns))
                known = box and box["minx"] is not None and box["minx"] == box["minx"]
                boxes.append(tuple(box[k] for k in ("minx", "miny", "maxx", "maxy")) if known else (float("nan"),) * 4)
        if not features and self.name_rows:
            return Written(None)
        store, folder = self._at(self.folder)
        store.create_dir(folder)
        name = f"part-{uuid.uuid4().hex}.fgb"
        # rows without a box come last, in a part of the tree that no area meets
        order = sorted(range(len(boxes)), key=lambda i: boxes[i][0] != boxes[i][0])
        boxes = [b if b[0] == b[0] else (float("inf"), float("inf"), -float("inf"), -float("inf")) for b in boxes]
        with store.open_output_stream(f"{folder}/{name}") as sink:
            sink.write(fgb.file_bytes(self.layer, columns, [features[i] for i in order], [boxes[i] for i in order], self.code))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = self._at(self.folder)
        if not any(message and message.name for message in messages):  # a table without rows has a file all the same
            self.name_rows = False
            messages = [self.write(iter([pa.RecordBatch.from_pylist([], self.schema)]))]
        for message in messages:
            if message and message.name:
                store.move(f"{folder}/{message.name}", f"{folder.rpartition('/')[0]}/{message.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, folder = self._at(self.folder)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class GeoFiles(DataSource):
    """``df.write.format("geoloom_files")``; ``to_geoparquet`` and ``to_feather`` set its options."""

    @classmethod
    def name(cls) -> str:
        return "geoloom_files"

    def writer(self, schema, overwrite: bool) -> _Writer:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Writer(dict(self.options), to_arrow_schema(schema))


def _files(spark: SparkSession, path: str) -> tuple[object, list]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        return store, []
    return store, [s.getPath() for s in store.listStatus(target) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]


def geo_metadata(path: str, spark: SparkSession | None = None) -> dict | None:
    """The ``geo`` key of a Parquet file's footer, or of a folder's first file; read where Spark can read."""
    spark = spark or SparkSession.active()
    _, files = _files(spark, path)
    if not files:
        return None
    jvm = spark._jvm
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(min(files, key=lambda p: p.getName()), spark._jsc.hadoopConfiguration()))
    try:
        found = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(found) if found else None


def to_geoparquet(
    df: DataFrame, path: str, geometry: str = "geometry", covering_bbox: bool = False, crs: int | None = None, encoding: str = "WKB", compression: str = "snappy", if_exists: str = "fail", with_z: bool = False
) -> None:
    """A folder of Parquet files with WKB, or nested coordinates (an encoding of ``native.ENCODINGS``; ``with_z``), and a ``geo`` key in each footer.

    ``covering_bbox`` adds a ``bbox`` struct by which readers leave out row groups. ``if_exists`` append adds files.
    """
    if encoding != "WKB" and encoding not in native.ENCODINGS:
        raise ValueError(f"no such encoding: {encoding}")
    spark = df.sparkSession
    if if_exists != "append" and _files(spark, path)[1]:
        raise ValueError(f"there are files in {path}")
    if covering_bbox:
        b = F.col("__b")
        box = F.struct(b["minx"].alias("xmin"), b["miny"].alias("ymin"), b["maxx"].alias("xmax"), b["maxy"].alias("ymax"))
        df = df.withColumn("__b", G.bounds(geometry)).withColumn("bbox", box).drop("__b")
    if encoding != "WKB":
        df = df.withColumn(geometry, native.encoded(geometry, encoding, with_z))
    _write(df, path, "geoparquet", geometry=geometry, encoding=encoding, compression=compression, crs=json.dumps(crs_json(crs)), covering=str(covering_bbox).lower())


def _write(df: DataFrame, path: str, kind: str, **options: str) -> None:
    df.sparkSession.dataSource.register(GeoFiles)
    df.write.format(GeoFiles.name()).options(kind=kind, **options).mode("append").save(path)


def to_feather(df: DataFrame, path: str, geometry: str = "geometry", crs: int | None = None, compression: str = "lz4") -> None:
    """A folder of Feather files, one for each task."""
    if _files(df.sparkSession, path)[1]:
        raise ValueError(f"there are files in {path}")
    _write(df, path, "feather", geometry=geometry, encoding="WKB", compression=compression, crs=json.dumps(crs_json(crs)), covering="false")


def to_flatgeobuf(df: DataFrame, path: str, geometry: str = "geometry", crs: int | None = None, layer: str = "layer") -> None:
    """A folder of FlatGeobuf files with an index each; rows are dealt by range of the Hilbert code of their boxes' middles.

    Attributes are booleans, integers, doubles, binaries and texts; others are written as text.
    """
    from ..operators.layers import hilbert_distance

    if _files(df.sparkSession, path)[1]:
        raise ValueError(f"there are files in {path}")
    kinds = {"boolean": "boolean", "int": "int", "bigint": "bigint", "smallint": "int", "tinyint": "int", "double": "double", "float": "double", "binary": "binary"}
    rows = df.select(*(F.col(n).cast(kinds.get(t, "string")).alias(n) for n, t in df.dtypes if n != geometry), geometry)
    coded = hilbert_distance(rows, geometry).repartitionByRange("hilbert").sortWithinPartitions("hilbert").drop("hilbert")
    _write(coded.withColumn("__box", G.bounds(geometry)), path, "flatgeobuf", geometry=geometry, encoding="WKB", compression="", crs="null", covering="false", layer=layer, code=str(crs or 0))


def read_feather(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Feather file or a folder of them; a task reads a file, of 2 GB at most. The first file has the schema of all."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    named = sorted(p.toString() for p in _files(spark, path)[1])
    if not named:
        raise ValueError(f"there are no files in {path}")
    head = spark.read.format("binaryFile").load(named[0]).select("content").mapInArrow(_schema_of, "schema binary").first()[0]
    schema = pa.ipc.read_schema(pa.py_buffer(head)).remove_metadata()
    schema = pa.schema([f for f in schema if f.name in columns]) if columns else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                table = pa.ipc.open_file(pa.BufferReader(content.as_buffer())).read_all()
                yield from table.select(schema.names).cast(schema).replace_schema_metadata(None).to_batches()

    return files.select("content").mapInArrow(run, from_arrow_schema(schema))


def _schema_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array([pa.ipc.open_file(pa.BufferReader(content.as_buffer())).schema.serialize().to_pybytes()])], names=["schema"])


def read_geoparquet(
    spark: SparkSession, path: str, columns: list[str] | None = None, bbox: tuple[float, float, float, float] | None = None, geometry: str | None = None
) -> DataFrame:
    """Rows with WKB in the footer's primary column (or ``geometry``); those that touch ``bbox``, if given.

    The footer's covering, if there is one, prunes row groups by its statistics, and a ``bbox`` column is taken for one in files
    without a footer of this kind. Separated coordinates become WKB.
    """
    meta = geo_metadata(path, spark) or {}
    name = geometry or meta.get("primary_column") or "geometry"
    own = meta.get("columns", {}).get(name, {})
    df = spark.read.parquet(path)
    if bbox is not None:
        cover = own.get("covering", {}).get("bbox") or ({k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")} if "bbox" in df.columns else None)
        if cover:
            box = Box(*(F.col(".".join(f"`{part}`" for part in cover[k])) for k in ("xmin", "ymin", "xmax", "ymax")))
            df = df.where(box.intersects(Box(*map(F.lit, map(float, bbox)))))
    if own.get("encoding") in native.ENCODINGS:
        df = df.withColumn(name, native.decoded(name, own["encoding"], native.has_z(df, name)))
    if bbox is not None:
        df = df.where(G.intersects(name, literal_box(*bbox)))
    return df.select(*columns) if columns else df
