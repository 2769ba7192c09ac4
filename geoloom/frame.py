"""SpatialFrame: a DataFrame with an active geometry column, its CRS and a row id.

Everything is lazy; the wrapper only remembers which column is which. Operators that need an
order or a label take it from the id column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions.planar import literal_box
from .operators import joins, layers, tabular


@dataclass(frozen=True)
class SpatialFrame:
    df: DataFrame
    geometry: str | None = "geometry"
    crs: int | None = None
    id: str = "id"

    # ---- the wrapper's state

    @property
    def active_geometry_name(self) -> str | None:
        return self.geometry if self.geometry in self.df.columns else None

    def set_geometry(self, column: str, crs: int | None = None) -> SpatialFrame:
        return replace(self, geometry=column, crs=self.crs if crs is None else crs)

    def rename_geometry(self, name: str) -> SpatialFrame:
        return replace(self, df=self.df.withColumnRenamed(self.geometry, name), geometry=name)

    def set_crs(self, crs: int, allow_override: bool = False) -> SpatialFrame:
        if self.crs not in (None, crs) and not allow_override:
            raise ValueError("the frame has another CRS; allow_override changes the label, to_crs the coordinates")
        return replace(self, crs=crs)

    def to_crs(self, crs: int) -> SpatialFrame:
        if self.crs is None:
            raise ValueError("a frame without CRS cannot be reprojected")
        return replace(self, df=self.df.withColumn(self.geometry, G.to_crs(self.geometry, self.crs, crs)), crs=crs)

    def estimate_utm_crs(self) -> int:
        """The EPSG code of the UTM zone of the middle of the layer's bounds."""
        frame = self if self.crs == 4326 else self.to_crs(4326)
        minx, miny, maxx, maxy = layers.total_bounds(frame.df, frame.geometry).first()
        lon, lat = (minx + maxx) / 2, (miny + maxy) / 2
        zone = min(60, int((lon + 180) // 6) + 1)
        if 56 <= lat < 64 and 3 <= lon < 12:  # the wide zone of south-west Norway
            zone = 32
        elif 72 <= lat <= 84 and 0 <= lon < 42:  # Svalbard has four zones
            zone = 31 + 2 * int((lon + 3) // 12)
        return (32600 if lat >= 0 else 32700) + zone

    def _like(self, df: DataFrame) -> SpatialFrame:
        return replace(self, df=df)

    def _side(self, other: SpatialFrame | None = None) -> joins.Side:
        if other is not None and None not in (self.crs, other.crs) and self.crs != other.crs:
            import warnings

            warnings.warn(f"CRS of the frames differ: {self.crs} and {other.crs}", UserWarning, stacklevel=3)
        return joins.geometry_side(self.df, self.id, self.geometry)

    # ---- projections and filters

    def __getitem__(self, key: str | list[str] | Column) -> SpatialFrame | Column:
        if isinstance(key, str):
            return self.df[key]
        return self._like(self.df.select(*key) if isinstance(key, list) else self.df.where(key))

    def cx(self, xmin: float | None, ymin: float | None, xmax: float | None, ymax: float | None) -> SpatialFrame:
        """Rows that touch a box; an open side is that of the layer's bounds."""
        if None in (xmin, ymin, xmax, ymax):
            whole = layers.total_bounds(self.df, self.geometry).first()
            xmin, ymin, xmax, ymax = (w if v is None else v for v, w in zip((xmin, ymin, xmax, ymax), whole))
        return self._like(self.df.where(G.intersects(self.geometry, literal_box(xmin, ymin, xmax, ymax))))

    def assign(self, **columns: Column) -> SpatialFrame:
        return self._like(self.df.withColumns(columns))

    def query(self, expression: str) -> SpatialFrame:
        return self._like(self.df.where(expression))

    def eval(self, expression: str) -> SpatialFrame:
        return self._like(self.df.selectExpr("*", expression))

    def fillna(self, value: Column | dict | None = None, limit: int | None = None) -> SpatialFrame:
        """Null geometries become a geometry, an empty collection by default, the first ``limit`` by id at most; a dict fills attributes."""
        if isinstance(value, dict):
            return self._like(self.df.na.fill(value))
        filler = G.from_wkt(F.lit("GEOMETRYCOLLECTION EMPTY")) if value is None else value
        missing = F.col(self.geometry).isNull()
        if limit is not None:
            few = self.df.where(missing).orderBy(self.id).limit(limit).select(F.col(self.id).alias("__few"))
            marked = self.df.join(few, F.col(self.id) == F.col("__few"), "left")
            return self._like(marked.withColumn(self.geometry, F.when(missing & F.col("__few").isNotNull(), filler).otherwise(F.col(self.geometry))).drop("__few"))
        return self._like(self.df.withColumn(self.geometry, F.coalesce(F.col(self.geometry), filler)))

    # ---- the frame's columns, rows and labels; the label is the id column

    def rename(self, columns: dict[str, str]) -> SpatialFrame:
        name = lambda c: columns.get(c, c)
        return replace(self, df=self.df.withColumnsRenamed(columns), geometry=name(self.geometry), id=name(self.id))

    def drop(self, *columns: str) -> SpatialFrame:
        return replace(self, df=self.df.drop(*columns), geometry=None if self.geometry in columns else self.geometry)

    def insert(self, at: int, name: str, value: Column) -> SpatialFrame:
        return self._like(tabular.insert(self.df, at, name, value))

    def astype(self, types: dict[str, str]) -> SpatialFrame:
        return self._like(self.df.withColumns({c: F.col(c).cast(t) for c, t in types.items()}))

    def dropna(self, how: str = "any", subset: list[str] | None = None) -> SpatialFrame:
        return self._like(self.df.na.drop(how, subset=subset))

    def replace(self, values: dict, subset: list[str] | None = None) -> SpatialFrame:
        return self._like(self.df.na.replace(values, subset=subset))

    def where(self, condition: Column, columns: list[str] | None = None, other: Column | None = None) -> SpatialFrame:
        return self._like(tabular.where(self.df, condition, columns or [c for c in self.df.columns if c != self.id], other))

    def mask(self, condition: Column, columns: list[str] | None = None, other: Column | None = None) -> SpatialFrame:
        return self._like(tabular.mask(self.df, condition, columns or [c for c in self.df.columns if c != self.id], other))

    def set_index(self, key: str, verify_integrity: bool = False) -> SpatialFrame:
        if verify_integrity:
            tabular.set_index(self.df, [key], verify_integrity=True)
        return replace(self, id=key)

    def reset_index(self, drop: bool = False) -> SpatialFrame:
        return replace(self, df=tabular.reset_index(self.df, self.id, drop), id="_index")

    def rename_axis(self, name: str) -> SpatialFrame:
        return replace(self, df=tabular.rename_axis(self.df, self.id, name), id=name)

    def set_axis(self, names: list[str]) -> SpatialFrame:
        return self.rename(dict(zip(self.df.columns, tabular.set_axis(self.df, names).columns)))

    def reindex(self, labels: list, fill: dict | None = None) -> SpatialFrame:
        return self._like(tabular.reindex(self.df, self.id, labels, fill))

    def reindex_like(self, other: SpatialFrame) -> SpatialFrame:
        return self._like(tabular.reindex_like(self.df, other.rename_axis(self.id).df, self.id))

    def sort_values(self, *columns: str, ascending: bool = True) -> SpatialFrame:
        """In the order of columns; of the geometry, that of the Hilbert curve."""
        rows = self.hilbert_distance() if self.geometry in columns else self.df
        names = ["hilbert" if c == self.geometry else c for c in columns]
        ordered = rows.orderBy(*((F.col(c).asc_nulls_last() if ascending else F.col(c).desc_nulls_last()) for c in names))
        return self._like(ordered.select(*self.df.columns))

    def sort_index(self, ascending: bool = True, na_position: str = "last") -> SpatialFrame:
        return self._like(tabular.sort_index(self.df, self.id, ascending, na_position))

    def merge(self, other: DataFrame | SpatialFrame, on: str | list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> SpatialFrame:
        """An equi-join; names that both have, but for the keys, get suffixes (the active geometry's own stays)."""
        right = other.df if isinstance(other, SpatialFrame) else other
        keys = [on] if isinstance(on, str) else on
        both = (set(self.df.columns) & set(right.columns)) - set(keys)
        left = self.df.withColumnsRenamed({c: c + suffixes[0] for c in both if c != self.geometry})
        joined = left.join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), keys, how)
        return replace(self, df=joined, id=self.id + suffixes[0] if self.id in both else self.id)

    def join(self, other: DataFrame | SpatialFrame, other_id: str = "id", how: str = "left", suffixes: tuple[str, str] = ("_x", "_y")) -> SpatialFrame:
        """Rows of another frame by label."""
        right = other.df if isinstance(other, SpatialFrame) else other
        return self.merge(right.withColumnRenamed(other.id if isinstance(other, SpatialFrame) else other_id, self.id), self.id, how, suffixes)

    def concat(self, *others: SpatialFrame) -> SpatialFrame:
        """Rows of several frames; different CRS are an error, an unknown one is taken as that of the others."""
        known = {f.crs for f in (self, *others)} - {None}
        if len(known) > 1:
            raise ValueError(f"the frames have different CRS: {sorted(known)}")
        frames = [f if f.geometry == self.geometry else f.rename_geometry(self.geometry) for f in others]
        return replace(self, df=tabular.concat([self.df, *(f.df for f in frames)]), crs=next(iter(known), None))

    def head(self, n: int = 5) -> SpatialFrame:
        return self._like(tabular.head(self.df, n, [self.id]))

    def tail(self, n: int = 5) -> SpatialFrame:
        return self._like(tabular.tail(self.df, n, [self.id]))

    def sample(self, n: int | None = None, frac: float | None = None, seed: int = 0) -> SpatialFrame:
        return self._like(tabular.sample(self.df, n, frac, seed, [self.id]))

    def apply(self, function: Callable, schema: str) -> SpatialFrame:
        """A Python function from a pandas frame to one of ``schema``, batch by batch; still a frame of this geometry if that has it."""
        rows = tabular.apply_rows(self.df, function, schema)
        return replace(self, df=rows, geometry=self.geometry if self.geometry in rows.columns else None)

    def loc(self, labels: list) -> SpatialFrame:
        return self._like(tabular.loc(self.df, self.id, labels))

    def iloc(self, start: int, stop: int) -> SpatialFrame:
        return self._like(tabular.iloc(self.df, start, stop, [self.id]))

    def take(self, indices: list[int]) -> SpatialFrame:
        return self._like(tabular.take(self.df, indices, [self.id]))

    def filter(self, items: list[str] | None = None, like: str | None = None, regex: str | None = None) -> DataFrame:
        return tabular.filter_columns(self.df, items, like, regex)

    def drop_duplicates(self, subset: list[str], keep: str | bool = "first") -> SpatialFrame:
        return self._like(tabular.drop_duplicates(self.df, subset, [self.id], keep))

    def nlargest(self, n: int, columns: list[str], keep: str = "first") -> SpatialFrame:
        return self._like(tabular.nlargest(self.df, n, columns, keep, [self.id]))

    def nsmallest(self, n: int, columns: list[str], keep: str = "first") -> SpatialFrame:
        return self._like(tabular.nsmallest(self.df, n, columns, keep, [self.id]))

    def apply_geometry(self, function: Callable, returns: str = "binary") -> SpatialFrame:
        """A Python function of each geometry's WKB."""
        return self._like(tabular.apply_values(self.df, self.geometry, function, returns))

    def value_counts(self, column: str | None = None, dropna: bool = True) -> DataFrame:
        return tabular.value_counts(self.df, column or self.geometry, dropna)

    def unique(self, column: str | None = None) -> DataFrame:
        return tabular.unique(self.df, column or self.geometry)

    def min(self, column: str | None = None) -> Column:
        return self._reduced("min", column)

    def max(self, column: str | None = None) -> Column:
        return self._reduced("max", column)

    def sum(self, column: str | None = None) -> Column:
        return self._reduced("sum", column)

    def _reduced(self, name: str, column: str | None) -> Column:
        column = column or self.geometry
        if column == self.geometry or dict(self.df.dtypes).get(column) == "binary":
            raise TypeError(f"geometries have no {name}")
        return getattr(F, name)(column)

    # ---- the index: cells are found when two frames are joined, so there is nothing to build

    @property
    def sindex(self) -> joins.Index:
        return joins.Index(self._side())

    def has_sindex(self) -> bool:
        """Whether an index has been built: never, see ``sindex``."""
        return False

    def isna(self) -> Column:
        return F.col(self.geometry).isNull()

    def notna(self) -> Column:
        return F.col(self.geometry).isNotNull()

    # ---- measures of the active geometry

    def __getattr__(self, name: str):
        """Functions of ``geometry`` on the active column: ``frame.area()``, ``frame.buffer(2)``."""
        if name.startswith("_") or not hasattr(G, name):
            raise AttributeError(name)
        function = getattr(G, name)
        return lambda *args, **kwargs: function(self.geometry, *args, **kwargs)

    def total_bounds(self) -> DataFrame:
        return layers.total_bounds(self.df, self.geometry)

    # ---- joins

    def sjoin(self, other: SpatialFrame, how: str = "inner", predicate: str = "intersects", distance: float | str | None = None, on_attribute: tuple[str, ...] = (), lsuffix: str = "left", rsuffix: str = "right") -> DataFrame:
        left, right = replace(self._side(other), keys=on_attribute), replace(other._side(), keys=on_attribute)
        return joins.sjoin(left, right, how, predicate, lsuffix, rsuffix, distance)

    def sjoin_nearest(
        self, other: SpatialFrame, how: str = "inner", max_distance: float | None = None, lsuffix: str = "left", rsuffix: str = "right", distance_col: str | None = None, exclusive: bool = False
    ) -> DataFrame:
        """Rows of both frames by least distance, all ties kept."""
        if self.crs == 4326:
            import warnings

            warnings.warn("distances of longitudes and latitudes are in degrees; to_crs a projected CRS first", UserWarning, stacklevel=2)
        return joins.sjoin_nearest(self._side(other), other._side(), how, max_distance, distance_col, exclusive, True, lsuffix, rsuffix)

    def semijoin(self, other: SpatialFrame, predicate: str = "intersects", distance: float | None = None) -> SpatialFrame:
        return self._like(joins.left_semi(self._side(other), other._side(), predicate, distance))

    def antijoin(self, other: SpatialFrame, predicate: str = "intersects", distance: float | None = None) -> SpatialFrame:
        return self._like(joins.left_anti(self._side(other), other._side(), predicate, distance))

    # ---- layers

    def dissolve(self, by: str | list[str] | None = None, **options) -> SpatialFrame:
        return self._like(layers.dissolve(self.df, by, geometry=self.geometry, **options))

    def overlay(self, other: SpatialFrame, how: str = "intersection", **options) -> SpatialFrame:
        right = other.df if other.geometry == self.geometry else other.rename_geometry(self.geometry).df
        return self._like(layers.overlay(self.df, right, how, self.id, other.id, self.geometry, **options))

    def clip(self, mask: Column | tuple | DataFrame | SpatialFrame, keep_geom_type: bool = False) -> SpatialFrame:
        return self._like(layers.clip(self.df, mask.df if isinstance(mask, SpatialFrame) else mask, self.geometry, keep_geom_type))

    def explode(self, index_parts: bool = False) -> SpatialFrame:
        return self._like(layers.explode(self.df, self.geometry, index_parts))

    def union_all(self, method: str = "unary", grid_size: float = 0.0) -> DataFrame:
        return layers.union_all(self.df, self.geometry, method, grid_size)

    def intersection_all(self) -> DataFrame:
        return layers.intersection_all(self.df, self.geometry)

    def get_coordinates(self, include_z: bool = False, include_m: bool = False) -> DataFrame:
        return layers.get_coordinates(self.df, self.id, self.geometry, include_z, include_m)

    def hilbert_distance(self, level: int = 16) -> DataFrame:
        return layers.hilbert_distance(self.df, self.geometry, level)

    def sort_by_geometry(self) -> SpatialFrame:
        """In the order of the Hilbert curve."""
        return self._like(self.hilbert_distance().orderBy("hilbert", self.id).drop("hilbert"))
