"""Operators on whole layers: dissolve, union, overlay, clip, explode and whole-column constructions.

A layer is a DataFrame with a WKB column; the rows' order, where it matters, is that of an id
column. Unions are two-phased: geometries are united by group and salt first, so a large
group is no single task's, and the partial unions are united after.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.jts import call
from ..functions.planar import Box, wkb_box
from .joins import geometry_side, pairs
from .steps import written

SALTS, CHUNK = 16, 4096
METHODS = ("unary", "coverage", "disjoint_subset")
DIMENSIONS = {"Point": 0, "MultiPoint": 0, "LineString": 1, "LinearRing": 1, "MultiLineString": 1, "Polygon": 2, "MultiPolygon": 2}


def _ordered(order: str, value: str | Column) -> Column:
    """Values in the order of a column."""
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda s: s["v"])


#: The Java reduction of each method; disjoint subsets are found by their boxes. A coverage is united by its edges.
REDUCTIONS = {"unary": "union", "disjoint_subset": "disjoint_union"}


def union_by(df: DataFrame, keys: list[str], geometry: str = "geometry", method: str = "unary", grid_size: float = 0.0, spread: bool = False) -> DataFrame:
    """(keys, geometry): the union of each group's geometries; null geometries are left out.

    With ``spread`` the layer is counted and bounded first, and large groups are united in
    neighbourhoods: by cells of about ``CHUNK`` rows (and ``SALTS`` parts of each, for places that are denser),
    then by ever wider cells, so partial unions shrink on the way. Without, by ``SALTS`` parts and then over all.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    if grid_size and method != "unary":
        raise ValueError("grid_size goes with the unary method only")
    if method == "coverage":
        return coverage_union_by(df, keys, geometry)
    op, more = REDUCTIONS[method], [grid_size] if grid_size else []
    rows = df.where(F.col(geometry).isNotNull()).select(*keys, F.col(geometry).alias("__part"))
    salt = F.pmod(F.xxhash64("__part"), F.lit(SALTS)).alias("__salt")
    united = lambda rows, by, *p: rows.groupBy(*keys, *by).agg(G.gathered(op, F.collect_list("__part"), *p).alias("__part"))
    if not spread:
        return united(united(rows, [salt]), [], *more).withColumnRenamed("__part", geometry)
    boxed = rows.withColumn("__b", G.settled(G.bounds("__part")))
    known = lambda c: F.nanvl(F.col(f"__b.{c}"), F.lit(None).cast("double"))
    n, minx, miny, maxx, maxy = boxed.agg(F.count(F.lit(1)), F.min(known("minx")), F.min(known("miny")), F.max(known("maxx")), F.max(known("maxy"))).first()
    level = 0
    while minx is not None and n > CHUNK * 4**level:
        level += 1
    if level:
        place = lambda lo, hi, low, high: F.least(F.floor(((F.col(f"__b.{lo}") + F.col(f"__b.{hi}")) / 2 - low) / ((high - low) or 1.0) * 2**level), F.lit(2**level - 1))
        rows = boxed.select(*keys, "__part", place("minx", "maxx", minx, maxx).alias("__cx"), place("miny", "maxy", miny, maxy).alias("__cy"))
        rows = united(rows, ["__cx", "__cy", salt])
        while level:
            rows = united(rows, ["__cx", "__cy"])
            step = min(2, level)  # sixteen cells become one
            rows = rows.withColumns({c: F.shiftright(c, step) for c in ("__cx", "__cy")})
            level -= step
    return united(rows, [], *more).withColumnRenamed("__part", geometry)


def union_all(df: DataFrame, geometry: str = "geometry", method: str = "unary", grid_size: float = 0.0) -> DataFrame:
    return union_by(df.withColumn("__all", F.lit(1)), ["__all"], geometry, method, grid_size, spread=True).drop("__all")


unary_union = union_all


def coverage_union_by(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """(keys, geometry): the union of each group's polygons, which share whole edges and do not overlap.

    Polygons become directed edges with the inside on their left. An edge that two neighbours share comes once in each direction, and
    one shuffle by edge cancels such pairs; of what is left, the union's own boundary, the edges of a straight side are made one, and
    these sides are gathered and linked into rings.
    Edges that come twice in one direction, and a boundary whose area is not that of the polygons, are no coverage's: an error.
    """
    rows = df.where(F.col(geometry).isNotNull()).select(*keys, F.col(geometry).alias("__g"))
    flat = call("Edges", F.col("__g"))
    at = lambda i, k: F.element_at("__flat", (4 * i + k + 1).cast("int"))
    every = F.when(F.size("__flat") > 0, F.sequence(F.lit(0), (F.size("__flat") / 4).cast("int") - 1))
    edges = rows.select(*keys, G.settled(flat).alias("__flat")).select(*keys, "__flat", F.explode(every).alias("__i"))
    edges = edges.select(*keys, F.struct(at(F.col("__i"), 0).alias("x"), at(F.col("__i"), 1).alias("y")).alias("__a"), F.struct(at(F.col("__i"), 2).alias("x"), at(F.col("__i"), 3).alias("y")).alias("__b"))
    low, high = F.least("__a", "__b").alias("__low"), F.greatest("__a", "__b").alias("__high")
    counted = edges.groupBy(*keys, low, high).agg(F.count_if(F.col("__a") < F.col("__b")).alias("__up"), F.count_if(F.col("__a") > F.col("__b")).alias("__down"))
    refused = F.raise_error(F.lit("the geometries are no coverage: an edge comes twice in one direction"))
    once = F.when((F.col("__up") > 1) | (F.col("__down") > 1), refused.cast("boolean")).otherwise(F.col("__up") != F.col("__down"))
    first, last = F.when(F.col("__up") > 0, F.col("__low")).otherwise(F.col("__high")), F.when(F.col("__up") > 0, F.col("__high")).otherwise(F.col("__low"))
    left = written(counted.where(once).select(*keys, first.alias("__a"), last.alias("__b")))
    joined = _joined_edges(left, keys)
    ends = lambda e: F.filter(e, lambda _, i: i % 6 < 4)
    boundary = joined.select(*keys, ends("__edges").alias("__edges"))
    areas = rows.groupBy(*keys).agg(F.sum(G.area("__g")).alias("__area"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    boundary = boundary.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), "__edges")
    none = F.expr("cast(array() as array<double>)")
    return areas.join(boundary, same, "left").select(*keys, call("Linked", F.coalesce("__edges", none), F.col("__area")).alias(geometry))


def _joined_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __edges): each group's directed edges (``__a`` to ``__b``), as ``Joined`` has them, those of a straight side as one.

    A place where one edge ends and one begins, and the way is straight, is no corner of a ring. Edges are joined there in cells
    of about ``CHUNK``, then in ever wider cells, so what a group gathers at last are its sides.
    """
    halves = F.explode(F.array(*(F.struct(F.col(at).alias("at"), F.col(other).alias("other"), F.lit(end).alias("end")) for at, other, end in (("__a", "__b", 0), ("__b", "__a", 1)))))
    met = edges.select(*keys, halves.alias("__h")).groupBy(*keys, F.col("__h.at").alias("__at")).agg(
        F.collect_list(F.struct("__h.other", "__h.end")).alias("__e"), F.max(F.when(F.col("__h.end") == 1, F.col("__h.other"))).alias("__from"), F.max(F.when(F.col("__h.end") == 0, F.col("__h.other"))).alias("__to")
    )
    straight = (F.size("__e") == 2) & call("Straight", *(F.col(f"{p}.{c}") for p in ("__from", "__at", "__to") for c in ("x", "y")))
    half = met.select(*keys, "__at", straight.cast("double").alias("__p"), F.explode("__e").alias("__o"))
    ahead, zero = F.col("__o.end") == 0, F.lit(0.0)
    start, end = F.when(ahead, F.col("__at")).otherwise(F.col("__o.other")), F.when(ahead, F.col("__o.other")).otherwise(F.col("__at"))
    half = half.select(*keys, start.alias("__a"), end.alias("__b"), F.when(ahead, F.col("__p")).otherwise(zero).alias("__pa"), F.when(ahead, zero).otherwise(F.col("__p")).alias("__pb"))
    n, minx, miny, maxx, maxy = edges.agg(F.count(F.lit(1)), F.min("__a.x"), F.min("__a.y"), F.max("__a.x"), F.max("__a.y")).first()
    level = 0
    while n > CHUNK * 4**level:
        level += 1
    place = lambda c, low, high: F.least(F.floor(((F.col(f"__a.{c}") + F.col(f"__b.{c}")) / 2 - low) / ((high - low) or 1.0) * 2**level), F.lit(2**level - 1))
    rows = half.select(*keys, F.array("__a.x", "__a.y", "__b.x", "__b.y", "__pa", "__pb").alias("__edges"), *((place("x", minx, maxx).alias("__cx"), place("y", miny, maxy).alias("__cy")) if level else ()))
    joined = lambda rows, *by: rows.groupBy(*keys, *by).agg(F.flatten(F.collect_list("__edges")).alias("__edges")).withColumn("__edges", G.settled(call("Joined", F.col("__edges"))))
    while level:
        rows, step = joined(rows, "__cx", "__cy"), min(2, level)
        rows = rows.withColumns({c: F.shiftright(c, step) for c in ("__cx", "__cy")})
        level -= step
    return joined(rows)


def box_union_by(df: DataFrame, keys: list[str], geometry: str = "geometry") -> DataFrame:
    """(keys, geometry): the union of each group's geometries, which is the box around them where they are boxes that fill it.

    Boxes fill the one around them without overlapping if their areas sum up to its area and, but for its own corners, each place is a
    corner of an even number of them. Both are sums, so nothing is gathered; other groups are united as any geometries are.
    """
    around = df.select(*keys, F.col(geometry).alias("__g"), G.settled(G.bounds(geometry)).alias("__b")).where(~F.isnan("__b.minx"))
    area = lambda p: (F.col(p + "maxx") - F.col(p + "minx")) * (F.col(p + "maxy") - F.col(p + "miny"))
    whole = around.groupBy(*keys).agg(
        *(f(f"__b.{c}").alias("__" + c) for f, c in ((F.min, "minx"), (F.min, "miny"), (F.max, "maxx"), (F.max, "maxy"))),
        F.sum(area("__b.")).alias("__sum"), F.bool_and(F.abs(G.area("__g") - area("__b.")) <= 1e-12 * area("__b.")).alias("__boxes"),
    )
    corners = F.array(*(F.struct(F.col(f"__b.{x}").alias("x"), F.col(f"__b.{y}").alias("y")) for x in ("minx", "maxx") for y in ("miny", "maxy")))
    odd = around.select(*keys, F.explode(corners).alias("__at")).groupBy(*keys, "__at").agg(F.count(F.lit(1)).alias("__n")).where("__n % 2 = 1")
    odd = odd.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(
        F.count(F.lit(1)).alias("__odd"), F.min("__at.x").alias("__x0"), F.min("__at.y").alias("__y0"), F.max("__at.x").alias("__x1"), F.max("__at.y").alias("__y1")
    )
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    outer = reduce(Column.__and__, (F.col(a) == F.col(b) for a, b in (("__x0", "__minx"), ("__y0", "__miny"), ("__x1", "__maxx"), ("__y1", "__maxy"))))
    fills = F.col("__boxes") & (F.abs(F.col("__sum") - area("__")) <= 1e-9 * area("__")) & (F.col("__odd") == 4) & outer
    told = written(whole.join(odd, same, "left").select(*keys, *("__" + c for c in ("minx", "miny", "maxx", "maxy")), F.coalesce(fills, F.lit(False)).alias("__fills")))
    box = wkb_box(Box(*(F.col("__" + c) for c in ("minx", "miny", "maxx", "maxy")))).alias(geometry)
    rest = told.where("not __fills").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    return told.where("__fills").select(*keys, box).unionByName(union_by(df.join(rest, same, "left_semi"), keys, geometry))


def intersection_all(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The common part of all geometries, by salts and then over all."""
    salt = F.pmod(F.xxhash64(geometry), F.lit(SALTS)).alias("__salt")
    parts = df.where(F.col(geometry).isNotNull()).groupBy(salt).agg(G.gathered("intersection", F.collect_list(geometry)).alias("__part"))
    return parts.agg(G.gathered("intersection", F.collect_list("__part")).alias(geometry))


def total_bounds(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """(minx, miny, maxx, maxy) over all rows; null and empty are left out, NaN if none is left."""
    box = df.select(G.bounds(geometry).alias("b")).where(~F.isnan("b.minx"))
    nan = F.lit(float("nan"))
    return box.agg(
        *(F.coalesce(F.min(f"b.{c}"), nan).alias(c) for c in ("minx", "miny")), *(F.coalesce(F.max(f"b.{c}"), nan).alias(c) for c in ("maxx", "maxy"))
    )


def reducer(name: str, column: str | Column, order: str | None = None) -> Column:
    """A named reducer: sum, count, mean, min, max, first, last, any, all, size, nunique, median, std, var or prod, of a column or an expression.

    first and last are those of the non-null values in the order of ``order``.
    """
    c = F.col(column) if isinstance(column, str) else column
    if name in ("first", "last"):
        if not order:
            raise ValueError(f"{name} needs the column that the rows are in the order of")
        pick = F.min_by if name == "first" else F.max_by
        return pick(c, F.when(c.isNotNull(), F.col(order)))
    made = {
        "any": lambda: F.bool_or(c.cast("boolean")),
        "all": lambda: F.bool_and(c.cast("boolean")),
        "mean": lambda: F.avg(c),
        "size": lambda: F.count(F.lit(1)),
        "nunique": lambda: F.count_distinct(c),
        "std": lambda: F.stddev_samp(c),
        "var": lambda: F.var_samp(c),
        "prod": lambda: F.product(c),
    }
    return made[name]() if name in made else getattr(F, name)(c)


def _named(how: str | Callable[..., Column]) -> str:
    return how if isinstance(how, str) else getattr(how, "__name__", "function").replace("<lambda>", "lambda")


def dissolve(
    df: DataFrame,
    by: str | list[str] | None = None,
    aggfunc: str | Callable[..., Column] | list | dict = "first",
    geometry: str = "geometry",
    order: str | None = None,
    dropna: bool = True,
    method: str = "unary",
    grid_size: float = 0.0,
    categories: dict[str, list] | None = None,
) -> DataFrame:
    """Groups with the union of their geometries and their aggregated attributes.

    A reducer is a name, or a callable that takes a column and gives an aggregate of it: an expression
    (``lambda c: F.max(c) - F.min(c)``) or a grouped-aggregate pandas UDF. A list of them gives columns named ``column_reducer``.
    ``first`` and ``last`` need ``order``. Rows with a null key are left
    out unless ``dropna`` is false. ``by`` None makes one group of all. ``categories`` are keys' values
    that have a group even if no row has them: one with null attributes and geometry.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    rows = df.na.drop(subset=keys) if keys and dropna else df
    rows = rows if keys else rows.withColumn("__all", F.lit(1))
    group = keys or ["__all"]
    attributes = [c for c in df.columns if c not in (*keys, geometry)]
    wanted = aggfunc if isinstance(aggfunc, dict) else dict.fromkeys(attributes, aggfunc)
    made = []
    for column, how in wanted.items():
        several = isinstance(how, list)
        for one in how if several else [how]:
            value = reducer(one, column, order) if isinstance(one, str) else one(F.col(column))
            made.append(value.alias(f"{column}_{_named(one)}" if several else column))
    shapes = union_by(rows, group, geometry, method, grid_size, spread=True)
    if made:
        summed = rows.groupBy(*group).agg(*made)
        renamed = shapes.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(group)), geometry)
        on = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(group)))
        shapes = summed.join(renamed, on, "left").select(*summed.columns, geometry)
    for key, values in (categories or {}).items():
        every = df.sparkSession.createDataFrame([(v,) for v in values], df.select(key).schema)
        shapes = every.join(shapes, key, "full").select(*shapes.columns)
    return shapes.drop("__all")


def dissolved_intersects(df: DataFrame, by: str, shape: Column, geometry: str = "geometry", predicate: str = "intersects") -> DataFrame:
    """(by, hit): whether a group's union is in a relation to a shape.

    Members decide ``intersects``, ``disjoint``, ``covered_by`` and ``within`` of the union each by itself. For ``covers`` and
    ``contains`` several may do it together, so those that touch the shape, and only they, are united. Other relations are not decided by pieces.
    """
    test = lambda name: F.when(F.col(geometry).isNotNull() & ~G.is_empty(geometry), G.relates(name, geometry, shape))
    if predicate == "intersects":
        hit = F.bool_or(test("intersects"))
    elif predicate == "disjoint":
        hit = F.bool_and(~test("intersects"))
    elif predicate == "covered_by":
        hit = F.bool_and(test("covered_by"))
    elif predicate == "within":
        hit = F.bool_and(test("covered_by")) & F.bool_or(test("within"))
    elif predicate in ("covers", "contains"):
        united = union_by(df.where(test("intersects")), [by], geometry, spread=True).select(F.col(by).alias("__by"), G.relates(predicate, geometry, shape).alias("__hit"))
        return df.select(by).distinct().join(united, F.col(by).eqNullSafe(F.col("__by")), "left").select(by, F.coalesce("__hit", F.lit(False)).alias("hit"))
    else:
        raise ValueError(f"not decided by the members of a union: {predicate}")
    return df.groupBy(by).agg(F.coalesce(hit, F.lit(predicate == "disjoint")).alias("hit"))


def explode(df: DataFrame, geometry: str = "geometry", index_parts: bool = False) -> DataFrame:
    """A row for each part of a geometry; rows with a null geometry stay."""
    parts = df.select(*(c for c in df.columns if c != geometry), F.posexplode_outer(G.dump(geometry)).alias("part", geometry))
    return parts if index_parts else parts.drop("part")


def get_coordinates(
    df: DataFrame, id: str, geometry: str = "geometry", include_z: bool = False, include_m: bool = False, ignore_index: bool = False, index_parts: bool = True
) -> DataFrame:
    """(id, part, x, y[, z][, m]): a row for each vertex; without its id or its place in the geometry if not asked for."""
    rows = df.select(id, F.posexplode(G.coordinates(geometry)).alias("part", "c"))
    return rows.select(*[id] * (not ignore_index), *["part"] * (index_parts and not ignore_index), "c.x", "c.y", *["c.z"] * include_z, *["c.m"] * include_m)


def hilbert_distance(df: DataFrame, geometry: str = "geometry", level: int = 16, total: tuple[float, float, float, float] | None = None) -> DataFrame:
    """``df`` with ``hilbert``: the code of each box's middle on a grid of 2**level over all boxes."""
    from ..functions.planar import hilbert

    minx, miny, maxx, maxy = total or total_bounds(df, geometry).first()
    side = float((1 << level) - 1)
    scaled = lambda lo, hi, low, high: F.floor((( F.col(f"__b.{lo}") + F.col(f"__b.{hi}")) / 2 - low) / ((high - low) or 1.0) * side)
    rows = df.withColumn("__b", G.bounds(geometry))
    rows = rows.withColumn("hilbert", hilbert(scaled("minx", "maxx", minx, maxx), scaled("miny", "maxy", miny, maxy), level))
    return rows.drop("__b")


# ------------------------------------------------------------------ clip and overlay


def clip(
    df: DataFrame,
    mask: Column | tuple[float, float, float, float] | DataFrame,
    geometry: str = "geometry",
    keep_geom_type: bool = False,
    id: str | None = None,
) -> DataFrame:
    """The rows' parts inside a mask; rows without any are dropped.

    A tuple is a rectangle, a column is a geometry. A DataFrame masks by the union of its
    geometries: with ``id``, the id column of ``df``, only the pieces that touch a row are united
    for it, by a cell join, and no union of the whole mask is made; without, all are united first.
    Rows are tested by predicate first, and those that the mask covers stay as they are.
    """
    if isinstance(mask, DataFrame) and id:
        pieces = mask.where(F.col(geometry).isNotNull()).select(F.md5(geometry).alias("__piece"), F.col(geometry).alias("__mask"))
        pieces = written(pieces.dropDuplicates(["__piece"]))
        found = pairs(geometry_side(df, id, geometry), geometry_side(pieces, "__piece", "__mask"), "intersects")
        touched = found.join(pieces, F.col("right_id") == F.col("__piece")).select(F.col("left_id").alias("__id"), "__mask")
        masked = df.join(union_by(touched, ["__id"], "__mask"), F.col(id) == F.col("__id")).drop("__id")
        return clip(masked, F.col("__mask"), geometry, keep_geom_type).drop("__mask")
    if isinstance(mask, tuple):
        from ..functions.planar import literal_box

        shape = literal_box(*mask)
    elif isinstance(mask, DataFrame):
        wkb = union_all(mask.select(F.col(mask.columns[-1] if geometry not in mask.columns else geometry).alias("geometry"))).first()
        shape = F.lit(bytearray(wkb[0])) if wkb and wkb[0] is not None else F.lit(None).cast("binary")
    else:
        shape = mask
    rows = df.where(G.intersects(geometry, shape))
    cut = F.when(G.covered_by(geometry, shape), F.col(geometry)).otherwise(G.intersection(geometry, shape))
    if keep_geom_type:
        kind = G.geom_type(geometry)
        cut = F.when(kind.endswith("Polygon"), G.collection_extract(cut, 2)).when(kind.endswith("LineString"), G.collection_extract(cut, 1)).otherwise(cut)
    return rows.withColumn(geometry, G.settled(cut)).where(~G.is_empty(geometry))


def _prepared(df: DataFrame, geometry: str, make_valid: bool) -> DataFrame:
    if make_valid:
        return df.withColumn(geometry, G.settled(F.when(G.is_valid(geometry), F.col(geometry)).otherwise(G.make_valid(geometry))))
    if not df.where(F.col(geometry).isNotNull() & ~G.is_valid(geometry)).isEmpty():
        raise ValueError("invalid input geometries")
    return df


def _dimensions(geometry: str, *frames: DataFrame) -> list[int | None]:
    """The dimension of each frame's geometries, in one job; None for a frame without any."""
    kinds = [f.where(F.col(geometry).isNotNull()).agg(F.lit(i).alias("side"), F.collect_set(G.geom_type(geometry)).alias("kinds")) for i, f in enumerate(frames)]
    found = {r["side"]: {DIMENSIONS.get(k, -1) for k in r["kinds"]} for r in reduce(DataFrame.unionAll, kinds).collect()}
    if any(len(d) > 1 for d in found.values()):
        raise NotImplementedError("a side of an overlay has geometries of one family")
    return [next(iter(found[i]), None) for i in range(len(frames))]


def overlay(
    left: DataFrame,
    right: DataFrame,
    how: str = "intersection",
    left_id: str = "id",
    right_id: str = "id",
    geometry: str = "geometry",
    keep_geom_type: bool = True,
    make_valid: bool = True,
) -> DataFrame:
    """Set operations of two layers: intersection, union, identity, symmetric_difference, difference.

    Columns of both frames are kept, with suffixes ``_1`` and ``_2`` where names clash; those of
    the side a part does not come from are null. Empty results are dropped.
    """
    if how not in ("intersection", "union", "identity", "symmetric_difference", "difference"):
        raise ValueError(f"no such how: {how}")
    a, b = _prepared(left, geometry, make_valid), _prepared(right, geometry, make_valid)
    dimension = _dimensions(geometry, *((a, b) if keep_geom_type else (a,)))[0]
    shared = (set(a.columns) & set(b.columns)) - {geometry}
    name_1 = {c: f"{c}_1" if c in shared else c for c in a.columns if c != geometry}
    name_2 = {c: f"{c}_2" if c in shared else c for c in b.columns if c != geometry}
    found = pairs(geometry_side(a, left_id, geometry), geometry_side(b, right_id, geometry), "intersects")

    def kept(rows: DataFrame) -> DataFrame:
        if keep_geom_type and dimension is not None:
            rows = rows.withColumn(geometry, G.collection_extract(geometry, dimension))
        rows = rows.withColumn(geometry, G.settled(geometry))
        return rows.where(F.col(geometry).isNotNull() & ~G.is_empty(geometry))

    def common() -> DataFrame:
        l_rows = a.select(F.col(left_id).alias("__l"), F.col(geometry).alias("__ga"), *(F.col(c).alias(n) for c, n in name_1.items()))
        r_rows = b.select(F.col(right_id).alias("__r"), F.col(geometry).alias("__gb"), *(F.col(c).alias(n) for c, n in name_2.items()))
        rows = found.join(l_rows, F.col("left_id") == F.col("__l")).join(r_rows, F.col("right_id") == F.col("__r"))
        return kept(rows.select(*name_1.values(), *name_2.values(), G.intersection("__ga", "__gb").alias(geometry)))

    def minus(x: DataFrame, y: DataFrame, x_id: str, y_id: str, mine: str, other: str, names: dict[str, str]) -> DataFrame:
        partners = y.select(F.col(y_id).alias("__y"), F.col(geometry).alias("__gy"))
        taken = found.join(partners, F.col(other) == F.col("__y")).select(F.col(mine).alias("__x"), F.col("__gy"))
        taken = union_by(taken, ["__x"], "__gy")
        rows = x.select(F.col(x_id).alias("__id"), F.col(geometry).alias("__g"), *(F.col(c).alias(n) for c, n in names.items()))
        rows = rows.join(taken, F.col("__id") == F.col("__x"), "left")
        left_over = F.when(F.col("__gy").isNull(), F.col("__g")).otherwise(G.difference("__g", "__gy"))
        return kept(rows.select(*names.values(), left_over.alias(geometry)))

    first = lambda names=name_1: minus(a, b, left_id, right_id, "left_id", "right_id", names)
    second = lambda: minus(b, a, right_id, left_id, "right_id", "left_id", name_2)
    if how == "difference":
        return first({c: c for c in name_1})
    if how == "intersection":
        return common()
    out = first()
    if how in ("identity", "union"):
        out = common().unionByName(out, allowMissingColumns=True)
    if how in ("symmetric_difference", "union"):
        out = out.unionByName(second(), allowMissingColumns=True)
    return out.select(*[c for c in out.columns if c != geometry], geometry)


# ------------------------------------------------------------------ whole-column constructions


def _whole(df: DataFrame, geometry: str, order: str | None = None) -> DataFrame:
    """All geometries of a column in one row: for constructions that need them together."""
    return df.agg((_ordered(order, geometry) if order else F.collect_list(geometry)).alias("all"))


def _exploded(op: str) -> Callable[..., DataFrame]:
    def run(df: DataFrame, geometry: str, *numbers: float) -> DataFrame:
        return _whole(df, geometry).select(F.explode(G.gathered_parts(op, F.col("all"), *numbers)).alias(geometry))

    return run


def delaunay_triangles(df: DataFrame, geometry: str = "geometry", tolerance: float = 0.0, only_edges: bool = False) -> DataFrame:
    return _exploded("delaunay")(df, geometry, tolerance, float(only_edges))


def voronoi_polygons(
    df: DataFrame, geometry: str = "geometry", tolerance: float = 0.0, extend_to: tuple[float, float, float, float] | None = None, only_edges: bool = False
) -> DataFrame:
    return _exploded("voronoi")(df, geometry, tolerance, float(only_edges), *(extend_to or ()))


def build_area(df: DataFrame, geometry: str = "geometry", node: bool = True) -> DataFrame:
    return _whole(df, geometry).select(G.gathered("build_area", F.col("all"), float(node)).alias(geometry))


def polygonize(df: DataFrame, geometry: str = "geometry", node: bool = True, part: str = "polygons") -> DataFrame:
    """Faces of linework, or with ``part`` its cuts, dangles or invalid ring lines."""
    return _exploded("polygonize")(df, geometry, float(node), ("polygons", "cuts", "dangles", "invalid").index(part))


def _rowwise(df: DataFrame, id: str, geometry: str, op: str, *numbers: float) -> DataFrame:
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(id).alias("id"), F.col(geometry).alias("g")))).alias("all"))
    made = G.gathered_parts(op, F.transform("all", lambda s: s["g"]), *numbers)
    zipped = rows.select(F.explode(F.arrays_zip(F.transform("all", lambda s: s["id"]).alias("id"), made.alias("g"))).alias("z"))
    return zipped.select(F.col("z.id").alias(id), F.col("z.g").alias(geometry))


def simplify_coverage(df: DataFrame, tolerance: float, id: str = "id", geometry: str = "geometry", simplify_boundary: bool = True) -> DataFrame:
    return _rowwise(df, id, geometry, "simplify_coverage", tolerance, float(simplify_boundary))


def invalid_coverage_edges(df: DataFrame, id: str = "id", geometry: str = "geometry", gap_width: float = 0.0) -> DataFrame:
    """(id, geometry): the edges of each row that break the coverage, null if none does."""
    return _rowwise(df, id, geometry, "invalid_coverage_edges", gap_width)


def is_valid_coverage(df: DataFrame, id: str = "id", geometry: str = "geometry", gap_width: float = 0.0) -> DataFrame:
    edges = invalid_coverage_edges(df, id, geometry, gap_width)
    return edges.agg(F.coalesce(F.bool_and(F.col(geometry).isNull() | G.is_empty(geometry)), F.lit(True)).alias("valid"))
