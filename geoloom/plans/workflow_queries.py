"""The workflows on the driver's tables, each held against arithmetic on rectangles.

Square caps and mitred corners make every buffer a rectangle; reaches end in a tenth, so that no
edge of a buffer falls on an edge of a layer, whose coordinates are multiples of a quarter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.planar import Box, wkb_box, wkb_point
from . import workflows as W
from .fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ADMIN = (15.5, 5.5, 880.5, 700.5)
SQUARE = {"cap_style": "square", "join_style": "mitre"}
FLAT = {"cap_style": "flat", "join_style": "mitre"}


def _against(name: str, sql: str | None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES["workflow_" + name] = function
        if sql:
            ORACLES["workflow_" + name] = with_views(sql)
        return function

    return add


def _boxes(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return view(spark, d, name).select(*columns, wkb_box(Box.of()).alias("geometry"))


def _points(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return view(spark, d, name).select(*columns, wkb_point("x", "y").alias("geometry"))


def _roads(spark: SparkSession, d: str) -> DataFrame:
    end = lambda x: F.concat_ws(" ", F.col(x).cast("string"), F.col("y").cast("string"))
    line = F.concat(F.lit("LINESTRING ("), end("x0"), F.lit(", "), end("x1"), F.lit(")"))
    return view(spark, d, "road").select("roadid", G.from_wkt(line).alias("geometry"))


def _area(name: str = "area"):
    return F.round(G.area("geometry"), 6).alias(name)


def _cut(name: str, source: str, columns: str, frame: str = "15.5e0 AS x0, 5.5e0 AS y0, 880.5e0 AS x1, 700.5e0 AS y1", strict: bool = True) -> str:
    """SQL: a table of the parts of a view's rectangles inside a frame."""
    less = "<" if strict else "<="
    return f"""{name} AS (SELECT {columns}, greatest(xmin, x0) AS xmin, greatest(ymin, y0) AS ymin, least(xmax, x1) AS xmax, least(ymax, y1) AS ymax
  FROM {source}, (SELECT {frame}) AS frame WHERE greatest(xmin, x0) {less} least(xmax, x1) AND greatest(ymin, y0) {less} least(ymax, y1))"""


def _inner(share: float) -> str:
    """SQL: the frame of the inner parcels."""
    lo = lambda a, b: f"min({a}) + (max({b}) - min({a})) * {share}e0"
    hi = lambda a, b: f"max({b}) - (max({b}) - min({a})) * {share}e0"
    return f"{lo('xmin', 'xmax')} AS x0, {lo('ymin', 'ymax')} AS y0, {hi('xmin', 'xmax')} AS x1, {hi('ymin', 'ymax')} AS y1 FROM parcel"


def _meet(a: str, b: str, less: str = "<") -> str:
    return f"{a}.xmin {less} {b}.xmax AND {b}.xmin {less} {a}.xmax AND {a}.ymin {less} {b}.ymax AND {b}.ymin {less} {a}.ymax"


def _both(a: str, b: str) -> str:
    return f"greatest({a}.xmin, {b}.xmin) AS xmin, greatest({a}.ymin, {b}.ymin) AS ymin, least({a}.xmax, {b}.xmax) AS xmax, least({a}.ymax, {b}.ymax) AS ymax"


_AREA = "(xmax - xmin) * (ymax - ymin)"


def _strips(r: str) -> str:
    return f"strip AS (SELECT roadid, x0 AS xmin, x1 AS xmax, y - {r}e0 AS ymin, y + {r}e0 AS ymax FROM road)"


def _around(name: str, source: str, key: str, r: str, where: str = "true") -> str:
    return f"{name} AS (SELECT {key}, x - {r}e0 AS xmin, y - {r}e0 AS ymin, x + {r}e0 AS xmax, y + {r}e0 AS ymax FROM {source} WHERE {where})"


@_against("flood_exposure", f"""SELECT buildingkey, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, round(32 * 2500 * sin(pi() / 32), 6) AS area
FROM building b WHERE EXISTS (SELECT 1 FROM patch f WHERE {_meet("b", "f", "<=")})""")
def flood_exposure(spark: SparkSession, d: str) -> DataFrame:
    made = W.flood_exposure(_boxes(spark, d, "building", "buildingkey"), _boxes(spark, d, "patch", "patchid"), "buildingkey", "patchid")
    centre = G.centroid("geometry")
    return made.select("buildingkey", F.round(G.x(centre), 6).alias("cx"), F.round(G.y(centre), 6).alias("cy"), _area())


@_against("nearby_buildings", """WITH numbered AS (SELECT *, row_number() OVER (ORDER BY buildingkey) - 1 AS place, count(*) OVER () AS n FROM building),
seed AS (SELECT (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM numbered WHERE place = n // 2)
SELECT buildingkey FROM building, seed WHERE sqrt(power(greatest(xmin - cx, 0, cx - xmax), 2) + power(greatest(ymin - cy, 0, cy - ymax), 2)) <= 180.1""")
def nearby_buildings(spark: SparkSession, d: str) -> DataFrame:
    return W.nearby_buildings(_boxes(spark, d, "building", "buildingkey"), "buildingkey", 180.1).select("buildingkey")


@_against("parcel_zoning", f"""WITH {_cut("inside", "parcel", "parcelid", _inner(0.2))}
SELECT parcelid, zonekey, round({_AREA}, 6) AS area FROM (SELECT parcelid, zonekey, {_both("p", "z")} FROM inside p JOIN zone z ON {_meet("p", "z")})""")
def parcel_zoning(spark: SparkSession, d: str) -> DataFrame:
    made = W.parcel_zoning(_boxes(spark, d, "parcel", "parcelid"), _boxes(spark, d, "zone", "zonekey"), "parcelid", "zonekey")
    return made.select("parcelid", "zonekey", _area())


@_against("network_service_area", f"""WITH {_strips("18.1")}, {_cut("piece", "strip", "roadid")}
SELECT round(sum({_AREA}), 6) AS area, CAST(count(*) AS INTEGER) AS parts FROM piece""")
def network_service_area(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.planar import literal_box

    made = W.network_service_area(_roads(spark, d), literal_box(*ADMIN), 18.1, **FLAT)
    return made.select(_area(), G.count_geometries("geometry").cast("int").alias("parts"))


_VEGETATION = f"""{_strips("10.1")},
piece AS (SELECT buildingkey, {_both("b", "s")} FROM building b JOIN strip s ON {_meet("b", "s")})"""


def _corridor(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    vegetation, poles = _boxes(spark, d, "building", "buildingkey"), _points(spark, d, "site", "siteid")
    return W.vegetation_corridor(_roads(spark, d), vegetation, poles, "buildingkey", "siteid", 10.1, 3.3, **FLAT | {"cap_style": "square"})


@_against("vegetation_corridor", f"""WITH road_end AS (SELECT roadid, x0 - 10.1e0 AS xmin, x1 + 10.1e0 AS xmax, y - 10.1e0 AS ymin, y + 10.1e0 AS ymax FROM road)
SELECT buildingkey, round(sum({_AREA}), 6) AS area FROM (SELECT buildingkey, {_both("b", "s")} FROM building b JOIN road_end s ON {_meet("b", "s")}) GROUP BY buildingkey""")
def vegetation_corridor(spark: SparkSession, d: str) -> DataFrame:
    return _corridor(spark, d)[0].select("buildingkey", _area())


_PRIORITY = f"""{_strips("18.1")}, {_cut("corridor", "strip", "roadid")},
inside AS (SELECT buildingkey, {_both("b", "s")} FROM building b JOIN corridor s ON {_meet("b", "s")}),
wet AS (SELECT buildingkey, patchid, {_both("b", "f")} FROM inside b JOIN patch f ON {_meet("b", "f")})"""


def _priority(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return W.corridor_flood_priority(
        _roads(spark, d), _boxes(spark, d, "building", "buildingkey"), _boxes(spark, d, "patch", "patchid"), _points(spark, d, "site", "siteid"),
        ADMIN, "buildingkey", "patchid", "siteid", 18.1, 12.3, **FLAT,
    )


@_against("corridor_flood_priority", f"WITH {_PRIORITY} SELECT buildingkey, patchid, round(sum({_AREA}), 6) AS area FROM wet GROUP BY buildingkey, patchid")
def corridor_flood_priority(spark: SparkSession, d: str) -> DataFrame:
    return _priority(spark, d)[0].select("buildingkey", "patchid", _area())


@_against("corridor_flood_poles", f"WITH {_PRIORITY} SELECT siteid FROM site WHERE EXISTS (SELECT 1 FROM wet WHERE x BETWEEN xmin - 12.3 AND xmax + 12.3 AND y BETWEEN ymin - 12.3 AND ymax + 12.3)")
def corridor_flood_poles(spark: SparkSession, d: str) -> DataFrame:
    return _priority(spark, d)[1].select("siteid")


@_against("emergency_response_catchments", f"""WITH numbered AS (SELECT *, row_number() OVER (ORDER BY depotid) - 1 AS place, greatest(count(*) OVER () // 48, 1) AS step FROM depot),
{_around("catchment", "numbered", "depotid", "110.1", "place % step = 0 AND place < step * 48")}, {_cut("block", "parcel", "parcelid, segment")},
covered AS (SELECT segment, parcelid, {_both("b", "c")} FROM block b JOIN catchment c ON {_meet("b", "c")}),
served AS (SELECT count(*) AS n FROM site WHERE EXISTS (SELECT 1 FROM catchment WHERE x > xmin AND x < xmax AND y > ymin AND y < ymax))
SELECT segment, count(*) AS blocks, round(sum({_AREA}), 4) AS covered_area, round(min(xmin), 6) AS minx, round(max(ymax), 6) AS maxy, (SELECT n FROM served) AS served_incidents FROM covered GROUP BY segment""")
def emergency_response_catchments(spark: SparkSession, d: str) -> DataFrame:
    made = W.emergency_response_catchments(
        _boxes(spark, d, "parcel", "parcelid", "segment"), _points(spark, d, "site", "siteid"), _points(spark, d, "depot", "depotid"), ADMIN, "parcelid", "segment", "siteid", "depotid", radius=110.1, **SQUARE
    )
    b = G.bounds("geometry")
    return made.select(
        "segment", F.col("parcelid").alias("blocks"), F.round("covered_area", 4).alias("covered_area"), F.round(b["minx"], 6).alias("minx"), F.round(b["maxy"], 6).alias("maxy"), "served_incidents"
    )


_OCCUPIED = f"""{_cut("house", "building", "buildingkey")}, {_cut("lot", "parcel", "parcelid")}, {_around("reach", "depot", "depotid", "60.1")},
near AS (SELECT * FROM house h WHERE EXISTS (SELECT 1 FROM depot t WHERE sqrt(power((h.xmin + h.xmax) / 2 - t.x, 2) + power((h.ymin + h.ymax) / 2 - t.y, 2)) <= 120.1)),
reached AS (SELECT parcelid, depotid, {_both("p", "r")} FROM lot p JOIN reach r ON {_meet("p", "r")}),
reached_less AS (SELECT p.parcelid, p.depotid, sum(greatest(least(p.xmax, f.xmax) - greatest(p.xmin, f.xmin), 0) * greatest(least(p.ymax, f.ymax) - greatest(p.ymin, f.ymin), 0)) AS taken
  FROM reached p JOIN patch f ON {_meet("p", "f")} GROUP BY p.parcelid, p.depotid),
served AS (SELECT DISTINCT parcelid FROM reached LEFT JOIN reached_less USING (parcelid, depotid) WHERE {_AREA} - coalesce(taken, 0) > 1e-9),
both_of AS (SELECT parcelid, buildingkey, {_both("p", "h")} FROM lot p JOIN near h ON {_meet("p", "h")} WHERE parcelid IN (SELECT parcelid FROM served)),
both_less AS (SELECT p.parcelid, p.buildingkey, sum(greatest(least(p.xmax, f.xmax) - greatest(p.xmin, f.xmin), 0) * greatest(least(p.ymax, f.ymax) - greatest(p.ymin, f.ymin), 0)) AS taken
  FROM both_of p JOIN patch f ON {_meet("p", "f")} GROUP BY p.parcelid, p.buildingkey)"""


def _occupied(spark: SparkSession, d: str) -> DataFrame:
    return W.accessible_occupied(
        _boxes(spark, d, "building", "buildingkey"), _boxes(spark, d, "parcel", "parcelid"), _points(spark, d, "depot", "depotid"), _boxes(spark, d, "patch", "patchid"),
        ADMIN, "buildingkey", "parcelid", "depotid", "patchid", 120.1, 60.1, **SQUARE,
    )


@_against("accessible_occupied", f"WITH {_OCCUPIED} SELECT parcelid, buildingkey, round({_AREA} - coalesce(taken, 0), 6) AS area FROM both_of LEFT JOIN both_less USING (parcelid, buildingkey) WHERE {_AREA} - coalesce(taken, 0) > 1e-9")
def accessible_occupied(spark: SparkSession, d: str) -> DataFrame:
    return _occupied(spark, d).select("parcelid", "buildingkey", _area())


@_against("accessibility_redevelopment", None)
def accessibility_redevelopment(spark: SparkSession, d: str) -> DataFrame:
    return W.accessibility_redevelopment(_occupied(spark, d), F.col("parcelid") % 12, 0.5).select("parcel_group", _area())


@_against("habitat_corridor_compliance", f"""WITH {_strips("15.1")}, {_cut("lot", "parcel", "parcelid, segment")},
along AS (SELECT parcelid, segment, {_both("p", "s")} FROM lot p JOIN strip s ON {_meet("p", "s")}),
hit AS (SELECT * FROM along p WHERE EXISTS (SELECT 1 FROM building h WHERE {_meet("p", "h", "<=")}) AND EXISTS (SELECT 1 FROM patch f WHERE {_meet("p", "f", "<=")}))
SELECT segment, count(*) AS parcels, round(sum({_AREA}), 6) AS impacted_area, round(sum({_AREA}), 4) AS area FROM hit GROUP BY segment""")
def habitat_corridor_compliance(spark: SparkSession, d: str) -> DataFrame:
    made = W.habitat_corridor_compliance(
        _boxes(spark, d, "parcel", "parcelid", "segment"), _roads(spark, d), _boxes(spark, d, "building", "buildingkey"), _boxes(spark, d, "patch", "patchid"),
        ADMIN, "parcelid", "segment", "buildingkey", "patchid", 15.1, **FLAT,
    )
    return made.select("segment", F.col("parcelid").alias("parcels"), F.round("impacted_area", 6).alias("impacted_area"), F.round(G.area("geometry"), 4).alias("area"))


@_against("insurance_flood_screening", f"""WITH {_cut("lot", "parcel", "parcelid")},
wet AS (SELECT parcelid, patchid, (p.xmax - p.xmin) * (p.ymax - p.ymin) AS parcel_area, {_both("p", "f")} FROM lot p JOIN patch f ON {_meet("p", "f")}),
ratio AS (SELECT parcelid, patchid, {_AREA} AS wet_area, {_AREA} / parcel_area AS flood_ratio FROM wet)
SELECT parcelid, patchid, round(wet_area, 6) AS wet_area, round(flood_ratio, 6) AS flood_ratio FROM ratio WHERE flood_ratio >= 0.15e0
QUALIFY row_number() OVER (PARTITION BY parcelid ORDER BY flood_ratio DESC, patchid) = 1""")
def insurance_flood_screening(spark: SparkSession, d: str) -> DataFrame:
    made = W.insurance_flood_screening(_boxes(spark, d, "parcel", "parcelid"), _boxes(spark, d, "patch", "patchid"), ADMIN, "parcelid", "patchid")
    return made.select("parcelid", "patchid", F.round("wet_area", 6).alias("wet_area"), F.round("flood_ratio", 6).alias("flood_ratio"))


def _suitable(share: float, r: str) -> str:
    """SQL: inner parcels outside patches that a station's square reaches, and their patches."""
    return f"""{_cut("lot", "parcel", "parcelid", _inner(share))}, {_around("reach", "depot", "depotid", r)},
reached AS (SELECT parcelid, depotid, {_both("p", "r")} FROM lot p JOIN reach r ON {_meet("p", "r")}),
reached_less AS (SELECT p.parcelid, p.depotid, sum(greatest(least(p.xmax, f.xmax) - greatest(p.xmin, f.xmin), 0) * greatest(least(p.ymax, f.ymax) - greatest(p.ymin, f.ymin), 0)) AS taken
  FROM reached p JOIN patch f ON {_meet("p", "f")} GROUP BY p.parcelid, p.depotid),
served AS (SELECT DISTINCT parcelid FROM reached LEFT JOIN reached_less USING (parcelid, depotid) WHERE {_AREA} - coalesce(taken, 0) > 1e-9),
chosen AS (SELECT * FROM lot WHERE parcelid IN (SELECT parcelid FROM served))"""


@_against("site_suitability", f"""WITH {_suitable(0.2, "50.1")},
less AS (SELECT parcelid, sum(greatest(least(p.xmax, f.xmax) - greatest(p.xmin, f.xmin), 0) * greatest(least(p.ymax, f.ymax) - greatest(p.ymin, f.ymin), 0)) AS taken FROM chosen p JOIN patch f ON {_meet("p", "f")} GROUP BY parcelid)
SELECT parcelid, round({_AREA} - coalesce(taken, 0), 6) AS area FROM chosen LEFT JOIN less USING (parcelid)""")
def site_suitability(spark: SparkSession, d: str) -> DataFrame:
    made = W.site_suitability(_boxes(spark, d, "parcel", "parcelid"), _boxes(spark, d, "patch", "patchid"), _points(spark, d, "depot", "depotid"), "parcelid", "patchid", "depotid", radius=50.1, **SQUARE)
    return made.select("parcelid", _area())


@_against("redevelopment_screening", f"""WITH {_suitable(0.15, "40.1")},
zoned AS (SELECT parcelid, zonekey, {_both("p", "z")} FROM chosen p JOIN zone z ON {_meet("p", "z")}),
less AS (SELECT p.parcelid, p.zonekey, sum(greatest(least(p.xmax, f.xmax) - greatest(p.xmin, f.xmin), 0) * greatest(least(p.ymax, f.ymax) - greatest(p.ymin, f.ymin), 0)) AS taken FROM zoned p JOIN patch f ON {_meet("p", "f")} GROUP BY p.parcelid, p.zonekey)
SELECT zonekey % 10 AS zone_type, round(sum({_AREA} - coalesce(taken, 0)), 4) AS area FROM zoned LEFT JOIN less USING (parcelid, zonekey) GROUP BY 1 HAVING sum({_AREA} - coalesce(taken, 0)) > 1e-9""")
def redevelopment_screening(spark: SparkSession, d: str) -> DataFrame:
    zones = _boxes(spark, d, "zone", "zonekey").withColumn("zone_type", F.col("zonekey") % 10)
    made = W.redevelopment_screening(
        _boxes(spark, d, "parcel", "parcelid"), zones, _boxes(spark, d, "patch", "patchid"), _points(spark, d, "depot", "depotid"), "parcelid", "zonekey", "zone_type", "patchid", "depotid", radius=40.1, **SQUARE
    )
    return made.select("zone_type", F.round(G.area("geometry"), 4).alias("area"))


@_against("retail_trade_area_screening", f"""WITH {_around("reach", "depot", "depotid", "70.1")}, {_strips("12.1")},
{_around("rival", "site", "siteid", "9.1", "segment = 'MACHINERY'")}
SELECT (parcelid - parcelid % 250) / 250 AS submarket, count(*) AS parcels, 100.0 * count(*) AS area FROM parcel p WHERE segment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')
AND EXISTS (SELECT 1 FROM reach r WHERE {_meet("p", "r")}) AND EXISTS (SELECT 1 FROM strip s WHERE {_meet("p", "s", "<=")}) AND NOT EXISTS (SELECT 1 FROM rival v WHERE {_meet("p", "v")}) GROUP BY 1""")
def retail_trade_area_screening(spark: SparkSession, d: str) -> DataFrame:
    parcels = _boxes(spark, d, "parcel", "parcelid", "segment").where(F.col("segment").isin("AUTOMOBILE", "BUILDING", "FURNITURE"))
    rivals = _points(spark, d, "site", "siteid", "segment").where(F.col("segment") == "MACHINERY")
    submarket = (F.col("parcelid") - F.col("parcelid") % 250) / 250
    # roads end flat, squares stand around points
    roads = _roads(spark, d).withColumn("geometry", G.buffer("geometry", 12.1, **FLAT))
    made = W.retail_trade_area_screening(parcels, _points(spark, d, "depot", "depotid"), roads, rivals, "parcelid", submarket, "depotid", "roadid", "siteid", 70.1, 0.0, 9.1, **SQUARE)
    return made.select("submarket", F.col("parcelid").alias("parcels"), _area())


@_against("transit_service_gap", f"""WITH {_cut("house", "building", "buildingkey", strict=False)}, {_around("reach", "depot", "depotid", "25.1")},
gap AS (SELECT buildingkey, (xmin + xmax) / 2 - 35.1e0 AS xmin, (ymin + ymax) / 2 - 35.1e0 AS ymin, (xmin + xmax) / 2 + 35.1e0 AS xmax, (ymin + ymax) / 2 + 35.1e0 AS ymax
  FROM house h WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE {_meet("h", "r")}))
SELECT buildingkey, count(*) AS parcels, round(sum({_AREA}), 4) AS area FROM (SELECT buildingkey, {_both("g", "p")} FROM gap g JOIN parcel p ON {_meet("g", "p")}) GROUP BY buildingkey""")
def transit_service_gap(spark: SparkSession, d: str) -> DataFrame:
    made = W.transit_service_gap(
        _boxes(spark, d, "building", "buildingkey"), _boxes(spark, d, "parcel", "parcelid"), _points(spark, d, "depot", "depotid"), ADMIN, "buildingkey", "parcelid", "depotid", 25.1, 35.1, **SQUARE
    )
    return made.groupBy("buildingkey").agg(F.count(F.lit(1)).alias("parcels"), F.round(F.sum(G.area("geometry")), 4).alias("area"))
