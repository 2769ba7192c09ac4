"""The fourteen screening workflows on layers: DataFrames with an id and a WKB column ``geometry``.

Each is a composition of the layer and join operators, so nothing is collected but extents and
counts. Steps that a later join reads are written once (`steps.written`). ``shape`` has the keyword arguments of the buffers (quad_segs, cap_style, join_style).
A mask made of many buffers is never united as a whole: `layers.clip` unites, for each row, the
pieces that touch it. Distances are in the units of the coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import joins as J
from ..operators import layers as L
from ..operators import tabular as T
from ..operators.steps import written

Frame = tuple[float, float, float, float]


def _grown(df: DataFrame, distance: float, shape: dict) -> DataFrame:
    return df.withColumn("geometry", G.buffer("geometry", distance, **shape))


def _polygons(df: DataFrame) -> DataFrame:
    return df.where(G.geom_type("geometry").isin("Polygon", "MultiPolygon"))


def _semi(left: DataFrame, left_id: str, right: DataFrame, right_id: str, predicate: str = "intersects") -> DataFrame:
    return J.left_semi(J.geometry_side(left, left_id), J.geometry_side(right, right_id), predicate)


def _anti(left: DataFrame, left_id: str, right: DataFrame, right_id: str, predicate: str = "intersects") -> DataFrame:
    return J.left_anti(J.geometry_side(left, left_id), J.geometry_side(right, right_id), predicate)


def inner_frame(df: DataFrame, share: float) -> Frame | None:
    """A layer's extent less ``share`` of its width and height on each side; None if it is empty."""
    minx, miny, maxx, maxy = L.total_bounds(df).first()
    if minx != minx:
        return None
    dx, dy = (maxx - minx) * share, (maxy - miny) * share
    return minx + dx, miny + dy, maxx - dx, maxy - dy


def _inner_part(df: DataFrame, share: float) -> DataFrame:
    frame = inner_frame(df, share)
    return df.limit(0) if frame is None else written(_polygons(L.clip(df, frame)))


def flood_exposure(buildings: DataFrame, floods: DataFrame, id: str, flood_id: str, radius: float = 50.0, **shape) -> DataFrame:
    """Circles around the centres of buildings that touch a flood zone."""
    valid = buildings.withColumn("geometry", G.make_valid("geometry"))
    return _semi(written(valid), id, floods, flood_id).withColumn("geometry", G.buffer(G.centroid("geometry"), radius, **shape))


def nearby_buildings(buildings: DataFrame, id: str, radius: float = 1000.0, crs: int | None = None) -> DataFrame:
    """Buildings within a distance of the centre of the middle one by id.

    With ``crs`` distances are measured in the layer's UTM zone and the result is turned back.
    """
    measured = buildings
    if crs is not None:
        from ..frame import SpatialFrame

        utm = SpatialFrame(buildings, crs=crs).estimate_utm_crs()
        measured = buildings.withColumn("geometry", G.to_crs("geometry", crs, utm))
    middle = buildings.count() // 2
    seed = T.positions(measured.select(id, "geometry"), [id]).where(F.col("_row") == middle).select(G.centroid("geometry")).first()
    if seed is None:
        return buildings
    near = measured.where(G.dwithin("geometry", F.lit(bytearray(seed[0])), radius))
    return near if crs is None else near.withColumn("geometry", G.to_crs("geometry", utm, crs))


def parcel_zoning(parcels: DataFrame, zones: DataFrame, id: str, zone_id: str, share: float = 0.2) -> DataFrame:
    """The inner parcels cut by zones."""
    return L.overlay(_inner_part(parcels, share), zones, "intersection", id, zone_id)


def network_service_area(network: DataFrame, admin: Column | Frame, radius: float = 25.0, **shape) -> DataFrame:
    """One geometry: what lies within ``radius`` of a network, inside a boundary.

    Pieces are cut before they are united, so the union is no larger than its result.
    """
    return L.union_all(L.clip(_grown(network, radius, shape), admin))


def vegetation_corridor(lines: DataFrame, vegetation: DataFrame, poles: DataFrame, id: str, pole_id: str, radius: float = 10.0, near: float = 1.0, **shape) -> tuple[DataFrame, DataFrame]:
    """(vegetation inside the corridor of lines, poles next to a centre of it)."""
    valid = written(vegetation.withColumn("geometry", G.make_valid("geometry")))
    inside = written(L.clip(valid, _grown(lines, radius, shape), keep_geom_type=True, id=id))
    centres = inside.select(id, G.buffer(G.centroid("geometry"), near, **shape).alias("geometry"))
    return inside, _semi(poles, pole_id, centres, id, "within")


def corridor_flood_priority(
    network: DataFrame, vegetation: DataFrame, floods: DataFrame, poles: DataFrame, admin: Column | Frame, id: str, flood_id: str, pole_id: str, radius: float = 18.0, reach: float = 12.0, **shape
) -> tuple[DataFrame, DataFrame]:
    """(vegetation in the network's corridor that floods, poles within reach of it)."""
    corridor = written(_polygons(L.clip(_grown(network, radius, shape), admin)))
    inside = written(L.clip(vegetation, corridor, keep_geom_type=True, id=id))
    priority = written(L.overlay(inside, floods, "intersection", id, flood_id))
    around = _grown(priority.select(F.struct(id, flood_id).alias("__pair"), "geometry"), reach, shape)
    return priority, _semi(poles, pole_id, around, "__pair")


def emergency_response_catchments(
    blocks: DataFrame, incidents: DataFrame, stations: DataFrame, admin: Column | Frame, id: str, district: str, incident_id: str, station_id: str, most_stations: int = 48, radius: float = 110.0, **shape
) -> DataFrame:
    """Hulls of the covered blocks of each district, with covered area and incidents served.

    At most ``most_stations`` stations, evenly picked by id: that is the workflow's own parameter.
    """
    blocks = written(_polygons(L.clip(blocks, admin)))
    step = max(stations.count() // most_stations, 1)
    picked = T.positions(stations, [station_id]).where((F.col("_row") % step == 0) & (F.col("_row") < step * most_stations))
    catchments = written(_grown(picked.select(station_id, "geometry"), radius, shape))
    served = _semi(incidents, incident_id, catchments, station_id, "within").count()
    covered = L.overlay(blocks.select(id, district, "geometry"), catchments, "intersection", id, station_id).withColumn("covered_area", G.area("geometry"))
    hulls = L.dissolve(covered.drop(station_id), district, {id: "count", "covered_area": "sum"})
    return hulls.withColumn("geometry", G.convex_hull("geometry")).withColumn("served_incidents", F.lit(served).cast("long"))


def accessible_occupied(
    buildings: DataFrame, parcels: DataFrame, transit: DataFrame, exclusions: DataFrame, admin: Column | Frame, id: str, parcel_id: str, station_id: str, exclusion_id: str, reach: float = 1800.0, radius: float = 900.0, **shape
) -> DataFrame:
    """Buildings near a station on developable parcels that a station serves, pair by pair."""
    buildings, parcels = (written(_polygons(L.clip(x, admin))) for x in (buildings, parcels))
    centres = J.geometry_side(buildings.select(id, G.centroid("geometry").alias("geometry")), id)
    # stations at one place are one, as only the buildings are asked for
    nearest = J.sjoin_nearest(centres, J.alike(J.geometry_side(transit, station_id)), max_distance=reach)
    near = written(buildings.join(nearest.select(F.col("left_id").alias("__near")), F.col(id) == F.col("__near"), "left_semi"))
    developable = written(L.overlay(parcels, exclusions, "difference", parcel_id, exclusion_id))
    served = written(_semi(developable, parcel_id, _grown(transit, radius, shape), station_id))
    return L.overlay(served.select(parcel_id, "geometry"), near.select(id, "geometry"), "intersection", parcel_id, id)


def accessibility_redevelopment(occupied: DataFrame, group: Column, tolerance: float = 25.0) -> DataFrame:
    """(parcel_group, geometry): hulls of the simplified parts of each group of `accessible_occupied`."""
    parts = L.explode(L.union_by(occupied.withColumn("parcel_group", group), ["parcel_group"]))
    return parts.withColumn("geometry", G.convex_hull(G.simplify("geometry", tolerance)))


def habitat_corridor_compliance(
    parcels: DataFrame, waterways: DataFrame, habitat: DataFrame, protected: DataFrame, admin: Column | Frame, id: str, region: str, habitat_id: str, protected_id: str, setback: float = 35.0, **shape
) -> DataFrame:
    """Parcels' parts along waterways that touch habitat and protected places, by region."""
    parcels = written(_polygons(L.clip(parcels, admin)))
    along = written(_polygons(L.clip(parcels, _grown(waterways, setback, shape), id=id)))
    impacted = _semi(written(_semi(along, id, habitat, habitat_id)), id, protected, protected_id)
    impacted = impacted.select(id, region, "geometry", G.area("geometry").alias("impacted_area"))
    return L.dissolve(impacted, region, {id: "count", "impacted_area": "sum"})


def insurance_flood_screening(parcels: DataFrame, floods: DataFrame, admin: Column | Frame, id: str, flood_id: str, threshold: float = 0.15) -> DataFrame:
    """Each parcel's worst flood zone, where it takes at least ``threshold`` of the parcel."""
    parcels = written(_polygons(L.clip(parcels, admin)).select(id, G.area("geometry").alias("parcel_area"), "geometry"))
    exposure = L.overlay(parcels, floods.select(flood_id, "geometry"), "intersection", id, flood_id)
    exposure = exposure.withColumn("wet_area", G.area("geometry")).withColumn("flood_ratio", F.col("wet_area") / F.col("parcel_area"))
    risk = exposure.where(F.col("flood_ratio") >= threshold)
    worst = risk.withColumn("__less", -F.col("flood_ratio"))
    return T.drop_duplicates(worst, [id], ["__less", flood_id]).drop("__less")


def site_suitability(parcels: DataFrame, exclusions: DataFrame, transit: DataFrame, id: str, exclusion_id: str, station_id: str, share: float = 0.2, radius: float = 200.0, **shape) -> DataFrame:
    """The inner parcels' parts outside exclusions, if a station's surroundings touch them."""
    suitable = written(L.overlay(_inner_part(parcels, share), exclusions, "difference", id, exclusion_id))
    return _semi(suitable, id, _grown(transit, radius, shape), station_id)


def redevelopment_screening(
    parcels: DataFrame, zones: DataFrame, exclusions: DataFrame, transit: DataFrame, id: str, zone_id: str, zone_type: str, exclusion_id: str, station_id: str, share: float = 0.15, radius: float = 150.0, **shape
) -> DataFrame:
    """(zone_type, geometry): suitable sites united by the type of zone they are in."""
    sites = written(site_suitability(parcels, exclusions, transit, id, exclusion_id, station_id, share, radius, **shape))
    zoned = L.overlay(sites.select(id, "geometry"), zones.select(zone_id, zone_type, "geometry"), "intersection", id, zone_id)
    return L.union_by(zoned, [zone_type])


def retail_trade_area_screening(
    candidates: DataFrame, transit: DataFrame, roads: DataFrame, competitors: DataFrame, id: str, submarket: Column, station_id: str, road_id: str, competitor_id: str, access: float = 120.0, frontage: float = 45.0, exclusion: float = 90.0, **shape
) -> DataFrame:
    """Candidate parcels near transit and roads but not near competitors, by submarket."""
    sites = written(_semi(candidates, id, _grown(transit, access, shape), station_id))
    sites = written(_semi(sites, id, _grown(roads, frontage, shape), road_id))
    sites = _anti(sites, id, _grown(competitors, exclusion, shape), competitor_id)
    return L.dissolve(sites.select(id, submarket.alias("submarket"), "geometry"), "submarket", {id: "count"})


def transit_service_gap(buildings: DataFrame, parcels: DataFrame, transit: DataFrame, admin: Column | Frame, id: str, parcel_id: str, station_id: str, radius: float = 125.0, around: float = 35.0, **shape) -> DataFrame:
    """Parcels' parts around the centres of buildings that no station serves."""
    unserved = _anti(written(L.clip(buildings, admin)), id, _grown(transit, radius, shape), station_id)
    gaps = written(unserved.select(id, G.buffer(G.centroid("geometry"), around, **shape).alias("geometry")))
    return L.overlay(gaps, parcels.select(parcel_id, "geometry"), "intersection", id, parcel_id)
