"""Coordinate reference systems by their parameters: ellipsoid, projection and shift to WGS 84; PROJJSON in and out."""

from __future__ import annotations

from dataclasses import dataclass

GEOGRAPHIC, TRANSVERSE_MERCATOR, OBLIQUE_STEREOGRAPHIC = range(3)
#: Methods with their EPSG codes, and the EPSG codes of their parameters in the order of ``Crs``.
METHODS = {TRANSVERSE_MERCATOR: ("Transverse Mercator", 9807), OBLIQUE_STEREOGRAPHIC: ("Oblique Stereographic", 9809)}
PARAMETERS = (
    ("Latitude of natural origin", 8801, "degree"), ("Longitude of natural origin", 8802, "degree"), ("Scale factor at natural origin", 8805, "unity"),
    ("False easting", 8806, "metre"), ("False northing", 8807, "metre"),
)
SHIFTS = ("X-axis translation", "Y-axis translation", "Z-axis translation", "X-axis rotation", "Y-axis rotation", "Z-axis rotation", "Scale difference")
#: Ellipsoids, by name: semi-major axis and inverse flattening.
ELLIPSOIDS = {
    "WGS 84": (6378137.0, 298.257223563), "GRS 1980": (6378137.0, 298.257222101), "Airy 1830": (6377563.396, 299.3249646), "Bessel 1841": (6377397.155, 299.1528128),
    "International 1924": (6378388.0, 297.0),
}
#: Datums: EPSG code of the geographic system, ellipsoid, and the seven parameters of the position-vector shift to WGS 84.
DATUMS = {
    "World Geodetic System 1984": (4326, "WGS 84", (0.0,) * 7),
    "European Terrestrial Reference System 1989": (4258, "GRS 1980", (0.0,) * 7),
    "Ordnance Survey of Great Britain 1936": (4277, "Airy 1830", (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)),
    "Amersfoort": (4289, "Bessel 1841", (565.4171, 50.3319, 465.5524, -0.398957, 0.343988, -1.87740, 4.0725)),
    "Deutsches Hauptdreiecksnetz": (4314, "Bessel 1841", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
    "European Datum 1950": (4230, "International 1924", (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0)),
}


@dataclass(frozen=True)
class Crs:
    """A system: its name, datum, method and the parameters that ``PARAMETERS`` names."""

    name: str
    datum: str
    ellipsoid: tuple[float, float]
    shift: tuple[float, ...]
    method: int = GEOGRAPHIC
    parameters: tuple[float, float, float, float, float] = (0.0, 0.0, 1.0, 0.0, 0.0)
    code: int | None = None
    base: int | None = None

    @property
    def numbers(self) -> tuple[float, ...]:
        """What the function that moves vertices takes."""
        return (float(self.method), self.ellipsoid[0], 1 / self.ellipsoid[1], *self.parameters, *self.shift)


def _of(code: int, name: str, datum: str, method: int = GEOGRAPHIC, *parameters: float) -> Crs:
    base, ellipsoid, shift = DATUMS[datum]
    return Crs(name, datum, ELLIPSOIDS[ellipsoid], shift, method, parameters or (0.0, 0.0, 1.0, 0.0, 0.0), code, base)


def by_code(code: int) -> Crs | None:
    """The system of an EPSG code, if it is one of those here."""
    world, europe, german, fifty = (list(DATUMS)[i] for i in (0, 1, 4, 5))
    for datum, (base, _, _) in DATUMS.items():
        if code == base:
            return _of(code, "WGS 84" if code == 4326 else datum, datum)
    zone = code % 100
    for first, datum, name, least, most in ((32600, world, "WGS 84", 1, 60), (32700, world, "WGS 84", 1, 60), (25800, europe, "ETRS89", 28, 38), (23000, fifty, "ED50", 28, 38)):
        if code - zone == first and least <= zone <= most:
            south = first == 32700
            return _of(code, f"{name} / UTM zone {zone}{'S' if south else 'N'}", datum, TRANSVERSE_MERCATOR, 0.0, 6.0 * zone - 183, 0.9996, 500000.0, 1e7 if south else 0.0)
    if 31466 <= code <= 31469:
        zone = code - 31464
        return _of(code, f"DHDN / 3-degree Gauss-Kruger zone {zone}", german, TRANSVERSE_MERCATOR, 0.0, 3.0 * zone, 1.0, 1e6 * zone + 500000, 0.0)
    if code == 27700:
        return _of(code, "OSGB36 / British National Grid", "Ordnance Survey of Great Britain 1936", TRANSVERSE_MERCATOR, 49.0, -2.0, 0.9996012717, 400000.0, -100000.0)
    if code == 28992:
        return _of(code, "Amersfoort / RD New", "Amersfoort", OBLIQUE_STEREOGRAPHIC, 52.15616055555555, 5.38763888888889, 0.9999079, 155000.0, 463000.0)
    return None


def _identified(authority_code: int | None) -> dict:
    return {"id": {"authority": "EPSG", "code": authority_code}} if authority_code else {}


def to_projjson(crs: Crs) -> dict:
    """A system as PROJJSON; a shift is not part of it."""
    axes = lambda *of: [{"name": n, "abbreviation": a, "direction": d, "unit": u} for n, a, d, u in of]
    ellipsoid = next((n for n, v in ELLIPSOIDS.items() if v == crs.ellipsoid), "unknown")
    frame = {"type": "GeodeticReferenceFrame", "name": crs.datum, "ellipsoid": {"name": ellipsoid, "semi_major_axis": crs.ellipsoid[0], "inverse_flattening": crs.ellipsoid[1]}}
    around = axes(("Geodetic latitude", "Lat", "north", "degree"), ("Geodetic longitude", "Lon", "east", "degree"))
    own = _identified(crs.code if crs.method == GEOGRAPHIC else crs.base)
    geographic = {"type": "GeographicCRS", "name": crs.name if crs.method == GEOGRAPHIC else crs.datum, "datum": frame, "coordinate_system": {"subtype": "ellipsoidal", "axis": around}} | own
    schema = {"$schema": "https://proj.org/schemas/v0.7/projjson.schema.json"}
    if crs.method == GEOGRAPHIC:
        return schema | geographic
    name, number = METHODS[crs.method]
    given = [{"name": n, "value": v, "unit": u} | _identified(c) for (n, c, u), v in zip(PARAMETERS, crs.parameters)]
    flat = {"subtype": "Cartesian", "axis": axes(("Easting", "E", "east", "metre"), ("Northing", "N", "north", "metre"))}
    conversion = {"name": crs.name, "method": {"name": name} | _identified(number), "parameters": given}
    return schema | {"type": "ProjectedCRS", "name": crs.name, "base_crs": geographic, "conversion": conversion, "coordinate_system": flat} | _identified(crs.code)


def from_projjson(told: dict) -> Crs:
    """A system from PROJJSON: geographic, projected by one of ``METHODS``, or bound to WGS 84 by a shift of three or seven parameters.

    A datum that is known here has its shift where none is bound.
    """
    if told["type"] == "BoundCRS":
        inner = from_projjson(told["source_crs"])
        values = {p["name"]: float(p["value"]) for p in told["transformation"]["parameters"]}
        turned = -1.0 if "Coordinate Frame" in told["transformation"]["method"]["name"] else 1.0
        shift = tuple(values.get(n, 0.0) * (turned if "rotation" in n else 1.0) for n in SHIFTS)
        return Crs(inner.name, inner.datum, inner.ellipsoid, shift, inner.method, inner.parameters, inner.code, inner.base)
    base = told.get("base_crs", told)
    frame = base.get("datum") or base["datum_ensemble"]
    shape = frame["ellipsoid"]
    axis = shape["semi_major_axis"]
    inverse = shape.get("inverse_flattening") or axis / (axis - shape["semi_minor_axis"])
    known = next((v for n, v in DATUMS.items() if n == frame["name"] or v[0] == base.get("id", {}).get("code")), None)
    code = lambda of: of.get("id", {}).get("code")
    common = {"name": told["name"], "datum": frame["name"], "ellipsoid": (float(axis), float(inverse)), "shift": known[2] if known else (0.0,) * 7, "code": code(told), "base": code(base)}
    if told["type"] in ("GeographicCRS", "GeodeticCRS"):
        return Crs(**common)
    conversion = told["conversion"]
    method = next((m for m, (n, c) in METHODS.items() if conversion["method"]["name"] == n or code(conversion["method"]) == c), None)
    if method is None:
        raise NotImplementedError(f"projection {conversion['method']['name']}")
    values = {p["name"]: float(p["value"]) for p in conversion["parameters"]}
    return Crs(**common, method=method, parameters=tuple(values.get(n, 1.0 if u == "unity" else 0.0) for n, _, u in PARAMETERS))
