"""Spatial views of the driver's tables: the same SQL text for Spark and for the oracle.

Coordinates are multiples of a quarter, so sums, products and areas are exact in doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _quarter(expression: str) -> str:
    return f"CAST(({expression}) % 4000 AS DOUBLE) / CAST(4 AS DOUBLE)"


TRIP = f"""
SELECT (((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + CAST(l_quantity AS BIGINT) AS tripkey, o_custkey AS custkey, l_shipdate AS pickuptime,
  l_quantity AS distance, l_extendedprice AS fare, (l_orderkey * 31 + l_linenumber * 7) % 997 AS tip,
  (l_orderkey * 37 + l_linenumber) % 90 + 1 AS minutes,
  {_quarter("l_orderkey * 7919 + l_linenumber * 631")} AS px, {_quarter("l_partkey * 104729 + l_linenumber * 17")} AS py,
  {_quarter("l_suppkey * 7919 + l_orderkey * 13")} AS dx, {_quarter("l_partkey * 7919 + l_orderkey * 101")} AS dy
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
ZONE = """
SELECT zonekey, name, xmin, ymin, xmin + CAST(190 + (zonekey % 4) * 10 AS DOUBLE) AS xmax, ymin + CAST(185 + (zonekey % 3) * 15 AS DOUBLE) AS ymax
FROM (SELECT n_nationkey AS zonekey, n_name AS name, n_regionkey AS regionkey,
  CAST((n_nationkey % 5) * 200 - (n_nationkey % 3) * 8 AS DOUBLE) AS xmin, CAST((n_nationkey - n_nationkey % 5) * 40 + (n_nationkey % 2) * 6 AS DOUBLE) AS ymin
  FROM nation) z
"""
BUILDING = f"""
SELECT buildingkey, name, xmin, ymin, xmin + CAST(p_size AS DOUBLE) / CAST(4 AS DOUBLE) AS xmax, ymin + CAST(p_size % 7 + 1 AS DOUBLE) AS ymax
FROM (SELECT p_partkey AS buildingkey, p_name AS name, p_size,
  {_quarter("p_partkey * p_partkey * 7919 + p_partkey * 31")} AS xmin, {_quarter("p_partkey * p_partkey % 100003 * p_partkey * 13 + p_partkey * 101")} AS ymin
  FROM part) b
"""
SITE = f"""
SELECT c_custkey AS siteid, c_mktsegment AS segment, c_acctbal AS balance,
  {_quarter("c_custkey * c_custkey * 31 + c_custkey * 7919")} AS x, {_quarter("c_custkey * c_custkey * 17 + c_custkey * 611")} AS y
FROM customer
"""
DEPOT = f"""
SELECT s_suppkey AS depotid, s_nationkey AS nationkey,
  {_quarter("s_suppkey * s_suppkey * 37 + s_suppkey * 4513")} AS x, {_quarter("s_suppkey * s_suppkey * 53 + s_suppkey * 1009")} AS y
FROM supplier
"""
#: Parcels tile a strip without overlap, a hundred to a row.
PARCEL = """
SELECT parcelid, segment, balance, xmin, ymin, xmin + CAST(10 AS DOUBLE) AS xmax, ymin + CAST(10 AS DOUBLE) AS ymax
FROM (SELECT c_custkey AS parcelid, c_mktsegment AS segment, c_acctbal AS balance,
  CAST((c_custkey % 100) * 10 AS DOUBLE) AS xmin, CAST((c_custkey - c_custkey % 100) / 10 AS DOUBLE) AS ymin
  FROM customer) p
"""
#: Rectangles without overlap, thirty-two to a row: flood zones and protected places.
PATCH = """
SELECT patchid, xmin, ymin, xmin + CAST(8 + patchid % 17 AS DOUBLE) AS xmax, ymin + CAST(7 + patchid % 19 AS DOUBLE) AS ymax
FROM (SELECT s_suppkey AS patchid, CAST((s_suppkey % 32) * 31 + s_suppkey % 5 AS DOUBLE) AS xmin,
  CAST((s_suppkey - s_suppkey % 32) / 32 * 31 + s_suppkey % 4 AS DOUBLE) AS ymin FROM supplier) q
"""
#: Level roads, forty apart.
ROAD = """
SELECT n_nationkey AS roadid, CAST((n_nationkey % 3) * 50 AS DOUBLE) AS x0, CAST(1000 - (n_nationkey % 4) * 50 AS DOUBLE) AS x1, CAST(n_nationkey * 40 + 20 AS DOUBLE) AS y FROM nation
"""
#: A building and itself moved, stretched or shrunk by its key: rectangles in all relations.
TWIN = f"""
SELECT buildingkey, xmin, ymin, xmax, ymax,
  xmin + CAST(buildingkey % 5 - 2 AS DOUBLE) AS bxmin, ymin + CAST(buildingkey % 3 - 1 AS DOUBLE) AS bymin,
  greatest(xmin + CAST(buildingkey % 5 - 2 AS DOUBLE) + CAST(1 AS DOUBLE) / CAST(4 AS DOUBLE), xmax + CAST(buildingkey % 7 - 2 AS DOUBLE)) AS bxmax,
  greatest(ymin + CAST(buildingkey % 3 - 1 AS DOUBLE) + CAST(1 AS DOUBLE) / CAST(4 AS DOUBLE), ymax + CAST(buildingkey % 4 - 1 AS DOUBLE)) AS bymax
FROM ({BUILDING}) t
"""
VIEWS = {"trip": TRIP, "zone": ZONE, "building": BUILDING, "site": SITE, "depot": DEPOT, "parcel": PARCEL, "twin": TWIN, "patch": PATCH, "road": ROAD}
_TABLES = {
    "trip": ("lineitem", "orders"), "zone": ("nation",), "building": ("part",), "site": ("customer",),
    "depot": ("supplier",), "parcel": ("customer",), "twin": ("part",),
    "patch": ("supplier",), "road": ("nation",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, tables = VIEWS[name], {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    for table in tables:
        sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
    return spark.sql(sql, **tables)


def with_views(sql: str) -> str:
    """Oracle SQL with the views it names before it."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b|,\s*{n}\s+[a-z]\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
