"""Unions of many shapes that mostly lie apart."""

import random
import time

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.planar import Box, wkb_box
from geoloom.operators import layers as L


def test_union_of_many_shapes_that_lie_apart(spark):
    """A fifth of a board's squares in one group: its time is about in proportion to their number."""
    rng = random.Random(8)
    took = {}
    for n in (4_000, 4_000, 32_000):
        cells = rng.sample(range(5 * n), n)
        rows = spark.createDataFrame([(i % 3, float(c % 250), float(c // 250)) for i, c in enumerate(cells)], "k long, x double, y double").repartition(1)
        rows = rows.select("k", wkb_box(Box(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1)).alias("geometry")).cache()
        rows.count()
        start = time.time()
        one = rows.agg(G.gathered("union", F.collect_list("geometry")).alias("g")).select(G.area("g").alias("area"), G.is_valid("g").alias("valid")).first()
        took[n] = time.time() - start
        assert tuple(one) == (n, True)
    assert took[32_000] < 24 * took[4_000] + 2


def test_union_of_points_lines_and_polygons(spark):
    shapes = ["POINT (9 9)", "POINT (9 9)", "LINESTRING (0 0, 2 2, 2 0, 0 2)", "POLYGON ((20 0, 21 0, 21 1, 20 1, 20 0))", "MULTIPOLYGON (((20.5 0, 22 0, 22 1, 20.5 1, 20.5 0)), ((30 0, 31 0, 31 1, 30 1, 30 0)))", "POLYGON EMPTY", None]
    rows = spark.createDataFrame([(s,) for s in shapes], "wkt string").select(G.from_wkt("wkt").alias("geometry"))
    got = L.union_all(rows).select(G.area("geometry").alias("area"), G.count_geometries("geometry").alias("parts"), G.length("geometry").alias("length")).first()
    # the line is cut where it crosses itself, into three; points that coincide are one
    assert (got.area, got.parts) == (3.0, 6) and round(got.length, 6) == round(4 * 2**0.5 + 2 + 6 + 4, 6)


def test_unions_of_a_row_of_boxes_are_their_outline(spark):
    """What a group gathers at last is no larger than its outline, however many boxes it is made of."""
    rows = spark.range(9_000).select((F.col("id") % 2).alias("band"), wkb_box(Box(F.col("id") * 5.0, F.col("id") % 2 * 100.0, F.col("id") * 5.0 + 10, F.col("id") % 2 * 100.0 + 10)).alias("geometry"))
    for method in L.METHODS:
        got = L.union_by(rows, ["band"], method=method, spread=True).select("band", G.area("geometry"), G.count_coordinates("geometry"), G.is_valid("geometry")).collect()
        assert sorted(map(tuple, got)) == [(0, 450_000.0, 5, True), (1, 450_000.0, 5, True)]


def test_coverage_of_a_board_with_holes_and_touching_corners(spark):
    rng = random.Random(3)
    cells = [(k, x, y) for k in range(2) for x in range(90) for y in range(90) if rng.random() < 0.6]
    # slanted, so that no side lies along an axis
    corner = lambda x, y: f"{2 * x + y} {2 * y - x}"
    wkt = [(k, f"POLYGON (({', '.join(corner(x + a, y + b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)))}))") for k, x, y in cells]
    rows = spark.createDataFrame(wkt, "k int, wkt string").select("k", G.from_wkt("wkt").alias("geometry"))
    by_edges = L.union_by(rows, ["k"], method="coverage").withColumnRenamed("geometry", "edges")
    same = by_edges.join(L.union_by(rows, ["k"], spread=True), "k").select("k", G.area("edges").alias("area"), G.geom_equals("edges", "geometry"), G.is_valid("edges"), G.is_valid("geometry"), (G.count_coordinates("edges") - G.count_coordinates("geometry")).alias("more"))
    for r in same.collect():
        assert abs(r.area - 5 * sum(k == r.k for k, _, _ in cells)) < 1e-6 and r[2:] == (True, True, True, 0)
