"""Joins whose pairs are only summed up: rows that share a box meet as one."""

from collections import Counter

from pyspark.sql import functions as F

from geoloom.operators import joins as J


def test_rows_that_share_a_place_meet_as_one(spark):
    sites = [(i, float(i % 7), float(i % 3)) for i in range(2000)]
    depots = [(i, float(i % 5), 1.0) for i in range(1000)] + [(1000, None, 1.0), (1001, -0.0, 1.0)]
    left = J.point_side(spark.createDataFrame(sites, "id long, x double, y double"), "id", "x", "y")
    right = J.point_side(spark.createDataFrame(depots, "id long, x double, y double"), "id", "x", "y")
    found = J.place_pairs(left, right, "dwithin", 1.5)
    assert found.count() <= 21 * 5  # two million pairs of rows
    summed = found.groupBy("left_place").agg(F.sum("right_n").alias("n"), F.min("distance").alias("least"))
    got = {r.id: (r.n, round(r.least, 9)) for r in J.at_places(left, summed, "left_place").collect()}
    at = Counter((x, y) for _, x, y in depots if x is not None)
    want = {}
    for i, x, y in sites:
        near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, n) for (a, b), n in at.items()]
        near = [(d, n) for d, n in near if d <= 1.5]
        if near:
            want[i] = (sum(n for _, n in near), round(min(d for d, _ in near), 9))
    assert got == want
    by_row = J.left_reduce_distances(J.pairs(left, right, "dwithin", 1.5))
    assert {r.left_id: round(r.distance, 9) for r in by_row.collect()} == {i: d for i, (_, d) in want.items()}
