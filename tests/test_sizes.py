"""How work is dealt when a table is one file."""

from pyspark.sql import functions as F

from geoloom.functions import geometry as G
from geoloom.functions.planar import Box, wkb_box
from geoloom.operators import joins as J
from geoloom.plans.shape_queries import QUERIES


def test_constructions_of_one_file_are_many_tasks_work(spark, sf_dir):
    made = QUERIES["more_constructions"](spark, sf_dir)
    assert made.select(F.spark_partition_id().alias("task")).distinct().count() > 1


def test_inscribed_circle_of_a_rectangle(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 3.0, 1.0), (0.0, 0.0, 1.0, 3.0), (5.0, 5.0, 6.0, 6.0), (0.0, 0.0, 1000.0, 0.25)], "xmin double, ymin double, xmax double, ymax double")
    line = G.maximum_inscribed_circle(wkb_box(Box.of()))
    found = rows.select("*", G.length(line).alias("radius"), G.coordinates(line)[0].alias("c")).collect()
    for r in found:
        assert (r.radius, r.c.x, r.c.y) == (min(r.xmax - r.xmin, r.ymax - r.ymin) / 2, (r.xmin + r.xmax) / 2, (r.ymin + r.ymax) / 2)
    turned = G.maximum_inscribed_circle(G.from_wkt(F.lit("POLYGON ((0 0, 2 2, 4 0, 2 -2, 0 0))")))
    assert abs(spark.range(1).select(G.length(turned).alias("r")).first().r - 2**0.5) < 0.01


def test_large_sides_are_not_broadcast(spark):
    """A side whose estimate is below the limit of broadcasts, with more rows than a task should hold."""
    n = 300_000
    side = lambda: J.point_side(spark.range(n).select("id", (F.col("id") % 1000).cast("double").alias("x"), F.floor(F.col("id") / 1000).cast("double").alias("y"), (F.col("id") % 7).alias("k")), "id", "x", "y", keys=("k",))
    found = J.pairs(side(), side())
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == n
