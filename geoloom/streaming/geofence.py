"""Streams of points against zones that stand still."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ZONE_LIMIT = 100_000


def zone_counts(
    points: DataFrame, zones: DataFrame, time: str, x: str, y: str, zone: str, window: str = "10 minutes", late: str = "10 minutes", cell: float = 200.0
) -> DataFrame:
    """(start, zone, n): points inside each rectangle in windows of event time.

    The zones' cells are joined with those of the points, so the stream's side is never compared
    with all zones; points later than ``late`` are left out. ``zones`` has xmin, ymin, xmax, ymax.
    """
    if zones.limit(ZONE_LIMIT + 1).count() > ZONE_LIMIT:
        raise ValueError("the zones must stay a bounded table")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    dealt = zones.withColumn("cx", F.explode(span("xmin", "xmax"))).withColumn("cy", F.explode(span("ymin", "ymax")))
    rows = points.withColumn("cx", F.floor(F.col(x) / cell)).withColumn("cy", F.floor(F.col(y) / cell))
    inside = (F.col(x) > F.col("xmin")) & (F.col(x) < F.col("xmax")) & (F.col(y) > F.col("ymin")) & (F.col(y) < F.col("ymax"))
    hits = rows.withWatermark(time, late).join(dealt, ["cx", "cy"]).where(inside)
    counts = hits.groupBy(F.window(time, window).alias("w"), F.col(zone)).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), zone, "n")
