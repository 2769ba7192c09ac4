"""Run the headline queries once warm and once timed; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))


def main() -> None:
    from pyspark.sql import SparkSession

    from geoloom.plans import operator_queries, shape_queries, trip_queries, workflow_queries

    cpus, sf_dir = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    names = [*(n for n in trip_queries.QUERIES), "sjoin_left", "sjoin_nearest", "dissolve", "overlay_intersection", "clip", "predicates", "constructions"]
    names += ["unions", "shape_properties", "workflow_flood_exposure", "workflow_vegetation_corridor", "workflow_transit_service_gap"]
    queries = trip_queries.QUERIES | operator_queries.QUERIES | shape_queries.QUERIES | workflow_queries.QUERIES
    took = {}
    for name in names:
        for _ in range(2):
            spark.catalog.clearCache()  # no run is served from what another has kept
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(Path(sf_dir).name.removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
