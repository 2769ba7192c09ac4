from pyspark.sql import functions as F

from geoloom.plans.fixtures import view
from geoloom.streaming.geofence import zone_counts


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") * 7919 % 4000 / 4.0).cast("double").alias("x"), (F.col("event_id") * 104729 % 4000 / 4.0).cast("double").alias("y")
    )
    events.write.parquet(f"{tmp_path}/events")
    zones = view(spark, sf_dir, "zone")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = zone_counts(stream, zones, "ts", "x", "y", "zonekey", "1 day").writeStream.format("memory").queryName("zones").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM zones").collect()))
    inside = (F.col("x") > F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") > F.col("ymin")) & (F.col("y") < F.col("ymax"))
    want = events.join(zones, inside).groupBy(F.window("ts", "1 day").alias("w"), "zonekey").count().select("w.start", "zonekey", "count").collect()
    assert got == sorted(map(tuple, want)) and got
