"""Results of steps that later joins read more than once, written in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of our own only where it is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="geoloom-steps-"))
    return _OWN[0]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table.

    A join reads its sides' boxes before it is planned, and again when it runs; a chain of joins
    would repeat its first steps for each of them. A written step is run once, is pruned to the
    columns that are asked for, and a lost executor costs only the tasks that read it. The write's
    shuffle files are not needed then, and Spark is told to remove them at its end.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/geoloom/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the session's shuffle partitions, for work on single rows that costs more than moving them.

    A file with one group of rows is read by one task, which would do all that comes before the next shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
