"""Topology in the JVM: Java functions on the JTS library that PySpark ships.

``geoloom/functions/jvm`` holds the sources and the jar built from them (``build_jar``).
``attach`` makes the functions known to a session; every function in ``geometry`` calls it.
"""

from __future__ import annotations

import subprocess
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType

HOME = Path(__file__).parent / "jvm"
JAR = HOME / "geoloom-jts.jar"
KINDS: dict[str, DataType] = {
    "Number": DoubleType(),
    "Flag": BooleanType(),
    "Text": StringType(),
    "Parse": BinaryType(),
    "Relates": BooleanType(),
    "Relate": StringType(),
    "PairNumber": DoubleType(),
    "PairShape": BinaryType(),
    "Shape": BinaryType(),
    "Parts": ArrayType(BinaryType()),
    "Vertices": ArrayType(DoubleType()),
    "Moved": BinaryType(),
    "Made": BinaryType(),
    "Plain": BinaryType(),
    "Gathered": BinaryType(),
    "GatheredParts": ArrayType(BinaryType()),
    "Pack": BinaryType(),
    "Least": ArrayType(DoubleType()),
    "Chosen": ArrayType(ArrayType(IntegerType())),
    "Enough": DoubleType(),
    "Leaves": ArrayType(IntegerType()),
    "Edges": ArrayType(DoubleType()),
    "Linked": BinaryType(),
    "Straight": BooleanType(),
    "Joined": ArrayType(DoubleType()),
    "Reproject": BinaryType(),
    "Range": BinaryType(),
    "Hits": ArrayType(LongType()),
}
#: The class that has a kind, where it is not ``Geo``.
OWNERS = {"Pack": "Near", "Least": "Near", "Chosen": "Near", "Enough": "Near", "Leaves": "Near", "Edges": "Rings", "Linked": "Rings", "Straight": "Rings", "Joined": "Rings", "Reproject": "Datum", "Range": "Files", "Hits": "Files"}


def build_jar(to: Path = JAR) -> Path:
    """Compile the sources with ``javac`` against PySpark's jars."""
    import pyspark

    jars = Path(pyspark.__file__).parent / "jars" / "*"
    with tempfile.TemporaryDirectory() as out:
        sources = [str(p) for p in sorted(HOME.rglob("*.java"))]
        subprocess.run(["javac", "--release", "17", "-nowarn", "-cp", str(jars), "-d", out, *sources], check=True)
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as jar:
            for path in sorted(Path(out).rglob("*.class")):
                jar.write(path, str(path.relative_to(out)))
    return to


def attach(spark: SparkSession | None = None) -> None:
    """Make the functions known to the session, once."""
    spark = spark or SparkSession.active()
    if spark.conf.get("geoloom.jts.attached", "") == "yes":
        return
    jar = JAR if JAR.exists() else build_jar(Path(tempfile.mkdtemp(prefix="geoloom-jts-")) / JAR.name)
    spark.sql(f"ADD JAR '{jar}'")
    for kind, result in KINDS.items():
        spark.udf.registerJavaFunction(f"geoloom_{kind.lower()}", f"geoloom.{OWNERS.get(kind, 'Geo')}${kind}", result)
    spark.conf.set("geoloom.jts.attached", "yes")


def call(kind: str, *args: Column) -> Column:
    attach()
    return F.call_function(f"geoloom_{kind.lower()}", *args)


def numbers(*values: float | Column) -> Column:
    return F.array(*(v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in values))


NONE = "cast(array() as array<double>)"
