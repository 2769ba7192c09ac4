"""Sharding along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to ``bits`` bits, the cells are ordered by their index on the
Hilbert curve, and the ordered rows are cut into runs of equal length. A shard then covers a
compact region of every dimension, so the minima and maxima that files keep prune well on
any of them.

The global rank is found by a range sort: rows are dealt in ranges of (index on the curve, group, key),
sorted inside each range and written, so a row's place in its range does not change again; the ranges'
counts, one number each, give the rank at which a range begins. A cell or a group that holds
most of the rows ends up in several ranges. Rows of a group (equal texts, say) that are in one cell stand
side by side, so they share a shard unless a cut falls between them, as it must in a group larger than what is left of the shard.

Null dimension: coordinate 0. Null text: size 1 and the checksum of the empty text. Rows that
are equal in cell, group and key tie; they are put in some order once. Null keys come first. Very long texts
count by their size. An empty table gives no rows. Columns named as the results are replaced, others are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ._shared import materialize

BITS = 5


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer coordinates below ``2**bits`` (Skilling 2004)."""
    x = [np.asarray(a, dtype=np.int64).copy() for a in axes]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q = 1 << level
        low = q - 1
        for i in range(n):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(is_set, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[n - 1] & (1 << level)) != 0, flip ^ ((1 << level) - 1), flip)
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ flip) >> level) & 1)
    return index


def category(column: Column, bits: int = BITS) -> Column:
    """Coordinate of a categorical dimension: equal values share one, null has 0."""
    return F.when(column.isNull(), F.lit(0)).otherwise((F.crc32(column.cast("string").cast("binary")) % (1 << bits)).cast("int"))


def magnitude(column: Column, bits: int = BITS) -> Column:
    """Coordinate of a size: two steps for each doubling, null and below one have 0."""
    step = F.floor(F.log2(F.greatest(column.cast("double"), F.lit(1.0))) * 2)
    return F.coalesce(F.least(step, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def shard(df: DataFrame, dims: list[Column], key: Column, n_shards: int, bits: int = BITS, group: Column | None = None) -> DataFrame:
    """``df`` with ``curve`` long, ``shard`` int and ``slot`` long; counts differ by one at most.

    ``df`` is written to the shared folder on the way, so select the columns that are needed.
    """
    if bits * len(dims) > 62:
        raise ValueError("an index on the curve is a long: bits * dimensions <= 62")

    @F.pandas_udf(LongType())
    def curve(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    kept = [n for n in df.columns if n not in ("curve", "shard", "slot")]
    group = F.lit(0) if group is None else group
    rows = df.select(*kept, curve(*dims).alias("curve"), group.alias("__group"), key.alias("__key"))
    ranges = rows.repartitionByRange("curve", F.col("__group"), F.col("__key")).sortWithinPartitions("curve", "__group", "__key")
    # its high bits are the range's number, in order, and its low ones the place in the range
    placed = materialize(ranges.select(*kept, "curve", F.monotonically_increasing_id().alias("__at")), "curve-ranges")
    placed = placed.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    counts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # a row for each range, as many as shuffle partitions whatever the input: one task adds them up
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    starts = counts.select("__range", before.alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    ranked = placed.join(F.broadcast(starts), "__range").withColumn("__rank", F.col("__before") + F.col("__at"))
    number = F.expr(f"(__rank * {n_shards}) div __total")
    return (
        ranked.withColumn("shard", number.cast("int"))
        .withColumn("slot", (F.col("__rank") - F.expr(f"(shard * __total + {n_shards - 1}) div {n_shards}")).cast("long"))
        .select(*kept, "curve", "shard", "slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in slot order."""
    n = sharded.agg(F.max("shard")).first()[0]
    ordered = sharded.repartitionByRange(8 * ((n or 0) + 1), "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
