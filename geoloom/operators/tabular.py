"""Tabular operators with an explicit order or key where a labelled frame would imply one."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .steps import written

SALTS = 64


def positions(df: DataFrame, order: list[str], name: str = "_row") -> DataFrame:
    """``df`` with its rows numbered from 0 in an order, without a single-task sort.

    The rows are sorted by range, and each range starts after the rows of those before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, so that a row keeps its range and its place in it
    marked = written(ranged.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    counts = marked.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range
    starts = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__at"))
    joined = marked.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return joined.withColumn(name, F.col("__at") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__at")


def take(df: DataFrame, indices: list[int], order: list[str]) -> DataFrame:
    """Rows at positions, as often and in the order they are asked for (column ``_at``); negative ones count from the end."""
    rows = positions(df, order)
    n = df.count() if any(i < 0 for i in indices) else 0
    wanted = df.sparkSession.createDataFrame([(i, p + n if p < 0 else p) for i, p in enumerate(indices)], "_at long, _row long")
    return rows.join(wanted, "_row").drop("_row")


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in an order; the last -n are left out if it is negative."""
    return df.orderBy(*order).limit(n) if n >= 0 else iloc(df, 0, max(0, df.count() + n), order)


def tail(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows in an order; the first -n are left out if it is negative."""
    total = df.count()
    return iloc(df, max(0, total - n) if n >= 0 else min(total, -n), total, order)


def sample(df: DataFrame, n: int | None = None, frac: float | None = None, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """``n`` rows, or a share of them: those whose key (all columns) has the smallest hash with the seed, so a
    sample comes out the same again."""
    if (n is None) == (frac is None):
        raise ValueError("one of n and frac is needed")
    n = round(frac * df.count()) if n is None else n
    names = key or df.columns
    return df.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(n)


def iloc(df: DataFrame, start: int, stop: int, order: list[str]) -> DataFrame:
    return positions(df, order).where((F.col("_row") >= start) & (F.col("_row") < stop)).drop("_row")


def loc(df: DataFrame, key: str, labels: list) -> DataFrame:
    """Rows with labels, as often as they are asked for and with their place in the list (column ``_at``)."""
    wanted = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(labels)], f"_at long, __label {df.schema[key].dataType.simpleString()}")
    return df.join(wanted, F.col(key).eqNullSafe(F.col("__label"))).drop("__label")


def set_index(df: DataFrame, keys: list[str], name: str = "_index", drop: bool = True, verify_integrity: bool = False) -> DataFrame:
    """``df`` with a label column: a key, or a struct of several; ``drop`` takes the keys' own columns away."""
    label = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    out = df.withColumn("__label", label)
    if verify_integrity and not out.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("labels repeat")
    return (out.drop(*keys) if drop else out).withColumnRenamed("__label", name)


def reset_index(df: DataFrame, key: str = "_index", drop: bool = False, order: list[str] | None = None) -> DataFrame:
    """Rows numbered from 0 (column ``_index``) in the order of the label, which becomes columns of its own or goes."""
    rows = positions(df, order or [key], "__position")
    if drop:
        rows = rows.drop(key)
    elif isinstance(df.schema[key].dataType, StructType):
        rows = rows.select("*", f"{key}.*").drop(key)
    elif key == "_index":
        rows = rows.withColumnRenamed(key, "index")
    return rows.withColumnRenamed("__position", "_index")


def rename_axis(df: DataFrame, key: str, name: str) -> DataFrame:
    """Another name for the label column."""
    return df.withColumnRenamed(key, name)


def set_axis(df: DataFrame, names: list[str]) -> DataFrame:
    """New names for all columns."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} names are needed")
    return df.toDF(*names)


def sort_index(df: DataFrame, key: str, ascending: bool = True, na_position: str = "last") -> DataFrame:
    """Rows in the order of their label."""
    c = F.col(key)
    first = na_position == "first"
    return df.orderBy((c.asc_nulls_first() if first else c.asc_nulls_last()) if ascending else (c.desc_nulls_first() if first else c.desc_nulls_last()))


def reindex_like(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The labels and columns of ``other``, with values of ``df``; null where it has none."""
    rows = other.select(key).join(df, key, "left")
    return rows.select(*(F.col(c) if c in df.columns else F.lit(None).cast(other.schema[c].dataType).alias(c) for c in other.columns))


def unique(df: DataFrame, column: str) -> DataFrame:
    """(column): its distinct values, null among them; geometries are told apart by their WKB."""
    return df.select(column).distinct()


def filter_columns(df: DataFrame, items: list[str] | None = None, like: str | None = None, regex: str | None = None) -> DataFrame:
    if sum(x is not None for x in (items, like, regex)) != 1:
        raise TypeError("one of items, like and regex is needed")
    if items is not None:
        return df.select(*[c for c in items if c in df.columns])
    return df.select(*[c for c in df.columns if (like in c if like is not None else re.search(regex, c))])


_KINDS: dict[str, Callable[[str], bool]] = {
    "number": lambda t: t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal"),
    "string": lambda t: t == "string",
    "datetime": lambda t: t.startswith("timestamp") or t == "date",
    "bool": lambda t: t == "boolean",
    "geometry": lambda t: t == "binary",
}


def select_dtypes(df: DataFrame, include: str | list[str] | None = None, exclude: str | list[str] | None = None) -> DataFrame:
    listed = lambda x: [x] if isinstance(x, str) else list(x or [])
    fits = lambda kind, kinds: any(_KINDS[k](kind) for k in kinds)
    keep = [c for c, t in df.dtypes if (not include or fits(t, listed(include))) and not fits(t, listed(exclude))]
    return df.select(*keep)


def insert(df: DataFrame, at: int, name: str, value: Column) -> DataFrame:
    names = df.columns
    return df.select(*names[:at], value.alias(name), *names[at:])


def pop(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    return df.select(name), df.drop(name)


def where(df: DataFrame, condition: Column, columns: list[str] | None = None, other: Column | None = None) -> DataFrame:
    """Values where the condition holds, else ``other`` (null)."""
    return df.withColumns({c: F.when(condition, F.col(c)).otherwise(F.lit(None) if other is None else other) for c in columns or df.columns})


def mask(df: DataFrame, condition: Column, columns: list[str] | None = None, other: Column | None = None) -> DataFrame:
    return where(df, ~F.coalesce(condition, F.lit(False)), columns, other)


def update(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Values of ``other`` that are not null take the place of those with the same key."""
    shared = [c for c in df.columns if c in other.columns and c != key]
    news = other.select(F.col(key).alias("__key"), *(F.col(c).alias("__new_" + c) for c in shared))
    rows = df.join(news, F.col(key) == F.col("__key"), "left")
    return rows.select(*(F.coalesce("__new_" + c, c).alias(c) if c in shared else F.col(c) for c in df.columns))


def reindex(df: DataFrame, key: str, labels: list, fill: dict | None = None) -> DataFrame:
    """A row for each label, null or filled where the frame has none."""
    wanted = df.sparkSession.createDataFrame([(x,) for x in labels], df.select(key).schema)
    rows = wanted.join(df, key, "left").select(*df.columns)
    return rows.na.fill(fill) if fill else rows


def drop_duplicates(df: DataFrame, subset: list[str], order: list[str], keep: str | bool = "first") -> DataFrame:
    """One row for each value of ``subset``: the first or last in an order, or none if it repeats.

    An aggregation, so repeated values are summed up before the shuffle.
    """
    row = F.struct(*(F.col(c) for c in df.columns))
    rank = F.struct(*(F.col(c) for c in order))
    pick = F.max_by(row, rank) if keep == "last" else F.min_by(row, rank)
    grouped = df.groupBy(*[F.col(c).alias("__" + c) for c in subset]).agg(pick.alias("row"), F.count(F.lit(1)).alias("__n"))
    if keep is False:
        grouped = grouped.where("__n = 1")
    return grouped.select("row.*")


def nlargest(df: DataFrame, n: int, columns: list[str], keep: str = "first", order: list[str] | None = None, largest: bool = True) -> DataFrame:
    """Ties go by ``order``, or against it with ``keep`` last. The n rows with the largest values; ``keep`` all keeps what ties with the last of them."""
    by = [F.col(c).desc_nulls_last() if largest else F.col(c).asc_nulls_last() for c in columns]
    ties = [F.col(c).asc() if keep != "last" else F.col(c).desc() for c in order or []]
    if keep != "all":
        return df.orderBy(*by, *ties).limit(n)
    least = df.orderBy(*by).limit(n).select(F.struct(*columns).alias("s")).agg(F.min("s") if largest else F.max("s")).first()[0]
    if least is None:
        return df.limit(0)
    bound = F.struct(*(F.lit(least[c]).alias(c) for c in columns))
    return df.where((F.struct(*columns) >= bound) if largest else (F.struct(*columns) <= bound))


def nsmallest(df: DataFrame, n: int, columns: list[str], keep: str = "first", order: list[str] | None = None) -> DataFrame:
    return nlargest(df, n, columns, keep, order, largest=False)


def shift(df: DataFrame, column: str, periods: int, by: list[str], order: list[str], fill: Column | None = None) -> DataFrame:
    """``df`` with the column's value ``periods`` rows before (after, if negative) within ``by``."""
    over = Window.partitionBy(*by).orderBy(*order)
    value = F.lag(column, periods).over(over) if periods >= 0 else F.lead(column, -periods).over(over)
    return df.withColumn(column, value if fill is None else F.coalesce(value, fill))


def value_counts(df: DataFrame, column: str, dropna: bool = True) -> DataFrame:
    rows = df.where(F.col(column).isNotNull()) if dropna else df
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def dense_count(df: DataFrame, codes: str, size: int) -> DataFrame:
    """(code, count) of every code below ``size``, 0 where there is none; others raise."""
    code = F.col(codes).cast("long")
    checked = df.select(
        F.when((code >= 0) & (code < size), code).otherwise(F.raise_error(F.lit("code out of its domain")).cast("long")).alias("code")
    )
    counts = checked.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(size).withColumnRenamed("id", "code")
    return every.join(counts, "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("count"))


def numeric_take(values: DataFrame, value: str, indices: DataFrame, index: str, order: list[str]) -> DataFrame:
    """``indices`` with the value at each position."""
    rows = positions(values.select(value, *[c for c in order if c != value]), order).select(F.col("_row").alias(index), value)
    return indices.join(rows, index, "left")


def datetime_component(df: DataFrame, column: str, component: str) -> Column:
    parts = {
        "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute,
        "second": F.second, "dayofyear": F.dayofyear, "week": F.weekofyear,
    }
    if component == "dayofweek":
        return F.weekday(df[column])
    return parts[component](df[column])


def concat(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def apply_rows(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A Python function from a pandas frame to a pandas frame, by Arrow batches."""

    def run(frames):
        for frame in frames:
            yield function(frame)

    return df.mapInPandas(run, schema)


def apply_values(df: DataFrame, column: str, function: Callable, returns: str) -> DataFrame:
    """A Python function of each value of a column (WKB of a geometry), by Arrow batches."""
    import pandas as pd

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return df.withColumn(column, run(F.col(column)))
