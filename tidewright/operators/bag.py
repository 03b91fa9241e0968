"""Bags with signed multiplicities: DataFrames with a long column ``_mult``.

A row counts as often as its multiplicity says; a negative one takes copies
away.  Every operator is a composition of DataFrame operations, so sums combine
before they are shuffled and joins are Catalyst's to choose.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

M = "_mult"


def lift(df: DataFrame, multiplicity: int = 1) -> DataFrame:
    """A plain frame as a bag."""
    return df.withColumn(M, F.lit(multiplicity).cast("long"))


def values(bag: DataFrame) -> list[str]:
    return [c for c in bag.columns if c != M]


def map_(bag: DataFrame, **columns: Column) -> DataFrame:
    return bag.select(*[c.alias(n) for n, c in columns.items()], M)


def filter_(bag: DataFrame, condition: Column) -> DataFrame:
    return bag.filter(condition)


def concat(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def negate(bag: DataFrame) -> DataFrame:
    return bag.withColumn(M, -F.col(M))


def consolidate(bag: DataFrame) -> DataFrame:
    """One row a value with the sum of its multiplicities; values that sum to 0 go."""
    return bag.groupBy(*values(bag)).agg(F.sum(M).alias(M)).where(F.col(M) != 0).select(*bag.columns)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return consolidate(concat(a, negate(b)))


def expand(bag: DataFrame) -> DataFrame:
    """The bag as a plain frame; what has a negative multiplicity isn't there."""
    return consolidate(bag).where(F.col(M) > 0).withColumn(M, F.explode(F.sequence(F.lit(1).cast("long"), F.col(M)))).drop(M)


def distinct(bag: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row of multiplicity 1 for each ``by`` with a positive sum; its other columns are the first by ``order``."""
    by = by or values(bag)
    summed = consolidate(bag).where(F.col(M) > 0)
    rest = [c for c in values(bag) if c not in by]
    if not rest:
        return summed.withColumn(M, F.lit(1).cast("long"))
    ranked = list(dict.fromkeys([*(order or ()), *rest]))
    first = F.min_by(F.struct(*rest), F.struct(*ranked))
    return summed.groupBy(*by).agg(first.alias("__first")).select(*[c if c in by else F.col("__first")[c].alias(c) for c in values(bag)], F.lit(1).cast("long").alias(M))


def join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal columns; multiplicities multiply, and a side without a match keeps its own.

    how: inner, left, right, full or anti (the rows of ``a`` without a match).
    Rows whose multiplicities cancel out don't match.
    """
    if how not in ("inner", "left", "right", "full", "anti"):
        raise ValueError(f"a join can't be {how!r}")
    a, b = consolidate(a), consolidate(b)
    if how == "anti":
        return a.join(b.select(*on).distinct(), on, "left_anti")
    b = b.withColumnRenamed(M, "__m")
    out = a.join(b, on, {"full": "full_outer"}.get(how, how))
    return out.withColumn(M, F.coalesce(M, F.lit(1)) * F.coalesce("__m", F.lit(1))).drop("__m")


def filter_by(a: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``a`` whose key is in ``keys``, as often as it is there."""
    counts = keys.groupBy(*on).agg(F.sum(M).alias("__m"))
    return consolidate(a.join(counts, on).withColumn(M, F.col(M) * F.col("__m")).drop("__m"))


def reduce_(bag: DataFrame, by: list[str], f: Callable, schema: Any) -> DataFrame:
    """A Python function of each key's consolidated rows (a pandas frame with ``_mult``); each key must fit a task."""
    return consolidate(bag).groupBy(*by).applyInPandas(f, schema)


def count(bag: DataFrame, by: list[str]) -> DataFrame:
    return bag.groupBy(*by).agg(F.sum(M).alias("count")).where("count <> 0")


def group_by(bag: DataFrame, by: list[str], **aggs: tuple[str, str]) -> DataFrame:
    """Aggregates weighed by multiplicity: name=(function, column); functions are sum, count, avg, min, max, median, mode.

    Groups whose multiplicities don't sum to more than 0 vanish.  Without ``by`` the whole bag is one group.
    """
    if not by:
        return group_by(bag.withColumn("__all", F.lit(1)), ["__all"], **aggs).drop("__all")
    bag = consolidate(bag)
    weight = F.col(M)
    made: list[Column] = []
    spread: list[tuple[str, str, str]] = []
    for name, (how, column) in aggs.items():
        x = F.col(column)
        if how == "sum":
            made.append(F.sum(F.coalesce(x, F.lit(0)) * weight).alias(name))
        elif how == "count":
            made.append(F.sum(F.when(x.isNotNull(), weight).otherwise(0)).alias(name))
        elif how == "avg":
            made.append((F.sum(F.coalesce(x, F.lit(0)) * weight) / F.sum(weight)).alias(name))
        elif how in ("min", "max"):
            made.append((F.min if how == "min" else F.max)(F.when(weight > 0, x)).alias(name))
        elif how == "median":
            made.append(F.percentile(x.cast("double"), F.lit(0.5), F.when(weight > 0, weight).otherwise(0)).alias(name))
        elif how == "mode":
            spread.append((name, how, column))
        else:
            raise ValueError(f"there is no aggregate {how!r}")
    out = bag.groupBy(*by).agg(*made, F.sum(M).alias("__sum"))
    for name, _, column in spread:
        counts = bag.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.sum(M).alias("__c"))
        best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("__c")).alias("c"), F.col(column).alias("v")))["v"].alias(name))
        out = out.join(best, by, "left")
    return out.where(F.col("__sum") > 0).select(*by, *aggs)


def key_by(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("_key", key)


rekey = key_by


def unkey(df: DataFrame) -> DataFrame:
    return df.drop("_key")


def _indexed(df: DataFrame, order: list[Column], index: str) -> DataFrame:
    """All rows with their places in the order, from 0."""
    from tidewright.sources import shared_dir

    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/sorted-{uuid.uuid4().hex}"
    ids = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    ids.write.parquet(path)
    ids = spark.read.schema(ids.schema).parquet(path)
    part = F.shiftright("__id", 33)
    start, begins = 0, []
    for p, n in sorted(tuple(r) for r in ids.groupBy(part.alias("p")).count().collect()):  # a row for each partition
        begins.append((p, start))
        start += n
    begins = spark.createDataFrame(begins, "__p long, __start long")
    out = ids.withColumn("__p", part).join(F.broadcast(begins), "__p")
    return out.withColumn(index, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__p", "__start", "__id").select(*df.columns, index)


def top_k(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0, by: list[str] | None = None, index: str | None = None) -> DataFrame:
    """Rows offset+1 to offset+limit of each ``by`` in the order, which must end in a key; ``index`` names a column for their places from 0.

    Without ``by`` and with a limit Spark keeps the top rows of each task only.
    An index over all rows comes from a table sorted by range, whose parts are
    counted, so that no task orders everything.
    """
    if not by and not index:
        out = df.orderBy(*order)
        out = out.offset(offset) if offset else out
        return out.limit(limit) if limit is not None else out
    if not by and limit is None:
        return _indexed(df, order, index).where(F.col(index) >= offset)
    if not by:
        top = top_k(df, order, limit + offset)
        place = F.row_number().over(Window.orderBy(*order)) - 1
    else:
        top, place = df, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    out = top.withColumn(index or "__n", place)
    n = F.col(index or "__n")
    out = out.where(n >= offset) if limit is None else out.where((n >= offset) & (n < offset + limit))
    return out if index else out.drop("__n")


def order_by(df: DataFrame, order: list[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    return top_k(df, order, limit, offset)


def tap(df: DataFrame, f: Callable[[DataFrame], None]) -> DataFrame:
    """Calls ``f`` with the frame and passes it on."""
    f(df)
    return df


def debug(df: DataFrame, name: str, rows: int = 20) -> DataFrame:
    """Prints the first rows under a name and passes the frame on."""
    print(f"{name}:")
    df.show(rows, truncate=False)
    return df


def pipe(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
