"""Running totals over tables of any size, in two levels.

The order's quantiles cut the rows into ranges. Each range sums its own rows, and a
range starts from what the ranges before it sum up to: a row a key and range, at most
`parts` of a key. So neither all rows nor those of one frequent key meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64


def range_bounds(df: DataFrame, order: str, parts: int = PARTS) -> list:
    """Values that cut a numeric column into about equal ranges."""
    cuts = df.select(F.percentile_approx(order, [k / parts for k in range(1, parts)], 10_000)).first()[0]
    return sorted(set(cuts or ()))


def range_of(order: str, bounds: list) -> Column:
    """The number of bounds below the value; 0 for null."""
    return reduce(lambda a, b: a + F.coalesce((F.col(order) > F.lit(b)).cast("int"), F.lit(0)), bounds, F.lit(0))


def running(df: DataFrame, order: str, totals: dict[str, Column], keys: tuple[str, ...] = (), ties: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """df with running totals, this row's included, per key (null is a key) in the
    order of a numeric column, then of ties. Null orders come first. Rows that
    are equal in all of these come in any order."""
    bounds = range_bounds(df, order, parts)
    t = df.withColumn("__part", range_of(order, bounds))
    for name, value in totals.items():
        t = t.withColumn(name, value)
    sums = t.groupBy(*keys, "__part").agg(*(F.sum(n).alias(f"__{n}") for n in totals))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most `parts` rows a key
    sums = sums.select(*(F.col(k).alias(f"__key_{k}") for k in keys), F.col("__part").alias("__at"), *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in totals))
    own = Window.partitionBy(*keys, "__part").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    inner = t.select("*", *(F.sum(n).over(own).alias(f"__own_{n}") for n in totals))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"__key_{k}")), keys, F.col("__part") == F.col("__at"))
    return inner.join(sums, same).select(*(c for c in df.columns if c not in totals), *((F.col(f"__own_{n}") + F.col(f"__{n}")).alias(n) for n in totals))
