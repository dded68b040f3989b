"""Exact quantiles and distinct counts of many columns, from counted values.

Every value is counted once, by partial aggregation.  Counts are summed in cells of equal
width over a column's range, which tells the cell of each wanted position; only those
cells are then put in order.  So no task holds a column's values, as an exact percentile
in one global aggregation would.

Nulls, NaN and infinities are not values.  A quantile between two values is interpolated;
a column without values has none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024


def finite(column: Column) -> Column:
    """The column as a double, null where it is not a finite number."""
    x = column.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, x, n): how often each value of each column occurs; ``c`` numbers the columns."""
    each = [F.struct(F.lit(i).alias("c"), finite(F.col(c)).alias("x")) for i, c in enumerate(columns)]
    return df.select(F.explode(F.array(*each)).alias("e")).select("e.*").where("x IS NOT NULL").groupBy("c", "x").agg(F.count("*").alias("n"))


def quantiles(counts: DataFrame, at: Sequence[float]) -> DataFrame:
    """(c, n_rows, n_unique, q): an array of the wanted quantiles for each column of :func:`value_counts`."""
    span = counts.groupBy("c").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"))
    cell = F.least(F.lit(CELLS - 1), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * CELLS))
    placed = counts.join(F.broadcast(span.select("c", "lo", "hi")), "c").select("c", "x", "n", cell.alias("cell"))  # a row per column
    earlier = lambda key: Window.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("c", "cell").agg(F.sum("n").alias("m"))  # CELLS rows per column
    totals = totals.withColumn("before", F.coalesce(F.sum("m").over(earlier(["c", "cell"])), F.lit(0)))
    place = lambda p: F.lit(float(p)) * (F.col("n_rows") - 1)
    wanted = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in at for f in (F.floor, F.ceil)]))
    wants = span.select("c", F.explode(wanted).alias("k"))  # two rows per column and quantile, at most
    hits = totals.join(F.broadcast(wants), "c").where("before <= k AND k < before + m").select("c", "cell", "before").distinct()
    inside = placed.join(F.broadcast(hits), ["c", "cell"])
    start = F.col("before") + F.coalesce(F.sum("n").over(earlier(["c", "cell", "x"])), F.lit(0))
    found = inside.withColumn("start", start).join(F.broadcast(wants), "c").where("start <= k AND k < start + n")
    known = found.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("v"))
    value = lambda p, f: F.col("v")[f(place(p)).cast("long")]
    q = [value(p, F.floor) + (value(p, F.ceil) - value(p, F.floor)) * (place(p) - F.floor(place(p))) for p in at]
    return span.join(known, "c").select("c", "n_rows", "n_unique", F.array(*q).alias("q"))


def quantile_row(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> DataFrame:
    """One row: the wanted quantiles of each column, as an array of its name; null for a column without values."""
    if not all(0 <= p <= 1 for p in at) or any(math.isnan(p) for p in at):
        raise ValueError("quantiles lie between 0 and 1")
    found = quantiles(value_counts(df, columns), at)
    return found.agg(*[F.max(F.when(F.col("c") == i, F.col("q"))).alias(c) for i, c in enumerate(columns)])
