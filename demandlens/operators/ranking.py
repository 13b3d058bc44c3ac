"""Positions and running values over all rows of a table, by ranges of the order, so that no task sorts or holds the whole of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.sources.shared import written


def _ranges(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df dealt out by ranges of an order and written, with the number of its range (_range): every row of one comes before all of the next."""
    return written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """df with positions 1, 2, ... in an order of all rows. Ranges of the order are numbered each by itself, after the rows of those before it."""
    dealt = _ranges(df, order)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row for each range
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(out, place).join(F.broadcast(before), "_range").withColumn(out, (F.col(out) + F.col("_before")).cast("int")).drop("_range", "_before")


def running_before(df: DataFrame, order: list[Column | str], value: str, out: str, how: str = "max") -> DataFrame:
    """df with the largest ("max") or least ("min") value of all rows that come strictly before in an order without ties; null before the first."""
    aggregate = {"max": F.max, "min": F.min}[how]
    dealt = _ranges(df, order)
    each = dealt.groupBy("_range").agg(aggregate(value).alias("_v"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = each.select("_range", aggregate("_v").over(earlier).alias("_before"))  # one row for each range
    inside = aggregate(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    whole = {"max": F.greatest, "min": F.least}[how](F.col("_before"), F.col("_inside"))  # of one that is null the other
    return dealt.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(out, whole).drop("_range", "_before", "_inside")
