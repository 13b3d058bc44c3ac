"""Incremental ingest and demand counts with Structured Streaming; both run to the end of what is there and can go on later.

What a batch adds lies in partitions of its own number, so a batch that is run again after a failure overwrites what it had written
and adds nothing twice. The keys that have been seen are an index by day, of which a batch reads only the days that it touches.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _put(rows: DataFrame, path: str, number: int, *parts: str) -> None:
    """Writes rows as what batch number adds to a table, in place of what it may have added before."""
    rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "batch").parquet(path)


def _start(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], f"{schema}, batch long").write.mode("append").partitionBy("batch").parquet(path)  # so that the first batch finds a table


def _days(rows: DataFrame, around: int = 0) -> tuple[list[datetime.date], bool]:
    """The days of rows and those up to around before and after them, and whether a row has none. Bounded by the calendar."""
    found = [r["day"] for r in rows.select("day").distinct().collect()]
    near = {d + datetime.timedelta(days=k) for d in found if d is not None for k in range(-around, around + 1)}
    return sorted(near), None in found


def _unseen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not among those seen; null equals null."""
    there = seen.select(*[F.col(k).alias(f"_{k}") for k in keys])
    return rows.join(there, reduce(Column.__and__, [rows[k].eqNullSafe(there[f"_{k}"]) for k in keys]), "left_anti")


def _run(spark: SparkSession, inbox: str, checkpoint: str, schema: str, each: Callable[[DataFrame, int], None], files_per_batch: int | None) -> None:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    reader.parquet(inbox).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _types(schema: str, spark: SparkSession, columns: list[str]) -> str:
    types = dict(spark.createDataFrame([], schema).dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)


def ingest(spark: SparkSession, inbox: str, table: str, checkpoint: str, schema: str, keys: list[str], time: str, within_days: int | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Appends the files of inbox that were not read before to a Parquet table, the earliest row of each key, and returns the table.

    Every file counts once, also after a restart, as the checkpoint remembers it. A row is new if no earlier batch had its keys (null
    equals null), however late it comes. The keys lie in an index by the day of their row. Where rows of one key are never more than
    within_days days apart, a batch reads only the index of its own days and of so many around them, so that what it reads does not
    grow with the table; without that, it reads the keys of all days. Rows without a time are compared with all days.
    """
    index = f"{table}_keys"

    def append(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), F.struct(time, F.xxhash64(*batch.columns))).alias("row")).select("row.*").withColumn("day", F.to_date(time))
        first = first.persist()
        try:
            seen = own.read.schema(f"{_types(schema, own, keys)}, day date, batch long").parquet(index).where(F.col("batch") < number)
            if within_days is not None:
                days, timeless = _days(first, within_days)
                seen = seen if timeless else seen.where(F.col("day").isin(days) | F.col("day").isNull())
            new = _unseen(first, seen, keys).persist()
            _put(new.drop("day"), table, number)
            _put(new.select(*keys, "day"), index, number, "day")
            new.unpersist()
        finally:
            first.unpersist()

    _start(spark, table, schema)
    _start(spark, index, f"{_types(schema, spark, keys)}, day date")
    _run(spark, inbox, checkpoint, schema, append, files_per_batch)
    return spark.read.schema(f"{schema}, batch long").parquet(table).drop("batch")


def daily_counts(spark: SparkSession, inbox: str, table: str, checkpoint: str, schema: str, keys: list[str], item: str, time: str, lateness: str = "2 days", files_per_batch: int | None = None) -> DataFrame:
    """(day, item, n, late) of distinct keys by day and item, counted as rows come in.

    Each batch counts the keys that their day and item have not had yet, and adds them to the table; late is how many of n came when their
    day was over: when a row of an earlier batch was more than lateness past its end. n and late are sums of what the batches wrote, also
    for days that are still open, and n is what counting all rows at once gives. A key that occurs on two days counts on both. Rows
    without a time belong to no day.
    """
    index, counts, edges = f"{table}_keys", f"{table}_counts", f"{table}_edges"
    named = list(dict.fromkeys([item, *keys]))

    def count(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        timed = batch.where(F.col(time).isNotNull()).withColumn("day", F.to_date(time))
        first = timed.select("day", *named).distinct().persist()
        try:
            days, _ = _days(first)
            seen = own.read.schema(f"{_types(schema, own, named)}, day date, batch long").parquet(index).where((F.col("batch") < number) & F.col("day").isin(days))
            edge = own.read.schema("edge timestamp, batch long").parquet(edges).where(F.col("batch") < number).agg((F.max("edge") - F.expr(f"interval {lateness}")).alias("edge")).first()["edge"]
            new = _unseen(first, seen, ["day", *named]).persist()
            over = F.lit(False) if edge is None else (F.date_add("day", 1).cast("timestamp") <= F.lit(edge))
            _put(new.groupBy("day", item).agg(F.count("*").alias("n"), F.count_if(over).alias("late")), counts, number)
            _put(new, index, number, "day")
            _put(timed.agg(F.max(time).cast("timestamp").alias("edge")), edges, number)
            new.unpersist()
        finally:
            first.unpersist()

    _start(spark, index, f"{_types(schema, spark, named)}, day date")
    _start(spark, counts, f"day date, {_types(schema, spark, [item])}, n long, late long")
    _start(spark, edges, "edge timestamp")
    _run(spark, inbox, checkpoint, schema, count, files_per_batch)
    added = spark.read.schema(f"day date, {_types(schema, spark, [item])}, n long, late long, batch long").parquet(counts)
    return added.groupBy("day", item).agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


def monthly_from_days(days: DataFrame, item: str) -> DataFrame:
    """(month, item, n): sums of daily counts."""
    return days.groupBy(F.trunc("day", "MM").alias("month"), item).agg(F.sum("n").alias("n"))
