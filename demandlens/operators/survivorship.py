"""Which value of a group of records survives, field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stable_mode(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(by, out): the value with the most rows, then the longest, then the greatest; blank ones do not count."""
    counts = df.where(F.trim(F.col(value).cast("string")) != "").groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.max_by(value, F.struct("n", F.length(F.col(value).cast("string")), value)).alias(out))


def best_title(df: DataFrame, by: str, title: str, confidence: str, parsed: str, key: str, out: str = "title") -> DataFrame:
    """(by, out): the title of the row with the most confidence, then a parsed one, then the longest, then the greatest id."""
    return df.groupBy(by).agg(F.max_by(title, F.struct(F.coalesce(F.col(confidence), F.lit(0.0)), F.coalesce(F.col(parsed), F.lit(False)), F.length(F.coalesce(F.col(title), F.lit(""))), key)).alias(out))


def best_description(df: DataFrame, by: str, text: str, key: str, out: str = "description") -> DataFrame:
    """(by, out): the text with the most distinct words, then the most characters that are not blank, then the greatest id."""
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(?U)[\\w+#.-]+"), 0)))
    return df.where(F.col(text).isNotNull()).groupBy(by).agg(F.max_by(text, F.struct(words, F.length(F.regexp_replace(text, "\\s", "")), key)).alias(out))


def date_bounds(df: DataFrame, by: str, date: str, reliable: str) -> DataFrame:
    """(by, first_date, last_date) of the rows whose date is reliable."""
    known = F.when(F.col(reliable), F.col(date))
    return df.groupBy(by).agg(F.min(known).alias("first_date"), F.max(known).alias("last_date"))


def reconcile(df: DataFrame, by: str, source: str, value: str, spread: float = 0.35, months: str | None = None) -> DataFrame:
    """(by, value, sources, status, months, observations): the median of the sources' medians; a conflict if they spread too far.

    The spread is (largest - least) over the median of medians, of two sources or more. All observations are kept, sorted.
    """
    rows = df.withColumn("_m", F.col(months) if months else F.lit(None).cast("int"))
    per_source = rows.where(F.col(value).isNotNull()).groupBy(by, source).agg(F.median(value).alias("median"))
    both = per_source.groupBy(by).agg(F.median("median").alias("middle"), F.min("median").alias("low"), F.max("median").alias("high"), F.count("*").alias("sources"))
    seen = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(source).alias("source"), F.col(value).alias("value")))).alias("observations"), F.bround(F.median("_m"), 0).cast("int").alias("months"))
    joined = df.select(by).distinct().join(both, by, "left").join(seen, by, "left")
    conflict = (F.col("sources") > 1) & ((F.col("high") - F.col("low")) / F.nullif(F.col("middle"), F.lit(0.0)) > spread)
    status = F.when(F.col("middle").isNull(), "unavailable").when(conflict, "conflict").otherwise("available")
    return joined.select(by, F.when(status == "available", F.col("middle")).alias("value"), F.coalesce("sources", F.lit(0).cast("long")).alias("sources"), status.alias("status"), F.when(status == "available", F.col("months")).alias("months"), "observations")


def assemble(parts: list[DataFrame], by: str) -> DataFrame:
    """One row per group from the surviving fields; a group without a field has null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, by, "full")
    return out
