"""Monthly trends of item coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.operators.metrics import densify, share


@dataclass(frozen=True)
class TrendRules:
    """Thresholds of the trend classes; the defaults are fixed values."""

    month_sample: int = 20
    months: int = 7
    total_sample: int = 200
    date_coverage: float = 0.70
    rolling: int = 3
    declining_slope: float = -0.005
    declining_change: float = -0.015
    emerging_before: float = 0.03
    emerging_change: float = 0.03
    growing_slope: float = 0.005
    growing_change: float = 0.015
    mature_coverage: float = 0.20
    mature_slope: float = 0.005
    mature_volatility: float = 0.04
    niche_coverage: float = 0.03
    niche_slope: float = 0.004
    stable_slope: float = 0.003
    stable_volatility: float = 0.03


def monthly_series(entities: DataFrame, pairs: DataFrame, items: DataFrame, date: str = "event_date", by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, item_id, ordinal, month, entity_count, sample_size, coverage) for every item and every month with entities; absent pairs are 0.

    by: columns of entities; each of their values has a series of its own, of the months in which it has entities.
    """
    dated = entities.where(F.col(date).isNotNull()).select("entity_id", *by, F.trunc(date, "MM").alias("month"))
    months = dated.groupBy(*by, "month").agg(F.count("*").alias("sample_size"))
    counts = pairs.join(dated, "entity_id").groupBy(*by, "item_id", "month").agg(F.count("*").alias("entity_count"))
    return dense_series(months, counts, items, by)


def dense_series(months: DataFrame, counts: DataFrame, items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What monthly_series gives, from the entities of each month (sample_size) and those with each item (entity_count)."""
    dense = densify(counts, items.select("item_id"), months.select(*by, "month"), ["entity_count"]).join(months, [*by, "month"])
    return dense.select(*by, "item_id", (F.year("month") * 12 + F.month("month")).alias("ordinal"), "month", "entity_count", "sample_size", share(F.col("entity_count"), F.col("sample_size")).alias("coverage"))


def rolling_mean(series: DataFrame, k: int = 3, value: str = "coverage", by: tuple[str, ...] = ()) -> DataFrame:
    """series with rolling: the mean of k rows if they are k months in a row, else null."""
    w = W.partitionBy(*by, "item_id").orderBy("ordinal")
    whole = F.col("ordinal") - F.lag("ordinal", k - 1).over(w) == k - 1
    return series.withColumn("rolling", F.when(whole, F.avg(value).over(w.rowsBetween(1 - k, 0))))


def calendar_changes(series: DataFrame, lags: tuple[int, ...] = (3, 6), value: str = "coverage", by: tuple[str, ...] = ()) -> DataFrame:
    """series with change_<k>m: the value minus that of exactly k calendar months before, null if that month is not there."""
    w = W.partitionBy(*by, "item_id").orderBy("ordinal")
    return series.withColumns({f"change_{k}m": F.col(value) - F.first(value).over(w.rangeBetween(-k, -k)) for k in lags})


def slope_and_volatility(series: DataFrame, value: str = "coverage", by: tuple[str, ...] = ()) -> DataFrame:
    """Per item the least-squares slope by month (null without two different months) and the sample deviation of changes between adjacent months (null below two)."""
    w = W.partitionBy(*by, "item_id").orderBy("ordinal")
    steps = series.withColumn("step", F.when(F.col("ordinal") - F.lag("ordinal").over(w) == 1, F.col(value) - F.lag(value).over(w)))
    return steps.groupBy(*by, "item_id").agg(F.regr_slope(F.col(value), F.col("ordinal").cast("double")).alias("slope"), F.when(F.count("step") >= 2, F.stddev_samp("step")).alias("volatility"))


def classify(df: DataFrame, r: TrendRules) -> DataFrame:
    """df (latest, before_3m, change_3m, slope, volatility, qualified_months, total_sample, date_coverage) with reasons against a class and trend."""
    gates = [(F.col("qualified_months") >= r.months, "months"), (F.col("total_sample") >= r.total_sample, "sample_size"), (F.col("date_coverage") >= r.date_coverage, "date_coverage"), (F.col("latest").isNotNull(), "latest_month")]
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in gates]))
    slope, change, latest, vol = F.col("slope"), F.col("change_3m"), F.col("latest"), F.col("volatility")
    flat = F.abs(slope)
    trend = (
        F.when(F.size("reasons") > 0, "insufficient")
        .when(slope.isNull() | vol.isNull() | change.isNull(), "inconclusive")
        .when((slope <= r.declining_slope) & (change <= r.declining_change), "Declining")
        .when((F.col("before_3m") <= r.emerging_before) & (change >= r.emerging_change), "Emerging")
        .when((slope >= r.growing_slope) & (change >= r.growing_change), "Growing")
        .when((latest >= r.mature_coverage) & (flat <= r.mature_slope) & (vol <= r.mature_volatility), "Mature")
        .when((latest <= r.niche_coverage) & (flat <= r.niche_slope), "Niche")
        .when((flat <= r.stable_slope) & (vol <= r.stable_volatility), "Stable")
        .otherwise("inconclusive")
    )
    return df.withColumn("reasons", reasons).withColumn("trend", trend)


def trends(entities: DataFrame, pairs: DataFrame, items: DataFrame, r: TrendRules | None = None, date: str = "event_date", by: tuple[str, ...] = ()) -> DataFrame:
    """One row per item: latest qualified month, its coverage, rolling mean, changes, slope, volatility, gates and class.

    Months with fewer than month_sample entities count for the rolling mean and the total sample only. by: columns of entities; each of
    their values has trends of its own.
    """
    total = entities.groupBy(*by).agg(F.count("*").alias("all_entities")) if by else entities.agg(F.count("*").alias("all_entities"))
    return courses(monthly_series(entities, pairs, items, date, by), total, items, r, by)


def courses(series: DataFrame, total: DataFrame, items: DataFrame, r: TrendRules | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """What trends gives, from the monthly series and the number of entities (all_entities), one row or one for each value of by."""
    r = r or TrendRules()
    key = [*by, "item_id"]
    series = rolling_mean(series, r.rolling, by=by)
    whole = series.groupBy(*key).agg(F.sum("sample_size").alias("total_sample"), F.max_by("rolling", "ordinal").alias("rolling"))
    good = series.where(F.col("sample_size") >= r.month_sample)
    moved = calendar_changes(good, by=by)
    last = moved.groupBy(*key).agg(F.max("ordinal").alias("latest_ordinal"), F.max_by("coverage", "ordinal").alias("latest"), F.max_by("change_3m", "ordinal").alias("change_3m"), F.max_by("change_6m", "ordinal").alias("change_6m"), F.count("*").alias("qualified_months"))
    every = items.select("item_id").crossJoin(F.broadcast(total))  # one row, or one for each value of by
    joined = every.join(whole, key, "left").join(last, key, "left").join(slope_and_volatility(good, by=by), key, "left")
    joined = joined.fillna(0, ["total_sample", "qualified_months"]).withColumn("before_3m", F.col("latest") - F.col("change_3m")).withColumn("date_coverage", F.coalesce(F.least(F.lit(1.0), share(F.col("total_sample"), F.col("all_entities"))), F.lit(0.0)))
    return classify(joined, r).select(*key, "latest_ordinal", "latest", "rolling", "change_3m", "change_6m", "slope", "volatility", "qualified_months", "total_sample", "date_coverage", "reasons", "trend")
