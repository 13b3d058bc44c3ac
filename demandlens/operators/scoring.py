"""Ranks, evidence confidence, scores, sensitivity, robustness and selection."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.operators import ranking


def ordinal_rank(df: DataFrame, score: str, key: str, out: str, by: list[str] | None = None) -> DataFrame:
    """df with positions 1, 2, ... by falling score, equal ones by key, within each by or over all rows."""
    order = [F.desc_nulls_last(score), F.col(key)]
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))) if by else ranking.numbered(df, order, out)


def rank_changes(df: DataFrame, pooled: str, balanced: str, key: str = "item_id") -> DataFrame:
    """(key, pooled_rank, balanced_rank, change): positive where the balanced rank is better."""
    both = ordinal_rank(ordinal_rank(df, pooled, key, "pooled_rank"), balanced, key, "balanced_rank")
    return both.select(key, "pooled_rank", "balanced_rank", (F.col("pooled_rank") - F.col("balanced_rank")).alias("change")).orderBy(F.abs("change").desc(), key)


def role_shifts(global_ranks: DataFrame, role_ranks: DataFrame, within: int = 5, limit: int = 3) -> DataFrame:
    """The items of a role's first ranks that stand furthest above their global rank."""
    both = role_ranks.join(global_ranks.select("item_id", "global_rank"), "item_id").withColumn("shift", F.col("global_rank") - F.col("role_rank"))
    kept = both.where((F.col("role_rank") <= within) & (F.col("shift") > 0))
    return kept.withColumn("k", F.row_number().over(W.partitionBy("role_id").orderBy(F.desc("shift"), "item_id"))).where(F.col("k") <= limit).select("role_id", "item_id", "global_rank", "role_rank", "shift")


def floor_percentile(df: DataFrame, by: list[str], value: str, p: float, out: str) -> DataFrame:
    """The value at index floor(p * (n - 1)) of the ascending values of each group, from counts of equal values so that no group is held whole."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by).orderBy(value)
    running = counts.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(W.partitionBy(*by)))
    return running.where(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1))).groupBy(*by).agg(F.min(value).alias(out))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def scaled(x: Column, low: float, high: float) -> Column:
    """x on a scale of 0 to 100 between low and high."""
    return 100 * clipped((x - low) / (high - low))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean of the parts by weight; null parts are left out and the other weights grow in proportion. Null if all are."""
    total, value = F.lit(0.0), F.lit(0.0)
    for name, c in parts.items():
        total = total + F.when(c.isNotNull(), weights[name]).otherwise(0.0)
        value = value + F.coalesce(c * weights[name], F.lit(0.0))
    return value / F.nullif(total, F.lit(0.0))


def checked(weights: dict[str, float], names: Iterable[str]) -> dict[str, float]:
    """weights, if they are those of names, none negative, and add up to 1; raises otherwise."""
    if set(weights) != set(names) or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError(f"weights of {sorted(names)} must be at least 0 and add up to 1, not {weights}")
    return weights


@dataclass(frozen=True)
class ConfidenceRules:
    """Weights, scales and caps of evidence confidence; the defaults are fixed values."""

    weights: dict[str, float] = field(default_factory=lambda: {"sample": 0.30, "diversity": 0.20, "freshness": 0.20, "metric": 0.15, "agreement": 0.15})
    full_sample: int = 500
    full_sources: int = 4
    fresh_days: int = 30
    stale_days: int = 180
    agreement_scale: float = 0.25
    cap_no_gold: float = 60.0
    cap_few_sources: float = 65.0
    cap_small: float = 40.0
    small: int = 10
    high: float = 75.0
    medium: float = 50.0

    def __post_init__(self):
        checked(self.weights, ("sample", "diversity", "freshness", "metric", "agreement"))
        if not (0 <= self.medium <= self.high <= 100 and 0 <= self.fresh_days < self.stale_days and self.agreement_scale > 0 and self.full_sample > 0 and self.full_sources > 0):
            raise ValueError(f"levels, days or scales out of order: {self}")
        if not all(0 <= c <= 100 for c in (self.cap_no_gold, self.cap_few_sources, self.cap_small)):
            raise ValueError(f"caps must be between 0 and 100: {self}")


def confidence(df: DataFrame, r: ConfidenceRules | None = None) -> DataFrame:
    """df with the components of confidence, score, level and warnings.

    Takes sample_size, effective_sources, eligible_sources, p75_age, newest_age, date_coverage, metric_count (null: not applicable),
    agreement_deviation (null: too few sources, which counts as 0), gold (boolean).
    """
    r = r or ConfidenceRules()
    n = F.col("sample_size")
    sample = 100 * F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.lit(float(r.full_sample))))
    diversity = 100 * F.least(F.lit(1.0), F.coalesce(F.col("effective_sources"), F.lit(0.0)) / r.full_sources)
    age = F.coalesce(F.col("p75_age"), F.col("newest_age")).cast("double")
    fresh = F.coalesce(100 * clipped((r.stale_days - age) / (r.stale_days - r.fresh_days)) * F.coalesce(F.col("date_coverage"), F.lit(0.0)), F.lit(0.0))
    metric = F.when(F.col("metric_count").isNotNull(), F.coalesce(100.0 * F.col("metric_count") / F.nullif(n, F.lit(0)), F.lit(0.0)))
    agree = F.coalesce(100 * F.greatest(F.lit(0.0), 1 - F.col("agreement_deviation") / r.agreement_scale), F.lit(0.0))
    parts = {"sample": sample, "diversity": diversity, "freshness": fresh, "metric": metric, "agreement": agree}
    df = df.withColumns({f"{k}_score": v for k, v in parts.items()})
    raw = weighted({k: F.col(f"{k}_score") for k in parts}, r.weights)
    few = F.col("eligible_sources") < 2
    cap = F.least(F.when(F.col("gold"), 100.0).otherwise(r.cap_no_gold), F.when(few, r.cap_few_sources).otherwise(100.0), F.when(n < r.small, r.cap_small).otherwise(100.0))
    warnings = F.array_compact(F.array(F.when(~F.col("gold"), F.lit("no_gold")), F.when(few, F.lit("few_sources")), F.when(n < r.small, F.lit("small_sample"))))
    df = df.withColumn("confidence", F.round(F.least(cap, raw), 2)).withColumn("warnings", warnings)
    return df.withColumn("level", F.when(F.col("confidence") >= r.high, "High").when(F.col("confidence") >= r.medium, "Medium").otherwise("Low"))


#: Fixed weights and scales of the decision scores.
VALUE_WEIGHTS = {"demand": 0.25, "effect": 0.20, "trend": 0.20, "synergy": 0.15, "confidence": 0.20}
ROI_WEIGHTS = {"gain": 0.45, "value": 0.25, "cost": 0.15, "confidence": 0.15}
SIGNAL_WEIGHTS = {"demand": 0.30, "company": 0.20, "role": 0.20, "synergy": 0.15, "confidence": 0.15}
HALF_VALUE = 160.0


def market_value(demand: Column, effect: Column, slope: Column, synergy: Column, trust: Column, weights: dict[str, float] | None = None) -> Column:
    """Score of 0 to 100 of demand (0 to 1), effect in percent, slope per month, synergy (0 to 1) and confidence (0 to 100)."""
    parts = {"demand": 100 * clipped(demand), "effect": scaled(effect, -20.0, 20.0), "trend": scaled(slope, -0.02, 0.02), "synergy": 100 * clipped(synergy), "confidence": trust}
    return weighted(parts, checked(weights or VALUE_WEIGHTS, VALUE_WEIGHTS))


def cost_decay(cost: Column, half_value: Column | float = HALF_VALUE) -> Column:
    """half / (half + cost): 1 for nothing, one half at the half-value cost."""
    half = F.lit(half_value) if isinstance(half_value, float) else half_value
    return half / (half + cost)


def personal_roi(gain: Column, value: Column, cost: Column, trust: Column, weights: dict[str, float] | None = None) -> Column:
    """Score of 0 to 100 of a fit gain (0 to 1), a market value and confidence (0 to 100) and a cost in hours."""
    return weighted({"gain": 100 * clipped(gain), "value": value, "cost": 100 * cost_decay(cost), "confidence": trust}, checked(weights or ROI_WEIGHTS, ROI_WEIGHTS))


def market_signal(demand: Column, company: Column, role: Column, synergy: Column, trust: Column, weights: dict[str, Column | float] | None = None) -> Column:
    """100 times the weighted sum of four parts of 0 to 1, and the weighted confidence of 0 to 100."""
    w = weights or SIGNAL_WEIGHTS
    return 100 * (w["demand"] * demand + w["company"] * company + w["role"] * role + w["synergy"] * synergy) + w["confidence"] * trust


#: Named scenarios: weights in the order of SIGNAL_WEIGHTS, and the half-value cost.
SCENARIOS = {"baseline": ((0.30, 0.20, 0.20, 0.15, 0.15), 160.0), "demand_heavy": ((0.45, 0.15, 0.15, 0.10, 0.15), 160.0), "breadth_heavy": ((0.20, 0.30, 0.30, 0.10, 0.10), 160.0), "confidence_heavy": ((0.25, 0.15, 0.15, 0.10, 0.35), 160.0), "short_cost": ((0.30, 0.20, 0.20, 0.15, 0.15), 100.0), "long_cost": ((0.30, 0.20, 0.20, 0.15, 0.15), 240.0)}


def sensitivity(df: DataFrame, key: str = "item_id", scenarios: dict[str, tuple[tuple[float, ...], float]] | None = None, sensitive: int = 5) -> DataFrame:
    """Ranks of all rows under every scenario: best, worst and baseline rank, their range, stability, and whether the range is sensitive.

    Takes demand, company, role, synergy, confidence, cost_expected. Each scenario is ranked in a partition of its own.
    """
    scenarios = scenarios or SCENARIOS
    for w, half in scenarios.values():
        checked(dict(zip(SIGNAL_WEIGHTS, w, strict=True)), SIGNAL_WEIGHTS)
        if half <= 0:
            raise ValueError("a half-value cost must be positive")
    named = F.array(*[F.struct(F.lit(s).alias("scenario"), *[F.lit(v).alias(k) for k, v in zip(SIGNAL_WEIGHTS, w, strict=True)], F.lit(h).alias("half")) for s, (w, h) in scenarios.items()])
    each = df.withColumn("s", F.explode(named))
    score = market_signal(F.col("demand"), F.col("company"), F.col("role"), F.col("synergy"), F.col("confidence"), {k: F.col(f"s.{k}") for k in SIGNAL_WEIGHTS}) * cost_decay(F.col("cost_expected"), F.col("s.half"))
    ranked = each.select(key, "s.scenario", F.round(score, 9).alias("score")).withColumn("place", F.row_number().over(W.partitionBy("scenario").orderBy(F.desc("score"), key)))
    out = ranked.groupBy(key).agg(F.min("place").alias("best_rank"), F.max("place").alias("worst_rank"), F.max(F.when(F.col("scenario") == "baseline", F.col("place"))).alias("baseline_rank"))
    n, wide = F.col("_n"), F.col("worst_rank") - F.col("best_rank")
    counted = out.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    return counted.withColumn("rank_range", wide).withColumn("stability", F.when(n > 1, 1 - wide / (n - 1)).otherwise(1.0)).withColumn("sensitive", wide >= sensitive).drop("_n")


def robustness(width: Column, n: Column, companies: Column, roles: Column, trust: Column, cost_min: Column, cost_expected: Column, cost_max: Column) -> Column:
    """Ranking robustness of 0 to 100 from the rank range, support, companies, roles, confidence and the spread of the cost."""
    spread = (cost_max - cost_min) / F.nullif(cost_expected, F.lit(0.0))
    return 100 * (
        0.30 * F.greatest(F.lit(0.0), 1 - width / 30.0) + 0.20 * F.least(F.lit(1.0), n / 30.0) + 0.15 * F.least(F.lit(1.0), companies / 20.0) + 0.10 * F.least(F.lit(1.0), roles / 4.0)
        + 0.15 * trust / 100.0 + 0.10 * F.greatest(F.lit(0.0), 1 - F.coalesce(spread, F.lit(0.0)) / 2)
    )


def robustness_level(score: Column) -> Column:
    return F.when(score >= 70, "robust").when(score >= 50, "moderate").otherwise("sensitive")


def is_candidate(eligibility: Column, n: Column, companies: Column, trust: Column, level: Column) -> Column:
    """Whether an item is a candidate: main, 10 entities, 8 companies, confidence 30, not sensitive."""
    return (eligibility == "main") & (n >= 10) & (companies >= 8) & (trust >= 30) & level.isin("robust", "moderate")


def evidence_status(n: Column) -> Column:
    """insufficient up to 3, small below 10, else normal."""
    return F.when(n <= 3, "insufficient").when(n < 10, "small").otherwise("normal")


def pareto(df: DataFrame, cost: str, signal: str) -> DataFrame:
    """Rows that no other row beats by a lower cost and at least the signal, or by the cost and a higher signal; equal rows stay.

    A cost stays if its best signal exceeds that of all lower costs; one row per distinct cost is compared.
    """
    best = df.groupBy(cost).agg(F.max(signal).alias("_best"))
    below = ranking.running_before(best, [F.col(cost)], "_best", "_below")
    front = below.where(F.col("_below").isNull() | (F.col("_best") > F.col("_below"))).select(F.col(cost).alias("_cost"), "_best")
    return df.join(front, (F.col(cost) == F.col("_cost")) & (F.col(signal) == F.col("_best"))).drop("_cost", "_best")


def tiered(df: DataFrame, level: str, rank: str, first: int = 12, second: int = 12, moderate: bool = True) -> DataFrame:
    """The first robust rows by rank (of all rows if none is robust), then the first moderate ones."""
    k = F.row_number().over(W.partitionBy(level).orderBy(rank))
    quota = F.when(F.col(level) == "robust", first).when((F.col(level) == "moderate") & F.lit(moderate), second).otherwise(0)
    picked = df.withColumn("_k", k).where(F.col("_k") <= quota).drop("_k")
    none = df.agg(F.count_if(F.col(level) == "robust").alias("_r"))
    fallback = df.orderBy(rank).limit(first).crossJoin(none).where("_r = 0").drop("_r")
    return picked.unionByName(fallback).distinct()


def relation_top(df: DataFrame, core: str, order: list[Column], primary: int = 5, secondary: int = 12) -> DataFrame:
    """The first relations of each core item, marked primary, then the next ones, marked secondary."""
    ranked = df.withColumn("position", F.row_number().over(W.partitionBy(core).orderBy(*order)))
    return ranked.where(F.col("position") <= primary + secondary).withColumn("tier", F.when(F.col("position") <= primary, "primary").otherwise("secondary"))


def named_findings(frames: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """The rows of keys (frame, item_id) found in their frames (item_id, value), all or none: no row at all if any is missing."""
    found = None
    for name, df in frames.items():
        part = keys.where(F.col("frame") == name).join(df.select("item_id", F.col("value").cast("double").alias("value")), "item_id").select("frame", "item_id", "value")
        found = part if found is None else found.unionByName(part)
    wanted, have = keys.agg(F.count("*").alias("wanted")), found.agg(F.count("*").alias("have"))
    return found.crossJoin(wanted).crossJoin(have).where("wanted = have").select("frame", "item_id", "value")
