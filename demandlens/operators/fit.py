"""Fit of an owned set of items to entities, gains of further items, and a budgeted greedy selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.sources.shared import written, written_counted


def requirements(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    """(entity_id, required, matched, fit) of entities with at least one item. owned: (item_id), a profile."""
    have = owned.select("item_id").distinct().withColumn("_own", F.lit(1))
    return pairs.join(have, "item_id", "left").groupBy("entity_id").agg(F.count("*").alias("required"), F.count("_own").alias("matched")).withColumn("fit", F.col("matched") / F.col("required").cast("double"))


def baseline(fits: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Entities with items, average fit, and the share with a fit of at least the threshold; one row, of nulls if there are none."""
    return fits.groupBy(*(by or [])).agg(F.count("*").alias("sample_size"), F.avg("fit").alias("average_fit"), F.avg((F.col("fit") >= threshold).cast("double")).alias("coverage"))


def gains(pairs: DataFrame, fits: DataFrame, owned: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Per item that is not owned: entities with it, average fit gain over all entities with items, entities that it lifts over the threshold.

    by: columns of fits to group by as well.
    """
    by = by or []
    n = fits.groupBy(*by).agg(F.count("*").alias("sample_size"))
    missing = pairs.join(owned.select("item_id").distinct(), "item_id", "left_anti").join(fits, "entity_id")
    crossing = (F.col("fit") < threshold) & ((F.col("matched") + 1) / F.col("required").cast("double") >= threshold)
    found = missing.groupBy(*by, "item_id").agg(F.count("*").alias("entity_count"), F.sum(1 / F.col("required").cast("double")).alias("gain"), F.count_if(crossing).alias("crossing_count"))
    joined = found.join(n, by) if by else found.crossJoin(F.broadcast(n))  # one row
    return joined.select(*by, "item_id", "entity_count", (F.col("gain") / F.col("sample_size")).alias("average_gain"), "crossing_count", (F.col("crossing_count") / F.col("sample_size").cast("double")).alias("threshold_gain"))


def status(targets: Column, sample: Column) -> Column:
    """no_target_entities, no_item_evidence or ok."""
    return F.when(targets == 0, "no_target_entities").when(sample == 0, "no_item_evidence").otherwise("ok")


def analyse(cohort: DataFrame, pairs: DataFrame, owned: DataFrame, threshold: float = 0.70) -> DataFrame:
    """Candidates of a cohort with the baseline beside each; a cohort without candidates keeps one row with a null item."""
    mine = pairs.join(cohort.select("entity_id"), "entity_id", "left_semi")
    fits = requirements(mine, owned)
    base = cohort.agg(F.count("*").alias("target_count")).crossJoin(baseline(fits, threshold)).withColumn("status", status(F.col("target_count"), F.col("sample_size")))
    return base.join(gains(mine, fits, owned, threshold), F.lit(True), "left")


def select_items(cohort: DataFrame, pairs: DataFrame, items: DataFrame, owned: list[str], budget: float, threshold: float = 0.70, average_weight: float = 0.6, threshold_weight: float = 0.4, least_gain: float = 1e-6) -> DataFrame:
    """Items picked one by one within a budget of cost, each time the one with the largest marginal gain per cost, gains kept up to date.

    Ties go to the larger gain, then to the lesser id. Returns step, item_id, cost, marginal, remaining. The loop is on the driver, as each
    pick depends on the last; its steps are at most the budget over the least cost. items: (item_id, cost); items without a positive cost
    are never picked.
    All gains are counted once. A pick changes only which items lift an entity over the threshold, and only of entities that hold the
    picked item; what they gave before and give now is counted for these, and the differences are added to the last gains, one row for
    each item. An entity that has reached the threshold gives nothing any more, so such entities are left out of what later steps read,
    written anew whenever half of those left have got there.
    """
    spark = pairs.sparkSession
    mine = written(pairs.where(F.col("item_id").isNotNull()).join(cohort.select("entity_id"), "entity_id", "left_semi"), "cohort_pairs")
    have, steps, left = list(dict.fromkeys(owned)), [], float(budget)
    held = spark.createDataFrame([(x,) for x in have], "item_id string")
    fits = written(requirements(mine, held), "fits")
    n = fits.count()
    now = written(gains(mine, fits, held, threshold).join(items.where(F.col("cost") > 0).select("item_id", "cost"), "item_id"), "gains")
    below, below_n = written_counted(fits.where(F.col("fit") < threshold).select("entity_id"), "below")
    waiting, reached, reached_n = written(mine.join(below, "entity_id", "left_semi"), "waiting"), [], 0

    def lifts(matched: Column) -> Column:
        required = F.col("required").cast("double")
        return ((matched / required < threshold) & ((matched + 1) / required >= threshold)).cast("long")

    while True:
        marginal = average_weight * F.col("average_gain") + threshold_weight * F.col("crossing_count") / max(n, 1)
        able = now.withColumn("marginal", F.round(marginal, 12)).where((F.col("cost") <= left + 1e-9) & (F.col("marginal") >= least_gain))
        best = able.orderBy(F.round(F.col("marginal") / F.col("cost"), 12).desc(), F.desc("marginal"), "item_id").limit(1).collect()
        if not best:
            break
        picked = best[0]["item_id"]
        left -= best[0]["cost"]
        have.append(picked)
        steps.append((len(steps) + 1, picked, float(best[0]["cost"]), best[0]["marginal"], left))
        touched = written(waiting.join(waiting.where(F.col("item_id") == picked).select("entity_id"), "entity_id", "left_semi"), "touched")
        each = touched.groupBy("entity_id").agg(F.count("*").alias("required"), F.count_if(F.col("item_id").isin(have)).alias("matched"))
        each, got = written_counted(each, "each", F.col("matched") / F.col("required").cast("double") >= threshold)
        change = touched.where(~F.col("item_id").isin(have)).join(each, "entity_id").groupBy("item_id").agg(F.sum(lifts(F.col("matched")) - lifts(F.col("matched") - 1)).alias("_change"))
        now = written(now.where(F.col("item_id") != picked).join(change, "item_id", "left").withColumn("crossing_count", F.col("crossing_count") + F.coalesce("_change", F.lit(0))).drop("_change"), "gains")
        reached, reached_n = [*reached, each.where(F.col("matched") / F.col("required").cast("double") >= threshold).select("entity_id")], reached_n + got
        if 2 * reached_n > below_n:
            waiting = written(waiting.join(reduce(DataFrame.unionByName, reached), "entity_id", "left_anti"), "waiting")
            below_n, reached, reached_n = below_n - reached_n, [], 0
    return spark.createDataFrame(steps, "step int, item_id string, cost double, marginal double, remaining double")
