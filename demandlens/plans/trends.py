"""Queries of windows and trends (W)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.operators import metrics, scoring, trend
from demandlens.plans.base import Star, query, rounded, with_tables

SERIES = """, d AS (SELECT entity_id, CAST(date_trunc('month', event_date) AS DATE) AS month FROM entities), mo AS (SELECT month, count(*) AS sample_size FROM d GROUP BY 1), c AS (SELECT item_id, month, count(*) AS n FROM pairs JOIN d USING (entity_id) GROUP BY 1, 2),
series AS (SELECT i.item_id, CAST(year(mo.month) * 12 + month(mo.month) AS INTEGER) AS ordinal, mo.month, CAST(coalesce(n, 0) AS BIGINT) AS entity_count, sample_size, coalesce(n, 0) * 1e0 / sample_size AS coverage FROM items i CROSS JOIN mo LEFT JOIN c ON c.item_id = i.item_id AND c.month = mo.month)"""
BASE = with_tables("entities", "items", "entity_items", "pairs")
COVERAGE = ", cov AS (SELECT item_id, count(*) * 1e0 / (SELECT count(*) FROM entities) AS coverage FROM pairs GROUP BY 1)"
BY_ROLE = ", br AS (SELECT role_id, item_id, count(*) AS n FROM pairs JOIN entities USING (entity_id) GROUP BY 1, 2)"


def series(t: Star) -> DataFrame:
    return trend.monthly_series(t.entities, t.pairs, t.items)


@query("w1_partition_count", with_tables("source_map", "entity_items") + "SELECT DISTINCT item_id, source_id, count(*) OVER (PARTITION BY item_id) AS sources FROM (SELECT DISTINCT item_id, source_id FROM entity_items JOIN source_map USING (entity_id, record_id))")
def w1(t: Star) -> DataFrame:
    two = t.counted().evidence.select("item_id", "source_id").distinct()
    return two.withColumn("sources", F.count("*").over(W.partitionBy("item_id")))


@query("w2_partition_mean", with_tables("source_map", "entity_items") + ", s AS (SELECT m.source_id, item_id, count(DISTINCT m.entity_id) * 1e0 / any_value(n) AS c FROM entity_items x JOIN source_map m USING (entity_id, record_id) JOIN (SELECT source_id, count(DISTINCT entity_id) AS n FROM source_map GROUP BY 1) z ON z.source_id = m.source_id GROUP BY 1, 2) SELECT item_id, source_id, round(c, 6) AS coverage, round(avg(c) OVER (PARTITION BY item_id), 6) AS mean_coverage FROM s")
def w2(t: Star) -> DataFrame:
    t = t.counted()
    found = metrics.source_demand(t.source_map, t.entity_items, t.evidence).select("item_id", "source_id", "coverage")
    return rounded(found.withColumn("mean_coverage", F.avg("coverage").over(W.partitionBy("item_id"))))


@query("w3_row_number", BASE + COVERAGE + " SELECT item_id, round(coverage, 6) AS coverage, CAST(row_number() OVER (ORDER BY coverage DESC, item_id) AS INTEGER) AS position FROM cov")
def w3(t: Star) -> DataFrame:
    # one row per item, so a single window over all of them stays small
    return rounded(scoring.ordinal_rank(metrics.demand(t.entities, t.source_map, t.entity_items, t.items).where("entity_count > 0").select("item_id", "coverage"), "coverage", "item_id", "position"))


@query("w4_monthly_series", BASE + SERIES + " SELECT item_id, ordinal, month, entity_count, sample_size, round(coverage, 6) AS coverage FROM series")
def w4(t: Star) -> DataFrame:
    return rounded(series(t))


@query("w5_rolling_mean", BASE + SERIES + " SELECT item_id, ordinal, CASE WHEN ordinal - lag(ordinal, 2) OVER w = 2 THEN round(avg(coverage) OVER (PARTITION BY item_id ORDER BY ordinal ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS rolling FROM series WINDOW w AS (PARTITION BY item_id ORDER BY ordinal)")
def w5(t: Star) -> DataFrame:
    return rounded(trend.rolling_mean(series(t)).select("item_id", "ordinal", "rolling"))


@query("w6_calendar_change", BASE + SERIES + " SELECT a.item_id, a.ordinal, round(a.coverage - b.coverage, 6) AS change_3m, round(a.coverage - c.coverage, 6) AS change_6m FROM series a LEFT JOIN series b ON a.item_id = b.item_id AND b.ordinal = a.ordinal - 3 AND b.sample_size >= 20 LEFT JOIN series c ON a.item_id = c.item_id AND c.ordinal = a.ordinal - 6 AND c.sample_size >= 20 WHERE a.sample_size >= 20")
def w6(t: Star) -> DataFrame:
    return rounded(trend.calendar_changes(series(t).where("sample_size >= 20")).select("item_id", "ordinal", "change_3m", "change_6m"))


SLOPES = " slopes AS (SELECT item_id, regr_slope(coverage, ordinal) AS slope FROM series WHERE sample_size >= 20 GROUP BY 1), steps AS (SELECT item_id, CASE WHEN ordinal - lag(ordinal) OVER w = 1 THEN coverage - lag(coverage) OVER w END AS step FROM series WHERE sample_size >= 20 WINDOW w AS (PARTITION BY item_id ORDER BY ordinal)), vols AS (SELECT item_id, CASE WHEN count(step) >= 2 THEN stddev_samp(step) END AS volatility FROM steps GROUP BY 1)"


@query("w7_slope", BASE + SERIES + "," + SLOPES + " SELECT item_id, round(slope, 9) AS slope FROM slopes")
def w7(t: Star) -> DataFrame:
    return rounded(trend.slope_and_volatility(series(t).where("sample_size >= 20")).select("item_id", "slope"), 9)


@query("w8_volatility", BASE + SERIES + "," + SLOPES + " SELECT item_id, round(volatility, 9) AS volatility FROM vols")
def w8(t: Star) -> DataFrame:
    return rounded(trend.slope_and_volatility(series(t).where("sample_size >= 20")).select("item_id", "volatility"), 9)


TRENDS = BASE + SERIES + "," + SLOPES + """, good AS (SELECT * FROM series WHERE sample_size >= 20), lastm AS (SELECT item_id, max(ordinal) AS o, count(*) AS qualified_months FROM good GROUP BY 1),
tot AS (SELECT item_id, CAST(sum(sample_size) AS BIGINT) AS total_sample FROM series GROUP BY 1),
f AS (SELECT l.item_id, l.o AS latest_ordinal, g.coverage AS latest, g.coverage - b3.coverage AS change_3m, b3.coverage AS before_3m, g.coverage - b6.coverage AS change_6m, slope, volatility, qualified_months, total_sample, least(1e0, total_sample * 1e0 / (SELECT count(*) FROM entities)) AS date_coverage
 FROM lastm l JOIN good g ON g.item_id = l.item_id AND g.ordinal = l.o LEFT JOIN good b3 ON b3.item_id = l.item_id AND b3.ordinal = l.o - 3 LEFT JOIN good b6 ON b6.item_id = l.item_id AND b6.ordinal = l.o - 6 JOIN slopes s ON s.item_id = l.item_id JOIN vols v ON v.item_id = l.item_id JOIN tot ON tot.item_id = l.item_id),
k AS (SELECT *, CASE WHEN qualified_months < 7 OR total_sample < 200 OR date_coverage < 0.7 THEN 'insufficient' WHEN slope IS NULL OR volatility IS NULL OR change_3m IS NULL THEN 'inconclusive' WHEN slope <= -0.005 AND change_3m <= -0.015 THEN 'Declining'
 WHEN latest - change_3m <= 0.03 AND change_3m >= 0.03 THEN 'Emerging' WHEN slope >= 0.005 AND change_3m >= 0.015 THEN 'Growing' WHEN latest >= 0.2 AND abs(slope) <= 0.005 AND volatility <= 0.04 THEN 'Mature' WHEN latest <= 0.03 AND abs(slope) <= 0.004 THEN 'Niche' WHEN abs(slope) <= 0.003 AND volatility <= 0.03 THEN 'Stable' ELSE 'inconclusive' END AS trend FROM f)"""


@query("w9_trend_class", TRENDS + " SELECT trend, count(*) AS n FROM k GROUP BY 1")
def w9(t: Star) -> DataFrame:
    return trend.trends(t.entities, t.pairs, t.items).groupBy("trend").agg(F.count("*").alias("n"))


@query("w10_trend_records", TRENDS + " SELECT item_id, latest_ordinal, round(latest, 6) AS latest, round(change_3m, 6) AS change_3m, round(change_6m, 6) AS change_6m, round(slope, 6) AS slope, round(volatility, 6) AS volatility, qualified_months, total_sample, round(date_coverage, 6) AS date_coverage, trend FROM k")
def w10(t: Star) -> DataFrame:
    return rounded(trend.trends(t.entities, t.pairs, t.items).drop("reasons", "rolling"))


@query("w11_ordinal_rank", BASE + BY_ROLE + " SELECT role_id, item_id, n, CAST(row_number() OVER (PARTITION BY role_id ORDER BY n DESC, item_id) AS INTEGER) AS position FROM br")
def w11(t: Star) -> DataFrame:
    return scoring.ordinal_rank(metrics.item_by_dimension(t.entities, t.pairs, "role_id").select(F.col("value").alias("role_id"), "item_id", F.col("entity_count").alias("n")), "n", "item_id", "position", ["role_id"])


@query("w12_competition_rank", BASE + BY_ROLE + " SELECT role_id, item_id, n, CAST(rank() OVER (PARTITION BY role_id ORDER BY n DESC) AS INTEGER) AS position FROM br")
def w12(t: Star) -> DataFrame:
    counts = metrics.item_by_dimension(t.entities, t.pairs, "role_id").select(F.col("value").alias("role_id"), "item_id", F.col("entity_count").alias("n"))
    return counts.withColumn("position", F.rank().over(W.partitionBy("role_id").orderBy(F.desc("n"))))


TWO = BASE + COVERAGE + ", m AS (SELECT item_id, count(DISTINCT entity_id) * 1e0 AS late FROM pairs JOIN entities USING (entity_id) WHERE event_date >= DATE '1999-01-01' GROUP BY 1), rk AS (SELECT item_id, CAST(row_number() OVER (ORDER BY coverage DESC, item_id) AS INTEGER) AS pooled_rank, CAST(row_number() OVER (ORDER BY late DESC, item_id) AS INTEGER) AS balanced_rank FROM cov JOIN m USING (item_id))"


@query("w13_rank_changes", TWO + " SELECT item_id, pooled_rank, balanced_rank, pooled_rank - balanced_rank AS change FROM rk")
def w13(t: Star) -> DataFrame:
    every = metrics.demand(t.entities, t.source_map, t.entity_items, t.items).select("item_id", F.col("coverage").alias("pooled"))
    late = t.pairs.join(t.entities.where("event_date >= date '1999-01-01'"), "entity_id").groupBy("item_id").agg(F.count("*").cast("double").alias("balanced"))
    return scoring.rank_changes(every.join(late, "item_id"), "pooled", "balanced")


@query("w14_role_shifts", BASE + COVERAGE + BY_ROLE + ", g AS (SELECT item_id, CAST(row_number() OVER (ORDER BY coverage DESC, item_id) AS INTEGER) AS global_rank FROM cov), r AS (SELECT role_id, item_id, CAST(row_number() OVER (PARTITION BY role_id ORDER BY n DESC, item_id) AS INTEGER) AS role_rank FROM br), s AS (SELECT role_id, item_id, global_rank, role_rank, global_rank - role_rank AS shift, row_number() OVER (PARTITION BY role_id ORDER BY global_rank - role_rank DESC, item_id) AS k FROM r JOIN g USING (item_id) WHERE role_rank <= 5 AND global_rank > role_rank) SELECT role_id, item_id, global_rank, role_rank, shift FROM s WHERE k <= 3")
def w14(t: Star) -> DataFrame:
    every = metrics.demand(t.entities, t.source_map, t.entity_items, t.items).where("entity_count > 0").select("item_id", "coverage")
    by_role = metrics.item_by_dimension(t.entities, t.pairs, "role_id").select(F.col("value").alias("role_id"), "item_id", F.col("entity_count").alias("n"))
    return scoring.role_shifts(scoring.ordinal_rank(every, "coverage", "item_id", "global_rank"), scoring.ordinal_rank(by_role, "n", "item_id", "role_rank", ["role_id"]))


@query("w15_floor_percentile", with_tables("entities") + "SELECT role_id, list_sort(list(measure))[CAST(floor(0.75 * (count(*) - 1)) AS BIGINT) + 1] AS p75 FROM entities WHERE measure IS NOT NULL GROUP BY 1")
def w15(t: Star) -> DataFrame:
    return scoring.floor_percentile(t.entities, ["role_id"], "measure", 0.75, "p75")


@query("w16_linear_percentile", with_tables("entities") + "SELECT role_id, round(quantile_cont(measure, 0.9), 6) AS p90 FROM entities GROUP BY 1")
def w16(t: Star) -> DataFrame:
    return rounded(t.entities.groupBy("role_id").agg(F.percentile("measure", 0.9).alias("p90")))
