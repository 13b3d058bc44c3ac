"""Queries of confidence, scores, sensitivity, robustness and selection (C, T5, T6, T12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import graph, metrics, scoring
from demandlens.plans.base import Star, query, rounded, with_tables
from demandlens.plans.graphs import EDGES, LEAST, SYNERGY
from demandlens.plans.metrics import AS_OF, SCOPED, WINDOWS, role_counts
from demandlens.sources.shared import written

BASE = with_tables("entities", "items", "entity_items", "pairs")
#: One row per item with the evidence that scores need.
EVIDENCE = (
    EDGES
    + SYNERGY
    + f""", rc AS (SELECT item_id, role_id, count(*) AS n FROM pairs JOIN entities USING (entity_id) GROUP BY 1, 2), rk AS (SELECT *, sum(n) OVER (PARTITION BY item_id) AS total FROM rc WHERE n >= 3),
br AS (SELECT item_id, count(*) AS roles, least(1e0, 1e0 / sum(power(n * 1e0 / total, 2)) / 5) * least(1e0, any_value(total) / 30e0) AS breadth FROM rk GROUP BY 1),
ev0 AS (SELECT item_id, count(*) AS sample_size, count(DISTINCT company_id) AS company_count, quantile_cont(greatest(date_diff('day', event_date, DATE '{AS_OF}'), 0), 0.75) AS p75_age FROM pairs JOIN entities USING (entity_id) GROUP BY 1),
cf AS (SELECT *, least(60e0, 65e0, CASE WHEN sample_size < 10 THEN 40e0 ELSE 100e0 END, (30 * least(1e0, ln(1 + sample_size) / ln(501)) + 20 * greatest(0e0, least(1e0, (180 - p75_age) / 150))) / 0.85e0) AS conf FROM ev0),
ev AS (SELECT i.item_id, category, eligibility, cost_min, cost_expected, cost_max, sample_size, company_count, coalesce(roles, 0) AS roles, sample_size * 1e0 / (SELECT count(*) FROM entities) AS demand, company_count * 1e0 / (SELECT count(DISTINCT company_id) FROM entities) AS company, coalesce(breadth, 0) AS role, synergy, round(conf, 2) AS confidence
 FROM items i JOIN cf ON cf.item_id = i.item_id LEFT JOIN br ON br.item_id = i.item_id JOIN syn ON syn.item_id = i.item_id)"""
)
SENSITIVE = ", sc AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}e0' for x in w)}, {h}e0)" for k, (w, h) in scoring.SCENARIOS.items()) + ") s(scenario, wd, wc, wr, ws, wt, half)), rank_s AS (SELECT item_id, scenario, row_number() OVER (PARTITION BY scenario ORDER BY round((100 * (wd * demand + wc * company + wr * role + ws * synergy) + wt * confidence) * half / (half + cost_expected), 9) DESC, item_id) AS place FROM ev CROSS JOIN sc), sens AS (SELECT item_id, CAST(min(place) AS INTEGER) AS best_rank, CAST(max(place) AS INTEGER) AS worst_rank, CAST(max(CASE WHEN scenario = 'baseline' THEN place END) AS INTEGER) AS baseline_rank FROM rank_s GROUP BY 1)"
ROBUST = ", rb AS (SELECT ev.*, best_rank, worst_rank, baseline_rank, worst_rank - best_rank AS width, 100 * (0.30e0 * greatest(0e0, 1 - (worst_rank - best_rank) / 30e0) + 0.20e0 * least(1e0, sample_size / 30e0) + 0.15e0 * least(1e0, company_count / 20e0) + 0.10e0 * least(1e0, roles / 4e0) + 0.15e0 * confidence / 100 + 0.10e0 * greatest(0e0, 1 - (cost_max - cost_min) / cost_expected / 2)) AS robustness, 100 * (0.3e0 * demand + 0.2e0 * company + 0.2e0 * role + 0.15e0 * synergy) + 0.15e0 * confidence AS signal FROM ev JOIN sens USING (item_id)), lv AS (SELECT *, CASE WHEN robustness >= 70 THEN 'robust' WHEN robustness >= 50 THEN 'moderate' ELSE 'sensitive' END AS level FROM rb)"


def evidence(t: Star) -> DataFrame:
    """Demand, breadth, synergy, confidence and cost of every item that an entity has."""
    t = t.once()
    n = t.entities.count()
    companies = t.entities.agg(F.countDistinct("company_id").alias("companies"))
    kept = graph.edges(t.pairs, n, least_jaccard=LEAST).where("kept")
    synergy = graph.synergy(graph.nodes(t.pairs, kept, n), kept)
    age = F.greatest(F.datediff(F.lit(AS_OF).cast("date"), "event_date"), F.lit(0))
    base = t.pairs.join(t.entities, "entity_id").groupBy("item_id").agg(F.count("*").alias("sample_size"), F.countDistinct("company_id").alias("company_count"))
    base = metrics.with_percentiles(base, t.pairs.join(t.entities.where("event_date is not null"), "entity_id"), ["item_id"], age, {"p75_age": 0.75})
    counts = role_counts(t)
    roles = counts.where("n >= 3").groupBy("item_id").agg(F.count("*").alias("roles"))
    wide = metrics.breadth(counts, 5).select("item_id", F.col("breadth").alias("role"))
    judged = scoring.confidence(base.select(
        "*", F.lit(0.0).alias("effective_sources"), F.lit(0).alias("eligible_sources"), F.lit(None).cast("double").alias("newest_age"), F.lit(1.0).alias("date_coverage"), F.lit(None).cast("long").alias("metric_count"),
        F.lit(None).cast("double").alias("agreement_deviation"), F.lit(False).alias("gold"),
    ))
    joined = t.items.join(judged, "item_id").join(roles, "item_id", "left").join(wide, "item_id", "left").join(synergy, "item_id").fillna({"roles": 0, "role": 0.0}).crossJoin(F.broadcast(companies))  # one row
    return joined.withColumn("demand", F.col("sample_size") / F.lit(float(n))).withColumn("company", F.col("company_count") / F.col("companies").cast("double"))


def ranked(t: Star) -> DataFrame:
    """evidence with sensitivity, signal, robustness and level."""
    ev = written(evidence(t), "evidence")
    out = ev.join(scoring.sensitivity(ev), "item_id")
    out = out.withColumn("signal", scoring.market_signal(F.col("demand"), F.col("company"), F.col("role"), F.col("synergy"), F.col("confidence")))
    out = out.withColumn("robustness", scoring.robustness(F.col("rank_range"), F.col("sample_size"), F.col("company_count"), F.col("roles"), F.col("confidence"), F.col("cost_min"), F.col("cost_expected"), F.col("cost_max")))
    return out.withColumn("level", scoring.robustness_level(F.col("robustness")))


@query("c1_confidence_parts", BASE + EVIDENCE + " SELECT item_id, round(100 * least(1e0, ln(1 + sample_size) / ln(501)), 6) AS sample_score, round(100 * greatest(0e0, least(1e0, (180 - p75_age) / 150)), 6) AS freshness_score FROM cf")
def c1(t: Star) -> DataFrame:
    return rounded(evidence(t).select("item_id", "sample_score", "freshness_score"))


@query("c2_confidence", BASE + EVIDENCE + " SELECT item_id, confidence, CASE WHEN confidence >= 75 THEN 'High' WHEN confidence >= 50 THEN 'Medium' ELSE 'Low' END AS level, 'no_gold,few_sources' || CASE WHEN sample_size < 10 THEN ',small_sample' ELSE '' END AS warnings FROM ev")
def c2(t: Star) -> DataFrame:
    return evidence(t).select("item_id", "confidence", "level", F.array_join("warnings", ",").alias("warnings"))


@query("c3_market_value", BASE + EVIDENCE + " SELECT item_id, round((25e0 * demand + 0.15e0 * 100 * least(1e0, synergy) + 0.2e0 * confidence) / 0.6e0, 6) AS value FROM ev")
def c3(t: Star) -> DataFrame:
    none = F.lit(None).cast("double")
    return rounded(evidence(t).select("item_id", scoring.market_value(F.col("demand"), none, none, F.col("synergy"), F.col("confidence")).alias("value")))


@query("c4_personal_roi", BASE + EVIDENCE + " SELECT item_id, round(45e0 * company + 0.15e0 * 100 * 160 / (160 + cost_expected) + 0.15e0 * confidence + 0.25e0 * (25e0 * demand + 15e0 * least(1e0, synergy) + 0.2e0 * confidence) / 0.6e0, 6) AS roi FROM ev")
def c4(t: Star) -> DataFrame:
    none = F.lit(None).cast("double")
    value = scoring.market_value(F.col("demand"), none, none, F.col("synergy"), F.col("confidence"))
    return rounded(evidence(t).select("item_id", scoring.personal_roi(F.col("company"), value, F.col("cost_expected"), F.col("confidence")).alias("roi")))


@query("c5_market_signal", BASE + EVIDENCE + SENSITIVE + ROBUST + " SELECT item_id, round(signal, 6) AS signal, round(signal * 160 / (160 + cost_expected), 6) AS score FROM rb")
def c5(t: Star) -> DataFrame:
    ev = evidence(t).withColumn("signal", scoring.market_signal(F.col("demand"), F.col("company"), F.col("role"), F.col("synergy"), F.col("confidence")))
    return rounded(ev.select("item_id", "signal", (F.col("signal") * scoring.cost_decay(F.col("cost_expected"))).alias("score")))


@query("c6_sensitivity", BASE + EVIDENCE + SENSITIVE + " SELECT item_id, best_rank, worst_rank, baseline_rank, worst_rank - best_rank AS rank_range, round(1 - (worst_rank - best_rank) * 1e0 / ((SELECT count(*) FROM sens) - 1), 6) AS stability, worst_rank - best_rank >= 5 AS sensitive FROM sens")
def c6(t: Star) -> DataFrame:
    return rounded(scoring.sensitivity(evidence(t)))


@query("c7_robustness", BASE + EVIDENCE + SENSITIVE + ROBUST + " SELECT item_id, round(robustness, 6) AS robustness, level FROM lv")
def c7(t: Star) -> DataFrame:
    return rounded(ranked(t).select("item_id", "robustness", "level"))


@query("c8_candidates", BASE + EVIDENCE + SENSITIVE + ROBUST + " SELECT item_id, eligibility = 'main' AND sample_size >= 10 AND company_count >= 8 AND confidence >= 30 AND level <> 'sensitive' AS candidate FROM lv")
def c8(t: Star) -> DataFrame:
    return ranked(t).select("item_id", scoring.is_candidate(F.col("eligibility"), F.col("sample_size"), F.col("company_count"), F.col("confidence"), F.col("level")).alias("candidate"))


@query("c9_summary", BASE + EVIDENCE + SENSITIVE + ROBUST + " SELECT item_id, category, eligibility, sample_size, company_count, round(demand, 6) AS demand, round(role, 6) AS role, round(synergy, 6) AS synergy, confidence, round(signal, 6) AS signal, baseline_rank, level FROM lv")
def c9(t: Star) -> DataFrame:
    return rounded(ranked(t).select("item_id", "category", "eligibility", "sample_size", "company_count", "demand", "role", "synergy", "confidence", "signal", "baseline_rank", "level"))


@query("c10_scope_ranks", BASE + SCOPED + """, c AS (SELECT "window", coalesce(role_id, 'all') AS role, item_id, count(*) AS n FROM w JOIN pairs USING (entity_id) GROUP BY GROUPING SETS (("window", item_id), ("window", role_id, item_id))) SELECT "window", role, item_id, eligibility, n, CAST(row_number() OVER (PARTITION BY "window", role, eligibility ORDER BY n DESC, item_id) AS INTEGER) AS class_rank, CASE WHEN eligibility = 'main' THEN CAST(row_number() OVER (PARTITION BY "window", role, eligibility ORDER BY n DESC, item_id) AS INTEGER) END AS demand_rank FROM c JOIN items USING (item_id)""")
def c10(t: Star) -> DataFrame:
    return scope_ranks(t)


def scope_ranks(t: Star) -> DataFrame:
    """Places of items by demand within each window, role (all for every one) and class of items."""
    cube = metrics.scope_cube(t.entities, t.pairs, AS_OF, WINDOWS)
    return ranked_scopes(cube.select("window", F.when(F.col("every_role") == 1, "all").otherwise(F.col("role_id")).alias("role"), "item_id", F.col("entity_count").alias("n")), t.items)


def ranked_scopes(counts: DataFrame, items: DataFrame) -> DataFrame:
    """What scope_ranks gives, from (window, role, item_id, n)."""
    scoped = counts.join(items.select("item_id", "eligibility"), "item_id").select("window", "role", "item_id", "eligibility", "n")
    out = scoring.ordinal_rank(scoped, "n", "item_id", "class_rank", ["window", "role", "eligibility"])
    return out.withColumn("demand_rank", F.when(F.col("eligibility") == "main", F.col("class_rank")))


@query("c11_scope_confidence", with_tables("entities", "source_map") + f", sc AS (SELECT role_id, source_id, count(DISTINCT record_id) AS n FROM entities JOIN source_map USING (entity_id) GROUP BY 1, 2), e AS (SELECT role_id, power(sum(n), 2) * 1e0 / sum(n * n) AS eff FROM sc GROUP BY 1), a AS (SELECT role_id, count(*) AS sample_size, quantile_cont(greatest(date_diff('day', event_date, DATE '{AS_OF}'), 0), 0.75) AS p75 FROM entities GROUP BY 1) SELECT role_id, sample_size, round(eff, 6) AS effective_sources, round(least(60e0, 65e0, (30 * least(1e0, ln(1 + sample_size) / ln(501)) + 20 * least(1e0, eff / 4) + 20 * greatest(0e0, least(1e0, (180 - p75) / 150))) / 0.85e0), 2) AS confidence FROM a JOIN e USING (role_id)")
def c11(t: Star) -> DataFrame:
    records = t.entities.join(t.source_map, "entity_id").groupBy("role_id", "source_id").agg(F.countDistinct("record_id").alias("n"))
    effective = metrics.effective_count(records, ["role_id"]).withColumnRenamed("effective", "effective_sources")
    aged = metrics.freshness(t.entities, AS_OF, "event_date", ["role_id"]).join(t.entities.groupBy("role_id").agg(F.count("*").alias("sample_size")), "role_id").join(effective, "role_id")
    judged = scoring.confidence(aged.select("role_id", "sample_size", "effective_sources", "p75_age", "date_coverage", F.lit(0).alias("eligible_sources"), F.lit(None).cast("double").alias("newest_age"), F.lit(None).cast("long").alias("metric_count"), F.lit(None).cast("double").alias("agreement_deviation"), F.lit(False).alias("gold")))
    return rounded(judged.select("role_id", "sample_size", "effective_sources", "confidence"))


@query("c12_quadrants", BASE + EVIDENCE + SENSITIVE + ROBUST + ", q AS (SELECT quantile_cont(signal, 0.75) AS hs, quantile_cont(cost_expected, 0.75) AS hc, quantile_cont(cost_expected, 0.25) AS lc, quantile_cont(signal, 0.5) AS ms FROM rb) SELECT item_id, CASE WHEN signal >= hs AND cost_expected >= hc THEN 'high_value_high_cost' WHEN cost_expected <= lc AND signal <= ms THEN 'low_cost_average' ELSE 'other' END AS quadrant FROM rb, q")
def c12(t: Star) -> DataFrame:
    ev = evidence(t).withColumn("signal", scoring.market_signal(F.col("demand"), F.col("company"), F.col("role"), F.col("synergy"), F.col("confidence"))).select("item_id", "signal", "cost_expected")
    ev = written(ev, "evidence")
    limits = ev.agg(F.percentile("signal", 0.75).alias("hs"), F.percentile("cost_expected", 0.75).alias("hc"), F.percentile("cost_expected", 0.25).alias("lc"), F.percentile("signal", 0.5).alias("ms"))
    quadrant = F.when((F.col("signal") >= F.col("hs")) & (F.col("cost_expected") >= F.col("hc")), "high_value_high_cost").when((F.col("cost_expected") <= F.col("lc")) & (F.col("signal") <= F.col("ms")), "low_cost_average").otherwise("other")
    return ev.crossJoin(F.broadcast(limits)).select("item_id", quadrant.alias("quadrant"))  # one row


@query("c14_evidence_status", with_tables("entities") + "SELECT company_id, count(*) AS n, CASE WHEN count(*) <= 3 THEN 'insufficient' WHEN count(*) < 10 THEN 'small' ELSE 'normal' END AS status FROM entities GROUP BY 1")
def c14(t: Star) -> DataFrame:
    return t.entities.groupBy("company_id").agg(F.count("*").alias("n")).withColumn("status", scoring.evidence_status(F.col("n")))


@query("t5_pareto", "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE (b.p_size < a.p_size AND b.p_retailprice >= a.p_retailprice) OR (b.p_size = a.p_size AND b.p_retailprice > a.p_retailprice))")
def t5(t: Star) -> DataFrame:
    return scoring.pareto(t.table("part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("t6_tiered_selection", BASE + EVIDENCE + SENSITIVE + ROBUST + ", k AS (SELECT item_id, level, baseline_rank, row_number() OVER (PARTITION BY level ORDER BY baseline_rank) AS k, row_number() OVER (ORDER BY baseline_rank) AS a, count(*) FILTER (WHERE level = 'robust') OVER () AS robust FROM lv) SELECT item_id, level, baseline_rank FROM k WHERE (level IN ('robust', 'moderate') AND k <= 12) OR (robust = 0 AND a <= 12)")
def t6(t: Star) -> DataFrame:
    return scoring.tiered(ranked(t).select("item_id", "level", "baseline_rank"), "level", "baseline_rank")


@query("t12_named_findings", BASE + ", g AS (SELECT item_id, count(*) AS n FROM pairs GROUP BY 1), r AS (SELECT item_id, count(*) AS n FROM pairs JOIN entities USING (entity_id) WHERE role_id = '1-URGENT' GROUP BY 1) SELECT 'global' AS frame, item_id, CAST(n AS DOUBLE) AS value FROM g WHERE item_id = 'red widget' UNION ALL SELECT 'role', item_id, CAST(n AS DOUBLE) FROM r WHERE item_id = 'small ring'")
def t12(t: Star) -> DataFrame:
    every = t.pairs.groupBy("item_id").agg(F.count("*").alias("value"))
    urgent = t.pairs.join(t.entities.where("role_id = '1-URGENT'"), "entity_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("value"))
    keys = t.spark.createDataFrame([("global", "red widget"), ("role", "small ring")], "frame string, item_id string")
    return scoring.named_findings({"global": every, "role": urgent}, keys)
