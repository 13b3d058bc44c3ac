"""Queries of fit and gain (A17 to A19, C13, T11) and of the adjusted effects (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import effects, fit, scoring
from demandlens.plans.base import Star, query, rounded, with_tables

BASE = with_tables("entities", "items", "entity_items", "pairs")
OWNED = ["red widget", "small ring", "blue bolt"]
OWN = "('red widget', 'small ring', 'blue bolt')"
FITS = f""", cohort AS (SELECT entity_id FROM entities WHERE role_id = '2-HIGH'), mine AS (SELECT * FROM pairs WHERE entity_id IN (SELECT entity_id FROM cohort)),
fits AS (SELECT entity_id, count(*) AS required, count(*) FILTER (WHERE item_id IN {OWN}) AS matched, count(*) FILTER (WHERE item_id IN {OWN}) * 1e0 / count(*) AS fit FROM mine GROUP BY 1),
gains AS (SELECT item_id, count(*) AS entity_count, sum(1e0 / required) / (SELECT count(*) FROM fits) AS average_gain, count(*) FILTER (WHERE fit < 0.5 AND (matched + 1) * 1e0 / required >= 0.5) AS crossing_count FROM mine JOIN fits USING (entity_id) WHERE item_id NOT IN {OWN} GROUP BY 1)"""


def owned(t: Star) -> DataFrame:
    return t.spark.createDataFrame([(x,) for x in OWNED], "item_id string")


def cohort(t: Star) -> DataFrame:
    return t.entities.where("role_id = '2-HIGH'").select("entity_id")


@query("a17_baseline_fit", BASE + FITS + " SELECT count(*) AS sample_size, round(avg(fit), 6) AS average_fit, round(avg(CASE WHEN fit >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM fits")
def a17(t: Star) -> DataFrame:
    mine = t.pairs.join(cohort(t), "entity_id", "left_semi")
    return rounded(fit.baseline(fit.requirements(mine, owned(t)), 0.5))


@query("a18_candidate_gain", BASE + FITS + " SELECT item_id, entity_count, round(average_gain, 6) AS average_gain, crossing_count, round(crossing_count * 1e0 / (SELECT count(*) FROM fits), 6) AS threshold_gain FROM gains")
def a18(t: Star) -> DataFrame:
    mine = t.pairs.join(cohort(t), "entity_id", "left_semi")
    return rounded(fit.gains(mine, fit.requirements(mine, owned(t)), owned(t), 0.5))


@query("a19_source_gain", with_tables("entities", "source_map", "entity_items", "pairs") + FITS + ", es AS (SELECT DISTINCT entity_id, source_id FROM source_map), sf AS (SELECT source_id, fits.* FROM fits JOIN es USING (entity_id)) SELECT sf.source_id, item_id, count(*) AS entity_count, round(sum(1e0 / required) / any_value(n), 6) AS average_gain, count(*) FILTER (WHERE fit < 0.5 AND (matched + 1) * 1e0 / required >= 0.5) AS crossing_count FROM mine JOIN sf USING (entity_id) JOIN (SELECT source_id, count(*) AS n FROM sf GROUP BY 1) z ON z.source_id = sf.source_id WHERE item_id NOT IN " + OWN + " GROUP BY sf.source_id, item_id")
def a19(t: Star) -> DataFrame:
    mine = t.pairs.join(cohort(t), "entity_id", "left_semi")
    fits = fit.requirements(mine, owned(t)).join(t.source_map.select("entity_id", "source_id").distinct(), "entity_id")
    return rounded(fit.gains(mine, fits, owned(t), 0.5, ["source_id"]).drop("threshold_gain"))


@query("c13_opportunity", BASE + FITS + ", b AS (SELECT (SELECT count(*) FROM cohort) AS target_count, count(*) AS sample_size, avg(fit) AS average_fit FROM fits) SELECT item_id, target_count, sample_size, round(average_fit, 6) AS average_fit, entity_count, round(average_gain, 6) AS average_gain, crossing_count, round(round(least(60e0, 65e0, 30e0 * least(1e0, ln(1 + entity_count) / ln(501)) / 0.85e0), 2), 2) AS confidence, 'ok' AS status FROM b LEFT JOIN gains ON true")
def c13(t: Star) -> DataFrame:
    found = fit.analyse(cohort(t), t.pairs, owned(t), 0.5)
    judged = scoring.confidence(found.select(
        "*", F.lit(0.0).alias("effective_sources"), F.lit(0).alias("eligible_sources"), F.lit(None).cast("double").alias("p75_age"), F.lit(None).cast("double").alias("newest_age"), F.lit(0.0).alias("date_coverage"),
        F.lit(None).cast("long").alias("metric_count"), F.lit(None).cast("double").alias("agreement_deviation"), F.lit(False).alias("gold"),
    ).withColumnRenamed("sample_size", "cohort_size").withColumnRenamed("entity_count", "sample_size"))
    return rounded(judged.select("item_id", "target_count", F.col("cohort_size").alias("sample_size"), "average_fit", F.col("sample_size").alias("entity_count"), "average_gain", "crossing_count", "confidence", "status"))


#: One step after the other: each row has what is owned so far; gains of all items are counted anew from it.
T11_SQL = BASE + f""", cohort AS (SELECT entity_id FROM entities WHERE role_id = '2-HIGH'), lists AS (SELECT entity_id, list(item_id) AS its FROM pairs WHERE entity_id IN (SELECT entity_id FROM cohort) GROUP BY 1),
steps AS (
 SELECT 0 AS step, [{OWN[1:-1]}] AS have, 120e0 AS remaining, CAST(NULL AS VARCHAR) AS item_id, CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS DOUBLE) AS marginal
 UNION ALL
 SELECT step + 1, list_append(have, item_id), remaining - cost, item_id, cost, marginal FROM (
  SELECT step, have, remaining, g.item_id, cost_expected AS cost, round(0.6 * gain / n + 0.4 * crossing / n, 12) AS marginal FROM (
   SELECT step, have, remaining, item_id, sum(1e0 / required) AS gain, count(*) FILTER (WHERE matched * 1e0 / required < 0.5 AND (matched + 1) * 1e0 / required >= 0.5) AS crossing FROM (
    SELECT step, have, remaining, len(its) AS required, len(list_intersect(its, have)) AS matched, unnest(list_filter(its, lambda i: NOT list_contains(have, i))) AS item_id FROM steps, lists
   ) GROUP BY step, have, remaining, item_id
  ) g JOIN items USING (item_id), (SELECT count(*) AS n FROM lists) WHERE cost_expected > 0 AND cost_expected <= remaining + 1e-9
  ORDER BY round(round(0.6 * gain / n + 0.4 * crossing / n, 12) / cost_expected, 12) DESC, marginal DESC, item_id LIMIT 1
 ) WHERE marginal >= 1e-6
)
SELECT CAST(step AS INTEGER) AS step, item_id, cost, marginal, round(remaining, 6) AS remaining FROM steps WHERE step > 0"""


@query("t11_greedy_selection", T11_SQL.replace("WITH ", "WITH RECURSIVE ", 1))
def t11(t: Star) -> DataFrame:
    costs = t.items.select("item_id", F.col("cost_expected").alias("cost"))
    return fit.select_items(cohort(t), t.pairs, costs, OWNED, 120.0, 0.5).withColumn("remaining", F.round("remaining", 6))


CONTROLS = ["role_id", "experience_band", "education_band"]


@query("m1_adjusted_effects")
def m1(t: Star) -> DataFrame:
    return effects.associations(t.entities, t.pairs, t.items, CONTROLS)


@query("m2_plain_effect", BASE + ", y AS (SELECT entity_id, ln(measure) AS y FROM entities WHERE measure BETWEEN 1000 AND 300000) SELECT i.item_id, count(*) AS with_item, round(avg(y) - ((SELECT sum(y) FROM y) - sum(y)) / ((SELECT count(*) FROM y) - count(*)), 6) AS coefficient FROM items i JOIN pairs USING (item_id) JOIN y USING (entity_id) GROUP BY 1 HAVING count(*) >= 20 AND (SELECT count(*) FROM y) - count(*) >= 20 AND (SELECT count(*) FROM y) >= 100")
def m2(t: Star) -> DataFrame:
    return rounded(effects.associations(t.entities, t.pairs, t.items, []).where("status like 'estimated%'").select("item_id", "with_item", "coefficient"))


@query("m3_gates", BASE + ", y AS (SELECT entity_id FROM entities WHERE measure BETWEEN 1000 AND 300000), h AS (SELECT item_id, count(*) AS with_item FROM pairs JOIN y USING (entity_id) GROUP BY 1) SELECT i.item_id, (SELECT count(*) FROM y) AS n, CAST(coalesce(with_item, 0) AS BIGINT) AS with_item, CAST((SELECT count(*) FROM y) - coalesce(with_item, 0) AS BIGINT) AS without_item, CASE WHEN (SELECT count(*) FROM y) = 0 THEN 'unavailable' WHEN (SELECT count(*) FROM y) < 100 OR coalesce(with_item, 0) < 20 OR (SELECT count(*) FROM y) - coalesce(with_item, 0) < 20 THEN 'insufficient_sample' ELSE 'candidate' END AS status FROM items i LEFT JOIN h ON h.item_id = i.item_id")
def m3(t: Star) -> DataFrame:
    r = effects.EffectRules()
    return effects.gates(effects.model_rows(t.entities, [], r), t.pairs, t.items, r)


@query("m4_percent_scale", "SELECT c_custkey, round(100 * (exp(c_acctbal / 10000) - 1), 6) AS percent FROM customer")
def m4(t: Star) -> DataFrame:
    return rounded(t.table("customer").select("c_custkey", effects.percent(F.col("c_acctbal") / 10000).alias("percent")))


@query("m5_model_rows", with_tables("entities", "entity_items", "pairs") + "SELECT entity_id, round(ln(measure), 6) AS y, role_id, CAST(city_code AS VARCHAR) AS city_code, string_agg(item_id, '|' ORDER BY item_id) AS items FROM entities LEFT JOIN pairs USING (entity_id) WHERE measure BETWEEN 1000 AND 300000 GROUP BY ALL")
def m5(t: Star) -> DataFrame:
    rows = effects.model_rows(t.entities, ["role_id", "city_code"], effects.EffectRules())
    lists = t.pairs.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")), "|").alias("items"))
    return rounded(rows.join(lists, "entity_id", "left"))


@query("a20_ordered_lists", with_tables("entity_items", "pairs") + "SELECT entity_id, string_agg(item_id, '|' ORDER BY item_id) AS items FROM pairs GROUP BY 1")
def a20(t: Star) -> DataFrame:
    return t.pairs.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("item_id")), "|").alias("items"))


@query("m6_rank_correlation", BASE + ", c AS (SELECT item_id, CAST(row_number() OVER (ORDER BY count(*) DESC, item_id) AS INTEGER) AS r1 FROM pairs GROUP BY item_id), x AS (SELECT p_name AS item_id, CAST(row_number() OVER (ORDER BY count(*) DESC, p_name) AS INTEGER) AS r2 FROM part GROUP BY p_name), b AS (SELECT item_id, r1, r2 FROM c JOIN x USING (item_id)) SELECT item_id, r1 AS internal_rank, r2 AS external_rank, r1 - r2 AS gap, abs(r1 - r2) >= 20 AS divergent, round((SELECT corr(r1, r2) FROM b), 6) AS correlation, CASE WHEN (SELECT corr(r1, r2) FROM b) >= 0.7 THEN 'High' WHEN (SELECT corr(r1, r2) FROM b) >= 0.4 THEN 'Medium' ELSE 'Low' END AS agreement FROM b")
def m6(t: Star) -> DataFrame:
    internal = scoring.ordinal_rank(t.pairs.groupBy("item_id").agg(F.count("*").alias("n")), "n", "item_id", "rank")
    external = scoring.ordinal_rank(t.table("part").groupBy(F.col("p_name").alias("key")).agg(F.count("*").alias("n")), "n", "key", "rank").select(F.upper("key").alias("term"), "rank")
    return rounded(effects.rank_correlation(internal, external, t.items.select("item_id", F.lower("item_id").alias("term"))))
