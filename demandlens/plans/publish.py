"""Queries that put the results of other operators together: the published snapshot (A35) and the profile of an item (A37)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators import effects, graph, holdings, metrics, trend
from demandlens.plans import models, trends  # noqa: F401  (whose SQL is used here)
from demandlens.plans.base import ORACLES, SQL_TABLES, Star, query, rounded, with_tables
from demandlens.plans.graphs import LEAST
from demandlens.plans.metrics import AS_OF, JUDGED, WINDOWS, judged
from demandlens.plans.scoring import ranked_scopes
from demandlens.sources import contracts
from demandlens.sources.shared import fresh_path, written


def long(df: DataFrame, kind: str, scope: Column, key: Column, values: list[str]) -> DataFrame:
    """(kind, scope, key, metric, value): one row for each value of each row; values that are null are left out."""
    each = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(F.lit(kind).alias("kind"), scope.alias("scope"), key.alias("key"), F.explode(each).alias("x")).select("kind", "scope", "key", "x.*").where("value is not null")


def _long_sql(source: str, kind: str, scope: str, key: str, values: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, {scope} AS scope, {key} AS key, '{v}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM {source} q WHERE {v} IS NOT NULL" for v in values)


SCOPED_SQL = """(SELECT coalesce(role_id, 'global') AS scope, item_id, count(*) AS entity_count, count(*) * 1e0 / any_value(n) AS coverage, median(measure) AS median
 FROM (SELECT item_id, measure, unnest([NULL, role_id]) AS role_id FROM pairs JOIN entities USING (entity_id)) p JOIN (SELECT unnest([NULL, role_id]) AS r, count(*) AS n FROM entities GROUP BY 1) s ON r IS NOT DISTINCT FROM role_id GROUP BY 1, 2)"""
BALANCED_SQL = (
    "(" + with_tables("entities", "source_map", "items", "entity_items") + JUDGED
    + """, rec AS (SELECT DISTINCT source_id, record_id, unnest(['global', role_id]) AS scope FROM source_map JOIN entities USING (entity_id) WHERE source_id IN (SELECT source_id FROM judged WHERE eligible)),
 tot AS (SELECT scope, source_id, count(*) AS n FROM rec GROUP BY 1, 2), cnt AS (SELECT scope, source_id, item_id, count(DISTINCT record_id) AS k FROM entity_items JOIN rec USING (record_id) GROUP BY 1, 2, 3)
 SELECT t.scope, i.item_id, CAST(count(*) AS DOUBLE) AS eligible_sources, CASE WHEN count(*) >= 2 THEN avg(coalesce(k, 0) * 1e0 / t.n) END AS balanced_coverage FROM items i CROSS JOIN tot t LEFT JOIN cnt ON cnt.scope = t.scope AND cnt.source_id = t.source_id AND cnt.item_id = i.item_id GROUP BY 1, 2)"""
)
ITEM_VALUES, BALANCED_VALUES, RANK_VALUES, TREND_VALUES, RELATION_VALUES = ["entity_count", "coverage", "median"], ["eligible_sources", "balanced_coverage"], ["n", "class_rank", "demand_rank"], ["latest", "change_3m", "change_6m", "slope", "volatility"], ["n", "jaccard", "pmi_nat"]
ROLES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _by_role(sql: str) -> str:
    """A query of the logical tables over all entities and over those of each role, with the role as scope."""

    def of(role: str) -> str:
        some = sql.replace(SQL_TABLES["entities"], "every_" + SQL_TABLES["entities"] + f", entities AS (SELECT * FROM every_entities WHERE role_id = '{role}')")
        return some.replace(SQL_TABLES["pairs"], "every_" + SQL_TABLES["pairs"] + ", pairs AS (SELECT * FROM every_pairs WHERE entity_id IN (SELECT entity_id FROM entities))")

    return "(" + " UNION ALL ".join(f"SELECT '{scope}' AS scope, * FROM ({text}) q" for scope, text in [("global", sql), *((r, of(r)) for r in ROLES)]) + ")"


@query(
    "a35_publish_all",
    with_tables("entities", "entity_items", "pairs")
    + " UNION ALL ".join([
        _long_sql(SCOPED_SQL, "item", "scope", "item_id", ITEM_VALUES), _long_sql(BALANCED_SQL, "balanced", "scope", "item_id", BALANCED_VALUES), _long_sql(f"({ORACLES['c10_scope_ranks']})", "ranking", "\"window\" || '|' || role", "item_id", RANK_VALUES),
        _long_sql(_by_role(ORACLES["w10_trend_records"]), "trend", "scope", "item_id", TREND_VALUES), _long_sql(_by_role(ORACLES["g2_edge_metrics"]), "relation", "scope", "item_a || '|' || item_b", RELATION_VALUES),
    ]),
)
def a35(t: Star) -> DataFrame:
    """Every metric for all entities and for each role, every ranking scope and every relation, published by scope and read back."""
    t = t.counted()
    entities = written(t.entities.select("entity_id", "role_id", "event_date", "measure"), "entities")
    held = holdings.holdings(t.cells, entities, t.sent)
    month, windows = F.trunc("event_date", "MM").alias("month"), metrics.windows_of(AS_OF, WINDOWS).alias("windows")
    sizes = written(entities.groupBy("role_id", month).agg(F.count("*").alias("n")), "sizes")
    numbered = written(holdings.pairs(held).groupBy("role_id", month, windows, "item_id").agg(F.count("*").alias("n")), "cube")
    cube = t.named(numbered, "item_id")
    total, by_scope = holdings.by_scope(sizes), holdings.by_scope
    found = holdings.pairs(held).withColumn("scope", F.explode(F.array(F.lit("global"), F.col("role_id")))).where("scope is not null").select("scope", "item_id", "measure")
    counts = by_scope(numbered, "item_id").withColumnRenamed("n", "entity_count").join(total, "scope").withColumn("coverage", metrics.share(F.col("entity_count"), F.col("n")))
    items = t.named(metrics.with_percentiles(counts, found, ["scope", "item_id"], "measure", {"median": 0.5}, t.sent), "item_id")
    sources = judged(t, written(t.named(holdings.evidence(held), "source_id"), "source_evidence")).where("eligible").select("source_id")
    records = written(t.named(holdings.records(held), "source_id", "item_id"), "records").join(F.broadcast(sources), "source_id", "left_semi")  # as many as have a role that counts
    first, listed = records.where(holdings.has(holdings.FIRST)), records.where(holdings.has(holdings.LISTED))
    balanced = metrics.mean_of_sources(by_scope(first, "source_id").withColumnRenamed("n", "sample_size"), by_scope(listed, "source_id", "item_id").withColumnRenamed("n", "record_count"), t.items)
    placed = cube.select("role_id", F.explode("windows").alias("window"), "item_id", "n").withColumn("each", F.explode(F.array(F.lit(True), F.lit(False)))).groupBy("window", F.when(F.col("each"), F.col("role_id")).otherwise("all").alias("role"), "item_id").agg(F.sum("n").alias("n"))
    months, monthly = by_scope(sizes.where("month is not null"), "month").withColumnRenamed("n", "sample_size"), by_scope(cube.where("month is not null"), "item_id", "month").withColumnRenamed("n", "entity_count")
    courses = trend.courses(trend.dense_series(months, monthly, t.items, ("scope",)), total.withColumnRenamed("n", "all_entities"), t.items, by=("scope",))
    none = t.items_of_none.select(F.array().cast("array<string>").alias("roles"), "item_id", F.lit(1).cast("long").alias("n"))
    support = by_scope(written(t.named(holdings.supports(held), "item_id").unionByName(none), "support"), "item_id")
    edges = graph.scored(by_scope(written(t.named(holdings.co_counts(held), "item_a", "item_b"), "co_counts"), "item_a", "item_b"), support, total, least_jaccard=LEAST).where("kept")
    scope, item = F.col("scope"), F.col("item_id")
    parts = [
        long(items, "item", scope, item, ITEM_VALUES), long(balanced, "balanced", scope, item, BALANCED_VALUES), long(ranked_scopes(placed, t.items), "ranking", F.concat_ws("|", "window", "role"), item, RANK_VALUES),
        long(courses, "trend", scope, item, TREND_VALUES), long(edges, "relation", scope, F.concat_ws("|", "item_a", "item_b"), RELATION_VALUES),
    ]
    root = fresh_path(t.spark, "published")
    contracts.replace(rounded(reduce(DataFrame.unionByName, parts)), root, by=("scope",))
    return contracts.current(t.spark, root)


@query(
    "a37_item_profile",
    with_tables("entities", "items", "entity_items", "pairs")
    + f""", d AS (SELECT i.item_id, i.category, count(*) AS entity_count, round(count(*) * 1e0 / (SELECT count(*) FROM entities), 6) AS coverage, round(quantile_cont(measure, 0.5), 6) AS median, round(quantile_cont(measure, 0.25), 6) AS p25, round(quantile_cont(measure, 0.75), 6) AS p75
 FROM items i JOIN pairs USING (item_id) JOIN entities USING (entity_id) WHERE item_id = 'red widget' GROUP BY 1, 2)
SELECT d.*, e.with_item, e.coefficient, w.slope, w.change_3m, w.trend FROM d LEFT JOIN ({ORACLES['m2_plain_effect']}) e ON e.item_id = d.item_id LEFT JOIN ({ORACLES['w10_trend_records']}) w ON w.item_id = d.item_id""",
)
def a37(t: Star) -> DataFrame:
    t = t.once()
    one = t.items.where("item_id = 'red widget'")
    demand = metrics.demand(t.entities, t.source_map, t.entity_items, one).select("item_id", "category", "entity_count", "coverage")
    measure = metrics.measure_by_item(t.entities, t.pairs, one).select("item_id", "median", "p25", "p75")
    effect = effects.associations(t.entities, t.pairs, one, []).where("status like 'estimated%'").select("item_id", "with_item", "coefficient")
    course = trend.trends(t.entities, t.pairs, one).select("item_id", "slope", "change_3m", "trend")
    return rounded(demand.join(measure, "item_id", "left").join(effect, "item_id", "left").join(course, "item_id", "left"))
