"""Queries of item graphs (G) and of selections on relations (T7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import graph, scoring
from demandlens.plans.base import Star, query, rounded, with_tables

BASE = with_tables("entities", "entity_items", "pairs")
EDGES = """, s AS (SELECT item_id, count(*) AS support FROM pairs GROUP BY 1), n AS (SELECT count(*) AS n FROM entities), co AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n FROM pairs a JOIN pairs b ON a.entity_id = b.entity_id AND a.item_id < b.item_id GROUP BY 1, 2),
edges AS (SELECT item_a, item_b, co.n, sa.support AS support_a, sb.support AS support_b, co.n * 1e0 / (sa.support + sb.support - co.n) AS jaccard, ln(co.n * 1e0 * n.n / (sa.support * 1e0 * sb.support)) AS pmi_nat FROM co JOIN s sa ON sa.item_id = item_a JOIN s sb ON sb.item_id = item_b CROSS JOIN n),
kept AS (SELECT * FROM edges WHERE n >= 3 AND jaccard >= 0.03), sides AS (SELECT item_a AS item_id, item_b AS other, jaccard, pmi_nat FROM kept UNION ALL SELECT item_b, item_a, jaccard, pmi_nat FROM kept),
nodes AS (SELECT s.item_id, support, CAST(coalesce(degree, 0) AS BIGINT) AS degree, coalesce(wd, 0) AS weighted_degree, support * 1e0 / n.n AS coverage FROM s CROSS JOIN n LEFT JOIN (SELECT item_id, count(*) AS degree, sum(jaccard) AS wd FROM sides GROUP BY 1) d ON d.item_id = s.item_id)"""
LEAST = 0.03


def _edges(t: Star) -> DataFrame:
    return graph.edges(t.once().pairs, t.entities.count(), least_jaccard=LEAST)


@query("g1_pair_support", BASE + EDGES + " SELECT item_a, item_b, n, support_a, support_b FROM edges")
def g1(t: Star) -> DataFrame:
    return _edges(t).select("item_a", "item_b", "n", "support_a", "support_b")


@query("g2_edge_metrics", BASE + EDGES + " SELECT item_a, item_b, n, round(jaccard, 6) AS jaccard, round(pmi_nat, 6) AS pmi_nat FROM kept")
def g2(t: Star) -> DataFrame:
    return rounded(_edges(t).where("kept").select("item_a", "item_b", "n", "jaccard", "pmi_nat"))


@query("g3_node_metrics", BASE + EDGES + " SELECT item_id, support, degree, round(weighted_degree, 6) AS weighted_degree, round(coverage, 6) AS coverage FROM nodes")
def g3(t: Star) -> DataFrame:
    return rounded(graph.nodes(t.pairs, _edges(t).where("kept"), t.entities.count()))


@query("g4_communities")
def g4(t: Star) -> DataFrame:
    kept = _edges(t).where("kept")
    return graph.communities(graph.support(t.pairs), kept)


@query("g5_network_report", BASE + EDGES + " SELECT count(*) AS pairs, count(*) FILTER (WHERE n >= 3 AND jaccard >= 0.03) AS kept, count(*) FILTER (WHERE NOT (n >= 3 AND jaccard >= 0.03)) AS filtered FROM edges")
def g5(t: Star) -> DataFrame:
    return graph.build_report(_edges(t))


@query("g6_core_relations", BASE + """, cohort AS (SELECT entity_id FROM entities WHERE role_id = '1-URGENT'), cp AS (SELECT * FROM pairs WHERE entity_id IN (SELECT entity_id FROM cohort)), s AS (SELECT item_id, count(*) AS support FROM cp GROUP BY 1),
b AS (SELECT item_id, count(*) AS n FROM cp WHERE item_id <> 'red widget' AND entity_id IN (SELECT entity_id FROM cp WHERE item_id = 'red widget') GROUP BY 1), r AS (SELECT b.item_id, b.n, s.support, c.support AS core_support FROM b JOIN s ON s.item_id = b.item_id CROSS JOIN (SELECT support FROM s WHERE item_id = 'red widget') c)
SELECT item_id, n, support, core_support, round(n * 1e0 / core_support, 6) AS conditional_coverage, round(n * 1e0 / (support + core_support - n), 6) AS jaccard, round(log2(n * 1e0 * (SELECT count(*) FROM cohort) / (support * 1e0 * core_support)), 6) AS pmi_log2, 'ok' AS status FROM r WHERE n >= 3 AND n * 1e0 / (support + core_support - n) >= 0.01""")
def g6(t: Star) -> DataFrame:
    cohort = t.entities.where("role_id = '1-URGENT'").select("entity_id")
    return rounded(graph.relations(t.pairs.join(cohort, "entity_id", "left_semi"), "red widget", cohort.count()))


@query("g7_neighbours", BASE + EDGES + " SELECT CASE WHEN item_a = 'red widget' THEN item_b ELSE item_a END AS item_id, n, round(jaccard, 6) AS jaccard, round(pmi_nat, 6) AS pmi_nat FROM kept WHERE item_a = 'red widget' OR item_b = 'red widget'")
def g7(t: Star) -> DataFrame:
    return rounded(graph.neighbours(_edges(t).where("kept"), "red widget"))


SYNERGY = """, st AS (SELECT sides.item_id, sum(jaccard * support) AS j, sum(least(2e0, greatest(0e0, pmi_nat)) / 2e0 * support) AS p, sum(support) * 1e0 AS w FROM sides JOIN nodes ON nodes.item_id = other GROUP BY 1),
syn AS (SELECT nodes.item_id, 0.4e0 * degree / ((SELECT count(*) FROM nodes) - 1) + 0.2e0 * ln(1 + support) / (SELECT max(ln(1 + support)) FROM nodes) + 0.2e0 * coalesce(j / w, 0) + 0.2e0 * coalesce(p / w, 0) AS synergy FROM nodes LEFT JOIN st ON st.item_id = nodes.item_id)"""


@query("g8_synergy", BASE + EDGES + SYNERGY + " SELECT item_id, round(synergy, 6) AS synergy FROM syn")
def g8(t: Star) -> DataFrame:
    kept = _edges(t).where("kept")
    return rounded(graph.synergy(graph.nodes(t.pairs, kept, t.entities.count()), kept))


@query("t7_relation_tiers", BASE + EDGES + ", r AS (SELECT item_id AS core, other, jaccard, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(jaccard, 9) DESC, other) AS INTEGER) AS position FROM sides) SELECT core, other, round(jaccard, 6) AS jaccard, position, CASE WHEN position <= 5 THEN 'primary' ELSE 'secondary' END AS tier FROM r WHERE position <= 17")
def t7(t: Star) -> DataFrame:
    kept = _edges(t).where("kept")
    both = kept.select(F.col("item_a").alias("core"), F.col("item_b").alias("other"), "jaccard").union(kept.select(F.col("item_b").alias("core"), F.col("item_a").alias("other"), "jaccard"))
    return rounded(scoring.relation_top(both, "core", [F.round("jaccard", 9).desc(), F.col("other")]))
