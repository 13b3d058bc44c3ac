"""Queries that SQL cannot express, against plain versions on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from demandlens.functions.similarity import ratio
from demandlens.operators import dedup, graph
from demandlens.plans import matching, registry
from demandlens.plans.base import Star
from demandlens.plans.graphs import _edges
from tests.test_dedup import match, slow_groups
from tests.test_metrics import greedy_communities, quality_of


@pytest.fixture(scope="module")
def keyed(spark, data):
    return dedup.keyed(matching.varied(Star(spark, data))).collect()


@pytest.fixture(scope="module")
def groups(keyed):
    return slow_groups(keyed)


@pytest.mark.parametrize(("name", "level"), [("d4_fuzzy_titles", 2), ("d5_simhash_pairs", 3)])
def test_pairs_of_a_level(spark, data, keyed, name, level):
    rows, units = registry.QUERIES[name](spark, data).collect(), {}
    for r in rows:
        if r.kind == "member":
            units.setdefault(r.left_id, []).append(r.right_id)
    got = {(frozenset((a, b)), r.score) for r in rows if r.kind == "pair" for a in units[r.left_id] for b in units[r.right_id]}
    want = {(frozenset((a.record_id, b.record_id)), m[1]) for i, a in enumerate(keyed) for b in keyed[:i] if (m := match(a, b)) and m[0] == level}
    assert got == want and sorted(x for u in units.values() for x in u) == sorted(r.record_id for r in keyed)


def test_groups_provenance_and_report(spark, data, groups):
    method = ["representative", "level_1_exact", "level_2_fuzzy_title", "level_3_simhash_description"]
    found = {r.record_id: r for r in registry.QUERIES["d12_provenance"](spark, data).collect()}
    assert {i: (r.match_method, r.score) for i, r in found.items()} == {i: (method[level], score) for i, (_, level, score) in groups.items()}
    by_entity = {}
    for i, r in found.items():
        by_entity.setdefault(r.entity_id, set()).add(i)
    members = {}
    for i, (first, *_) in groups.items():
        members.setdefault(first, set()).add(i)
    assert sorted(map(sorted, by_entity.values())) == sorted(map(sorted, members.values()))
    assert {r.record_id: r.entity_id for r in registry.QUERIES["d9_complete_link_groups"](spark, data).collect()} == {i: r.entity_id for i, r in found.items()}
    report = registry.QUERIES["d13_dedup_report"](spark, data).first()
    assert (report.records, report.entities, report.removed) == (len(groups), len(members), len(groups) - len(members))
    assert report.duplicate_groups == sum(len(m) > 1 for m in members.values())


def test_near_titles_of_items(spark, data):
    items = Star(spark, data).items.select("item_id", "category").collect()
    want = {(a.item_id, b.item_id, round(ratio(a.item_id, b.item_id), 6)) for a in items for b in items if a.category == b.category and a.item_id < b.item_id and ratio(a.item_id, b.item_id) >= 60}
    assert {(r.left_title, r.right_title, r.ratio) for r in registry.QUERIES["d6_indel_ratio"](spark, data).collect()} == want and want


def test_communities_of_items(spark, data):
    rows = registry.QUERIES["g4_communities"](spark, data).collect()
    edges = {(r.item_a, r.item_b): r.jaccard for r in _edges(Star(spark, data)).where("kept").select("item_a", "item_b", "jaccard").collect()}
    names = sorted(r.item_id for r in graph.support(Star(spark, data).pairs).collect())
    found = {r.item_id: r.community for r in rows}
    assert sorted(found) == names and quality_of(found, edges) >= quality_of(greedy_communities(names, edges), edges) - 0.01
    assert all(r.size == sum(c == r.community for c in found.values()) for r in rows)


def test_sketched_counts_of_items(spark, data):
    got = {(r.window, r.item_id): r for r in registry.QUERIES["a33_sketched_counts"](spark, data).collect()}
    exact = registry.QUERIES["a33_scope_counts"](spark, data).select("window", "item_id", "entity_count", "company_count", "record_count").collect()
    assert len(got) == len(exact)
    for r in exact:
        assert all(abs(got[r.window, r.item_id][c] - r[c]) <= max(1, 0.02 * r[c]) for c in ("entity_count", "company_count", "record_count"))


def test_prints_differ_where_texts_do(spark, data):
    rows = registry.QUERIES["d7_simhash"](spark, data).join(spark.read.parquet(f"{data}/part.parquet"), "p_partkey").groupBy("p_name").agg(F.countDistinct("print").alias("n"), F.first("print").alias("print")).collect()
    assert all(r.n == 1 for r in rows) and len({r.print for r in rows}) > 0.9 * len(rows)
