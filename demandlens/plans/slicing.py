"""Queries of slices, filters, joins and set operations (F, J, X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import graph, metrics, slices
from demandlens.plans.base import Star, query, rounded, with_tables

MAIN = slices.Slice(equal={"role_id": "1-URGENT"}, date_from="1996-01-01", date_to="1999-12-31", sources=("ASIA", "EUROPE"))
#: MAIN's entities in SQL.
SLICED = """sliced AS (SELECT * FROM entities e WHERE role_id = '1-URGENT' AND event_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
 AND EXISTS (SELECT 1 FROM source_map m WHERE m.entity_id = e.entity_id AND m.source_id IN ('ASIA', 'EUROPE')))"""


@query("f1_conjunctive_slice", with_tables("entities") + "SELECT entity_id, role_id, experience_band, event_date FROM entities WHERE role_id = '2-HIGH' AND experience_band = 'F' AND city_code = 3 AND education_band = 'BUILDING' AND event_date BETWEEN DATE '1995-01-01' AND DATE '2000-06-30'")
def f1(t: Star) -> DataFrame:
    s = slices.Slice(equal={"role_id": "2-HIGH", "experience_band": "F", "city_code": 3, "education_band": "BUILDING"}, date_from="1995-01-01", date_to="2000-06-30")
    return slices.select(t.entities, t.source_map, s).select("entity_id", "role_id", "experience_band", "event_date")


@query("f2_source_membership", with_tables("entities", "source_map") + f", {SLICED} SELECT entity_id, city_code, measure FROM sliced")
def f2(t: Star) -> DataFrame:
    return slices.select(t.entities, t.source_map, MAIN).select("entity_id", "city_code", "measure")


@query("f3_source_evidence", with_tables("source_map") + "SELECT source_id, count(*) AS records, count(DISTINCT entity_id) AS entities FROM source_map WHERE source_id IN ('ASIA', 'EUROPE') GROUP BY source_id")
def f3(t: Star) -> DataFrame:
    return slices.of_sources(t.source_map, MAIN).groupBy("source_id").agg(F.count("*").alias("records"), F.countDistinct("entity_id").alias("entities"))


@query("f4_core_sources", with_tables("source_map") + "SELECT DISTINCT source_id FROM source_map WHERE source_id IN ('ASIA', 'EUROPE', 'ATLANTIS')")
def f4(t: Star) -> DataFrame:
    return slices.present_sources(t.source_map, ["ASIA", "EUROPE", "ATLANTIS"])


@query("f5_optional_scope", with_tables("entities") + "SELECT count(*) AS n, 'present' AS \"column\" FROM entities WHERE education_band = 'BUILDING' UNION ALL SELECT count(*), 'absent' FROM entities")
def f5(t: Star) -> DataFrame:
    scoped = slices.Slice(scope="BUILDING", scope_col="education_band")
    absent = slices.Slice(scope="BUILDING", scope_col="no_such_column")
    return slices.select(t.entities, t.source_map, scoped).agg(F.count("*").alias("n")).withColumn("column", F.lit("present")).union(slices.select(t.entities, t.source_map, absent).agg(F.count("*").alias("n")).withColumn("column", F.lit("absent")))


@query("f6_slice_metadata", with_tables("entities", "source_map") + f", {SLICED} SELECT (SELECT count(*) FROM sliced) AS sample_size, (SELECT count(DISTINCT source_id) FROM source_map WHERE entity_id IN (SELECT entity_id FROM sliced) AND source_id IN ('ASIA', 'EUROPE')) AS source_count, (SELECT min(event_date) FROM sliced) AS date_from, (SELECT max(event_date) FROM sliced) AS date_to")
def f6(t: Star) -> DataFrame:
    return slices.metadata(slices.select(t.entities, t.source_map, MAIN), slices.of_sources(t.source_map, MAIN))


@query("f7_cohort", with_tables("entities", "source_map") + "SELECT entity_id FROM entities e WHERE role_id = '3-MEDIUM' AND city_code = 5 AND EXISTS (SELECT 1 FROM source_map m WHERE m.entity_id = e.entity_id AND source_id IN ('AFRICA', 'AMERICA'))")
def f7(t: Star) -> DataFrame:
    return slices.select(t.entities, t.source_map, slices.Slice(equal={"role_id": "3-MEDIUM", "city_code": 5}, sources=("AFRICA", "AMERICA"))).select("entity_id")


@query("f8_recency_closed", with_tables("entities") + "SELECT entity_id, event_date FROM entities WHERE event_date BETWEEN DATE '1998-06-30' - 180 AND DATE '1998-06-30'")
def f8(t: Star) -> DataFrame:
    return slices.recent_closed(t.entities, "1998-06-30", 180).select("entity_id", "event_date")


@query("f9_recency_open", with_tables("entities") + "SELECT role_id, count(*) AS n FROM entities WHERE event_date >= DATE '1998-06-30' - 180 GROUP BY role_id")
def f9(t: Star) -> DataFrame:
    return slices.recent_open(t.entities, "1998-06-30", 180).groupBy("role_id").agg(F.count("*").alias("n"))


@query("f10_result_filter", with_tables("items") + "SELECT item_id, category, eligibility, cost_expected FROM items WHERE eligibility = 'main' ORDER BY cost_expected NULLS LAST, item_id LIMIT 10")
def f10(t: Star) -> DataFrame:
    return t.items.filter("eligibility = 'main'").orderBy(F.asc_nulls_last("cost_expected"), "item_id").limit(10).select("item_id", "category", "eligibility", "cost_expected")


@query("f11_measure_range", with_tables("entities") + "SELECT entity_id, measure FROM entities WHERE measure BETWEEN 1000 AND 300000")
def f11(t: Star) -> DataFrame:
    return t.entities.filter(F.col("measure").between(1000, 300000)).select("entity_id", "measure")


@query("f12_bad_numbers", "SELECT CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad, count(*) AS n FROM customer")
def f12(t: Star) -> DataFrame:
    return t.table("customer").agg(F.count_if(slices.bad_number(F.col("c_acctbal"))).alias("bad"), F.count("*").alias("n"))


@query("f13_theme_membership", with_tables("items") + ", l AS (SELECT item_id, category || '; ' || eligibility AS label FROM items) SELECT item_id, label FROM l WHERE list_contains(list_transform(string_split(label, ';'), lambda x: trim(x)), 'main')")
def f13(t: Star) -> DataFrame:
    labelled = t.items.select("item_id", F.concat_ws("; ", "category", "eligibility").alias("label"))
    return labelled.filter(slices.in_theme(F.col("label"), "main"))


@query("j1_bridge_join", with_tables("entities", "items", "entity_items") + "SELECT category, role_id, count(*) AS n FROM entity_items JOIN entities USING (entity_id) JOIN items USING (item_id) GROUP BY category, role_id")
def j1(t: Star) -> DataFrame:
    return t.entity_items.join(t.entities, "entity_id").join(t.items, "item_id").groupBy("category", "role_id").agg(F.count("*").alias("n"))


@query("j2_left_join_zero_fill", with_tables("entities", "items", "entity_items", "pairs") + "SELECT item_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM items LEFT JOIN (SELECT item_id, count(*) AS n FROM pairs WHERE entity_id IN (SELECT entity_id FROM entities WHERE role_id = '1-URGENT' AND city_code = 3 AND experience_band = 'P') GROUP BY item_id) USING (item_id)")
def j2(t: Star) -> DataFrame:
    scarce = t.entities.where("role_id = '1-URGENT' and city_code = 3 and experience_band = 'P'").select("entity_id")
    counts = t.pairs.join(scarce, "entity_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("n"))
    return t.items.select("item_id").join(counts, "item_id", "left").fillna(0, ["n"])


@query("j3_totals_join", with_tables("entities") + "SELECT role_id, round(count(*) * 1e0 / (SELECT count(*) FROM entities), 6) AS share FROM entities GROUP BY role_id")
def j3(t: Star) -> DataFrame:
    e = t.entities
    total = e.agg(F.count("*").alias("total"))
    return rounded(e.groupBy("role_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("role_id", (F.col("n") / F.col("total")).alias("share")))  # one row


@query("j4_densified", with_tables("items", "source_map", "entity_items") + """, c AS (SELECT item_id, source_id, count(DISTINCT record_id) AS n FROM entity_items JOIN source_map USING (entity_id, record_id) GROUP BY ALL)
SELECT i.item_id, s.source_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM items i CROSS JOIN (SELECT DISTINCT source_id FROM source_map) s LEFT JOIN c ON c.item_id = i.item_id AND c.source_id = s.source_id""")
def j4(t: Star) -> DataFrame:
    m = t.source_map
    counts = t.counted().evidence.groupBy("item_id", "source_id").agg(F.countDistinct("record_id").alias("n"))
    return metrics.densify(counts, t.items.select("item_id"), m.select("source_id").distinct(), ["n"])


@query("j5_baseline_kept", with_tables("entities") + "SELECT b.n AS baseline, c.role_id FROM (SELECT count(*) AS n FROM entities) b LEFT JOIN (SELECT DISTINCT role_id FROM entities WHERE role_id = 'none such') c ON true")
def j5(t: Star) -> DataFrame:
    e = t.entities
    return e.agg(F.count("*").alias("baseline")).join(e.filter("role_id = 'none such'").select("role_id").distinct(), F.lit(True), "left")


@query("j6_semi_join", with_tables("entities", "entity_items") + "SELECT experience_band, count(*) AS n FROM entities e WHERE EXISTS (SELECT 1 FROM entity_items x WHERE x.entity_id = e.entity_id AND item_id LIKE 'red%') GROUP BY experience_band")
def j6(t: Star) -> DataFrame:
    return t.entities.join(t.entity_items.filter(F.col("item_id").startswith("red")), "entity_id", "left_semi").groupBy("experience_band").agg(F.count("*").alias("n"))


@query("j7_anti_join", with_tables("entity_items", "pairs") + "SELECT item_id, count(*) AS n FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT p_name FROM part WHERE p_name LIKE '%ring') o WHERE o.p_name = p.item_id) GROUP BY item_id")
def j7(t: Star) -> DataFrame:
    owned = t.table("part").filter(F.col("p_name").endswith("ring")).select(F.col("p_name").alias("item_id")).distinct()
    return t.pairs.join(owned, "item_id", "left_anti").groupBy("item_id").agg(F.count("*").alias("n"))


@query("j8_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL UNION ALL SELECT o_orderkey, -1 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def j8(t: Star) -> DataFrame:
    lines, orders = t.table("lineitem"), t.table("orders")
    key = F.col("l_orderkey") == F.col("o_orderkey")
    return lines.join(orders, key, "left_anti").select("l_orderkey", "l_linenumber").union(orders.join(lines, key, "left_anti").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(-1).alias("l_linenumber")))


@query("j9_full_join", "SELECT coalesce(a.k, b.k) AS nation, CAST(coalesce(a.n, 0) AS BIGINT) AS customers, CAST(coalesce(b.n, 0) AS BIGINT) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 1000 GROUP BY 1) b ON a.k = b.k")
def j9(t: Star) -> DataFrame:
    a = t.table("customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = t.table("supplier").filter("s_acctbal < 1000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full").fillna(0, ["customers", "suppliers"])


@query("j10_join_with_predicate", with_tables("source_map", "entity_items") + "SELECT source_id, count(*) AS n FROM entity_items x JOIN source_map m ON x.entity_id = m.entity_id AND x.record_id = m.record_id AND m.observed_at >= DATE '1998-01-01' GROUP BY source_id")
def j10(t: Star) -> DataFrame:
    x, m = t.entity_items, t.source_map
    on = (x.entity_id == m.entity_id) & (x.record_id == m.record_id) & (m.observed_at >= F.lit("1998-01-01").cast("date"))
    return x.join(m, on).groupBy("source_id").agg(F.count("*").alias("n"))


@query("j11_renamed_key", with_tables("entities", "source_map") + ", r AS (SELECT entity_id, min(record_id) AS representative FROM source_map GROUP BY entity_id) SELECT e.entity_id, r.representative, m.source_id FROM entities e LEFT JOIN r ON r.entity_id = e.entity_id LEFT JOIN source_map m ON r.representative = m.record_id")
def j11(t: Star) -> DataFrame:
    m = t.source_map
    first = m.groupBy("entity_id").agg(F.min("record_id").alias("representative"))
    e = t.entities.select("entity_id")
    return e.join(first, "entity_id", "left").join(m.select(F.col("record_id").alias("representative"), "source_id"), "representative", "left").select("entity_id", "representative", "source_id")


@query("j12_distinct_semi", with_tables("entities", "source_map") + "SELECT city_code, count(*) AS n FROM entities JOIN (SELECT DISTINCT entity_id FROM source_map WHERE source_id = 'ASIA') USING (entity_id) GROUP BY city_code")
def j12(t: Star) -> DataFrame:
    return t.entities.join(t.source_map.filter("source_id = 'ASIA'"), "entity_id", "left_semi").groupBy("city_code").agg(F.count("*").alias("n"))


@query("j13_cohort_semi", with_tables("entities", "entity_items", "pairs") + "SELECT item_id, count(*) AS n FROM pairs WHERE entity_id IN (SELECT entity_id FROM entities WHERE event_date >= DATE '2000-01-01') GROUP BY item_id")
def j13(t: Star) -> DataFrame:
    cohort = t.entities.filter(F.col("event_date") >= F.lit("2000-01-01").cast("date"))
    return t.pairs.join(cohort, "entity_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("n"))


@query("j14_item_pairs", with_tables("entity_items", "pairs") + "SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS n FROM pairs a JOIN pairs b ON a.entity_id = b.entity_id AND a.item_id < b.item_id GROUP BY 1, 2")
def j14(t: Star) -> DataFrame:
    return graph.co_counts(t.pairs)


@query("j15_blocked_pairs", "SELECT a.doc_id AS left_id, b.doc_id AS right_id FROM documents a JOIN documents b ON a.lang = b.lang AND a.source = b.source AND a.doc_id < b.doc_id AND a.n_chars = b.n_chars")
def j15(t: Star) -> DataFrame:
    d = t.table("documents").select("doc_id", "lang", "source", "n_chars")
    a, b = d.alias("a"), d.alias("b")
    # the length is part of the block: a block of one language and source alone could hold a third of the rows
    on = (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") == F.col("b.source")) & (F.col("a.n_chars") == F.col("b.n_chars")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    return a.join(b, on).select(F.col("a.doc_id").alias("left_id"), F.col("b.doc_id").alias("right_id"))


@query("x1_labelled_union", "SELECT 'null_customer' AS test, count(*) AS violations FROM orders WHERE o_custkey IS NULL UNION ALL SELECT 'negative_price', count(*) FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'debtors', count(*) FROM customer WHERE c_acctbal < 0")
def x1(t: Star) -> DataFrame:
    checks = {"null_customer": t.table("orders").filter("o_custkey is null"), "negative_price": t.table("orders").filter("o_totalprice < 0"), "debtors": t.table("customer").filter("c_acctbal < 0")}
    return metrics.violations(checks)


@query("x2_union_of_mixes", with_tables("entities") + "SELECT 'role' AS dimension, role_id AS value, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'experience', experience_band, count(*) FROM entities GROUP BY 2")
def x2(t: Star) -> DataFrame:
    return metrics.mixes(t.entities, {"role": "role_id", "experience": "experience_band"})


@query("x3_distinct_pairs", with_tables("entity_items") + "SELECT DISTINCT entity_id, item_id FROM entity_items")
def x3(t: Star) -> DataFrame:
    return t.pairs


@query("x4_set_overlap", with_tables("entity_items", "pairs") + ", a AS (SELECT entity_id FROM pairs WHERE item_id = 'red widget'), b AS (SELECT entity_id FROM pairs WHERE item_id = 'small ring') SELECT (SELECT count(*) FROM a JOIN b USING (entity_id)) AS both_sets, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either_set")
def x4(t: Star) -> DataFrame:
    marked = t.pairs.filter(F.col("item_id").isin("red widget", "small ring")).groupBy("entity_id").agg(F.count("*").alias("n"))
    return marked.agg(F.count_if(F.col("n") == 2).alias("both_sets"), F.count("*").alias("either_set"))


@query("x4_posting_overlaps", with_tables("entity_items", "pairs") + ", n AS (SELECT item_id, count(*) AS n FROM pairs GROUP BY 1), c AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS both_sets FROM pairs a JOIN pairs b ON a.entity_id = b.entity_id AND a.item_id < b.item_id GROUP BY 1, 2) SELECT item_a, item_b, both_sets, x.n + y.n - both_sets AS either_set FROM c JOIN n x ON x.item_id = item_a JOIN n y ON y.item_id = item_b")
def x4_all(t: Star) -> DataFrame:
    return graph.overlaps(graph.posting_bitmaps(t.pairs, "entity_id"))


@query("x5_set_difference", with_tables("entity_items", "pairs") + ", a AS (SELECT entity_id FROM pairs WHERE item_id = 'red widget'), b AS (SELECT entity_id FROM pairs WHERE item_id = 'small ring') SELECT 'false_positive' AS kind, entity_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'false_negative', entity_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def x5(t: Star) -> DataFrame:
    p = t.pairs
    found, expected = p.filter("item_id = 'red widget'").select("entity_id"), p.filter("item_id = 'small ring'").select("entity_id")
    return found.join(expected, "entity_id", "left_anti").select(F.lit("false_positive").alias("kind"), "entity_id").union(expected.join(found, "entity_id", "left_anti").select(F.lit("false_negative").alias("kind"), "entity_id"))


@query("x6_missing_members", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def x6(t: Star) -> DataFrame:
    return t.table("nation").select("n_nationkey").join(t.table("customer").where("c_acctbal > 9900"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti")
