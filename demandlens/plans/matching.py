"""Queries of duplicate records and of survivorship (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions.similarity import simhash
from demandlens.operators import dedup, survivorship
from demandlens.plans.base import Star, query, rounded
from demandlens.sources.shared import written

RECORDS_SQL = "r AS (SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'src' || (p_partkey % 3) AS source_id, p_brand AS company, p_type AS city, p_name AS title, p_name || ' for ' || p_brand AS description FROM part)"


def records(t: Star) -> DataFrame:
    """Parts as records of no known role: brands are companies, types cities, names titles. Only the exact level matches them."""
    return t.table("part").select(
        F.col("p_partkey").cast("string").alias("record_id"), F.concat(F.lit("src"), (F.col("p_partkey") % 3).cast("string")).alias("source_id"), F.col("p_partkey").cast("string").alias("source_record"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"),
        F.col("p_name").alias("title_raw"), F.col("p_type").alias("city"), F.lit("other").alias("role_id"), F.lit(None).cast("string").alias("experience_band"), F.concat("p_name", F.lit(" for "), "p_brand").alias("description"), F.lit(None).cast("string").alias("observed_at"), F.lit("valid").alias("record_status"),
    )


def varied(t: Star) -> DataFrame:
    """The same parts with numbered titles, short and long, roles for three quarters and two wordings of the description, so that all levels match some."""
    p = t.table("part").select(F.col("p_partkey").cast("string").alias("record_id"), "p_partkey", "p_size", "p_type", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    number = (F.col("p_partkey") % 7).cast("string")
    title = F.when(F.col("p_size") % 2 == 0, F.concat("name", F.lit(" of the "), F.lower("p_type"), F.lit(" line, number "), number)).otherwise(F.concat("name", F.lit(" no "), number))
    role = F.when(F.col("p_size") % 4 == 0, "other").otherwise(F.split_part(F.col("name"), F.lit(" "), F.lit(2)))
    text = F.concat("name", F.lit(" for "), "brand", F.when(F.col("p_size") > 40, ", large enough for any use one can think of").otherwise(", small"))
    more = p.select("record_id", title.alias("title"), title.alias("title_raw"), role.alias("role_id"), text.alias("description"))
    return records(t).drop("title", "title_raw", "role_id", "description").join(more, "record_id")


def links(rows: DataFrame, level: int) -> DataFrame:
    """Matches of one level: pairs of units by their first records (kind pair), and the records of every unit (kind member, unit on the left)."""
    united = dedup.united(rows)
    heads = written(dedup.unit_heads(united), "heads")
    pairs = dedup.matched_pairs(heads).where(F.col("level") == level).select(F.lit("pair").alias("kind"), "left_id", "right_id", "score")
    members = dedup.membership(united, heads).select(F.lit("member").alias("kind"), F.col("id").alias("left_id"), F.col("record_id").alias("right_id"), F.lit(None).cast("double").alias("score"))
    return rounded(pairs.unionByName(members))


@query("d1_blocks", f"WITH {RECORDS_SQL} SELECT company, city, count(*) AS n, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM r GROUP BY 1, 2")
def d1(t: Star) -> DataFrame:
    return dedup.keyed(records(t)).groupBy(F.col("company_key").alias("company"), F.col("city").alias("city")).agg(F.count("*").alias("n")).withColumn("pairs", F.expr("n * (n - 1) div 2"))


@query("d2_guards", "WITH g AS (SELECT c_custkey, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN ' senior' WHEN c_custkey % 5 = 1 THEN ' intern' WHEN c_custkey % 5 = 2 THEN ' [unit ' || (c_custkey % 2) || ']' ELSE '' END AS title FROM customer) SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'senior' WHEN 1 THEN 'intern' END AS seniority, c_custkey % 5 = 1 AS intern, CASE WHEN c_custkey % 5 = 2 THEN 'unit ' || (c_custkey % 2) END AS unit FROM g")
def d2(t: Star) -> DataFrame:
    k = F.col("c_custkey") % 5
    tail = F.when(k == 0, " senior").when(k == 1, " intern").when(k == 2, F.concat(F.lit(" [Unit "), (F.col("c_custkey") % 2).cast("string"), F.lit("]"))).otherwise("")
    none = F.lit(None).cast("string")
    made = t.table("customer").select("c_custkey", F.lit("c").alias("company"), F.concat("c_mktsegment", tail).alias("title"), F.concat("c_mktsegment", tail).alias("title_raw"), F.lit("x").alias("city"), none.alias("role_id"), none.alias("experience_band"), none.alias("description"))
    return dedup.keyed(made).select("c_custkey", "seniority", "intern", "unit")


@query(
    "d3_exact_pairs",
    f"WITH {RECORDS_SQL}, u AS (SELECT *, min(record_id) OVER (PARTITION BY company, city, title, source_id) AS id FROM r), h AS (SELECT DISTINCT company, city, title, source_id, id FROM u)"
    " SELECT 'pair' AS kind, least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, 1e2 AS score FROM h a JOIN h b ON a.company = b.company AND a.city = b.city AND a.title = b.title AND a.source_id < b.source_id UNION ALL SELECT 'member', id, record_id, NULL FROM u",
)
def d3(t: Star) -> DataFrame:
    return links(records(t), 1)


@query("d4_fuzzy_titles")
def d4(t: Star) -> DataFrame:
    return links(varied(t), 2)


@query("d5_simhash_pairs")
def d5(t: Star) -> DataFrame:
    return links(varied(t), 3)


@query("d6_indel_ratio")
def d6(t: Star) -> DataFrame:
    return rounded(dedup.near_titles(t.items.select("item_id", "category"), ["category"], "item_id", 60.0))


@query("d7_simhash")
def d7(t: Star) -> DataFrame:
    return t.table("part").select("p_partkey", F.hex(simhash(F.col("p_name"))).alias("print"))


@query("d8_text_key", "SELECT c_custkey, regexp_replace(lower(c_name || ' ' || c_mktsegment), '\\s+', '', 'g') AS body FROM customer")
def d8(t: Star) -> DataFrame:
    none = F.lit(None).cast("string")
    made = t.table("customer").select("c_custkey", *[none.alias(c) for c in ("company", "title", "title_raw", "city", "role_id", "experience_band")], F.concat_ws(" \n", "c_name", "c_mktsegment").alias("description"))
    return dedup.keyed(made).select("c_custkey", "body")


#: Parts with one brand, type and name have one description, so they are one group.
GROUPS_SQL = f"WITH {RECORDS_SQL}, g AS (SELECT *, min(source_id || '|' || record_id) OVER (PARTITION BY company, city, title) AS first FROM r), k AS (SELECT *, 'entity_' || substr(sha256(string_split(first, '|')[2]), 1, 24) AS entity_id FROM g)"


@query("d9_complete_link_groups")
def d9(t: Star) -> DataFrame:
    return dedup.deduplicate(varied(t)).select("record_id", "entity_id")


@query("d9_exact_level", GROUPS_SQL + " SELECT record_id, entity_id FROM k")
def d9_exact(t: Star) -> DataFrame:
    return dedup.deduplicate(records(t)).select("record_id", "entity_id")


@query("d10_audited_decisions", GROUPS_SQL + ", n AS (SELECT entity_id, count(*) AS n, min(record_id) AS low FROM k GROUP BY 1) SELECT record_id, CASE WHEN n = 2 AND CAST(low AS BIGINT) % 2 = 0 AND first <> source_id || '|' || record_id THEN 'entity_' || substr(sha256(record_id), 1, 24) ELSE entity_id END AS entity_id FROM k JOIN n USING (entity_id)")
def d10(t: Star) -> DataFrame:
    merged = written(dedup.deduplicate(records(t)), "merged")
    pairs = merged.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("record_id").alias("left_id"), F.max("record_id").alias("right_id")).where("n = 2")
    decisions = pairs.select("left_id", "right_id", F.when(F.col("left_id").cast("long") % 2 == 0, "different").otherwise("same").alias("decision"))
    return dedup.apply_decisions(merged, decisions).select("record_id", "entity_id")


@query("d11_eligible", "SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part WHERE p_size > 10")
def d11(t: Star) -> DataFrame:
    some = t.table("part").select("p_partkey", "p_size").withColumnRenamed("p_partkey", "k")
    marked = records(t).drop("record_status").join(some, F.col("record_id") == F.col("k").cast("string")).withColumn("record_status", F.when(F.col("p_size") > 10, "valid").otherwise("invalid"))
    return dedup.eligible(marked).select("record_id")


@query("d12_provenance")
def d12(t: Star) -> DataFrame:
    return rounded(dedup.provenance(dedup.deduplicate(varied(t))).select("record_id", "entity_id", "source_id", "match_method", "score"))


@query("d13_dedup_report")
def d13(t: Star) -> DataFrame:
    return rounded(dedup.report(dedup.deduplicate(varied(t))))


@query("d14_stable_mode", "SELECT o_custkey, max_by(o_orderpriority, printf('%08d%04d%s', n, length(o_orderpriority), o_orderpriority)) AS priority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def d14(t: Star) -> DataFrame:
    return survivorship.stable_mode(t.table("orders"), "o_custkey", "o_orderpriority", "priority")


@query("d15_best_title", "SELECT p_brand, first(p_name ORDER BY p_retailprice DESC, p_size > 25 DESC, length(p_name) DESC, p_partkey DESC) AS title FROM part GROUP BY 1")
def d15(t: Star) -> DataFrame:
    return survivorship.best_title(t.table("part").withColumn("parsed", F.col("p_size") > 25), "p_brand", "p_name", "p_retailprice", "parsed", "p_partkey")


@query("d16_best_description", "SELECT source, first(doc_id ORDER BY words DESC, chars DESC, doc_id DESC) AS doc_id FROM (SELECT source, doc_id, len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_+#.-]+'))) AS words, length(regexp_replace(text, '\\s', '', 'g')) AS chars FROM documents) GROUP BY 1")
def d16(t: Star) -> DataFrame:
    d = t.table("documents").select("doc_id", "source", "text")
    best = survivorship.best_description(d, "source", "text", "doc_id").toDF("s", "best")
    return d.join(best, (F.col("text") == F.col("best")) & (F.col("source") == F.col("s"))).groupBy("source").agg(F.max("doc_id").alias("doc_id"))


@query("d17_date_bounds", "SELECT o_custkey, min(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS first_date, max(CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END) AS last_date FROM orders GROUP BY 1")
def d17(t: Star) -> DataFrame:
    return survivorship.date_bounds(t.table("orders").withColumn("ok", F.col("o_orderstatus") != "P"), "o_custkey", "o_orderdate", "ok")


RECONCILED = "WITH s AS (SELECT o_custkey, o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY 1, 2), b AS (SELECT o_custkey, median(m) AS middle, min(m) AS low, max(m) AS high, count(*) AS sources FROM s GROUP BY 1), c AS (SELECT *, sources > 1 AND (high - low) / middle > 0.35 AS conflict FROM b)"


@query("d18_reconciled_measure", RECONCILED + " SELECT o_custkey, CASE WHEN NOT conflict THEN round(middle, 4) END AS value, sources, CASE WHEN conflict THEN 'conflict' ELSE 'available' END AS status, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.o_custkey) AS observed FROM c")
def d18(t: Star) -> DataFrame:
    found = survivorship.reconcile(t.table("orders"), "o_custkey", "o_orderstatus", "o_totalprice")
    return rounded(found.select("o_custkey", "value", "sources", "status", F.size("observations").cast("long").alias("observed")), 4)


@query("d19_assembled", RECONCILED + ", m AS (SELECT o_custkey, max_by(o_orderpriority, printf('%08d%04d%s', n, length(o_orderpriority), o_orderpriority)) AS priority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1), d AS (SELECT o_custkey, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders GROUP BY 1) SELECT o_custkey, priority, first_date, last_date, CASE WHEN conflict THEN 'conflict' ELSE 'available' END AS status FROM c JOIN m USING (o_custkey) JOIN d USING (o_custkey)")
def d19(t: Star) -> DataFrame:
    o = t.table("orders").withColumn("ok", F.lit(True))
    parts = [survivorship.stable_mode(o, "o_custkey", "o_orderpriority", "priority"), survivorship.date_bounds(o, "o_custkey", "o_orderdate", "ok"), survivorship.reconcile(o, "o_custkey", "o_orderstatus", "o_totalprice").select("o_custkey", "status")]
    return survivorship.assemble(parts, "o_custkey")


@query("d20_pair_labels", f"""WITH {RECORDS_SQL}, c AS (SELECT company, city, title, min(record_id) AS lo, max(record_id) AS hi FROM r GROUP BY ALL), p AS (SELECT lo AS a, hi AS b FROM c WHERE lo < hi UNION ALL SELECT lo, lead(lo) OVER (PARTITION BY company, city ORDER BY title) FROM c)
 SELECT least(a, b) AS left_id, greatest(a, b) AS right_id, CASE WHEN x.title = y.title THEN 'easy' WHEN x.source_id <> y.source_id THEN 'cross_source_negative' ELSE 'hard' END AS kind FROM p JOIN r x ON x.record_id = a JOIN r y ON y.record_id = b""")
def d20(t: Star) -> DataFrame:
    return rounded(dedup.pair_sample(dedup.keyed(records(t))))
