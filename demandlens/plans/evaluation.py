"""Queries of data tests, evaluation and sampling (Q, T8 to T10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.operators import evaluate
from demandlens.plans.base import Star, query, rounded, with_tables
from demandlens.plans.metrics import THEMES_SQL, themes
from demandlens.sources.shared import fresh_path, written

#: A rule that predicts quality: few signs and no line of capitals.
PREDICTED = "p AS (SELECT l.doc_id, quality = 1 AS gold, d.text NOT LIKE '%\\%\\%\\%%' ESCAPE '\\' AND d.text NOT LIKE '%!!%' AS predicted, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id))"
SCORES = "s AS (SELECT count(*) FILTER (WHERE gold AND predicted) AS tp, count(*) FILTER (WHERE NOT gold AND predicted) AS fp, count(*) FILTER (WHERE gold AND NOT predicted) AS fn, count(*) FILTER (WHERE NOT gold AND NOT predicted) AS tn FROM p)"


def predicted(t: Star) -> DataFrame:
    joined = t.table("labels").join(t.table("documents"), "doc_id")
    fine = ~F.contains("text", F.lit("%%%")) & ~F.contains("text", F.lit("!!"))
    return joined.select("doc_id", (F.col("quality") == 1).alias("gold"), fine.alias("predicted"), "lang", "n_chars")


@query("q1_data_tests", with_tables("entities", "source_map", "items", "entity_items") + """SELECT 'entities_unique' AS test, (SELECT count(*) FROM (SELECT entity_id FROM entities GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'items_unique', 0 UNION ALL SELECT 'records_unique', (SELECT count(*) FROM (SELECT record_id, source_id FROM source_map GROUP BY 1, 2 HAVING count(*) > 1))
UNION ALL SELECT 'relations_unique', (SELECT count(*) FROM (SELECT record_id, item_id FROM entity_items GROUP BY 1, 2 HAVING count(*) > 1)) UNION ALL SELECT 'entities_id_present', 0 UNION ALL SELECT 'items_id_present', 0 UNION ALL SELECT 'records_source_present', 0 UNION ALL SELECT 'measure_sane', (SELECT count(*) FROM entities WHERE measure < 0 OR isnan(measure)) UNION ALL SELECT 'cost_ordered', 0
UNION ALL SELECT 'records_reference', (SELECT count(*) FROM source_map WHERE entity_id NOT IN (SELECT entity_id FROM entities)) UNION ALL SELECT 'relations_reference', 0""")
def q1(t: Star) -> DataFrame:
    t = t.counted()
    entities = written(t.entities.select("entity_id", "measure"), "entities")
    records = t.doubtful_records(entities)
    ids = t.sent(records.select("entity_id").distinct(), "ids")
    return evaluate.star_checks(entities, records, t.items, t.doubtful_relations, entities.join(ids, "entity_id", "left_semi"))


@query("q2_published_checks", with_tables("entities") + "SELECT count(*) AS rows, count(*) FILTER (WHERE measure < 0) AS negative, count(*) FILTER (WHERE role_id IS NULL) AS unassigned, count(*) FILTER (WHERE measure > 500000) AS above_range FROM entities")
def q2(t: Star) -> DataFrame:
    return t.entities.agg(F.count("*").alias("rows"), F.count_if(F.col("measure") < 0).alias("negative"), F.count_if(F.col("role_id").isNull()).alias("unassigned"), F.count_if(F.col("measure") > 500000).alias("above_range"))


@query("q3_binary_evaluation", f"WITH {PREDICTED}, {SCORES} SELECT tp, fp, fn, tn, round(tp * 1e0 / (tp + fp), 6) AS precision, round(tp * 1e0 / (tp + fn), 6) AS recall, round(fp * 1e0 / (fp + tn), 6) AS false_merge_rate, round(fn * 1e0 / (tp + fn), 6) AS miss_rate, round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM s")
def q3(t: Star) -> DataFrame:
    return rounded(evaluate.binary(predicted(t), "gold", "predicted"))


CLASSED = "k AS (SELECT doc_id, lang AS gold, CASE WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' la ') AND contains(text, ' et') THEN 'fr' WHEN contains(text, ' la ') THEN 'es' ELSE 'en' END AS predicted FROM documents WHERE lang IS NOT NULL)"


def classed(t: Star) -> DataFrame:
    def has(w: str) -> F.Column:
        return F.contains("text", F.lit(w))

    guess = F.when(has(" der "), "de").when(has(" la ") & has(" et"), "fr").when(has(" la "), "es").otherwise("en")
    return t.table("documents").where("lang is not null").select("doc_id", F.col("lang").alias("gold"), guess.alias("predicted"))


@query("q4_class_evaluation", f"WITH {CLASSED}, l AS (SELECT gold AS label FROM k UNION SELECT predicted FROM k), c AS (SELECT label, (SELECT count(*) FROM k WHERE gold = label) AS support, (SELECT count(*) FROM k WHERE predicted = label) AS predicted_count, (SELECT count(*) FROM k WHERE predicted = label AND gold = label) AS tp FROM l), r AS (SELECT *, CASE WHEN predicted_count = 0 THEN 0 ELSE tp * 1e0 / predicted_count END AS p, tp * 1e0 / nullif(support, 0) AS r FROM c) SELECT label, support, predicted_count, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r")
def q4(t: Star) -> DataFrame:
    return rounded(evaluate.per_class(classed(t), "gold", "predicted"))


@query("q4_confusion", f"WITH {CLASSED} SELECT gold, predicted, count(*) AS n FROM k GROUP BY 1, 2")
def q4b(t: Star) -> DataFrame:
    return evaluate.confusion(classed(t), "gold", "predicted")


LABELLED = with_tables("source_map", "entity_items") + ", a AS (SELECT entity_id, list(DISTINCT split_part(item_id, ' ', 1)) AS g, list(DISTINCT split_part(item_id, ' ', 1)) FILTER (WHERE source_id IN ('ASIA', 'EUROPE', 'AFRICA')) AS p0 FROM entity_items JOIN source_map USING (entity_id, record_id) GROUP BY 1), e AS (SELECT g, coalesce(p0, []) AS p, len(list_intersect(g, coalesce(p0, []))) AS tp FROM a), r AS (SELECT *, CASE WHEN len(p) = 0 THEN 0 ELSE tp * 1e0 / len(p) END AS rp, tp * 1e0 / len(g) AS rr FROM e)"


@query("q5_multi_label", LABELLED + " SELECT round(avg(rp), 6) AS macro_precision, round(avg(rr), 6) AS macro_recall, round(avg(coalesce(2 * rp * rr / nullif(rp + rr, 0), 0)), 6) AS macro_f1, round(avg(CASE WHEN tp = len(g) AND tp = len(p) THEN 1e0 ELSE 0e0 END), 6) AS exact_match, count(*) AS n, round(sum(tp) * 1e0 / sum(len(p)), 6) AS micro_precision, round(sum(tp) * 1e0 / sum(len(g)), 6) AS micro_recall, round(2e0 * sum(tp) / (sum(len(p)) + sum(len(g))), 6) AS micro_f1 FROM r")
def q5(t: Star) -> DataFrame:
    word = F.split_part(F.col("item_id"), F.lit(" "), F.lit(1))
    # the few words of an entity are told apart by hash before they are listed
    words = t.counted().evidence.groupBy("entity_id", word.alias("word")).agg(F.bool_or(F.coalesce(F.col("source_id").isin("ASIA", "EUROPE", "AFRICA"), F.lit(False))).alias("found"))
    lists = words.groupBy("entity_id").agg(F.collect_list("word").alias("g"), F.collect_list(F.when(F.col("found"), F.col("word"))).alias("p"))
    return rounded(evaluate.multi_label(lists, "g", "p"))


@query("q6_fixture_scores", with_tables("entities", "source_map") + ", g AS (SELECT DISTINCT entity_id FROM source_map WHERE source_id = 'ASIA'), f AS (SELECT DISTINCT entity_id FROM source_map WHERE source_id = 'EUROPE'), m AS (SELECT e.entity_id IN (SELECT entity_id FROM g) AS gold, e.entity_id IN (SELECT entity_id FROM f) AS found, role_id FROM entities e) SELECT role_id, count(*) FILTER (WHERE gold AND found) AS tp, count(*) FILTER (WHERE NOT gold AND found) AS fp, count(*) FILTER (WHERE gold AND NOT found) AS fn, round(count(*) FILTER (WHERE gold AND found) * 1e0 / count(*) FILTER (WHERE found), 6) AS precision FROM m GROUP BY 1")
def q6(t: Star) -> DataFrame:
    marks = t.source_map.groupBy("entity_id").agg(F.bool_or(F.col("source_id") == "ASIA").alias("gold"), F.bool_or(F.col("source_id") == "EUROPE").alias("found"))
    joined = t.entities.join(marks, "entity_id", "left").fillna(False, ["gold", "found"])
    return rounded(evaluate.binary(joined, "gold", "found", ["role_id"]).select("role_id", "tp", "fp", "fn", "precision"))


@query("q7_quality_gate", f"WITH {PREDICTED}, {SCORES} SELECT tp, fp, 'gold=' || (tp + fn >= 300) || ',precision=' || (tp * 1e0 / (tp + fp) >= 0.95) || ',recall=' || (tp * 1e0 / (tp + fn) >= 0.9) AS checks, CASE WHEN tp + fn < 300 THEN 'INSUFFICIENT' WHEN tp * 1e0 / (tp + fp) < 0.95 OR tp * 1e0 / (tp + fn) < 0.9 THEN 'FAILED' ELSE 'PASSED' END AS gate FROM s")
def q7(t: Star) -> DataFrame:
    row = evaluate.binary(predicted(t), "gold", "predicted")
    return evaluate.gate(row, {"gold": F.col("tp") + F.col("fn") >= 300}, {"precision": F.col("precision") >= 0.95, "recall": F.col("recall") >= 0.90}).select("tp", "fp", "checks", "gate")


SPLIT = "CASE WHEN CAST('0x' || substr(sha256('seed:' || {k}), 1, 8) AS BIGINT) % 10 < 3 THEN 'held_out' ELSE 'development' END"


def labels(t: Star) -> DataFrame:
    """Labels with a split that is wrong for some."""
    mine = evaluate.split(F.col("doc_id"), "seed")
    return t.table("labels").select("doc_id", F.when(F.col("doc_id") % 97 == 5, "held_out").otherwise(mine).alias("split"))


LABELS_SQL = f"lb AS (SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 'held_out' ELSE {SPLIT.format(k='doc_id')} END AS split, {SPLIT.format(k='doc_id')} AS right_split FROM labels)"


@query("q8_label_readiness", f"WITH {LABELS_SQL} SELECT count(*) AS labels, count(DISTINCT doc_id) AS distinct_keys, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500)) AS orphans, count(*) FILTER (WHERE split <> right_split) AS wrong_splits, count(*) FILTER (WHERE split = 'held_out') AS held_out, greatest(0, 10000 - count(*)) AS remaining FROM lb")
def q8(t: Star) -> DataFrame:
    return evaluate.readiness(labels(t), t.table("documents").where("n_chars > 500").select("doc_id"), "doc_id", "seed", 10000)


@query("q9_label_integrity", f"WITH {LABELS_SQL} SELECT 'orphan' AS kind, doc_id AS key FROM lb WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 500) UNION ALL SELECT 'wrong_split', doc_id FROM lb WHERE split <> right_split")
def q9(t: Star) -> DataFrame:
    return evaluate.integrity(labels(t), t.table("documents").where("n_chars > 500").select("doc_id"), "doc_id", "seed")


@query("q10_label_upsert", "WITH n AS (SELECT DISTINCT o_custkey AS k, first(o_orderpriority ORDER BY o_orderdate DESC, o_orderstatus DESC, o_orderpriority DESC) OVER (PARTITION BY o_custkey) AS v, max(o_orderdate) OVER (PARTITION BY o_custkey) AS ts FROM orders) SELECT c_custkey AS k, CASE WHEN n.k IS NULL THEN c_mktsegment ELSE v END AS value, CAST(CASE WHEN n.k IS NULL THEN 1 ELSE 2 END AS INTEGER) AS version, TIMESTAMP '1990-01-01' AS annotated_at, coalesce(ts, TIMESTAMP '1990-01-01') AS updated_at FROM customer LEFT JOIN n ON n.k = c_custkey")
def q10(t: Star) -> DataFrame:
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    stored = t.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("value"), F.lit("a").alias("annotator"), start.alias("annotated_at"), start.alias("updated_at"), F.lit(1).alias("version"))
    new = t.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("value"), F.col("o_orderstatus").alias("annotator"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return evaluate.upsert(stored, new, "k").select("k", "value", "version", "annotated_at", "updated_at")


@query("q11_record_diff", "SELECT a.p_partkey, concat_ws(',', CASE WHEN a.p_brand <> b.p_brand THEN 'p_brand' END, CASE WHEN a.p_type <> b.p_type THEN 'p_type' END, CASE WHEN a.p_size <> b.p_size THEN 'p_size' END) AS fields FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def q11(t: Star) -> DataFrame:
    p = t.table("part")
    found = evaluate.differing(p, p.withColumn("p_partkey", F.col("p_partkey") - 1), "p_partkey", ["p_brand", "p_type", "p_size"])
    return found.withColumn("fields", F.array_join("fields", ","))


@query("q12_restricted_content", "SELECT 'url' AS \"column\", 'restricted_content' AS kind, count(*) AS n FROM pages WHERE regexp_matches(url, '(?i)https?://') UNION ALL SELECT 'page_id', 'forbidden_column', count(*) FROM pages")
def q12(t: Star) -> DataFrame:
    return evaluate.restricted(t.table("pages").select("page_id", "url"), ("page_id",))


@query("q13_valid_mapping", with_tables("items") + f", {THEMES_SQL} SELECT 'unknown_member' AS kind, item_id AS value FROM themes WHERE item_id NOT IN (SELECT item_id FROM items) UNION SELECT 'empty_group', theme FROM themes GROUP BY theme HAVING count(*) FILTER (WHERE item_id IN (SELECT item_id FROM items)) = 0")
def q13(t: Star) -> DataFrame:
    return evaluate.valid_mapping(themes(t), t.items, "theme", "item_id")


@query("q14_artifact_audit", "SELECT 'as listed' AS inventory, 'ok' AS status, true AS some UNION ALL SELECT 'other sizes', 'changed', true")
def q14(t: Star) -> DataFrame:
    path = fresh_path(t.spark, "published")
    t.entities.groupBy("role_id", "city_code").agg(F.count("*").alias("n")).write.json(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    listed = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    inventories = {"as listed": listed, "other sizes": listed.withColumn("bytes", F.col("bytes") + 1)}
    found = reduce(DataFrame.union, [evaluate.artifact_audit(files, i).select(F.lit(n).alias("inventory"), "status") for n, i in inventories.items()])
    return found.groupBy("inventory", "status").agg((F.count("*") > 0).alias("some"))


@query("t8_hash_split", f"SELECT o_orderkey, {SPLIT.format(k='o_orderkey')} AS split FROM orders")
def t8(t: Star) -> DataFrame:
    return t.table("orders").select("o_orderkey", evaluate.split(F.col("o_orderkey"), "seed").alias("split"))


@query("t9_round_robin", "WITH k AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('seed:' || o_orderkey), o_orderkey) AS k FROM orders) SELECT o_orderkey, o_orderpriority FROM k ORDER BY k, o_orderpriority LIMIT 42")
def t9(t: Star) -> DataFrame:
    return evaluate.round_robin(t.table("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", "seed", 42)


@query("t10_hard_first", "SELECT doc_id FROM documents ORDER BY lang = 'de' DESC, n_chars DESC, sha256('seed:' || doc_id), doc_id LIMIT 40")
def t10(t: Star) -> DataFrame:
    return evaluate.hard_first(t.table("documents"), F.col("lang") == "de", F.col("n_chars"), "doc_id", "seed", 40).select("doc_id")
