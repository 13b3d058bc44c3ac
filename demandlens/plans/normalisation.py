"""Queries of row normalisation (N) and extraction (E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions import extract, normalize
from demandlens.plans.base import Star, query, rounded, with_tables

TAXONOMY = [("fastener", ["bolt|nut", "^red .*gear"]), ("round", ["ring", "gear"]), ("other", [])]
#: Raw values made of the tables' own columns, for Spark and for DuckDB.
SALARY = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN CAST(CAST(round(abs(c_acctbal) / 1000) AS INT) AS {s}) || '-' || CAST(CAST(round(abs(c_acctbal) / 500) AS INT) + 1 AS {s}) || 'K' WHEN c_custkey % 7 = 2 THEN CAST(CAST(round(c_acctbal / 100) AS INT) AS {s}) || '-50 k·13薪' WHEN c_custkey % 7 = 3 THEN '200-' || CAST(c_custkey % 500 AS {s}) || '元/天' WHEN c_custkey % 7 = 4 THEN CAST(c_custkey % 30 AS {s}) || '-20万/年' WHEN c_custkey % 7 = 5 THEN '面议' ELSE c_mktsegment END"
YEARS = "CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 8 = 1 THEN CAST(c_custkey % 9 AS {s}) || '-' || CAST(c_custkey % 7 + 2 AS {s}) || '年' WHEN c_custkey % 8 = 2 THEN CAST(c_custkey % 12 AS {s}) || '年以上' WHEN c_custkey % 8 = 3 THEN CAST(c_custkey % 3 AS {s}) || '年以内' WHEN c_custkey % 8 = 4 THEN CAST(c_custkey % 12 AS {s}) || '年' WHEN c_custkey % 8 = 5 THEN '经验不限' WHEN c_custkey % 8 = 6 THEN '应届生' ELSE c_mktsegment END"
DATES = "CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y.%m.%d') WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y-%m') ELSE NULL END"


def spark_dates() -> F.Column:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    return F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, F.date_format(d, "yyyy.MM.dd")).when(k == 3, F.date_format(d, "yyyy-MM"))


SALARY_SQL = f"""WITH r AS (SELECT c_custkey, {SALARY.format(s="VARCHAR")} AS raw FROM customer), t AS (SELECT *, replace(lower(raw), ' ', '') AS t FROM r),
g AS (SELECT *, TRY_CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)(k|元/天|万/年)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(t, '^([0-9]+)-([0-9]+)(k|元/天|万/年)', 2) AS DOUBLE) AS b, regexp_extract(t, '^([0-9]+)-([0-9]+)(k|元/天|万/年)', 3) AS u, TRY_CAST(regexp_extract(t, '·([0-9]+)薪$', 1) AS DOUBLE) AS m FROM t),
f AS (SELECT *, CASE u WHEN 'k' THEN 1000e0 WHEN '元/天' THEN 21.75e0 WHEN '万/年' THEN 10000e0 / 12 END AS k FROM g),
s AS (SELECT *, CASE WHEN raw IS NULL THEN 'missing_at_source' WHEN t = '面议' THEN 'negotiable' WHEN a IS NULL THEN 'unparseable' WHEN a <= 0 OR b <= 0 OR a > b THEN 'invalid_range' WHEN u = 'k' AND m IS NULL THEN 'parsed_monthly' WHEN u = 'k' THEN 'parsed_monthly_with_months' WHEN u = '元/天' THEN 'parsed_daily' ELSE 'parsed_annual' END AS status FROM f)
SELECT c_custkey, CASE WHEN status LIKE 'parsed%' THEN round(a * k, 4) END AS low, CASE WHEN status LIKE 'parsed%' THEN round(b * k, 4) END AS high, CASE WHEN status LIKE 'parsed%' THEN round((a + b) / 2 * k * CASE WHEN u = 'k' THEN coalesce(m, 12) ELSE 12 END, 4) END AS annual, CASE WHEN status LIKE 'parsed%' THEN CAST(CASE WHEN u = 'k' THEN m ELSE 12 END AS INTEGER) END AS months, status FROM s"""


@query("n1_text", "SELECT c_custkey, nullif(lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))), '') AS value FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '   ' ELSE '  ' || c_name || chr(9) || ' ' || c_mktsegment || ' ' END AS raw FROM customer)")
def n1(t: Star) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 10 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_name", F.lit("\t "), "c_mktsegment", F.lit(" ")))
    return t.table("customer").select("c_custkey", normalize.text(raw).alias("value"))


@query("n2_role", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'bolt|nut|^red .*gear') THEN 'fastener' WHEN regexp_matches(lower(p_name), 'ring|gear') THEN 'round' ELSE 'other' END AS role, CASE WHEN regexp_matches(lower(p_name), 'bolt|nut|ring|gear') THEN 'parsed' ELSE 'fallback_other' END AS status FROM part")
def n2(t: Star) -> DataFrame:
    role, status = normalize.classify(F.col("p_name"), TAXONOMY)
    return t.table("part").select("p_partkey", role.alias("role"), status.alias("status"))


@query("n3_longest_prefix", "WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'elsewhere' ELSE 'nation_' || c_nationkey || ' district' END AS raw FROM customer) SELECT c_custkey, max_by(n_nationkey, length(n_name) * 100 + n_nationkey) AS code, CASE WHEN max(n_nationkey) IS NULL THEN 'unparseable' ELSE 'parsed' END AS code_status FROM v LEFT JOIN nation ON starts_with(raw, lower(n_name)) GROUP BY 1")
def n3(t: Star) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 11 == 0, "elsewhere").otherwise(F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string"), F.lit(" District")))
    aliases = t.table("nation").select(F.col("n_name").alias("alias"), F.col("n_nationkey").alias("code"))
    return normalize.longest_prefix(t.table("customer").select("c_custkey", raw.alias("raw")), "raw", aliases, [8, 9]).drop("raw")


@query("n4_keyword_band", "SELECT c_custkey, CASE WHEN contains(lower(c_mktsegment), 'build') THEN 'a' WHEN contains(lower(c_mktsegment), 'mach') OR contains(lower(c_mktsegment), 'house') THEN 'b' END AS band, CASE WHEN contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'mach') OR contains(lower(c_mktsegment), 'house') THEN 'parsed' ELSE 'unparseable' END AS status FROM customer")
def n4(t: Star) -> DataFrame:
    band, status = normalize.keyword_band(F.col("c_mktsegment"), (("a", ("build",)), ("b", ("mach", "house"))))
    return t.table("customer").select("c_custkey", band.alias("band"), status.alias("status"))


YEARS_SQL = f"""WITH r AS (SELECT c_custkey, {YEARS.format(s="VARCHAR")} AS raw FROM customer), g AS (SELECT *, TRY_CAST(regexp_extract(raw, '^([0-9]+)-([0-9]+)年', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(raw, '^([0-9]+)-([0-9]+)年', 2) AS DOUBLE) AS b, TRY_CAST(regexp_extract(raw, '^([0-9]+)年', 1) AS DOUBLE) AS x FROM r),
h AS (SELECT c_custkey, raw, CASE WHEN raw LIKE '%不限' THEN 0 WHEN raw LIKE '应届%' THEN 0 WHEN a IS NOT NULL THEN CASE WHEN a <= b THEN a END WHEN raw LIKE '%年以内' THEN 0 WHEN x IS NOT NULL THEN x END AS low, CASE WHEN raw LIKE '应届%' THEN 0 WHEN a IS NOT NULL THEN CASE WHEN a <= b THEN b END WHEN raw LIKE '%年以上' THEN NULL WHEN x IS NOT NULL THEN x END AS high FROM g)
SELECT c_custkey, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, CASE WHEN raw LIKE '%不限' THEN 'no_requirement' WHEN low IS NULL THEN NULL WHEN high <= 1 THEN 'entry' WHEN low < 3 THEN 'junior' WHEN low < 5 THEN 'mid' WHEN low < 10 THEN 'senior' ELSE 'expert' END AS band, CASE WHEN raw IS NULL THEN 'missing_at_source' WHEN low IS NULL THEN 'unparseable' ELSE 'parsed' END AS status FROM h"""


@query("n5_years", YEARS_SQL)
def n5(t: Star) -> DataFrame:
    return t.table("customer").select("c_custkey", normalize.years(F.expr(YEARS.format(s="STRING"))).alias("y")).select("c_custkey", "y.*")


@query("n6_date", f"WITH r AS (SELECT o_orderkey, o_orderdate, {DATES} AS raw FROM orders) SELECT o_orderkey, CASE WHEN length(raw) = 10 THEN CAST(o_orderdate AS DATE) END AS value, CASE WHEN raw IS NULL THEN 'missing_at_source' WHEN length(raw) = 10 THEN 'parsed' ELSE 'unparseable' END AS status FROM r")
def n6(t: Star) -> DataFrame:
    value, status = normalize.date(spark_dates())
    return t.table("orders").select("o_orderkey", value.alias("value"), status.alias("status"))


@query("n7_salary", SALARY_SQL)
def n7(t: Star) -> DataFrame:
    parsed = t.table("customer").select("c_custkey", normalize.salary(F.expr(SALARY.format(s="STRING"))).alias("s"))
    return rounded(parsed.select("c_custkey", "s.low", "s.high", "s.annual", "s.months", "s.status"), 4)


@query("n8_monthly", "WITH r AS (SELECT c_custkey, abs(c_acctbal) AS a, abs(c_acctbal) + 100 AS b, (['year', 'month', 'week', 'day', 'hour', 'fortnight'])[c_custkey % 6 + 1] AS u FROM customer), f AS (SELECT *, CASE u WHEN 'year' THEN 1e0 / 12 WHEN 'month' THEN 1e0 WHEN 'week' THEN 52e0 / 12 WHEN 'day' THEN 260e0 / 12 WHEN 'hour' THEN 2080e0 / 12 END AS k FROM r) SELECT c_custkey, CASE WHEN a > 0 THEN round(a * k, 4) END AS low, CASE WHEN a > 0 THEN round(b * k, 4) END AS high, CASE WHEN k IS NULL OR a <= 0 THEN 'unavailable' ELSE 'from_' || u END AS method FROM f")
def n8(t: Star) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ["Year", "month ", "week", "day", "hour", "fortnight"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    made = normalize.monthly(F.abs("c_acctbal"), F.abs("c_acctbal") + 100, unit)
    return rounded(t.table("customer").select("c_custkey", made.alias("m")).select("c_custkey", "m.*"), 4)


@query("n9_title_scope", "SELECT p_partkey, CASE WHEN contains(p_name, 'ring') THEN 'target' WHEN contains(p_name, 'red') THEN 'non_target' ELSE 'possible' END AS scope FROM part")
def n9(t: Star) -> DataFrame:
    return t.table("part").select("p_partkey", normalize.title_scope(F.col("p_name"), ["RING"], ["red"], ["gear"]).alias("scope"))


@query("n10_structured_years", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 5) || '-' || (c_custkey % 5 + 2) || '年' WHEN c_custkey % 4 = 1 THEN (c_custkey % 5) || '年以上' WHEN c_custkey % 4 = 2 THEN '3-5年' END AS raw FROM customer")
def n10(t: Star) -> DataFrame:
    k, m = F.col("c_custkey") % 4, F.col("c_custkey") % 5
    made = normalize.years_from_fields(F.when(k == 0, m), F.when(k == 0, m + 2), F.when(k == 1, m), F.when(k == 2, "Middle").otherwise("unheard of"))
    return t.table("customer").select("c_custkey", made.alias("raw"))


@query("n11_record_id", "SELECT c_custkey, 'record_' || substr(sha256(CASE WHEN c_custkey % 9 = 0 THEN 'crm||' || c_custkey || '|' || c_mktsegment ELSE 'crm|' || c_name || '|' || c_custkey END), 1, 24) AS record_id FROM customer")
def n11(t: Star) -> DataFrame:
    name = F.when(F.col("c_custkey") % 9 != 0, F.col("c_name"))
    return t.table("customer").select("c_custkey", normalize.record_id([F.lit("crm"), name, F.col("c_custkey")], more=[F.col("c_mktsegment")]).alias("record_id"))


@query("n12_quality_flags", "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'debt' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN c_acctbal > 9000 THEN 'rich' END) AS flags, CASE WHEN c_acctbal < 0 THEN 'invalid' ELSE 'valid' END AS status FROM customer")
def n12(t: Star) -> DataFrame:
    found = t.table("customer").select("c_custkey", normalize.flags({"debt": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING", "rich": F.col("c_acctbal") > 9000}).alias("f"))
    return found.select("c_custkey", F.array_join("f", ",").alias("flags"), F.when(F.array_contains("f", "debt"), "invalid").otherwise("valid").alias("status"))


@query("n13_silver", f"SELECT s.c_custkey, lower(c_name) AS name, s.status AS salary_status, y.band, y.status AS years_status, concat_ws(',', CASE WHEN s.status = 'invalid_range' THEN 'salary' END, CASE WHEN y.status = 'unparseable' THEN 'years' END) AS flags FROM ({SALARY_SQL}) s JOIN ({YEARS_SQL}) y ON s.c_custkey = y.c_custkey JOIN customer c ON c.c_custkey = s.c_custkey")
def n13(t: Star) -> DataFrame:
    row = t.table("customer").select("c_custkey", normalize.text(F.col("c_name")).alias("name"), normalize.salary(F.expr(SALARY.format(s="STRING"))).alias("s"), normalize.years(F.expr(YEARS.format(s="STRING"))).alias("y"))
    found = normalize.flags({"salary": F.col("s.status") == "invalid_range", "years": F.col("y.status") == "unparseable"})
    return row.select("c_custkey", "name", F.col("s.status").alias("salary_status"), F.col("y.band").alias("band"), F.col("y.status").alias("years_status"), F.array_join(found, ",").alias("flags"))


@query("n14_script", "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN 'other' ELSE 'en' END AS script FROM documents")
def n14(t: Star) -> DataFrame:
    return t.table("documents").select("doc_id", normalize.script(F.col("text")).alias("script"))


@query("n15_masking", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '[0-9][0-9 -]{9,17}[0-9]', '[PHONE]', 'g')) AS masked FROM documents")
def n15(t: Star) -> DataFrame:
    return t.table("documents").select("doc_id", F.sha2(normalize.masked(F.col("text")), 256).alias("masked"))


@query("n16_text_profile", "SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) * 1e0 / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0), 6) AS english, CAST(length(text) AS INTEGER) AS chars, contains(text, 'And therhean is the is') AS boilerplate FROM documents")
def n16(t: Star) -> DataFrame:
    return rounded(t.table("documents").select("doc_id", normalize.english_ratio(F.col("text")).alias("english"), F.length("text").alias("chars"), F.contains("text", F.lit("And therhean is the is")).alias("boilerplate")))


@query("n17_sections", "SELECT p_partkey, nullif(concat_ws(' / ', CASE WHEN p_size > 10 THEN 'name: ' || p_name END, CASE WHEN p_size < 40 THEN 'type: ' || p_type END), '') AS body FROM part")
def n17(t: Star) -> DataFrame:
    return t.table("part").select("p_partkey", normalize.sections({"name": F.when(F.col("p_size") > 10, F.col("p_name")), "type": F.when(F.col("p_size") < 40, F.concat(F.lit(" "), "p_type"))}, " / ").alias("body"))


@query("n18_currency", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'HKD' WHEN c_custkey % 3 = 1 THEN 'CNY' END AS currency FROM customer")
def n18(t: Star) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 3 == 0, "HK$ 100").when(F.col("c_custkey") % 3 == 1, "100 rmb")
    return t.table("customer").select("c_custkey", normalize.currency([raw, F.col("c_mktsegment")]).alias("currency"))


@query("n19_date_until", f"WITH r AS (SELECT o_orderkey, o_orderdate, {DATES} AS raw FROM orders) SELECT o_orderkey, CASE WHEN length(raw) = 10 AND o_orderdate <= TIMESTAMP '1999-12-31' AND CAST(o_orderdate AS DATE) <> DATE '1997-01-01' THEN CAST(o_orderdate AS DATE) END AS value FROM r")
def n19(t: Star) -> DataFrame:
    return t.table("orders").select("o_orderkey", normalize.date_until(spark_dates(), F.lit("1999-12-31").cast("date"), ("1997-01-01",)).alias("value"))


@query("n20_evidence_json", "SELECT p_partkey, CASE WHEN p_size > 10 AND p_size < 40 THEN '{\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}' WHEN p_size > 10 THEN '{\"size\":' || p_size || '}' ELSE '{\"type\":\"' || p_type || '\"}' END AS evidence FROM part WHERE p_size > 10 OR p_size < 40")
def n20(t: Star) -> DataFrame:
    made = normalize.evidence_json({"size": F.when(F.col("p_size") > 10, F.col("p_size")), "type": F.when(F.col("p_size") < 40, F.col("p_type"))})
    return t.table("part").select("p_partkey", made.alias("evidence")).where("evidence is not null")


CATALOGUE = {"the_item": ("the", ["teh", "and the"]), "la_item": ("la", ["les"]), "der_item": ("der", ["das"]), "r_item": ("a", []), "nothing": ("qqqqq", [])}
SHORT = {"r_item": "(?i)(?<![A-Za-z0-9_])a(?=\\s+(?:the|of)\\b)"}
#: The same rules in SQL: item, method, confidence, rank, pattern without look-around.
RULES_SQL = "rules AS (SELECT * FROM (VALUES ('the_item', 'rule_canonical', 0.98e0, 3, 'the'), ('the_item', 'rule_alias', 0.95e0, 2, 'teh'), ('the_item', 'rule_alias', 0.95e0, 2, 'and the'), ('la_item', 'rule_canonical', 0.98e0, 3, 'la'), ('la_item', 'rule_alias', 0.95e0, 2, 'les'), ('der_item', 'rule_canonical', 0.98e0, 3, 'der'), ('der_item', 'rule_alias', 0.95e0, 2, 'das')) r(item, method, confidence, rank, term)), m AS (SELECT doc_id AS id, item, method, confidence, rank FROM documents, rules WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])' || term || '([^A-Za-z0-9_]|$)') UNION ALL SELECT doc_id, 'r_item', 'rule_short_context', 0.90e0, 1 FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])a\\s+(the|of)([^A-Za-z0-9_]|$)')), best AS (SELECT id, item, max_by(method, rank) AS method, max(confidence) AS confidence FROM m GROUP BY 1, 2)"


def _rules(t: Star, catalogue: dict[str, tuple[str, list[str]]], short: dict[str, str]) -> DataFrame:
    frame = t.spark.createDataFrame([(item, name, aliases) for item, (name, aliases) in catalogue.items()], "item string, name string, aliases array<string>")
    return extract.rules_frame(frame, t.spark.createDataFrame(list(short.items()), "item string, pattern string"))


def _matches(t: Star) -> DataFrame:
    return extract.token_matches(t.table("documents"), _rules(t, CATALOGUE, SHORT), "doc_id", "text")


@query("e1_term_boundary", "SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])of the([^A-Za-z0-9_]|$)') AS found FROM documents")
def e1(t: Star) -> DataFrame:
    return t.table("documents").select("doc_id", F.rlike("text", extract.bounded(F.lit("of the"))).alias("found"))


@query("e2_short_context", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])a\\s+(the|of)([^A-Za-z0-9_]|$)')")
def e2(t: Star) -> DataFrame:
    return t.table("documents").where(F.col("text").rlike(SHORT["r_item"])).select("doc_id")


@query("e3_rules", "SELECT DISTINCT p_name AS item, p_name AS term, 'rule_canonical' AS method, 0.98e0 AS confidence, 3 AS rank FROM part UNION ALL SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')), 'rule_alias', 0.95e0, 2 FROM part")
def e3(t: Star) -> DataFrame:
    return extract.rules_frame(t.items.select(F.col("item_id").alias("item"), F.col("item_id").alias("name"), F.split("item_id", " ").alias("aliases"))).drop("pattern")


@query("e4_best_match", f"WITH {RULES_SQL} SELECT id, item, method, confidence FROM best")
def e4(t: Star) -> DataFrame:
    return _matches(t).select("id", "item", "method", "confidence")


@query("e4_catalogue_match", f"WITH {RULES_SQL} SELECT id, item, method, confidence FROM best WHERE item <> 'r_item'")
def e4_catalogue(t: Star) -> DataFrame:
    rules = _rules(t, {item: terms for item, terms in CATALOGUE.items() if item not in SHORT}, {})
    return extract.token_matches(t.table("documents"), rules, "doc_id", "text").select("id", "item", "method", "confidence")


ALIASES_SQL = "WITH s AS (SELECT p_partkey AS id, unnest(string_split(p_name, ' ')) AS term FROM part)"


def _structured(t: Star) -> DataFrame:
    aliases = t.table("part").select(F.explode(F.split("p_name", " ")).alias("term")).distinct().where("term <> 'red'").select(F.lower("term").alias("term"), F.concat(F.lit("item_"), "term").alias("item"))
    return extract.structured(t.table("part").withColumn("listed", F.to_json(F.split(F.upper("p_name"), " "))), aliases, "p_partkey", "listed")


@query("e5_structured_list", ALIASES_SQL + " SELECT DISTINCT id, 'item_' || term AS item, 'structured' AS method, 0.85e0 AS confidence, upper(term) AS matched FROM s WHERE term <> 'red'")
def e5(t: Star) -> DataFrame:
    return _structured(t)


@query("e6_precedence", ALIASES_SQL + ", m AS (SELECT DISTINCT id, 'item_' || term AS item, 'structured' AS method, 0.85e0 AS confidence FROM s WHERE term <> 'red' UNION ALL SELECT p_partkey, 'item_red', 'rule_canonical', 0.98e0 FROM part WHERE contains(p_name, 'red')) SELECT * FROM m")
def e6(t: Star) -> DataFrame:
    rules = _rules(t, {f"item_{w}": (w, []) for w in ("red", "ring", "widget")}, {})
    found = extract.token_matches(t.table("part"), rules, "p_partkey", "p_name")
    return extract.by_precedence([_structured(t), found]).select("id", "item", "method", "confidence")


@query("e7_alias_index", "WITH a AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term, p_name AS item FROM part) SELECT term, count(DISTINCT item) AS items FROM a GROUP BY 1 HAVING count(DISTINCT item) > 1")
def e7(t: Star) -> DataFrame:
    catalogue = t.items.select(F.col("item_id").alias("item"), F.upper(F.split_part("item_id", F.lit(" "), F.lit(1))).alias("name"), F.array(F.split_part("item_id", F.lit(" "), F.lit(2))).alias("aliases"))
    return extract.ambiguous_terms(extract.alias_index(catalogue))


@query("e8_semantic_rules", with_tables("items") + "SELECT item_id AS item, CASE WHEN item_id = 'red ring' THEN 'special' WHEN category = 'ring' THEN 'support' WHEN category = 'widget' THEN 'main' END AS rule FROM items")
def e8(t: Star) -> DataFrame:
    defaults = t.spark.createDataFrame([("ring", "support"), ("widget", "main")], "category string, rule string")
    overrides = t.spark.createDataFrame([("red ring", "special")], "item string, rule string")
    return extract.resolved(t.items.select(F.col("item_id").alias("item"), "category"), defaults, overrides).select("item", "rule")


@query("e9_extraction_report", f"WITH {RULES_SQL} SELECT (SELECT count(*) FROM documents) AS texts, count(DISTINCT id) AS texts_with_items, count(*) AS relations, count(DISTINCT item) AS items FROM best")
def e9(t: Star) -> DataFrame:
    return extract.report(t.table("documents"), _matches(t), "doc_id")
