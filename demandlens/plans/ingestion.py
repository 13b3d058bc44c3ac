"""Queries of sources and sinks (S) and of streams (R). Files that they write and read again go to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.functions import normalize
from demandlens.plans.base import Star, query, rounded
from demandlens.sources import contracts, readers
from demandlens.sources.shared import fresh_path
from demandlens.streaming import incremental


@query("s1_csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def s1(t: Star) -> DataFrame:
    path = fresh_path(t.spark, "customers")
    t.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(path)
    return readers.csv(t.spark, path)


@query("s2_parquet_scan", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000")
def s2(t: Star) -> DataFrame:
    return t.table("orders").where("o_totalprice > 100000").select("o_orderkey", "o_orderpriority")


@query("s3_format_dispatch", "SELECT s_suppkey, s_name FROM supplier")
def s3(t: Star) -> DataFrame:
    return readers.by_suffix(t.spark, f"{t.at}/supplier.parquet").select("s_suppkey", "s_name")


@query("s4_directory_scan", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name FROM part")
def s4(t: Star) -> DataFrame:
    path = fresh_path(t.spark, "parts")
    t.table("part").select("p_partkey", "p_name").repartition(3, "p_partkey").write.option("header", True).csv(path)
    return readers.directory(t.spark, path, ".csv").select("p_partkey", "p_name")


@query("s5_evolving_union", "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier")
def s5(t: Star) -> DataFrame:
    a = t.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return readers.evolving_union([a, t.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))])


@query("s6_nested_json", "SELECT c_mktsegment, c_custkey, c_name FROM customer WHERE c_custkey % 13 <> 0")
def s6(t: Star) -> DataFrame:
    path = fresh_path(t.spark, "nested")
    name = F.when(F.col("c_custkey") % 13 != 0, F.col("c_name"))
    t.table("customer").groupBy("c_mktsegment", (F.col("c_custkey") % 50).alias("part")).agg(F.collect_list(F.struct("c_custkey", name.alias("c_name"))).alias("rows")).write.json(path)
    whole = t.spark.read.schema("c_mktsegment string, rows array<struct<c_custkey:bigint,c_name:string>>").json(path)
    return readers.nested(whole, "rows", ["c_custkey", "c_name"], ["c_name"], ["c_mktsegment"])[0]


@query("s7_json_lines", "SELECT p_partkey, p_name FROM part WHERE p_partkey % 17 NOT IN (0, 1)")
def s7(t: Star) -> DataFrame:
    path = fresh_path(t.spark, "lines")
    row = F.to_json(F.struct("p_partkey", F.when(F.col("p_partkey") % 17 != 1, F.concat("p_name", F.lit(" "))).alias("p_name")))
    t.table("part").select(F.when(F.col("p_partkey") % 17 == 0, F.concat(F.lit("{broken "), row)).otherwise(row)).write.text(path)
    good, _ = readers.json_lines(t.spark, path, "p_partkey bigint, p_name string", ["p_partkey", "p_name"])
    return good.select("p_partkey", F.regexp_replace("p_name", " ", "").alias("p_name"))


@query("s8_section_concat", "SELECT p_partkey, CASE WHEN p_name = p_type THEN p_name ELSE concat_ws(' / ', p_name, CASE WHEN p_size > 20 THEN p_type END, CASE WHEN p_brand <> p_name THEN p_brand END) END AS body FROM part")
def s8(t: Star) -> DataFrame:
    parts = [F.col("p_name"), F.when(F.col("p_size") > 20, F.concat(F.lit(" "), "p_type")).otherwise(" "), F.col("p_name"), F.col("p_brand")]
    return t.table("part").select("p_partkey", readers.section_concat(parts, " / ").alias("body"))


@query("s9_json_filter", "SELECT event_id FROM events WHERE CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) = 42")
def s9(t: Star) -> DataFrame:
    return readers.json_filter(t.table("events"), "props", "$.k", "42").select("event_id")


@query("s10_snapshot_mapping", "SELECT c_custkey, sha256('+' || c_name || '|' || CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE '+' || c_mktsegment END) AS identity, CASE WHEN c_acctbal > 0 THEN round(c_acctbal / 12, 4) END AS low, CASE WHEN c_acctbal > 0 THEN round((c_acctbal + 50) / 12, 4) END AS high FROM customer")
def s10(t: Star) -> DataFrame:
    money = normalize.monthly(F.col("c_acctbal"), F.col("c_acctbal") + 50, F.lit("year"))
    mapped = t.table("customer").select("c_custkey", readers.identity([F.col("c_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))]).alias("identity"), money.alias("m"))
    return rounded(mapped.select("c_custkey", "identity", "m.low", "m.high"), 4)


@query("s11_provenance", "SELECT s_suppkey AS record, s_name AS raw_input__source_id, 'crm' AS source_id, 'run-1' AS run_id FROM supplier")
def s11(t: Star) -> DataFrame:
    raw = t.table("supplier").select("s_suppkey", F.col("s_name").alias("source_id"))
    made = readers.with_provenance(raw, {"s_suppkey": "record"}, "crm", "run-1", "2024-01-01T00:00:00Z", "0" * 64)
    return made.select("record", "raw_input__source_id", "source_id", "run_id")


@query("s13_idempotent_import", "SELECT CAST(0 AS BIGINT) AS again, CAST(0 AS BIGINT) AS unaccounted, true AS some")
def s13(t: Star) -> DataFrame:
    path = fresh_path(t.spark, "inbox")
    t.table("part").select("p_partkey", "p_name").repartition(4, "p_partkey").write.parquet(path)
    found = contracts.artifacts(t.spark, path, "*.parquet")
    done = found.where(F.crc32("sha256") % 2 == 0)
    again, new, there = (df.agg(F.count("*").alias(n)) for df, n in ((contracts.new_artifacts(found, found, "approved"), "again"), (contracts.new_artifacts(found, done, "approved"), "new"), (done, "done")))
    one = again.crossJoin(new).crossJoin(there).crossJoin(found.agg(F.count("*").alias("found")))  # one row each
    return one.select("again", (F.col("found") - F.col("new") - F.col("done")).alias("unaccounted"), (F.col("found") > 0).alias("some"))


@query("s14_accounting", "SELECT count(*) AS raw, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS accepted, count(*) FILTER (WHERE c_custkey % 3 = 0) AS rejected, count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_acctbal < 0) AS in_debt, count(*) FILTER (WHERE c_custkey % 3 <> 0) AS there FROM customer")
def s14(t: Star) -> DataFrame:
    raw, path = t.table("customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise(" ")), fresh_path(t.spark, "accepted")
    counts = readers.import_counted(raw, ["c_name"], path, {"in_debt": F.col("c_acctbal") < 0})
    return t.spark.read.parquet(path).agg(*[F.lit(counts[c]).cast("long").alias(c) for c in ("raw", "accepted", "rejected", "in_debt")], F.count("*").alias("there"))


@query("s15_keep_first", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def s15(t: Star) -> DataFrame:
    rows = t.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority")
    return readers.keep_first(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("s16_row_hash", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || '}') AS h FROM nation JOIN (SELECT DISTINCT c_nationkey FROM customer) ON c_nationkey = n_nationkey")
def s16(t: Star) -> DataFrame:
    used = t.table("nation").join(t.table("customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select("n_nationkey", "n_name")
    return used.select("n_nationkey", readers.row_hash(used).alias("h"))


@query("s17_write_once", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def s17(t: Star) -> DataFrame:
    path = fresh_path(t.spark, "once")
    contracts.write_once(t.table("customer").where("c_acctbal > 5000").select("c_custkey", "c_name"), path)
    return t.spark.read.parquet(path)


@query("s17_atomic_replace", "SELECT c_custkey, c_name, CAST(2 AS BIGINT) AS versions FROM customer WHERE c_acctbal <= 5000")
def s17_replace(t: Star) -> DataFrame:
    root, rows = fresh_path(t.spark, "replaced"), t.table("customer").select("c_custkey", "c_name", "c_acctbal")
    contracts.replace(rows.where("c_acctbal > 5000"), root)
    contracts.replace(rows.where("c_acctbal <= 5000"), root)
    return contracts.current(t.spark, root).select("c_custkey", "c_name", F.lit(len(contracts.versions(t.spark, root))).cast("long").alias("versions"))


def _reported(t: Star, kind: str) -> DataFrame:
    path = fresh_path(t.spark, kind)
    contracts.write_report(t.entities.groupBy("role_id").agg(F.count("*").alias("n")).orderBy("role_id"), path, kind)
    back = t.spark.read.json(path) if kind == "json" else readers.csv(t.spark, path)
    return back.select("role_id", F.col("n").cast("long").alias("n"))


query("s18_json_report", "SELECT o_orderpriority AS role_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")(lambda t: _reported(t, "json"))
query("s19_csv_report", "SELECT o_orderpriority AS role_id, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")(lambda t: _reported(t, "csv"))


@query("s20_back_filled_view", "SELECT p_partkey, p_name, NULL::VARCHAR AS p_comment FROM part WHERE p_size < 5")
def s20(t: Star) -> DataFrame:
    contracts.register(t.spark, f"{t.at}/part.parquet", "part_with_comment", contracts.Contract(("p_partkey", "p_name", "p_size"), {"p_comment": "string"}))
    return t.spark.table("part_with_comment").where("p_size < 5").select("p_partkey", "p_name", "p_comment")


@query("s21_contract_check", "SELECT count(*) AS n, 'o_clerk' AS missing FROM orders")
def s21(t: Star) -> DataFrame:
    gone = contracts.missing(t.table("orders"), contracts.Contract(("o_orderkey", "o_clerk")))
    return t.table("orders").agg(F.count("*").alias("n")).withColumn("missing", F.lit(",".join(gone)))


@query("s23_source_status", "WITH m AS (SELECT r_name AS source_id, max(CAST(l_shipdate AS DATE)) AS last_sync, count(*) AS record_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1) SELECT r_name AS source_id, last_sync, CAST(coalesce(record_count, 0) AS BIGINT) AS record_count, CASE WHEN last_sync IS NULL THEN 'never' WHEN date_diff('day', last_sync, DATE '2001-10-15') <= 30 THEN 'fresh' ELSE 'stale' END AS status FROM region LEFT JOIN m ON source_id = r_name")
def s23(t: Star) -> DataFrame:
    sources = t.table("supplier").join(t.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'")
    runs = t.table("lineitem").join(sources, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("r_name").alias("source_id"), F.col("l_shipdate").cast("date").alias("imported_at")).agg(F.count("*").alias("record_count"))
    return contracts.source_status(t.table("region").select(F.col("r_name").alias("source_id")), runs, "2001-10-15").select("source_id", "last_sync", "record_count", "status")


@query("s25_merged_manifests", "SELECT source_id, run_id, load_order, record_count FROM (SELECT o_orderpriority AS source_id, o_custkey % 10 AS run_id, o_orderkey AS load_order, o_totalprice AS record_count, row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 10 ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def s25(t: Star) -> DataFrame:
    m = t.table("orders").select(F.col("o_orderpriority").alias("source_id"), (F.col("o_custkey") % 10).alias("run_id"), F.col("o_orderkey").alias("load_order"), F.col("o_totalprice").alias("record_count"))
    return contracts.merged_manifests(m)


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _landings(t: Star) -> list[DataFrame]:
    """Events in four landings by their time of arrival. A fifth come a second time with another value, a day and an hour later, and a seventh
    of all rows arrives ten days after its time."""
    events = t.table("events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    again = events.where("event_id % 5 = 0").withColumns({"ts": F.col("ts") + F.expr("interval 25 hours"), "value": F.col("value") + 1})
    tardy = F.when(F.col("event_id") % 7 == 3, F.expr("interval 10 days")).otherwise(F.expr("interval 0 days"))
    landed = events.unionByName(again).withColumn("at", F.unix_micros(F.col("ts") + tardy))
    ends = landed.agg(F.min("at").alias("lo"), F.max("at").alias("hi")).first()
    part = F.expr(f"(at - {ends['lo']}) * 4 div {ends['hi'] - ends['lo'] + 1}")
    return [landed.where(part == k).drop("at") for k in range(4)]


#: The landings in SQL: rows with their part, and the latest time that earlier parts had before it.
LANDED = """landed AS (SELECT *, epoch_us(ts + CASE WHEN event_id % 7 = 3 THEN INTERVAL 10 DAY ELSE INTERVAL 0 DAY END) AS came FROM (
  SELECT event_id, ts, user_id, event_type, value FROM events UNION ALL SELECT event_id, ts + INTERVAL 25 HOUR, user_id, event_type, value + 1 FROM events WHERE event_id % 5 = 0
)), parts AS (SELECT *, (came - (SELECT min(came) FROM landed)) * 4 // (SELECT max(came) - min(came) + 1 FROM landed) AS part FROM landed),
edges AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS edge FROM parts GROUP BY part)"""


@query("r1_incremental_ingest", f"WITH {LANDED} SELECT event_id, first(user_id ORDER BY part, ts) AS user_id, first(event_type ORDER BY part, ts) AS event_type, first(value ORDER BY part, ts) AS value FROM parts GROUP BY 1")
def r1(t: Star) -> DataFrame:
    inbox, table, checkpoint = fresh_path(t.spark, "landing"), fresh_path(t.spark, "bronze"), fresh_path(t.spark, "progress")
    for rows in _landings(t):  # each run goes on where the last one stopped
        rows.write.mode("append").parquet(inbox)
        found = incremental.ingest(t.spark, inbox, table, checkpoint, EVENTS, ["event_id"], "ts", within_days=2)
    return found.select("event_id", "user_id", "event_type", "value")


@query("r2_daily_counts", f"WITH {LANDED}, f AS (SELECT CAST(ts AS DATE) AS day, event_type, event_id, min(part) AS part FROM parts GROUP BY ALL) SELECT day, event_type, count(*) AS n, count(*) FILTER (WHERE day + INTERVAL 1 DAY <= edge) AS late FROM f JOIN edges USING (part) GROUP BY ALL")
def r2(t: Star) -> DataFrame:
    inbox, table, checkpoint = fresh_path(t.spark, "landing"), fresh_path(t.spark, "days"), fresh_path(t.spark, "progress")
    for rows in _landings(t):
        rows.write.mode("append").parquet(inbox)
        found = incremental.daily_counts(t.spark, inbox, table, checkpoint, EVENTS, ["event_id"], "event_type", "ts")
    return found
