"""Queries that join and count records: no hashed ids on the way, and the rows of their SQL also where keys are null, repeated or share a record id."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from demandlens.functions.similarity import simhash
from demandlens.operators import dedup, evaluate, holdings
from demandlens.plans import base, matching, publish, registry
from demandlens.plans.base import Star
from tests.test_oracles import TABLES, plain

NAMES = [
    "a12_balanced_demand",
    "a38_source_catalogue",
    "a40_source_evidence_maps",
    "a13_source_eligibility",
    "a29_agreement",
    "j4_densified",
    "a6_source_demand",
    "w2_partition_mean",
    "a11_sliced_demand",
    "t3_top_coverage",
    "a34_inventory",
    "a33_scope_counts",
    "a30_divergence",
    "q5_multi_label",
]


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    """Test tables with odd lines: null keys whose record ids coincide, the same line with two dates, suppliers and parts that are not there."""
    at = tmp_path_factory.mktemp("odd")
    for t in TABLES:
        shutil.copy(f"{data}/{t}.parquet", f"{at}/{t}.parquet")
    con = duckdb.connect()
    old = f"(SELECT * FROM '{data}/lineitem.parquet' WHERE l_orderkey < 200)"
    more = " UNION ALL ".join(f"SELECT * REPLACE ({x}) FROM {old}" for x in (
        "CAST(NULL AS BIGINT) AS l_partkey, l_linenumber AS l_suppkey, l_suppkey % 10 AS l_linenumber", "CAST(NULL AS BIGINT) AS l_suppkey", "CAST(NULL AS INTEGER) AS l_linenumber", "1 AS l_partkey, CAST(NULL AS BIGINT) AS l_suppkey, 2 AS l_linenumber",
        "CAST(NULL AS BIGINT) AS l_partkey, 1 AS l_suppkey, 2 AS l_linenumber", "CAST(NULL AS BIGINT) AS l_orderkey", "l_shipdate + INTERVAL 3 DAY AS l_shipdate", "l_tax + 1 AS l_tax", "l_suppkey + 1000000 AS l_suppkey", "l_partkey + 1000000 AS l_partkey",
    ))
    con.execute(f"COPY (SELECT * FROM '{data}/lineitem.parquet' UNION ALL {more}) TO '{at}/lineitem.parquet'")
    con.execute(f"COPY (SELECT * FROM '{data}/part.parquet' UNION ALL SELECT * REPLACE (p_name || ' too' AS p_name) FROM '{data}/part.parquet' WHERE p_partkey % 7 = 1) TO '{at}/part.parquet'")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_odd_lines(spark, odd, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet'")
    df = registry.QUERIES[name](spark, odd)
    assert "sha2(cast(concat_ws" not in df._jdf.queryExecution().optimizedPlan().toString()  # before, it was there or in the lines that were written
    columns = sorted(df.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(tuple(map(plain, r))) for r in con.execute(f"SELECT {picked} FROM ({registry.ORACLES[name]}) q").fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_written_lines_have_no_hash(spark, data):
    t = Star(spark, data).once()
    assert "record_id" not in t._lines.columns
    assert t.evidence.where("length(record_id) > 40").count() == 0


def test_evidence_is_the_join(spark, odd):
    t = Star(spark, odd).once()
    columns = ["entity_id", "record_id", "item_id", "source_id", "observed_at"]
    want = t.counted().entity_items.join(t.counted().source_map, ["entity_id", "record_id"]).select(columns)
    assert not want.exceptAll(t.evidence.select(columns)).count() and not t.evidence.select(columns).exceptAll(want).count()
    assert not t.counted().evidence.select(columns).distinct().exceptAll(want).count()


def test_grams_are_hashed_once(spark):
    texts = ["", "ab", "abc", "abcd" * 31, "x" * 129, "xy" * 65, "é中" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    text = df.select(simhash(F.col("t")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert text.count("xxhash64(") == 1

    for r in df.select("t", simhash(F.col("t")).alias("p")).collect():
        hashes = [h["h"] for h in spark.createDataFrame([(r.t[i : i + 3],) for i in range(len(r.t) - 2)] or [("",)], "g string").select(F.xxhash64("g").alias("h")).collect()]
        bits = [2 * sum(h >> k & 1 for h in hashes) >= len(hashes) for k in range(64)]
        word = sum(1 << k for k in range(64) if bits[k])
        assert r.p == (None if len(r.t) < 3 else word - (1 << 64) * (word >> 63))


def test_prints_of_units_only(spark, data, monkeypatch):
    seen = {}
    write = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    dedup.deduplicate(matching.records(Star(spark, data)))
    assert "print" not in seen["keyed"].columns and "print" in seen["units"].columns


@pytest.mark.parametrize("name", ["a38_source_catalogue", "a13_source_eligibility"])
def test_source_counts_write_no_lines(spark, odd, name, monkeypatch):
    rows, write, count = {}, base.written, base.written_counted

    def counted(df, at):
        out, rows[at] = count(df, at)
        return out, rows[at]

    monkeypatch.setattr(base, "written", lambda df, at: rows.setdefault(at, 0) or write(df, at))
    monkeypatch.setattr(base, "written_counted", counted)
    assert registry.QUERIES[name](spark, odd).count() == 5
    assert "lines" not in rows and 0 < rows["repeating"] < Star(spark, odd).table("lineitem").count() / 2


@pytest.mark.parametrize("most", [0, base.MOST_ROWS])
def test_marked_lines_are_the_same_unwritten(spark, odd, most, monkeypatch):
    monkeypatch.setattr(base, "MOST_ROWS", most)
    t, columns = Star(spark, odd).counted(), ["entity_id", "record_id", "source_id", "observed_at", "has_items"]
    want, found = t.once().marked.select(columns), t.marked.select(columns)
    assert not want.exceptAll(found).count() and not found.exceptAll(want).count()
    counts = {r.source_id: r.n for r in want.groupBy("source_id").agg(F.countDistinct("record_id").alias("n")).collect()}
    assert {r.source_id: r.record_count for r in t.record_counts.collect()} == counts


def test_part_bits(spark, tmp_path):
    keys = [-(2**62), -65, -64, -1, 0, 63, 64, 64, None, 2**62]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    near = sorted({k + d for k in keys if k is not None for d in (-1, 0, 1)})
    found = Star(spark, str(tmp_path))._with_parts(spark.createDataFrame([(k,) for k in [*near, None]], "l_partkey long")).collect()
    assert {r.l_partkey: r.has_items for r in found} == {k: k is not None and k in keys for k in [*near, None]} and len(found) == len(near) + 1


@pytest.fixture(scope="module")
def broken(odd, tmp_path_factory):
    """The odd tables with two lines of one record id, orders that are not there, there twice or without a sane total, a region and parts without a name."""
    at = tmp_path_factory.mktemp("broken")
    for t in TABLES:
        shutil.copy(f"{odd}/{t}.parquet", f"{at}/{t}.parquet")
    con = duckdb.connect()
    for table, rows in {
        "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 40 = 1 THEN -1 ELSE o_totalprice END AS o_totalprice) FROM '{}' WHERE o_orderkey % 9 <> 4 UNION ALL SELECT * FROM '{}' WHERE o_orderkey % 50 = 7 UNION ALL SELECT * REPLACE (CAST(NULL AS BIGINT) AS o_orderkey) FROM '{}' WHERE o_orderkey < 5",
        "region": "SELECT * REPLACE (CASE WHEN r_name <> 'ASIA' THEN r_name END AS r_name) FROM '{}'",
        "lineitem": "SELECT * FROM '{}' UNION ALL SELECT * EXCLUDE (x, y) REPLACE (CAST(x AS BIGINT) AS l_orderkey, 1 AS l_partkey, 1 AS l_suppkey, CAST(y AS INTEGER) AS l_linenumber) FROM (SELECT * FROM '{}' LIMIT 1), (VALUES (1, NULL), (NULL, 1)) v(x, y)",
        "part": "SELECT * REPLACE (CASE WHEN p_partkey % 30 <> 2 THEN p_name END AS p_name) FROM '{}'",
    }.items():
        con.execute(f"COPY ({rows.replace('{}', f'{odd}/{table}.parquet')}) TO '{at}/{table}.parquet'")
    return str(at)


@pytest.mark.parametrize("most", [0, base.MOST_ROWS])
def test_data_tests_look_at_doubtful_lines(spark, odd, broken, most, monkeypatch):
    monkeypatch.setattr(base, "MOST_ROWS", most)
    rows, write = {}, base.written

    def kept(df, name):
        rows[name] = write(df, name)
        return rows[name]

    monkeypatch.setattr(base, "written", kept)
    for at in (odd, broken):
        rows.clear()
        t = Star(spark, at)
        want = {r.test: r.violations for r in evaluate.star_checks(t.entities, t.source_map, t.items, t.entity_items).collect()}
        assert {r.test: r.violations for r in registry.QUERIES["q1_data_tests"](spark, at).collect()} == want
        lines = t.table("lineitem").count()
        assert rows["doubtful_records"].count() < lines and rows["doubtful_relations"].count() < lines / 2
        assert rows["doubtful_records"].where("length(record_id) > 40").count() == 0
    assert want["records_unique"] > 0 and want["relations_unique"] > 0 and want["entities_unique"] > 0 and want["records_source_present"] > 0 and want["records_reference"] > 0 and want["relations_reference"] > 0


def test_clean_lines_are_not_doubtful(spark, data):
    t = Star(spark, data).counted()
    assert t.doubtful_records(t.entities).count() < t.table("lineitem").count() / 1000 and t.doubtful_relations.count() == 0


@pytest.mark.parametrize("most", [0, base.MOST_ROWS])
def test_published_snapshot_of_odd_lines(spark, odd, broken, most, monkeypatch):
    monkeypatch.setattr(base, "MOST_ROWS", most)
    at = odd if most else broken
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    names = []
    for module in (base, holdings, publish):
        monkeypatch.setattr(module, "written", lambda df, name, write=module.written: names.append(name) or write(df, name))
    df = registry.QUERIES["a35_publish_all"](spark, at)
    columns = sorted(df.columns)
    want = sorted(repr(tuple(map(plain, r))) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES['a35_publish_all']}) q").fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want
    assert "holdings" in names and not {"lines", "pairs"} & set(names)


def test_entities_meet_their_lines_once(spark, odd):
    t = Star(spark, odd).counted()
    held = holdings.holdings(t.cells, t.entities, t.sent)
    assert held.count() == t.evidence.select("entity_id").union(t.pairs.select("entity_id")).where("entity_id is not null").distinct().union(
        t.source_map.select("entity_id").where("entity_id is not null").distinct()).distinct().count()
    busy = holdings.holdings(t.cells, t.entities, t.sent, 0)
    assert busy.selectExpr("max(size(cells))").first()[0] <= held.selectExpr("max(size(cells))").first()[0]
    for count in (holdings.records, holdings.supports, holdings.co_counts, holdings.evidence):
        a, b = count(held), count(busy)
        assert a.count() and not a.exceptAll(b).count() and not b.exceptAll(a).count()
