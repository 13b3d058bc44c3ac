"""Sources, contracts, scores, evaluation and streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandlens.operators import evaluate, scoring
from demandlens.sources import contracts, readers
from demandlens.sources.shared import fresh_path, scratch
from demandlens.streaming import incremental


def test_json_lines_reject_what_is_broken(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x y"}\n{broken\n\n{"a": 2}\n', encoding="utf-8")
    good, bad = readers.json_lines(spark, str(tmp_path / "x.jsonl"), "a long, b string", ["a", "b"])
    assert [tuple(r) for r in good.collect()] == [(1, "x y")] and bad.count() == 2


def test_contracts(spark):
    df = spark.createDataFrame([(1,)], "a long")
    c = contracts.Contract(("a",), {"b": "string"})
    assert contracts.conform(df, c).dtypes == [("a", "bigint"), ("b", "string")]
    with pytest.raises(ValueError, match="missing"):
        contracts.conform(df, contracts.Contract(("a", "z")))
    path = fresh_path(spark, "once")
    contracts.write_once(df, path)
    with pytest.raises(Exception, match="exists"):
        contracts.write_once(df, path)


def test_canonical_names(spark):
    df = spark.createDataFrame([("n", 3)], "Title string, amount long")
    assert readers.canonical(df, {"title": ["job_title", "Title"], "pay": ["salary", "amount"], "city": ["city"]}).collect()[0].asDict() == {"title": "n", "pay": "3", "city": None}


def test_confidence_caps_and_missing_parts(spark):
    rows = [(500, 4.0, 3, 20.0, None, 1.0, 500, 0.0, True), (5, 4.0, 3, 20.0, None, 1.0, 5, 0.0, True), (500, 4.0, 1, 20.0, None, 1.0, None, None, True), (500, 4.0, 3, 20.0, None, 1.0, 500, 0.0, False)]
    df = spark.createDataFrame(rows, "sample_size long, effective_sources double, eligible_sources int, p75_age double, newest_age double, date_coverage double, metric_count long, agreement_deviation double, gold boolean")
    got = [(r.confidence, r.level) for r in scoring.confidence(df).collect()]
    assert got == [(100.0, "High"), (40.0, "Low"), (65.0, "Medium"), (60.0, "Medium")]


def test_pareto_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 2, 5), ("d", 3, 9), ("e", 3, 8)], "k string, cost long, signal long")
    assert sorted(r.k for r in scoring.pareto(df, "cost", "signal").collect()) == ["a", "b", "d"]


def test_evaluation_of_empty_parts(spark):
    none = spark.createDataFrame([], "g boolean, p boolean")
    row = evaluate.binary(none, "g", "p").first()
    assert row.tp == 0 and row.precision is None and row.f1 is None
    lists = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "g array<string>, p array<string>")
    row = evaluate.multi_label(lists, "g", "p").first()
    assert row.macro_precision == 0.75 and row.micro_recall == 1.0 and row.exact_match == 0.5
    assert evaluate.gate(row_frame := spark.range(1), {"n": F.lit(False)}, {"q": F.lit(True)}).first()["gate"] == "INSUFFICIENT"
    assert evaluate.gate(row_frame, {"n": F.lit(True)}, {"q": F.lit(None).cast("boolean")}).first()["gate"] == "FAILED"


def test_labels_keep_their_first_date(spark):
    stored = spark.createDataFrame([("a", "old", "x", 1, 1, 1)], "k string, value string, annotator string, annotated_at long, updated_at long, version int")
    new = spark.createDataFrame([("a", "new", "y", 5), ("a", "newer", "y", 6), ("b", "first", "z", 7)], "k string, value string, annotator string, at long")
    rows = {r.k: tuple(r) for r in evaluate.upsert(stored, new, "k").collect()}
    assert rows == {"a": ("a", "newer", "y", 1, 6, 2), "b": ("b", "first", "z", 7, 7, 1)}


def test_stream_equals_batch_and_resumes(spark):
    schema, start = "k long, item string, ts timestamp", datetime(2026, 1, 1)
    rows = [(i % 40, f"i{i % 3}", start + timedelta(hours=i)) for i in range(200)]
    inbox, table, progress = (fresh_path(spark, n) for n in ("in", "out", "progress"))
    df = spark.createDataFrame(rows, schema)
    df.where("k < 20").write.parquet(inbox)
    first = incremental.ingest(spark, inbox, table, progress, schema, ["k"], "ts").count()
    df.where("k >= 20").write.mode("append").parquet(inbox)
    again = incremental.ingest(spark, inbox, table, progress, schema, ["k"], "ts").count()
    assert (first, again) == (20, 40)
    days = incremental.daily_counts(spark, inbox, fresh_path(spark, "days"), fresh_path(spark, "p"), schema, ["k", "item", "ts"], "item", "ts", "1 hour")
    want = {(r.day, r.item): r.n for r in df.groupBy(F.to_date("ts").alias("day"), "item").agg(F.count("*").alias("n")).collect()}
    assert {(r.day, r.item): r.n for r in days.collect()} == want


def test_a_batch_reads_only_the_days_that_it_touches(spark, monkeypatch):
    """Keys repeat across files and restarts; the index files that a batch reads do not grow with the table."""
    schema, start = "k long, item string, ts timestamp", datetime(2026, 1, 1)
    inbox, table, progress = (fresh_path(spark, n) for n in ("in", "out", "progress"))
    read, plain = [], incremental._unseen
    monkeypatch.setattr(incremental, "_unseen", lambda rows, seen, keys: read.append(seen.select(F.col("_metadata.file_path")).distinct().count()) or plain(rows, seen, keys))
    for day in range(12):
        rows = [(10 * day + i, f"d{day}", start + timedelta(days=day, hours=i)) for i in range(10)]
        rows += [(10 * day - 3, "again", start + timedelta(days=day))] * 2  # a key of the day before, twice
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(inbox)
        found = incremental.ingest(spark, inbox, table, progress, schema, ["k"], "ts", within_days=1)
    got = [(r.k, r.item) for r in found.collect()]
    assert sorted(got) == sorted([(10 * d + i, f"d{d}") for d in range(12) for i in range(10)] + [(-3, "again")])
    assert read[0] == 0 and max(read[6:]) <= max(read[2:6])
    for path, keys in ((table, "k long"), (f"{table}_keys", "k long")):
        assert spark.read.schema(f"{keys}, batch long").parquet(path).groupBy("k").count().where("count > 1").count() == 0


def test_a_batch_that_is_run_again_adds_nothing(spark):
    schema, start = "k long, item string, ts timestamp", datetime(2026, 1, 1)
    inbox, table = fresh_path(spark, "in"), fresh_path(spark, "out")
    spark.createDataFrame([(i, "a", start + timedelta(hours=i)) for i in range(50)], schema).write.parquet(inbox)
    # a checkpoint that knows nothing of the batch is what is left if its run failed after the writes
    counts = [incremental.ingest(spark, inbox, table, fresh_path(spark, "progress"), schema, ["k"], "ts").count() for _ in range(2)]
    assert counts == [50, 50]
    table = fresh_path(spark, "days")
    days = [sorted(map(tuple, incremental.daily_counts(spark, inbox, table, fresh_path(spark, "progress"), schema, ["k"], "item", "ts").collect())) for _ in range(2)]
    assert days[0] == days[1] and sum(n for _, _, n, _ in days[0]) == 50


def test_a_key_on_two_days_counts_on_both_and_is_not_late(spark):
    schema, start = "k long, item string, ts timestamp", datetime(2026, 1, 1)
    rng = random.Random(3)
    rows = [(rng.randrange(30), rng.choice("ab"), start + timedelta(hours=rng.randrange(240))) for _ in range(400)] + [(5, "a", None)]
    inbox, table, progress = (fresh_path(spark, n) for n in ("in", "days", "p"))
    latest, late, seen = None, {}, set()
    for k in range(0, 401, 100):  # four shuffled landings
        part = rows[k : k + 100]
        spark.createDataFrame(part, schema).write.mode("append").parquet(inbox)
        found = incremental.daily_counts(spark, inbox, table, progress, schema, ["k"], "item", "ts", "2 days")
        for key, item, ts in part:
            if ts is not None and (ts.date(), item, key) not in seen:
                seen.add((ts.date(), item, key))
                over = latest is not None and datetime.combine(ts.date(), datetime.min.time()) + timedelta(days=1) <= latest - timedelta(days=2)
                late[ts.date(), item] = late.get((ts.date(), item), 0) + over
        latest = max([ts for *_, ts in part if ts is not None] + ([latest] if latest else []))
    want = {}
    for day, item, _ in seen:
        want[day, item] = want.get((day, item), 0) + 1
    assert {(r.day, r.item): (r.n, r.late) for r in found.collect()} == {d: (n, late[d]) for d, n in want.items()}
    assert sum(late.values()) > 0


def test_replaced_tables_are_whole_at_any_time(spark):
    root = fresh_path(spark, "table")
    with pytest.raises(FileNotFoundError):
        contracts.current(spark, root)
    assert contracts.replace(spark.range(10), root) == 1

    @F.udf("long")
    def stops(i):
        if i == 57:
            raise RuntimeError("killed half-way")
        return i

    reader = contracts.current(spark, root)
    with pytest.raises(Exception, match="killed half-way"):
        contracts.replace(spark.range(0, 100, 1, 10).select(stops("id").alias("id")), root)
    assert contracts.current(spark, root).count() == 10
    with pytest.raises(ValueError, match="expected"):
        contracts.replace(spark.range(5), root, expected_rows=6)
    # a manifest that its writer could not finish is no version, and its number is left out
    spark.createDataFrame([('{"path": "/tm',)], "value string").coalesce(1).write.text(f"{root}/manifests/2.json")
    assert contracts.current(spark, root).count() == 10
    assert contracts.replace(spark.range(20), root) == 3
    assert contracts.current(spark, root).count() == 20 and reader.count() == 10
    assert [v["rows"] for v in contracts.versions(spark, root)] == [10, 20]
    assert contracts.vacuum(spark, root, keep=1) >= 2 and contracts.current(spark, root).count() == 20


def test_counts_come_from_the_write(spark):
    df = spark.createDataFrame([("a", 1), (" ", 2), (None, 3), ("b", -4)], "t string, n int")
    path = fresh_path(spark, "accepted")
    counts = readers.import_counted(df, ["t"], path, {"negative": F.col("n") < 0})
    assert counts == {"raw": 4, "accepted": 2, "rejected": 2, "negative": 1} and spark.read.parquet(path).count() == 2
    assert readers.import_counted(df.limit(0), ["t"], fresh_path(spark, "none"))["raw"] == 0


def test_daily_counts_have_open_days_and_late_rows(spark):
    schema, start = "k long, item string, ts timestamp", datetime(2026, 1, 1)
    inbox, table, progress = (fresh_path(spark, n) for n in ("in", "days", "p"))
    df = spark.createDataFrame([(i % 40, f"i{i % 3}", start + timedelta(hours=i)) for i in range(200)], schema)
    tardy = spark.createDataFrame([(99, "i0", start), (98, "i9", start + timedelta(hours=30)), (0, "i0", start)], schema)  # the last one is a copy

    def counts():
        return {(r.day, r.item): (r.n, r.late) for r in incremental.daily_counts(spark, inbox, table, progress, schema, ["k", "item", "ts"], "item", "ts", "1 hour").collect()}

    def batch(rows):
        return {(r.day, r.item): r.n for r in rows.distinct().groupBy(F.to_date("ts").alias("day"), "item").agg(F.count("*").alias("n")).collect()}

    df.write.parquet(inbox)
    first = counts()
    assert {k: n for k, (n, _) in first.items()} == batch(df) and not any(late for _, late in first.values())
    tardy.write.mode("append").parquet(inbox)
    again = counts()
    assert {k: n for k, (n, _) in again.items()} == batch(df.union(tardy))
    assert {k: late for k, (_, late) in again.items() if late} == {(start.date(), "i0"): 1, (start.date() + timedelta(days=1), "i9"): 1}


def test_ingest_keeps_late_rows_and_null_keys(spark):
    schema, start = "k long, item string, ts timestamp", datetime(2026, 1, 1)
    inbox, table, progress = (fresh_path(spark, n) for n in ("in", "out", "progress"))
    for rows in ([(1, "a", start), (1, "b", start - timedelta(days=3)), (None, "n", start)], [(2, "old", start - timedelta(days=3000)), (1, "c", start), (None, "m", start)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(inbox)
        found = incremental.ingest(spark, inbox, table, progress, schema, ["k"], "ts")
    assert {(r.k, r.item) for r in found.collect()} == {(1, "b"), (None, "n"), (2, "old")}


def test_scratch_is_cleared(spark):
    with scratch(spark):
        path = fresh_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
