"""What duplicate records cost: texts are keyed once by all tasks, near titles compared once, prints of few expressions."""

from pyspark.sql import functions as F

from demandlens.functions import similarity
from demandlens.operators import dedup
from demandlens.plans import matching
from demandlens.plans.base import Star


def test_records_are_keyed_once_by_all_tasks(spark, data, monkeypatch):
    calls, plans = [], []
    keyed, written = dedup.keyed, dedup.written
    monkeypatch.setattr(dedup, "keyed", lambda *a, **k: calls.append(k) or keyed(*a, **k))

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(dedup, "written", seen)
    df = matching.varied(Star(spark, data))
    got = {r.record_id: r.unit_mark for r in dedup.united(df).collect()}
    assert got == {r.record_id: r.unit_mark for r in dedup.units(keyed(df)).collect()}
    assert len(calls) == 1 and [n for n, _ in plans] == ["keyed", "united"]
    (_, first), (_, second) = plans
    assert first.index("ArrowEvalPython") < first.index("RepartitionByExpression") and "ArrowEvalPython" not in second
    assert "aggregate(" not in first + second  # no print


def test_near_titles_are_compared_after_repeats_are_gone(spark):
    df = spark.createDataFrame([("k", f"senior data analyst number {i}") for i in range(20)], "k string, title string")
    near = dedup.near_titles(df, ["k"], "title", 90.0)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate")
    assert near.count() == 190


def test_print_has_few_expressions(spark):
    """Threshold of every bit in one step for each sum: no expression for each bit."""
    df = spark.createDataFrame([("a" * 3 * k + "bcd" * k + "ef",) for k in (1, 2, 20, 21, 22, 40, 60)], "t string")
    made = df.select("t", similarity.simhash(F.col("t")).alias("p"))
    assert made._jdf.queryExecution().analyzed().toString().count("CASE WHEN") <= 2
    for r in made.collect():
        hashes = [x.h & (1 << 64) - 1 for x in spark.createDataFrame([(r.t[i : i + 3],) for i in range(len(r.t) - 2)], "g string").select(F.xxhash64("g").alias("h")).collect()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))
        assert r.p & (1 << 64) - 1 == want
