"""Metrics, trends, graphs, fit and effects on tiny tables with values worked out by hand."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.operators import effects, fit, graph, metrics, ranking, scoring, slices, trend
from demandlens.operators.slices import Slice

ENTITIES = "entity_id string, role_id string, city_code string, experience_band string, education_band string, event_date date, measure double, market_scope string, company_id string"


@pytest.fixture(scope="module")
def tiny(spark):
    entities = spark.createDataFrame([
        ("job-1", "data_analyst", "CN-110000", "mid", "bachelor", date(2026, 8, 1), 10000.0, "target", "c1"), ("job-2", "backend_engineer", "CN-110000", "senior", "master", date(2026, 8, 15), 30000.0, "target", "c2"), ("job-3", "data_analyst", "CN-310000", "entry", "bachelor", date(2026, 9, 1), None, "target", "c3"),
    ], ENTITIES)
    source_map = spark.createDataFrame([("job-1", "s1", "a"), ("job-2", "s2", "b"), ("job-2", "s3", "a"), ("job-3", "s4", "b")], "entity_id string, record_id string, source_id string")
    items = spark.createDataFrame([("python", "language"), ("sql", "language"), ("excel", "tool")], "item_id string, category string")
    relations = spark.createDataFrame([("job-1", "s1", "python"), ("job-1", "s1", "sql"), ("job-2", "s2", "sql"), ("job-2", "s3", "python"), ("job-3", "s4", "sql")], "entity_id string, record_id string, item_id string")
    return entities, source_map, items, relations


def test_demand_counts_entities_once(tiny):
    entities, source_map, items, relations = tiny
    rows = {r.item_id: r for r in metrics.demand(entities, source_map, relations, items).collect()}
    assert rows["python"].coverage == pytest.approx(2 / 3) and rows["sql"].coverage == 1.0 and rows["excel"].entity_count == 0
    only_a = {r.item_id: r for r in metrics.demand(entities, source_map, relations, items, Slice(sources=("a",))).collect()}
    assert only_a["sql"].entity_count == 1 and only_a["sql"].sample_size == 2  # evidence of other sources does not count


def test_measure_by_item_keeps_unavailable_apart_from_zero(tiny):
    entities, _, items, relations = tiny
    rows = {r.item_id: r for r in metrics.measure_by_item(entities, relations.select("entity_id", "item_id").distinct(), items).collect()}
    assert (rows["python"]["median"], rows["python"].p25, rows["python"].p75) == (20000, 15000, 25000)
    assert rows["excel"].status == "unavailable" and rows["excel"]["median"] is None


def test_balanced_demand_needs_two_sources(spark, tiny):
    entities, source_map, items, relations = tiny
    for eligible, want in ((("a", "b"), 0.5), (("a",), None)):
        judged = spark.createDataFrame([(s, s in eligible) for s in "ab"], "source_id string, eligible boolean")
        rows = {(r.item_id, r.source_id): r for r in metrics.balanced_demand(entities, source_map, relations, items, judged).collect()}
        assert rows["python", "a"].coverage == 1.0 and rows["python", "b"].coverage == 0.0 and rows["python", "a"].pooled_coverage == pytest.approx(2 / 3)
        assert rows["python", "a"].balanced_coverage == want


def test_eligibility_gives_reasons_in_order(spark):
    sources = spark.createDataFrame([("x", "reference", 10, 100, 2, date(2020, 1, 1)), ("y", "core_market", 80, 100, 60, date(2026, 6, 1)), ("z", None, 0, 0, 0, None)], "source_id string, source_role string, target_count long, all_count long, with_items long, newest date")
    rows = {r.source_id: r for r in metrics.eligibility(sources, metrics.Guardrails(), "2026-08-01").collect()}
    assert rows["x"].reasons == ["source_role", "sample_size", "target_share", "item_coverage", "freshness"] and rows["y"].eligible and not rows["z"].eligible


def test_slices(tiny):
    entities, source_map, _, _ = tiny
    assert slices.select(entities, source_map, Slice(equal={"role_id": "data_analyst"}, date_from="2026-08-01", date_to="2026-08-31")).count() == 1
    assert slices.select(entities, source_map, Slice(scope="target")).count() == 3 and slices.select(entities, source_map, Slice(scope="non_target")).count() == 0
    assert slices.recent_closed(entities, "2026-08-15", 14).count() == 2 and slices.recent_open(entities, "2026-08-15", 14).count() == 3
    empty = slices.metadata(entities.limit(0), source_map).first()
    assert (empty.sample_size, empty.source_count, empty.date_from) == (0, 0, None)


def test_divergence(spark):
    counts = spark.createDataFrame([("a", "x", 5), ("a", "y", 5), ("b", "x", 5), ("b", "y", 5), ("c", "z", 3)], "source_id string, category string, n long")
    assert metrics.divergence(counts, "a", "b").first()[0] == 0.0
    assert metrics.divergence(counts, "a", "c").first()[0] == pytest.approx(1.0)
    assert metrics.divergence(counts, "a", "none").first()[0] == 1.0 and metrics.divergence(counts, "m", "n").first()[0] == 0.0


def months(spark, counts, n):
    rows, pairs = [], []
    for m, k in enumerate(counts):
        for i in range(n):
            rows.append((f"{m}-{i}", date(2026, m + 1, 5)))
            if i < k:
                pairs.append((f"{m}-{i}", "python"))
    return spark.createDataFrame(rows, "entity_id string, event_date date"), spark.createDataFrame(pairs, "entity_id string, item_id string"), spark.createDataFrame([("python",)], "item_id string")


@pytest.mark.parametrize(("counts", "n", "label"), [([0, 0, 0, 0, 1, 2, 3], 20, "Emerging"), ([2, 2, 4, 6, 8, 10, 12], 20, "Growing"), ([6] * 7, 20, "Mature"), ([2] * 7, 20, "Stable"), ([12, 10, 8, 6, 4, 2, 1], 20, "Declining"), ([1] * 7, 40, "Niche")])
def test_trend_classes(spark, counts, n, label):
    rules = trend.TrendRules(total_sample=100)
    assert trend.trends(*months(spark, counts, n), rules).first()["trend"] == label


def test_trend_values(spark):
    row = trend.trends(*months(spark, [1, 1, 2, 3, 4, 5, 6], 10), trend.TrendRules(month_sample=1, total_sample=50)).first()
    assert (row.rolling, row.change_3m, row.change_6m) == pytest.approx((0.5, 0.3, 0.5)) and row["trend"] == "Growing"
    assert trend.trends(*months(spark, [1, 2], 10)).first()["trend"] == "insufficient"


def test_graph(spark):
    sets = {"1": "ab", "2": "ab", "3": "ac", "4": "bc"}
    pairs = spark.createDataFrame([(e, i) for e, s in sets.items() for i in s], "entity_id string, item_id string")
    edges = graph.edges(pairs, 4, least_count=2)
    kept = edges.where("kept").collect()
    assert len(kept) == 1 and (kept[0].item_a, kept[0].item_b, kept[0].n, kept[0].jaccard) == ("a", "b", 2, 0.5) and kept[0].pmi_nat == pytest.approx(math.log(8 / 9))
    assert graph.build_report(edges).first()["filtered"] == 2
    found = {r.item_id: r.community for r in graph.communities(graph.support(pairs), edges.where("kept")).collect()}
    assert found["a"] == found["b"] != found["c"]


def test_communities_separate_two_cliques(spark):
    names = [f"{g}{i}" for g in "xy" for i in range(5)]
    rows = [(a, b, 1.0) for a in names for b in names if a < b and a[0] == b[0]] + [("x0", "y0", 0.1)]
    kept = spark.createDataFrame(rows, "item_a string, item_b string, jaccard double")
    nodes = spark.createDataFrame([(n,) for n in names], "item_id string")
    member = graph.communities(nodes, kept)
    by = {r.item_id: r.community for r in member.collect()}
    assert len({by[n] for n in names if n[0] == "x"}) == 1 and by["x0"] != by["y0"]
    assert graph.modularity(member, kept).first()[0] > 0.4


def test_fit_and_gain(spark):
    sets = {"j1": ["sql", "power_bi"], "j2": ["sql", "python", "power_bi", "excel"], "j3": ["sql"]}
    pairs = spark.createDataFrame([(e, i) for e, s in sets.items() for i in s], "entity_id string, item_id string")
    cohort = spark.createDataFrame([(e,) for e in [*sets, "j4"]], "entity_id string")
    owned = spark.createDataFrame([("sql",)], "item_id string")
    rows = {r.item_id: r for r in fit.analyse(cohort, pairs, owned).collect()}
    assert rows["power_bi"].average_fit == pytest.approx((0.5 + 0.25 + 1) / 3) and rows["power_bi"].coverage == pytest.approx(1 / 3)
    assert rows["power_bi"].average_gain == pytest.approx((0.5 + 0.25) / 3) and rows["power_bi"].crossing_count == 1 and rows["power_bi"].target_count == 4
    nothing = fit.analyse(cohort.limit(0), pairs, owned).collect()
    assert len(nothing) == 1 and nothing[0].item_id is None and nothing[0].status == "no_target_entities"
    costs = spark.createDataFrame([("power_bi", 10.0), ("python", 100.0), ("excel", 5.0)], "item_id string, cost double")
    picked = fit.select_items(cohort, pairs, costs, ["sql"], 16.0).collect()
    assert [r.item_id for r in picked] == ["power_bi", "excel"] and picked[-1].remaining == 1.0
    assert fit.select_items(cohort, pairs, costs, ["sql"], 1.0).count() == 0


def test_adjusted_effect_against_a_dense_fit(spark):
    rng = np.random.default_rng(1)
    rows, pairs = [], []
    for i in range(400):
        role, city, has = f"r{i % 3}", f"c{rng.integers(4)}", rng.random() < 0.4
        y = 18000 * 1.1 ** (i % 3) * (1.2 if has else 1) * np.exp(rng.normal(0, 0.05))
        rows.append((str(i), role, None if city == "c3" else city, float(y)))
        pairs += [(str(i), "python")] * has + [(str(i), "sql")]
    entities = spark.createDataFrame(rows, "entity_id string, role string, city string, measure double")
    p = spark.createDataFrame(pairs, "entity_id string, item_id string")
    items = spark.createDataFrame([("python",), ("sql",), ("none",)], "item_id string")
    found = {r.item_id: r for r in effects.associations(entities, p, items, ["role", "city"]).collect()}
    have = {a for a, b in pairs if b == "python"}
    levels = [sorted({r[1] for r in rows})[1:], sorted({r[2] or "__missing__" for r in rows})[1:]]
    x = np.array([[1.0, *[float(r[1] == v) for v in levels[0]], *[float((r[2] or "__missing__") == v) for v in levels[1]], float(r[0] in have)] for r in rows])
    y = np.log([r[3] for r in rows])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inverse, x)
    cov = inverse @ (x.T * (e / (1 - h)) ** 2) @ x @ inverse
    r = found["python"]
    assert r.coefficient == pytest.approx(beta[-1], abs=1e-9) and r.error == pytest.approx(np.sqrt(cov[-1, -1]), rel=1e-6) and abs(r.coefficient - math.log(1.2)) < 0.02
    assert r.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())), abs=1e-9) and r.status == "estimated"
    assert found["sql"].status == "insufficient_sample" and found["none"].status == "insufficient_sample"


def test_fan_out_does_not_count_twice(tiny):
    _, source_map, _, relations = tiny
    naive = source_map.join(relations, "entity_id").where("item_id = 'python'").count()
    right = metrics.source_demand(source_map, relations).where("item_id = 'python'").agg(F.sum("entity_count")).first()[0]
    assert naive == 3 and right == 2


def test_percentiles_are_exact(spark):
    """Against sorted lists: ties, negative values, zeros, groups of one row, null keys and values, one group with most of the rows."""
    rng = random.Random(3)
    rows = [(g, rng.choice([0.0, -1.5, 2.25, None, rng.gauss(0, 100), rng.random(), 7.0])) for g in ["a"] * 3000 + ["b"] * 40 + ["c"] + [None] * 30]
    df = spark.createDataFrame([*rows, ("empty", None)], "g string, v double").repartition(4)
    points = {"low": 0.0, "p25": 0.25, "mid": 0.5, "p75": 0.75, "high": 1.0}
    found = {r.g: r for r in metrics.percentiles(df, ["g"], "v", points).collect()}
    for g in ("a", "b", "c", None):
        values = sorted(v for k, v in rows if k == g and v is not None)
        for name, q in points.items():
            if values:
                at = q * (len(values) - 1)
                low, high = values[int(at)], values[min(len(values) - 1, -int(-at // 1))]
                assert found[g][name] == pytest.approx(low + (high - low) * (at - int(at)), abs=1e-9), (g, name)
    assert "empty" not in found
    summary = metrics.with_percentiles(df.groupBy("g").count(), df, ["g"], "v", {"mid": 0.5})
    assert summary.count() == 5 and summary.where("g = 'empty'").first().mid is None
    assert metrics.percentiles(df.limit(0), ["g"], "v", points).count() == 0
    assert metrics.percentiles(df, [], "v", {"mid": 0.5}).count() == 1


def test_fingerprint_counts_repeated_rows(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b")], "k int, v string")
    prints = [metrics.inventory(df, "t").first().fingerprint for df in (twice, twice.repartition(3), twice.distinct(), twice.limit(0))]
    assert prints[0] == prints[1] and len(set(prints)) == 3 and prints[3] == "0"


def test_parameters_are_checked():
    from demandlens.operators import dedup

    with pytest.raises(ValueError, match="add up to 1"):
        scoring.ConfidenceRules(weights={"sample": 0.9, "diversity": 0.2, "freshness": 0.2, "metric": 0.15, "agreement": 0.15})
    with pytest.raises(ValueError, match="out of order"):
        scoring.ConfidenceRules(high=10.0)
    with pytest.raises(ValueError, match="add up to 1"):
        scoring.checked({"a": 0.5, "b": 0.6}, ("a", "b"))
    with pytest.raises(ValueError, match="order"):
        dedup.DedupRules(title=80.0)
    with pytest.raises(ValueError, match="range"):
        metrics.Guardrails(least_target_share=2.0)


def test_greedy_selection_against_a_plain_loop(spark):
    rng = random.Random(8)
    sets = {f"e{k}": {f"i{rng.randrange(9)}" for _ in range(rng.randrange(1, 6))} for k in range(40)}
    costs = {f"i{k}": float(rng.randrange(1, 9)) for k in range(9)} | {"i8": 0.0}
    owned, left, want = {"i0"}, 15.0, []
    while True:
        best = None
        for item, cost in costs.items():
            lacking = [s for s in sets.values() if item in s and item not in owned]
            lifted = sum(len(s & owned) / len(s) < 0.7 <= (len(s & owned) + 1) / len(s) for s in lacking)
            marginal = 0.6 * sum(1 / len(s) for s in lacking) / len(sets) + 0.4 * lifted / len(sets)
            if lacking and 0 < cost <= left and marginal >= 1e-6:
                best = min(x for x in (best, (-round(marginal / cost, 12), -round(marginal, 12), item)) if x)
        if not best:
            break
        owned.add(best[2])
        left -= costs[best[2]]
        want.append((best[2], left))
    pairs = spark.createDataFrame([(e, i) for e, s in sets.items() for i in s], "entity_id string, item_id string")
    cohort, priced = spark.createDataFrame([(e,) for e in sets], "entity_id string"), spark.createDataFrame(list(costs.items()), "item_id string, cost double")
    assert [(r.item_id, r.remaining) for r in fit.select_items(cohort, pairs, priced, ["i0"], 15.0).collect()] == want and len(want) > 2


def test_communities_against_the_best_division(spark):
    """On small graphs the modularity found is near that of the best of all divisions."""
    rng = random.Random(4)
    names = "abcdefg"
    edges = [(a, b, round(rng.uniform(0.1, 1), 2)) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (0.9 if (a < "d") == (b < "d") else 0.25)]
    total, degree = 2 * sum(w for *_, w in edges), {n: sum(w for a, b, w in edges if n in (a, b)) for n in names}

    def quality(at):
        return sum(2 * w for a, b, w in edges if at[a] == at[b]) / total - sum((sum(degree[n] for n in names if at[n] == c) / total) ** 2 for c in set(at.values()))

    def divisions(k, used):
        if k == len(names):
            yield {}
            return
        for c in range(used + 1):
            for rest in divisions(k + 1, max(used, c + 1)):
                yield {names[k]: c} | rest

    best = max(quality(at) for at in divisions(0, 0))
    kept = spark.createDataFrame([(a, b, 1, w, 0.0) for a, b, w in edges], "item_a string, item_b string, n int, jaccard double, pmi_nat double")
    member = graph.communities(spark.createDataFrame([(n,) for n in names], "item_id string"), kept)
    found = quality({r.item_id: r.community for r in member.collect()})
    assert best - 0.05 <= found <= best + 1e-9
    assert graph.modularity(member, kept).first().modularity == pytest.approx(found, abs=1e-9)


def greedy_communities(names, edges):
    """Merging the best pair of communities, one at a time, until none gains."""
    m2 = 2 * sum(edges.values())
    mass, links, at = dict.fromkeys(names, 0.0), {n: {} for n in names}, {n: n for n in names}
    for (a, b), w in edges.items():
        mass[a] += w / m2
        mass[b] += w / m2
        links[a][b] = links[b][a] = w / m2
    while True:
        gain, a, b = max(((2 * (w - mass[a] * mass[b]), a, b) for a in links for b, w in links[a].items() if a < b), default=(0, None, None))
        if gain <= 1e-12:
            return at
        for c, w in links.pop(b).items():
            del links[c][b]
            if c != a:
                links[a][c] = links[c][a] = links[a].get(c, 0) + w
        mass[a] += mass.pop(b)
        at = {n: a if c == b else c for n, c in at.items()}


def quality_of(at, edges):
    m2, mass, inner = 2 * sum(edges.values()), {}, 0.0
    for (a, b), w in edges.items():
        inner += 2 * w * (at[a] == at[b])
        for n in (a, b):
            mass[at[n]] = mass.get(at[n], 0.0) + w
    return inner / m2 - sum(x * x for x in mass.values()) / m2**2


@pytest.mark.parametrize(("seed", "share"), [(1, 0.2), (2, 0.4)])
def test_communities_are_as_good_as_greedy_ones(spark, seed, share):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(30)]
    edges = {(a, b): round(rng.random(), 3) + 0.001 for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < share}
    kept = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "item_a string, item_b string, jaccard double")
    found = {r.item_id: r.community for r in graph.communities(spark.createDataFrame([(n,) for n in names], "item_id string"), kept).collect()}
    assert set(found) == set(names)
    assert quality_of(found, edges) >= quality_of(greedy_communities(names, edges), edges) - 0.01


def test_a_hub_takes_in_many_neighbours_a_round(spark, monkeypatch):
    """Without that a star would need a round for each of its 40 ends."""
    rows = [("hub", f"x{i:02}", 1.0) for i in range(40)] + [("alone", "too", 1.0)]
    kept = spark.createDataFrame(rows, "item_a string, item_b string, jaccard double")
    rounds, plain = [], graph._merges
    monkeypatch.setattr(graph, "_merges", lambda *a, **k: rounds.append(1) or plain(*a, **k))
    nodes = spark.createDataFrame([(n,) for n in {n for a, b, _ in rows for n in (a, b)} | {"single"}], "item_id string")
    found = {r.item_id: (r.community, r.size) for r in graph.communities(nodes, kept).collect()}
    assert len({c for c, _ in found.values()}) == 3 and found["hub"] == (0, 41) and found["single"][1] == 1 and found["too"] == found["alone"]
    assert len(rounds) <= 22


@pytest.fixture
def apart(spark):
    """Small partitions stay apart, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_positions_over_many_ranges(spark, apart):
    """Ranks and running values are those of one sorted list, with ties and nulls."""
    rng = random.Random(6)
    rows = [(f"k{i:04}", rng.choice([None, *range(40)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, score int").repartition(7)
    ranked = scoring.ordinal_rank(df, "score", "key", "position")
    assert ranking._ranges(df, ["key"]).select("_range").distinct().count() > 1
    want = {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1] if r[1] is not None else 99, r[0])))}
    assert {r.key: r.position for r in ranked.collect()} == want
    got = {r.key: r.low for r in ranking.running_before(df, ["key"], "score", "low", "min").collect()}
    least, plain = None, {}
    for k, v in sorted(rows):
        plain[k] = least
        least = v if least is None else least if v is None else min(least, v)
    assert got == plain


def test_bitmaps_count_as_sets_do(spark):
    rng = random.Random(3)
    sets = {i: {rng.randrange(-50, 200_000) for _ in range(rng.choice([1, 5, 3000]))} | set(range(20 * (i in "ab"))) for i in "abcdef"}
    bits = graph.posting_bitmaps(spark.createDataFrame([(i, e) for i, s in sets.items() for e in s] + [("a", None), (None, 5)], "item_id string, e long"), "e")
    assert {r.item_id: r.n for r in graph.set_sizes(bits).collect()} == {i: len(s) for i, s in sets.items()}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    assert {(r.item_a, r.item_b): (r.both_sets, r.either_set) for r in graph.overlaps(bits).collect()} == {p: n for p, n in want.items() if n[0]}
    wanted = spark.createDataFrame([("b", "a"), ("a", "f"), ("a", "none")], "item_a string, item_b string")
    got = {(r.item_a, r.item_b): (r.both_sets, r.either_set) for r in graph.overlaps(bits, wanted).collect()}
    assert got == {("b", "a"): want["a", "b"], ("a", "f"): want["a", "f"], ("a", "none"): (0, len(sets["a"]))}


def test_sketches_of_days_give_the_counts_of_windows(spark):
    rows = [(i, i % 700, (date(2026, 1, 1) + timedelta(days=i % 120)) if i % 50 else None) for i in range(12000)]
    entities = spark.createDataFrame(rows, "entity_id long, company_id long, event_date date")
    entity_items = spark.createDataFrame([(i, f"r{i}-{k}", f"item{i % 3}") for i in range(12000) for k in range(1 + i % 2)], "entity_id long, record_id string, item_id string")
    windows = {"30d": 30, "90d": 90, "all": None}
    got = {(r.window, r.item_id): (r.entity_count, r.company_count, r.record_count) for r in metrics.sketched_counts(metrics.daily_sketches(entities, entity_items), "2026-04-30", windows).collect()}
    exact = metrics.in_windows(entities, "2026-04-30", windows).join(entity_items, "entity_id").groupBy("window", "item_id").agg(*[F.countDistinct(c) for c in ("entity_id", "company_id", "record_id")]).collect()
    assert len(got) == 9
    for r in exact:
        for estimate, n in zip(got[r["window"], r["item_id"]], r[2:], strict=True):
            assert abs(estimate - n) <= max(1, 0.02 * n)


def test_relations_of_scopes_are_those_of_their_entities(spark):
    rng = random.Random(9)
    entities = spark.createDataFrame([(i, rng.choice(["x", "y", None])) for i in range(200)], "entity_id long, role_id string").cache()
    pairs = spark.createDataFrame([(i, c) for i in range(200) for c in rng.sample("abcdefg", rng.randrange(5))], "entity_id long, item_id string").cache()
    got = {s: {tuple(r)[1:] for r in graph.scoped_edges(pairs, entities).withColumns({c: F.round(c, 9) for c in ("jaccard", "pmi_nat")}).select("scope", "item_a", "item_b", "n", "support_a", "support_b", "jaccard", "pmi_nat", "kept").where(F.col("scope") == s).collect()} for s in ("global", "x", "y")}
    for s in got:
        some = entities if s == "global" else entities.where(F.col("role_id") == s)
        e = graph.edges(pairs.join(some, "entity_id", "left_semi"), some.count())
        want = {tuple(r) for r in e.withColumns({c: F.round(c, 9) for c in ("jaccard", "pmi_nat")}).select("item_a", "item_b", "n", "support_a", "support_b", "jaccard", "pmi_nat", "kept").collect()}
        assert got[s] == want and want


def test_students_t(spark):
    table = {(0.975, 1): 12.7062047, (0.975, 10): 2.2281389, (0.95, 5): 2.0150484, (0.995, 30): 2.7499957, (0.975, 1e6): 1.9599664, (0.025, 10): -2.2281389}
    for (q, degrees), t in table.items():
        assert effects.student_point(q, degrees) == pytest.approx(t, abs=1e-6) and effects.student_cdf(t, degrees) == pytest.approx(q, abs=1e-8)
    rng = random.Random(1)
    rows = [(f"e{i}", "x" if i % 2 else "y", 1000 * math.exp(rng.random() + 0.3 * (i % 3 == 0))) for i in range(60)]
    entities = spark.createDataFrame(rows, "entity_id string, role_id string, measure double")
    pairs = spark.createDataFrame([(f"e{i}", "i") for i in range(0, 60, 3)], "entity_id string, item_id string")
    items = spark.createDataFrame([("i",)], "item_id string")
    rules = {"least_n": 10, "least_with": 5, "least_without": 5}
    normal, student = (effects.associations(entities, pairs, items, ["role_id"], effects.EffectRules(**rules, student=s)).first() for s in (False, True))
    assert (student.coefficient, student.error) == pytest.approx((normal.coefficient, normal.error))
    assert (student.high - student.low) / (2 * student.error) == pytest.approx(effects.student_point(0.975, 57)) and (normal.high - normal.low) / (2 * normal.error) == pytest.approx(1.959964, abs=1e-6)
    assert student.p_value == pytest.approx(2 * effects.student_cdf(-abs(student.coefficient) / student.error, 57)) and student.p_value > normal.p_value
