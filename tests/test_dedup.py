"""Duplicate records and surviving values."""

import random

import pytest
from pyspark.sql import functions as F

from demandlens.functions.similarity import ratio
from demandlens.operators import components, dedup, survivorship

SCHEMA = "record_id string, source_id string, source_record string, company string, title string, title_raw string, city string, role_id string, experience_band string, description string, observed_at string, record_status string"


def records(spark, *changes):
    base = {"company": "acme", "title": "data analyst", "city": "x", "role_id": "analyst", "experience_band": None, "description": "we analyse data every day", "observed_at": "2026-01-01", "record_status": "valid"}
    rows = []
    for k, change in enumerate(changes):
        r = base | {"record_id": f"r{k}", "source_id": f"s{k}", "source_record": str(k)} | change
        r.setdefault("title_raw", r["title"])
        rows.append(tuple(r[c.split()[0]] for c in SCHEMA.split(", ")))
    return spark.createDataFrame(rows, SCHEMA)


def groups(df):
    out = {}
    for r in dedup.deduplicate(df).collect():
        out.setdefault(r.entity_id, set()).add(r.record_id)
    return sorted(map(sorted, out.values()))


def test_levels_and_guards(spark):
    """Pairs of records, each pair in a company of its own: which are merged."""
    senior = "senior data platform analyst"
    merged = [({}, {}), ({"title": senior}, {"title": senior + "!"})]
    apart = [({}, {"source_id": "s0", "description": "something else entirely, not alike"})]
    apart += [({}, change) for change in ({"city": "y"}, {"company": "other"}, {"role_id": "engineer"}, {"title": "data analyst intern"}, {"title_raw": "data analyst (unit b)"}, {"title": ""})]
    rows = [{"company": f"c{k}", "source_id": f"s{i}"} | change for k, pair in enumerate(merged + apart) for i, change in enumerate(pair)]
    assert groups(records(spark, *rows)) == sorted([["r0", "r1"], ["r2", "r3"], *[[f"r{i}"] for i in range(4, len(rows))]])


def test_chain_of_three_is_not_merged_through_the_middle(spark):
    found = groups(records(spark, {"experience_band": "mid"}, {"experience_band": "unknown", "observed_at": "2026-01-02"}, {"experience_band": "senior", "observed_at": "2026-01-03"}))
    assert found == [["r0", "r1"], ["r2"]]


def test_many_copies_make_no_pairs(spark):
    df = records(spark, *[{"description": "the same"} for _ in range(300)])
    assert len(groups(df)) == 1
    assert dedup.provenance(dedup.deduplicate(df)).count() == 300


def test_decisions(spark):
    merged = dedup.deduplicate(records(spark, {}, {}, {"city": "y"}))
    split = dedup.apply_decisions(merged, spark.createDataFrame([("r0", "r1", "different"), ("r8", "r9", "same")], "left_id string, right_id string, decision string"))
    assert split.select("entity_id").distinct().count() == 3
    with pytest.raises(ValueError, match="decision"):
        dedup.apply_decisions(merged, spark.createDataFrame([("r0", "r2", "same")], "left_id string, right_id string, decision string"))
    with pytest.raises(ValueError, match="records"):
        dedup.eligible(records(spark, {"record_id": "a"}, {"record_id": "a"}))


def test_survivors(spark):
    rows = spark.createDataFrame([("e", "a", 100.0, "x"), ("e", "a", 110.0, "x"), ("e", "b", 300.0, "yy"), ("f", "a", 100.0, " "), ("f", "b", 110.0, "z"), ("g", "a", None, None)], "e string, s string, v double, t string")
    found = {r.e: r for r in survivorship.reconcile(rows, "e", "s", "v").collect()}
    assert found["e"].status == "conflict" and found["e"].value is None and len(found["e"].observations) == 3
    assert found["f"].status == "available" and found["f"].value == 105 and found["g"].status == "unavailable"
    assert {r.e: r.m for r in survivorship.stable_mode(rows, "e", "t", "m").collect()} == {"e": "x", "f": "z"}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3)], "u long, v long")
    found = {r.node: r.root for r in components.components(edges.where(F.col("u").isNotNull() | F.lit(True))).collect()}
    assert all(found[i] == 1 for i in range(1, 61)) and found[101] == 100
    assert components.components(edges.limit(0)).count() == 0


def match(a, b):
    """(level, score) of two records by the rule for pairs, or None; a and b have the fields that dedup.keyed makes."""
    if a.company_key != b.company_key or a.city_key != b.city_key or not (a.company_key and a.city_key and a.title_key and b.title_key):
        return None
    known = a.role not in ("", "other") and b.role not in ("", "other")
    if known and a.role != b.role or a.seniority and b.seniority and a.seniority != b.seniority or a.intern != b.intern or a.intern and b.full_time or b.intern and a.full_time or a.unit != b.unit:
        return None
    if a.title_key == b.title_key:
        if a.source_id == b.source_id and a.source_record and b.source_record and a.source_record != b.source_record and not (a.body and b.body and ratio(a.body, b.body) >= 95):
            return None
        return 1, 100.0
    if not known:
        return None
    found = round(ratio(a.title_key, b.title_key), 6)
    if found >= 96:
        return 2, found
    if found >= 90 and a.print is not None and b.print is not None and (d := ((a.print ^ b.print) & (1 << 64) - 1).bit_count()) <= 3:
        return 3, round((1 - d / 64) * 100, 6)
    return None


def slow_groups(records):
    """Representative, level and score of each record, taken one at a time; a record alike to an earlier one follows it."""
    records = sorted(records, key=lambda r: (r.observed_at or "9999", r.source_id, r.record_id))
    bodies = {}
    for r in records:
        bodies.setdefault((r.company_key, r.city_key, r.title_key, r.source_id, r.source_record), set()).add(r.body)
    groups, out, units = [], {}, {}
    for r in records:
        changed = len(bodies[r.company_key, r.city_key, r.title_key, r.source_id, r.source_record]) > 1
        native = "" if not r.source_record else "*" if r.body and not changed else r.source_record
        unit = (*[r[c] for c in dedup.SIGNATURE], r.source_id, native)
        if unit in units and r.title_key and r.company_key and r.city_key:
            g, level, score = units[unit]
            out[r.record_id] = (g[0].record_id, level or 1, score or 100.0)
            continue
        best = None
        for g in groups:
            found = [match(r, m) for m in g]
            if all(found):
                level, score = max(found, key=lambda f: (f[0], -f[1]))
                best = min([x for x in (best, ((level, -score, g[0].record_id), g)) if x], key=lambda x: x[0])
        if best:
            best[1].append(r)
            g, level, score = best[1], best[0][0], -best[0][1]
        else:
            g, level, score = [r], 0, None
            groups.append(g)
        units[unit] = (g, level, score)
        out[r.record_id] = (g[0].record_id, level, score)
    return out


def test_groups_are_those_of_the_rule(spark):
    """500 random blocks: exact, fuzzy and SimHash matches, guards, changed texts of one native id, empty texts, copies."""
    rng = random.Random(13)
    titles = ["data analyst of the northern office", "data analyst of the northern offices", "data analyst of the northern officer!", "data analyst of northern offices", "data engineer", "data engineer intern", ""]
    text = "we look for people who analyse numbers every day and write about what they found in clear words"
    texts = [text, text + ".", text + " and so on, as long as it takes to be quite another text than it was before", text.replace("numbers", "figures"), "", None, "short"]
    changes = []
    for k in range(500):
        for i in range(rng.randrange(2, 9)):
            changes.append({
                "company": f"c{k}", "title": rng.choice(titles), "title_raw": rng.choice([None, "x (unit a)"]) if rng.random() < 0.1 else None, "source_id": f"s{rng.randrange(3)}", "source_record": rng.choice(["", "1", "2", str(100 + i)]),
                "role_id": rng.choice(["analyst", "analyst", "other", "engineer"]), "description": rng.choice(texts), "observed_at": rng.choice(["2026-01-01", "2026-01-02", None, ""]), "experience_band": rng.choice([None, None, "mid"]),
            })
    df = records(spark, *changes)
    want = slow_groups(dedup.keyed(df).collect())
    for task_links in (dedup.TASK_LINKS, 0):
        got = {r.record_id: (r.representative_id, r.level, None if r.score is None else round(r.score, 6)) for r in dedup.deduplicate(df, task_links=task_links).collect()}
        assert got == want
    assert {level for _, level, _ in want.values()} == {0, 1, 2, 3}


def test_records_of_several_sources_stay_together(spark):
    # one title; a text test only between different ids of one source
    df = records(spark, *[{"source_id": s, "description": d, "observed_at": f"2026-01-0{k + 1}"} for k, (s, d) in enumerate([("s0", "A" * 40), ("s2", "B" * 40), ("s1", "A" * 40), ("s1", "B" * 40)])])
    assert groups(df) == [["r0", "r1", "r2"], ["r3"]]


def test_prints_by_another_hash(spark):
    text = "we look for people who analyse numbers every day and write about what they found in clear words"
    df = records(spark, {"title": "data analyst of the office", "description": text}, {"title": "data analyst of the offices up", "description": text + "."})
    for features in ("xxhash64", "blake2b"):
        rules = dedup.DedupRules(features=features, distance=20)
        assert sorted(r.level for r in dedup.deduplicate(df, rules).collect()) == [0, 3]
    with pytest.raises(ValueError, match="hash"):
        dedup.DedupRules(features="md5")


def test_near_titles_misses_none(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    titles = sorted({"".join(c for c in t if rng.random() > 0.06) + rng.choice(["", "a", "b "]) for t in base for _ in range(6)} - {""})
    df = spark.createDataFrame([(t,) for t in titles], "t string").withColumn("k", F.lit(1))
    for least in (75.0, 90.0, 96.0):
        got = {(r.left_title, r.right_title) for r in dedup.near_titles(df, ["k"], "t", least).collect()}
        assert got == {(a, b) for a in titles for b in titles if a < b and round(ratio(a, b), 6) >= least}


def test_a_split_pair_parts_whichever_is_the_representative(spark):
    # the second id is the first by source, so that it represents the pair
    merged = dedup.deduplicate(records(spark, {"source_id": "z"}, {"source_id": "a"}))
    split = dedup.apply_decisions(merged, spark.createDataFrame([("r0", "r1", "different")], "left_id string, right_id string, decision string"))
    assert merged.select("entity_id").distinct().count() == 1 and split.select("entity_id").distinct().count() == 2


def test_pair_sample_is_linear(spark):
    df = dedup.keyed(records(spark, *[{"title": f"t{k % 3}"} for k in range(30)]))
    rows = dedup.pair_sample(df).collect()
    assert len(rows) == 5 and sorted(r.kind for r in rows) == ["cross_source_negative"] * 2 + ["easy"] * 3


@pytest.mark.parametrize(("n", "missing", "task_links", "most_rounds"), [(1000, 100, 25_000, 5), (60, 5, 32, 9)])
def test_dense_components_take_few_rounds(spark, monkeypatch, n, missing, task_links, most_rounds):
    """One of so many pairs is missing; groups are those of taking one unit after the other."""
    pair = F.xxhash64("a", "b")
    name = {s: F.format_string("u%05d", F.col(s)) for s in "ab"}
    order = {s: F.concat((F.xxhash64(s) % 1000).cast("string"), name[s]) for s in "ab"}
    pairs = spark.range(n).toDF("a").join(spark.range(n).toDF("b"), F.col("a") < F.col("b")).where(pair % missing != 0)
    links = pairs.select(F.lit("u00000").alias("root"), name["a"].alias("left_id"), name["b"].alias("right_id"), order["a"].alias("left_order"), order["b"].alias("right_order"), (1 + F.pmod(pair, F.lit(3))).cast("int").alias("level"), (90.0 + F.pmod(pair, F.lit(7))).alias("score"))
    rounds, plain = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: (rounds.append(1) if name == "first" else None) or plain(df, name))
    got = {r.id: (r.founder, r.level, r.score) for r in dedup._in_rounds(links, int((2 * task_links) ** 0.5)).collect()}
    rows = links.toPandas()
    orders = dict(zip(rows["left_id"], rows["left_order"], strict=True)) | dict(zip(rows["right_id"], rows["right_order"], strict=True))
    want = dedup.complete_links(sorted(orders, key=orders.get), list(zip(rows["left_id"], rows["right_id"], rows["level"], rows["score"], strict=True)))
    assert got == want and len(rounds) <= most_rounds


def test_pairs_and_members_stand_for_all_matches(spark):
    """Levels 2 and 3 of whole records, by comparing all pairs; the queries give pairs of units and the records of each."""
    rng = random.Random(2)
    text = "we look for people who analyse numbers every day and write about what they found in clear words"
    titles = ["data analyst of the northern office", "data analyst of the northern offices", "data analyst of northern offices", "analyst of data in the north"]
    df = records(spark, *[{"company": f"c{k % 12}", "title": rng.choice(titles), "source_id": f"s{rng.randrange(2)}", "source_record": "", "description": rng.choice([text, text + ".", text + " and more of it, much more than was there before"])} for k in range(150)])
    united = dedup.units(dedup.keyed(df)).cache()
    heads = dedup.unit_heads(united)
    units = {}
    for r in dedup.membership(united, heads).collect():
        units.setdefault(r.id, []).append(r.record_id)
    assert sorted(x for u in units.values() for x in u) == sorted(r.record_id for r in df.collect())
    got = {}
    for r in dedup.matched_pairs(heads).collect():
        for a in units[r.left_id]:
            for b in units[r.right_id]:
                got[frozenset((a, b))] = (r.level, round(r.score, 6))
    for u in units.values():
        got |= {frozenset((a, b)): (1, 100.0) for a in u for b in u if a != b}
    rows = united.collect()
    want = {frozenset((a.record_id, b.record_id)): m for i, a in enumerate(rows) for b in rows[:i] if (m := match(a, b))}
    assert got == want and {level for level, _ in want.values()} == {1, 2, 3}


def test_rare_pairs_of_characters_come_first(spark):
    """A pair of characters that all titles have is no key of any but short ones."""
    rng = random.Random(8)
    titles = {"senior " + "".join(rng.choice("abcdefghijklmnop") for _ in range(14)) + " engineer" for _ in range(300)}
    keys = dedup.title_keys(spark.createDataFrame([(t, "x") for t in titles], "t string, k string"), ["k"], "t", 90.0).groupBy("_g").count().collect()
    assert max(r["count"] for r in keys) < 0.2 * len(titles)
