"""Duplicate records: blocking, protected differences, three levels of matching, complete-link groups, provenance."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.functions.normalize import nfkc
from demandlens.functions.similarity import may_reach, ratio_udf, simhash, simhash_udf
from demandlens.operators.components import components
from demandlens.sources.shared import ensure_checkpoints, written

#: Words of seniority in the order in which they are tried, of full-time work, and brackets of business units.
SENIORITY = (("intern", "实习|\\bintern(?:ship)?\\b"), ("junior", "初级|junior|应届|graduate"), ("senior", "高级|资深|senior"), ("lead", "专家|负责人|lead|principal|staff"))
FULL_TIME, UNIT = "全职|full[- ]?time", "[（(\\[【]([^）)\\]】]+)[）)\\]】]"


@dataclass(frozen=True)
class DedupRules:
    """Thresholds of the levels; the defaults are fixed values. features: the hash of the prints' grams, xxhash64 (in the JVM) or blake2b."""

    same_source_text: float = 95.0
    title: float = 96.0
    simhash_title: float = 90.0
    distance: int = 3
    features: str = "xxhash64"

    def __post_init__(self):
        if not (0 < self.simhash_title <= self.title <= 100 and 0 < self.same_source_text <= 100 and 0 <= self.distance <= 64):
            raise ValueError(f"thresholds out of order: {self}")
        if self.features not in ("xxhash64", "blake2b"):
            raise ValueError(f"no hash {self.features}")


def eligible(records: DataFrame) -> DataFrame:
    """The valid records; raises if an id is empty or not unique, or provenance is missing."""
    valid = records.where(F.col("record_status") == "valid")
    empty = F.coalesce(F.trim("record_id"), F.lit("")) == ""
    bad = valid.agg(F.count_if(empty).alias("empty"), (F.count("*") - F.countDistinct("record_id") - F.count_if(F.col("record_id").isNull())).alias("repeated"), F.count_if(F.coalesce(F.trim("source_id"), F.lit("")) == "").alias("unsourced")).first()
    if bad["empty"] or bad["repeated"] or bad["unsourced"]:
        raise ValueError(f"records without usable ids or provenance: {bad.asDict()}")
    return valid


def keyed(records: DataFrame, r: DedupRules | None = None, prints: bool = True) -> DataFrame:
    """records with what blocking and guards compare: city_key, title_key, body, seniority, intern, full_time, unit, and print if prints.

    Takes record_id, source_id, source_record, company, title, title_raw, city, role_id, experience_band, description, observed_at.
    """

    def plain(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c).cast("string")), F.lit(""))

    df = records.withColumn("city_key", F.lower(plain("city"))).withColumn("company_key", plain("company")).withColumn("title_key", F.lower(plain("title")))
    df = df.withColumn("body", F.regexp_replace(F.lower(nfkc(plain("description"))), "(?U)\\s+", ""))
    titles = F.concat_ws(" ", plain("title_raw"), F.col("title_key"))
    band = F.lower(plain("experience_band"))
    level = F.coalesce(*[F.when(titles.rlike(f"(?iU){p}"), F.lit(n)) for n, p in SENIORITY], F.when(~band.isin("", "unlimited", "unknown"), band))
    shown = F.concat_ws(" ", plain("title_raw"), F.col("body"))
    unit = F.lower(F.trim(F.regexp_extract(F.when(plain("title_raw") != "", plain("title_raw")).otherwise(F.col("title_key")), UNIT, 1)))
    return df.withColumns({"seniority": level, "intern": shown.rlike(f"(?iU){SENIORITY[0][1]}"), "full_time": shown.rlike(f"(?i){FULL_TIME}"), "unit": F.nullif(unit, F.lit("")), "role": plain("role_id")} | ({"print": text_print("body", r)} if prints else {}))


def protected(a: str, b: str) -> Column:
    """Whether two records (column prefixes a and b) differ in what must not be merged."""

    def both(c: str) -> tuple[Column, Column]:
        return F.col(f"{a}_{c}"), F.col(f"{b}_{c}")

    (ra, rb), (sa, sb), (ia, ib), (fa, fb), (ua, ub) = both("role"), both("seniority"), both("intern"), both("full_time"), both("unit")
    roles = ~ra.isin("", "other") & ~rb.isin("", "other") & (ra != rb)
    return roles | F.coalesce(sa != sb, F.lit(False)) | (ia != ib) | (ia & fb) | (ib & fa) | ~ua.eqNullSafe(ub)


#: What two records compare. Records that also share a source and, where that matters, a native id are alike: one unit.
SIGNATURE = ("company_key", "city_key", "title_key", "role", "seniority", "intern", "full_time", "unit", "body")
#: Links of a component that one task groups by itself; larger components are grouped by all tasks in rounds, with the same result.
TASK_LINKS = 100_000


def units(keyed_records: DataFrame) -> DataFrame:
    """keyed_records with unit: records of one unit compare alike with all others and match each other, so that they are taken as one.

    Different native ids of one source need like texts to match. That asks nothing of records with the same text, so the native id
    parts them only where the text is empty or where the id stands with several texts under one title. native is "*" where any other id
    is another posting, "" where there is none.
    """
    place = ("company_key", "city_key", "title_key", "source_id", "_native")
    df = keyed_records.withColumn("_native", F.coalesce(F.trim(F.col("source_record").cast("string")), F.lit("")))
    changed = df.where("_native <> ''").groupBy(*place).agg(F.min("body").alias("_low"), F.max("body").alias("_high")).where("_low <> _high").select(*place, F.lit(True).alias("_changed"))
    df = df.join(changed, list(place), "left")
    native = F.when(F.col("_native") == "", "").when((F.col("body") != "") & F.col("_changed").isNull(), "*").otherwise(F.col("_native"))
    whole = (F.col("company_key") != "") & (F.col("city_key") != "") & (F.col("title_key") != "")
    df = df.withColumn("native", native)
    mark = F.sha2(F.to_json(F.struct(*SIGNATURE, "source_id", "native"), {"ignoreNullFields": "false"}), 256)
    return df.withColumn("unit_mark", F.when(whole, mark).otherwise(F.sha2(F.concat(F.lit("alone "), "record_id"), 256))).drop("_native", "_changed")


def united(records: DataFrame, r: DedupRules | None = None) -> DataFrame:
    """records with what keyed (but for prints) and units add, written.

    Records are dealt to all tasks first, as a small file with many rows is read by few, and are keyed once for both uses in units.
    """
    some = written(keyed(records.repartition("record_id"), r, prints=False), "keyed")
    return written(units(some), "united")


def text_print(c: str, r: DedupRules | None = None) -> Column:
    """The SimHash of a text with the hash that the rules name."""
    return simhash(F.col(c)) if (r or DedupRules()).features == "xxhash64" else simhash_udf()(c)


def unit_heads(united: DataFrame, r: DedupRules | None = None) -> DataFrame:
    """One row for each unit: unit_mark, id and order of its first record, and what pairs of units are compared by.

    Records of a unit have one text, so where united has no print it is made here, once for each unit.
    """
    order = F.concat_ws("\u0001", F.coalesce(F.nullif(F.trim(F.col("observed_at").cast("string")), F.lit("")), F.lit("9999-12-31T23:59:59+00:00")), "source_id", "record_id")
    heads = united.groupBy("unit_mark").agg(F.min(F.struct(order.alias("order"), "record_id")).alias("f"), *[F.first(c).alias(c) for c in (*SIGNATURE, *["print"] * ("print" in united.columns), "source_id", "native")])
    heads = heads if "print" in heads.columns else heads.withColumn("print", text_print("body", r))
    return heads.select("unit_mark", F.col("f.record_id").alias("id"), F.col("f.order").alias("order"), *SIGNATURE, "print", "source_id", "native")


def title_keys(titles: DataFrame, by: list[str], title: str, least: float) -> DataFrame:
    """(by, title, _g): what titles meet by. Two titles of one by with a ratio of at least least have a _g in common.

    A title is a set of pairs of neighbouring characters, or of numbered characters (the second e is another than the first) where least is
    so low that all its pairs would be needed. Each character of a title that is left out breaks two of its pairs at most, each put in
    breaks one; numbered characters lose at most those that are left out. So of a title's set, in one order of all, the first few are enough,
    and that order is by how many titles have them, the rarest first: a pair that most titles have is seldom among the first.
    """
    t = least / 200
    broken = (2 - 3 * t) + max(0.0, 1 - 3 * t) * (1 - t) / t + min(0.0, 1 - 3 * t) * t / (1 - t)  # pairs of each character, at most
    some, n = titles.select(*by, title).distinct(), F.length(title)
    if broken < 1:
        every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring(F.col(title), i, F.lit(2))))
        share = broken
    else:
        letters = F.array_sort(F.split(title, ""))
        every = F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x)).cast("string")))
        share = 1 - t / (1 - t)  # a partner is at least t / (1 - t) as long, and shares that many characters
    grams = written(some.where(n >= 1).select(*by, title, F.explode(every).alias("_g")), "grams")
    held = grams.groupBy("_g").agg(F.count("*").alias("_held"))
    ranked = grams.join(held, "_g").withColumn("_place", F.row_number().over(W.partitionBy(*by, title).orderBy("_held", "_g")))
    return ranked.where(F.col("_place") <= F.floor(n * share + 1e-9) + 1).select(*by, title, "_g")


def near_titles(titles: DataFrame, by: list[str], title: str, least: float) -> DataFrame:
    """(by, left_title, right_title, ratio) of different titles of one by with a ratio of at least least, left before right.

    Titles meet by title_keys, which misses no pair that reaches least; what has met is compared by length and then whole.
    """
    keyed = written(title_keys(titles, by, title, least), "title_keys")
    a, b = keyed.withColumnRenamed(title, "left_title"), keyed.withColumnRenamed(title, "right_title")
    met = a.join(b, [*by, "_g"]).where((F.col("left_title") < F.col("right_title")) & may_reach(F.col("left_title"), F.col("right_title"), least)).select(*by, "left_title", "right_title").distinct()
    return met.withColumn("ratio", F.round(ratio_udf(once=True)("left_title", "right_title"), 6)).where(F.col("ratio") >= least)


def _print_blocks(records: DataFrame, name: str, distance: int) -> DataFrame:
    """records once for each of distance + 1 blocks of the bits of their print (name_block): prints at most distance bits apart share one."""
    width = -(-64 // (distance + 1))
    bits = [F.shiftrightunsigned(F.col(f"{name}_print"), at).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)) for at in range(0, 64, width)]
    return records.withColumn(f"{name}_block", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), b.alias("bits")) for k, b in enumerate(bits)])))


def membership(united: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, record_id): the records of each unit, by the id of its first. Pairs of units hold for all their records."""
    return united.select("unit_mark", "record_id").join(heads.select("unit_mark", "id"), "unit_mark").select("id", "record_id")


def matched_pairs(records: DataFrame, r: DedupRules | None = None) -> DataFrame:
    """(left_id, right_id, level, score) of units (id, columns of SIGNATURE, print, source_id, native) that match, left_id < right_id.

    Level 1: same company, city and title; if they are different native ids of one source, also similar texts. Levels 2 and 3: one known
    role, and titles that near_titles finds: of at least r.title, or of at least r.simhash_title with close SimHash prints.
    """
    r = r or DedupRules()
    block = ["company_key", "city_key"]
    some = records.where((F.col("company_key") != "") & (F.col("city_key") != "") & (F.col("title_key") != ""))

    def side(name: str) -> DataFrame:
        return some.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", *SIGNATURE, "print", "source_id", "native")])

    def equal(*columns: str) -> Column:
        on = F.lit(True)
        for c in columns:
            on = on & (F.col(f"a_{c}") == F.col(f"b_{c}"))
        return on

    ids = [F.least("a_id", "b_id").alias("left_id"), F.greatest("a_id", "b_id").alias("right_id")]
    ratio = ratio_udf()
    titled = side("a").join(side("b"), equal(*block, "title_key") & (F.col("a_id") < F.col("b_id")) & ~protected("a", "b"))
    others = (F.col("a_source_id") == F.col("b_source_id")) & (F.col("a_native") != "") & (F.col("b_native") != "") & ((F.col("a_native") != F.col("b_native")) | (F.col("a_native") == "*"))
    free = titled.where(~others).select(*ids, F.lit(1).alias("level"), F.lit(100.0).alias("score"))
    texts = titled.where(others & (F.col("a_body") != "") & (F.col("b_body") != "") & may_reach(F.col("a_body"), F.col("b_body"), r.same_source_text))
    alike = texts.where(ratio("a_body", "b_body") >= r.same_source_text).select(*ids, F.lit(1).alias("level"), F.lit(100.0).alias("score"))

    known = some.where(~F.col("role").isin("", "other"))
    near = written(near_titles(known, [*block, "role"], "title_key", min(r.title, r.simhash_title)), "near")

    def sides(pairs: DataFrame, *more: str) -> DataFrame:
        """Records of near titles, left as a, right as b, with equal columns more."""
        keys = [*block, "role"]
        a, b = side("a"), side("b")
        if more:
            a, b = _print_blocks(a, "a", r.distance), _print_blocks(b, "b", r.distance)
        met = pairs.join(a, (F.col("left_title") == F.col("a_title_key")) & (F.col("role") == F.col("a_role")) & (F.col("company_key") == F.col("a_company_key")) & (F.col("city_key") == F.col("a_city_key")))
        return met.join(b, (F.col("right_title") == F.col("b_title_key")) & equal(*keys, *more)).where(~protected("a", "b"))

    fuzzy = sides(near.where(F.col("ratio") >= r.title)).select(*ids, F.lit(2).alias("level"), F.col("ratio").alias("score"))
    distance = F.bit_count(F.col("a_print").bitwiseXOR(F.col("b_print")))
    close = sides(near.where((F.col("ratio") < r.title) & (F.col("ratio") >= r.simhash_title)), "block").where(distance <= r.distance)
    close = close.select(*ids, F.lit(3).alias("level"), F.round((1 - distance / 64.0) * 100, 6).alias("score")).distinct()
    rest = fuzzy.unionByName(close)
    return free.unionByName(alike).unionByName(rest)


def complete_links(members: list[str], links: list[tuple[str, str, int, float]]) -> dict[str, tuple[str, int, float]]:
    """Founder, level and score of each member, in their order: a member joins a group only if it matches all of it.

    Of several groups it joins the one whose weakest match is of the best level, then score, then with the least founder. A founder has
    level 0 and score 100.
    """
    match: dict[str, dict[str, tuple[int, float]]] = {m: {} for m in members}
    for x, y, level, score in links:
        match[x][y] = match[y][x] = (level, -score)
    at: dict[str, tuple[str, int, float]] = {}
    sizes: dict[str, int] = {}
    for m in members:
        found: dict[str, tuple[int, tuple[int, float]]] = {}
        for o, weight in match[m].items():
            if o in at:
                n, worst = found.get(at[o][0], (0, weight))
                found[at[o][0]] = (n + 1, max(worst, weight))
        whole = [(worst, g) for g, (n, worst) in found.items() if n == sizes[g]]
        if whole:
            (level, minus), g = min(whole)
            at[m] = (g, level, -minus)
            sizes[g] += 1
        else:
            at[m] = (m, 0, 100.0)
            sizes[m] = 1
    return at


def _in_tasks(links: DataFrame) -> DataFrame:
    """(id, founder, level, score) of linked units; links has root, and one task groups each component."""

    def run(links: pd.DataFrame) -> pd.DataFrame:
        order = pd.concat([links[["left_order", "left_id"]].set_axis(["o", "id"], axis=1), links[["right_order", "right_id"]].set_axis(["o", "id"], axis=1)]).drop_duplicates().sort_values("o")
        at = complete_links(order["id"].tolist(), list(zip(links["left_id"], links["right_id"], links["level"], links["score"], strict=True)))
        return pd.DataFrame([(k, *v) for k, v in at.items()], columns=["id", "founder", "level", "score"])

    return links.groupBy("root").applyInPandas(run, "id string, founder string, level int, score double")


def _block_placed(units: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Places the earliest units of a component in their order, as complete_links does.

    units has id, o and a row for each group placed before that the unit matches whole (founder null if there is none), with the weakest
    match (level, minus); links are those among the units. A unit can still join such a group if it also matches all that joined since.
    """
    match: dict[str, dict[str, tuple[int, float]]] = {}
    for x, y, level, minus in zip(links["id"], links["other"], links["level"], links["minus"], strict=True):
        match.setdefault(x, {})[y] = match.setdefault(y, {})[x] = (level, minus)
    whole: dict[str, dict[str, tuple[int, float]]] = {}
    for u, founder, level, minus in units.sort_values("o")[["id", "founder", "level", "minus"]].itertuples(index=False):
        whole.setdefault(u, {})
        if isinstance(founder, str):
            whole[u][founder] = (int(level), minus)
    joined: dict[str, int] = {}
    at: dict[str, tuple[str, int, float]] = {}
    for u, before in whole.items():
        met: dict[str, tuple[int, tuple[int, float]]] = {}
        for o, weight in match.get(u, {}).items():
            if o in at:
                n, worst = met.get(at[o][0], (0, weight))
                met[at[o][0]] = (n + 1, max(worst, weight))
        options = [(worst if g not in met else max(worst, met[g][1]), g) for g, worst in before.items() if joined.get(g, 0) == met.get(g, (0,))[0]]
        options += [(worst, g) for g, (n, worst) in met.items() if g in whole and n == joined[g] and g not in before]  # groups of these units alone
        (level, minus), g = min(options, default=((0, -100.0), u))
        at[u] = (g, level, -minus)
        joined[g] = joined.get(g, 0) + 1
    return pd.DataFrame([(k, *v) for k, v in at.items()], columns=["id", "founder", "level", "score"])


def _in_rounds(links: DataFrame, block: int) -> DataFrame:
    """The same for components of any size, by all tasks: each round places all units whose place no earlier one can change.

    Of each component the earliest units, block of them, are placed in their order by one task, which needs only the links among them and
    which earlier groups each of them matches whole. So a dense component, where each unit waits for nearly all before it, takes a round
    for each block. Beyond them a unit is placed in the same round if all earlier units it matches are placed, and if it can join groups,
    no earlier unit that is not placed yet can join the best of them too; so a sparse component takes a few rounds.
    """
    both = links.select("root", F.col("left_id").alias("id"), F.col("right_id").alias("other"), F.col("left_order").alias("o"), F.col("right_order").alias("other_o"), "level", (-F.col("score")).alias("minus"))
    both = written(both.union(links.select("root", "right_id", "left_id", "right_order", "left_order", "level", -F.col("score"))), "both")
    todo = written(both.select("root", "id", "o").distinct(), "todo")
    placed = todo.select("root", "id", F.col("id").alias("founder"), F.lit(0).alias("level"), F.lit(100.0).alias("score")).limit(0)
    while todo.limit(1).count():
        sizes = placed.groupBy("founder").agg(F.count("*").alias("size"))
        met = both.join(todo.select("id"), "id").join(placed.select(F.col("id").alias("other"), "founder"), "other")
        worst = F.max(F.struct("level", "minus")).alias("worst")
        able = met.groupBy("id", "o", "founder").agg(F.count("*").alias("n"), worst).join(sizes, "founder").where("n = size")
        able = written(able.select("id", "o", "founder", "worst"), "able")
        place = F.row_number().over(W.partitionBy("root").orderBy("o"))
        first = written(todo.withColumn("place", place).where(F.col("place") <= block).select("root", "id", "o"), "first")
        inner = both.where("o < other_o").join(first.select("id"), "id").join(first.select(F.col("id").alias("other")), "other").select("root", "id", "other", "level", "minus")
        asked = first.join(able.select("id", "founder", "worst.*"), "id", "left")
        early = asked.groupBy("root").cogroup(inner.groupBy("root")).applyInPandas(_block_placed, "id string, founder string, level int, score double")
        later = todo.join(first, "id", "left_anti")
        waiting = both.join(later.select("id"), "id", "left_semi").join(todo.select(F.col("id").alias("other")), "other", "left_semi").where("other_o < o").select("id").distinct()
        ready = later.join(waiting, "id", "left_anti")
        firsts = able.groupBy("founder").agg(F.min("o").alias("first"))
        best = able.groupBy("id", "o").agg(F.min(F.struct("worst", "founder")).alias("best")).select("id", "o", "best.*")
        joining = ready.join(best, ["id", "o"]).join(firsts, "founder").where("o = first").select("id", "founder", F.col("worst.level").alias("level"), (-F.col("worst.minus")).alias("score"))
        founding = ready.join(best, "id", "left_anti").select("id", F.col("id").alias("founder"), F.lit(0).alias("level"), F.lit(100.0).alias("score"))
        new = written(todo.select("root", "id").join(early.unionByName(joining).unionByName(founding), "id").select("root", "id", "founder", "level", "score"), "placed")
        placed = written(placed.unionByName(new), "placed")
        todo = written(todo.join(new.select("id"), "id", "left_anti"), "todo")
    return placed.select("id", "founder", "level", "score")


def complete_link_groups(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(id, founder, level, score) of all units in links (left_id, right_id, left_order, right_order, level, score).

    Groups never leave a component of the links. Components in which all match all are one group each; of the others those with at most
    task_links links are grouped by one task each, larger ones in rounds by all tasks, in which a task never has more links than that.
    """
    if not links.limit(1).count():
        return links.select(F.col("left_id").alias("id"), F.col("right_id").alias("founder"), "level", "score")
    parts = written(components(links.select(F.col("left_id").alias("u"), F.col("right_id").alias("v"))), "parts")
    rooted = written(links.join(parts.withColumnRenamed("node", "left_id"), "left_id"), "rooted")
    sizes = parts.groupBy("root").agg(F.count("*").alias("n")).join(rooted.groupBy("root").agg(F.count("*").alias("links")), "root")
    sizes = written(sizes, "sizes")
    full = sizes.where("links = n * (n - 1) / 2").select("root")
    whole = rooted.join(full, "root")
    later = F.when(F.col("left_order") < F.col("right_order"), F.col("right_id")).otherwise(F.col("left_id"))
    first = F.min(F.least(F.struct(F.col("left_order").alias("o"), F.col("left_id").alias("id")), F.struct(F.col("right_order").alias("o"), F.col("right_id").alias("id"))))
    founders = whole.groupBy("root").agg(first.alias("f")).select("root", F.col("f.id").alias("founder"))
    worst = whole.groupBy("root", later.alias("id")).agg(F.max(F.struct("level", (-F.col("score")).alias("minus"))).alias("w")).join(founders, "root")
    cliques = worst.select("id", "founder", F.col("w.level").alias("level"), (-F.col("w.minus")).alias("score")).unionByName(founders.select(F.col("founder").alias("id"), "founder", F.lit(0).alias("level"), F.lit(100.0).alias("score")))
    rest = rooted.join(full, "root", "left_anti")
    small = rest.join(sizes.where(F.col("links") <= task_links).select("root"), "root", "left_semi")
    large = rest.join(sizes.where(F.col("links") > task_links).select("root"), "root", "left_semi")
    out = cliques.unionByName(_in_tasks(small))
    return out.unionByName(_in_rounds(large, max(1, int((2 * task_links) ** 0.5)))) if large.limit(1).count() else out


def deduplicate(records: DataFrame, r: DedupRules | None = None, task_links: int = TASK_LINKS) -> DataFrame:
    """records with entity_id, representative_id, level and score: groups in which every record matches every other.

    Records are taken in the order of observation, source and id (no observation last). Records that compare alike and match each other
    are one unit, placed where the first of them is, and are never paired, so many copies cost no pairs. level and score are those of the
    weakest match with the group when a record joined it; 0 and null for the first of a group.
    """
    ensure_checkpoints(records.sparkSession)
    df = united(eligible(records), r)
    heads = written(unit_heads(df, r), "units")
    found = matched_pairs(heads, r)
    for s in ("left", "right"):
        found = found.join(heads.select(F.col("id").alias(f"{s}_id"), F.col("order").alias(f"{s}_order")), f"{s}_id")
    grouped = complete_link_groups(written(found, "links"), task_links)
    placed = heads.select("unit_mark", "id").join(grouped, "id", "left").withColumn("founder", F.coalesce("founder", "id"))
    merged = df.join(placed, "unit_mark")
    alone, copy = F.col("record_id") == F.col("founder"), F.col("record_id") != F.col("id")
    level = F.when(alone, 0).when(copy & (F.col("id") == F.col("founder")), 1).otherwise(F.coalesce("level", F.lit(1)))
    score = F.when(alone, None).when(copy & (F.col("id") == F.col("founder")), 100.0).otherwise(F.coalesce("score", F.lit(100.0)))
    return merged.select(*records.columns, F.concat(F.lit("entity_"), F.substring(F.sha2("founder", 256), 1, 24)).alias("entity_id"), F.col("founder").alias("representative_id"), level.alias("level"), score.alias("score"))


def provenance(merged: DataFrame) -> DataFrame:
    """One row for each record: its entity, how it was matched, with what score and why. No source row is ever lost."""
    method = F.element_at(F.array(F.lit("representative"), F.lit("level_1_exact"), F.lit("level_2_fuzzy_title"), F.lit("level_3_simhash_description")), F.col("level") + 1)
    return merged.select("entity_id", "record_id", "source_id", "representative_id", method.alias("match_method"), "score", F.when(F.col("level") == 0, "first of its group").otherwise("matches every record of its group").alias("reason"))


def apply_decisions(merged: DataFrame, decisions: DataFrame) -> DataFrame:
    """merged after audited decisions (left_id, right_id, decision): different splits a group of two, same only confirms.

    A pair that is not in one group is ignored for different; different on a larger group, or same on two groups, raises.
    """
    ids = merged.select("record_id", "entity_id")
    both = decisions.join(ids.toDF("left_id", "left_entity"), "left_id").join(ids.toDF("right_id", "right_entity"), "right_id")
    sizes = merged.groupBy("entity_id").agg(F.count("*").alias("n"))
    judged = both.join(sizes.withColumnRenamed("entity_id", "left_entity"), "left_entity").withColumn("together", F.col("left_entity") == F.col("right_entity"))
    bad = judged.where(((F.col("decision") == "same") & ~F.col("together")) | ((F.col("decision") == "different") & F.col("together") & (F.col("n") != 2))).limit(1).count()
    if bad:
        raise ValueError("an audited decision does not fit its group")
    split = judged.where("decision = 'different' and together").select(F.explode(F.array("left_id", "right_id")).alias("record_id"), F.lit(True).alias("_split")).distinct()
    out = merged.join(split, "record_id", "left")
    mine = F.col("_split").isNotNull() & (F.col("record_id") != F.col("representative_id"))
    own = F.concat(F.lit("entity_"), F.substring(F.sha2("record_id", 256), 1, 24))
    return out.withColumn("entity_id", F.when(mine, own).otherwise(F.col("entity_id"))).withColumn("representative_id", F.when(mine, F.col("record_id")).otherwise(F.col("representative_id"))).withColumn("level", F.when(mine, 0).otherwise(F.col("level"))).select(*merged.columns)


def report(merged: DataFrame) -> DataFrame:
    """One row: records, entities, groups of more than one record, removed records, rate, groups over several sources."""
    by = merged.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("s"))
    row = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("entities"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.count_if(F.col("s") > 1).alias("cross_source_groups"))
    return row.withColumn("removed", F.col("records") - F.col("entities")).withColumn("dedup_rate", F.col("removed") / F.nullif(F.col("records").cast("double"), F.lit(0.0)))


def pair_sample(keyed_records: DataFrame) -> DataFrame:
    """(left_id, right_id, kind) of pairs to be labelled by hand, a few for each title and never all: left before right.

    Easy ones are the first and last record of one company, city and title. Of each title and the next one of its company and city the
    first records make a negative of two sources, or a hard one of one source. Only titles are sorted, not records.
    """
    one = F.struct("record_id", "source_id")
    titles = keyed_records.groupBy("company_key", "city_key", "title_key").agg(F.min(one).alias("a"), F.max(one).alias("z"))
    easy = titles.where("a.record_id < z.record_id").select("a", F.col("z").alias("b"), F.lit(True).alias("easy"))
    following = F.lead("a").over(W.partitionBy("company_key", "city_key").orderBy("title_key"))
    other = titles.select("a", following.alias("b"), F.lit(False).alias("easy")).where("b is not null")
    kind = F.when(F.col("easy"), "easy").when(F.col("a.source_id") != F.col("b.source_id"), "cross_source_negative").otherwise("hard")
    return easy.union(other).select(F.least("a.record_id", "b.record_id").alias("left_id"), F.greatest("a.record_id", "b.record_id").alias("right_id"), kind.alias("kind"))
