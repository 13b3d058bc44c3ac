"""Item graphs: co-occurrence, edge and node metrics, communities, relations of one item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.sources.shared import written, written_counted


def co_counts(pairs: DataFrame, entity: str = "entity_id", item: str = "item_id") -> DataFrame:
    """(item_a, item_b, n): entities with both items, item_a < item_b. pairs are distinct."""
    a, b = pairs.select(entity, F.col(item).alias("item_a")), pairs.select(entity, F.col(item).alias("item_b"))
    return a.join(b, entity).where("item_a < item_b").groupBy("item_a", "item_b").agg(F.count("*").alias("n"))


def posting_bitmaps(pairs: DataFrame, number: str, item: str = "item_id") -> DataFrame:
    """(item, bucket, bits): each item's entities as bitmaps, one for each bucket of 32,768 numbers that it has any in.

    number is a column of whole numbers that tells entities apart. Bitmaps are made before the shuffle and united after it, so an item that
    most entities have costs a few kilobytes for each bucket and task.
    """
    return pairs.where(F.col(item).isNotNull() & F.col(number).isNotNull()).groupBy(F.col(item).alias("item_id"), F.bitmap_bucket_number(F.col(number)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(number))).alias("bits"))


def set_sizes(bitmaps: DataFrame) -> DataFrame:
    """(item_id, n): the entities of each item."""
    return bitmaps.groupBy("item_id").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def overlaps(bitmaps: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(item_a, item_b, both_sets, either_set) of pairs of items: how many entities have both, how many either.

    All pairs that have any in common, item_a < item_b, or those of wanted (item_a, item_b), also with none in common. Items meet in
    buckets, so a pair costs a few kilobytes for each bucket and not a row for each entity that has both; no pair of entities is made.
    """
    bitmaps = written(bitmaps, "bitmaps")
    a, b = (bitmaps.select(F.col("item_id").alias(f"item_{s}"), "bucket", F.col("bits").alias(f"bits_{s}")) for s in "ab")
    if wanted is not None:
        met = wanted.select("item_a", "item_b").distinct().join(a, "item_a").join(b, ["item_b", "bucket"])
    else:
        met = a.join(b, "bucket").where("item_a < item_b")
    each = met.select("item_a", "item_b", "bucket", F.explode(F.array("bits_a", "bits_b")).alias("bits")).groupBy("item_a", "item_b", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    both = each.groupBy("item_a", "item_b").agg(F.sum(F.bitmap_count("bits")).alias("both_sets")).where("both_sets > 0")
    if wanted is not None:
        both = wanted.select("item_a", "item_b").distinct().join(both, ["item_a", "item_b"], "left").fillna(0, ["both_sets"])
    n = set_sizes(bitmaps)
    sized = both.join(n.toDF("item_a", "n_a"), "item_a", "left").join(n.toDF("item_b", "n_b"), "item_b", "left").fillna(0, ["n_a", "n_b"])
    return sized.select("item_a", "item_b", "both_sets", (F.col("n_a") + F.col("n_b") - F.col("both_sets")).alias("either_set"))


def support(pairs: DataFrame) -> DataFrame:
    """(item_id, support): entities with each item."""
    return pairs.groupBy("item_id").agg(F.count("*").alias("support"))


def jaccard(both: Column, a: Column, b: Column) -> Column:
    return both.cast("double") / F.nullif((a + b - both).cast("double"), F.lit(0.0))


def pmi(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Pointwise mutual information, natural logarithm."""
    return F.ln(both.cast("double") * n / (a.cast("double") * b))


def edges(pairs: DataFrame, n: int | Column, least_count: int = 3, least_jaccard: float = 0.01) -> DataFrame:
    """All item pairs with support, Jaccard index, PMI and whether they pass the gates; the weight of an edge is its Jaccard index."""
    s = support(pairs)
    size = F.lit(n) if isinstance(n, int) else n
    joined = co_counts(pairs).join(s.select(F.col("item_id").alias("item_a"), F.col("support").alias("support_a")), "item_a").join(s.select(F.col("item_id").alias("item_b"), F.col("support").alias("support_b")), "item_b")
    out = joined.withColumn("jaccard", jaccard(F.col("n"), F.col("support_a"), F.col("support_b"))).withColumn("pmi_nat", pmi(F.col("n"), F.col("support_a"), F.col("support_b"), size))
    return out.withColumn("kept", (F.col("n") >= least_count) & (F.col("jaccard") >= least_jaccard))


def scoped_edges(pairs: DataFrame, entities: DataFrame, scope: str = "role_id", whole: str = "global", least_count: int = 3, least_jaccard: float = 0.01) -> DataFrame:
    """(scope, ...) with the columns of edges: item pairs over all entities (scope is the text whole) and over those of each value of a column.

    Entities meet themselves once. As each has one value, the counts over all entities are the sums of those by value.
    """
    sized = entities.select("entity_id", F.col(scope).cast("string").alias("scope"))
    mine = written(pairs.join(sized, "entity_id"), "scoped_pairs")

    def with_whole(counts: DataFrame, *keys: str) -> DataFrame:
        both = F.explode(F.array(F.lit(whole), F.col("scope")))
        return counts.withColumn("scope", both).where("scope is not null").groupBy("scope", *keys).agg(F.sum("n").alias("n"))

    a, b = (mine.select("entity_id", F.col("item_id").alias(f"item_{s}"), *["scope"] * (s == "a")) for s in "ab")
    co = with_whole(a.join(b, "entity_id").where("item_a < item_b").groupBy("scope", "item_a", "item_b").agg(F.count("*").alias("n")), "item_a", "item_b")
    s = written(with_whole(mine.groupBy("scope", "item_id").agg(F.count("*").alias("n")), "item_id"), "support")
    n = with_whole(sized.groupBy("scope").agg(F.count("*").alias("n")))
    return scored(co, s, n, least_count, least_jaccard)


def scored(co: DataFrame, s: DataFrame, n: DataFrame, least_count: int = 3, least_jaccard: float = 0.01) -> DataFrame:
    """What scoped_edges gives, from (scope, item_a, item_b, n), (scope, item_id, n) and (scope, n)."""
    n = n.withColumnRenamed("n", "entities")
    joined = co.join(s.toDF("scope", "item_a", "support_a"), ["scope", "item_a"]).join(s.toDF("scope", "item_b", "support_b"), ["scope", "item_b"]).join(n, "scope")
    out = joined.withColumn("jaccard", jaccard(F.col("n"), F.col("support_a"), F.col("support_b"))).withColumn("pmi_nat", pmi(F.col("n"), F.col("support_a"), F.col("support_b"), F.col("entities")))
    return out.withColumn("kept", (F.col("n") >= least_count) & (F.col("jaccard") >= least_jaccard)).drop("entities")


def _both_ways(e: DataFrame, *values: str) -> DataFrame:
    return e.select(F.col("item_a").alias("item_id"), F.col("item_b").alias("other"), *values).union(e.select(F.col("item_b").alias("item_id"), F.col("item_a").alias("other"), *values))


def nodes(pairs: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """(item_id, support, coverage, degree, weighted_degree); items without edges stay with degree 0."""
    degrees = _both_ways(kept, "jaccard").groupBy("item_id").agg(F.count("*").alias("degree"), F.sum("jaccard").alias("weighted_degree"))
    return support(pairs).join(degrees, "item_id", "left").fillna({"degree": 0, "weighted_degree": 0.0}).withColumn("coverage", F.col("support") / F.nullif(F.lit(float(n)), F.lit(0.0)))


def build_report(all_edges: DataFrame) -> DataFrame:
    """One row: pairs, kept and filtered edges."""
    return all_edges.agg(F.count("*").alias("pairs"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("filtered"))


def neighbours(kept: DataFrame, item: str) -> DataFrame:
    """The other ends of an item's edges, strongest first."""
    other = F.when(F.col("item_a") == item, F.col("item_b")).otherwise(F.col("item_a"))
    return kept.where((F.col("item_a") == item) | (F.col("item_b") == item)).select(other.alias("item_id"), "n", "jaccard", "pmi_nat").orderBy(F.desc("jaccard"), F.desc("n"), "item_id")


def relations(pairs: DataFrame, core: str, n: int, least_sample: int = 4, small_sample: int = 10, least_count: int = 3, least_jaccard: float = 0.01) -> DataFrame:
    """Items that go with one core item in a slice of n entities: co-count, conditional coverage, Jaccard index, PMI (base 2), sample status.

    No rows below least_sample entities. Order: Jaccard, count, id.
    """
    s = support(pairs)
    mine = pairs.where(F.col("item_id") == core).select("entity_id")
    both = pairs.join(mine, "entity_id", "left_semi").where(F.col("item_id") != core).groupBy("item_id").agg(F.count("*").alias("n"))
    own = s.where(F.col("item_id") == core).select(F.col("support").alias("core_support"))
    joined = both.join(s, "item_id").crossJoin(F.broadcast(own))  # one row
    size = F.lit(float(n))
    out = joined.select(
        "item_id", "n", "support", "core_support", (F.col("n") / F.col("core_support").cast("double")).alias("conditional_coverage"), jaccard(F.col("n"), F.col("support"), F.col("core_support")).alias("jaccard"),
        (F.log2(F.col("n") * size / (F.col("support").cast("double") * F.col("core_support")))).alias("pmi_log2"), F.when(F.lit(n < small_sample), "small_sample").otherwise("ok").alias("status"),
    )
    return out.where((F.col("n") >= least_count) & (F.col("jaccard") >= least_jaccard) & F.lit(n >= least_sample)).orderBy(F.desc("jaccard"), F.desc("n"), "item_id")


def synergy(node_table: DataFrame, kept: DataFrame, pmi_cap: float = 2.0) -> DataFrame:
    """(item_id, synergy) of 0 to 1: 0.4 centrality, 0.2 log-support, 0.2 Jaccard and 0.2 positive PMI weighted by the neighbours' support.

    Centrality is the share of other items that an item has an edge with.
    """
    sides = _both_ways(kept, "jaccard", "pmi_nat").join(node_table.select(F.col("item_id").alias("other"), F.col("support").alias("w")), "other")
    strength = sides.groupBy("item_id").agg(F.sum(F.col("jaccard") * F.col("w")).alias("j"), F.sum(F.least(F.lit(pmi_cap), F.greatest(F.lit(0.0), F.col("pmi_nat"))) / pmi_cap * F.col("w")).alias("p"), F.sum("w").cast("double").alias("w"))
    top = node_table.agg(F.max(F.log1p(F.col("support").cast("double"))).alias("top"), F.count("*").alias("items"))
    joined = node_table.join(strength, "item_id", "left").crossJoin(F.broadcast(top))  # one row
    centrality = F.coalesce(F.col("degree") / F.nullif((F.col("items") - 1).cast("double"), F.lit(0.0)), F.lit(0.0))
    score = 0.4 * centrality + 0.2 * F.coalesce(F.log1p(F.col("support").cast("double")) / F.nullif(F.col("top"), F.lit(0.0)), F.lit(0.0)) + 0.2 * F.coalesce(F.col("j") / F.col("w"), F.lit(0.0)) + 0.2 * F.coalesce(F.col("p") / F.col("w"), F.lit(0.0))
    return joined.select("item_id", score.alias("synergy"))


def _quality(links: DataFrame, now: DataFrame) -> float:
    """Modularity of a division (item_id, community) of links (a, b, w), one row for each edge; nan without links."""
    ends = links.join(now.toDF("a", "at_a"), "a").join(now.toDF("b", "at_b"), "b")
    inner = F.when(F.col("at_a") == F.col("at_b"), F.col("w")).otherwise(0.0)
    sides = F.explode(F.array(F.struct(F.col("at_a").alias("c"), inner.alias("i"), "w"), F.struct(F.col("at_b").alias("c"), inner.alias("i"), "w")))
    by = ends.select(sides.alias("s")).groupBy("s.c").agg(F.sum("s.i").alias("inner"), F.sum("s.w").alias("mass"))
    sums = by.agg(F.sum("inner").alias("i"), F.sum(F.col("mass") * F.col("mass")).alias("s"), F.sum("mass").alias("m2")).first()
    return sums["i"] / sums["m2"] - sums["s"] / sums["m2"] ** 2 if sums["m2"] else float("nan")


def _masses(links: DataFrame) -> DataFrame:
    """(c, mass): the weight of all ends of links (a, b, w) at each community; a link inside a community has both there."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("c"), "w"), F.struct(F.col("b").alias("c"), "w")))
    return links.select(ends.alias("e")).groupBy("e.c").agg(F.sum("e.w").alias("mass"))


def _merges(links: DataFrame, m2: float, enough: float = 0.9) -> tuple[DataFrame, int]:
    """(old, new): which communities merge into which in one round, and how many do. links (a, b, w) has a <= b, m2 is the weight of all ends.

    Pairs have one order, by modularity gain, then by their ends. A pair that is the first of both its ends merges; the first pair of all is
    one, so that every round with a gain merges some. Others whose first pair leads to the heavier end of such a pair, a hub, join it too,
    in their order, while what they gain beside those before them is still enough of what they gain alone. So hubs need no round for
    each of their neighbours.
    """
    mass = _masses(links)
    pairs = links.where("a <> b").join(mass.toDF("a", "mass_a"), "a").join(mass.toDF("b", "mass_b"), "b")
    pairs = pairs.withColumn("gain", F.round(2 * (F.col("w") / m2 - F.col("mass_a") * F.col("mass_b") / m2**2), 12)).where("gain > 0")
    pair = F.struct((-F.col("gain")).alias("minus"), "a", "b", "w", "mass_a", "mass_b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), pair.alias("p")).groupBy("c").agg(F.min("p").alias("p"))
    firsts = written(ends.select("c", "p.*"), "firsts")
    mutual = firsts.groupBy("a", "b", "mass_a", "mass_b").agg(F.count("*").alias("n")).where("n = 2").drop("n")
    heavier = F.col("mass_a") >= F.col("mass_b")
    mutual = mutual.select(F.when(heavier, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(heavier, F.col("b")).otherwise(F.col("a")).alias("other"), (F.col("mass_a") + F.col("mass_b")).alias("start"))
    paired = mutual.select(F.explode(F.array("hub", "other")).alias("c"))
    free = firsts.join(paired, "c", "left_anti").withColumn("hub", F.when(F.col("c") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    free = free.withColumn("own", F.when(F.col("c") == F.col("a"), F.col("mass_a")).otherwise(F.col("mass_b"))).join(mutual.select("hub", "start"), "hub")
    before = F.sum("own").over(W.partitionBy("hub").orderBy("minus", "a", "b")) - F.col("own") + F.col("start")
    joins = free.withColumn("before", before).where(2 * (F.col("w") / m2 - F.col("own") * F.col("before") / m2**2) >= -enough * F.col("minus"))
    every = mutual.select(F.col("other").alias("old"), F.col("hub").alias("new")).unionByName(joins.select(F.col("c").alias("old"), F.col("hub").alias("new")))
    return written_counted(every, "merges")


def _renamed(df: DataFrame, column: str, merges: DataFrame) -> DataFrame:
    return df.join(merges.toDF(column, "_new"), column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def _agglomerated(links: DataFrame, now: DataFrame, m2: float, at_once: int = 8) -> DataFrame:
    """(item_id, community): communities merged by modularity gain until no merge gains. Links between two communities become one link.

    Items follow the merges of at_once rounds at a time.
    """
    pending: list[DataFrame] = []
    while True:
        merges, more = _merges(links, m2)
        if more:
            pending.append(merges)
            ends = _renamed(_renamed(links, "a", merges), "b", merges)
            links = written(ends.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "links")
        if len(pending) == at_once or not more:
            for m in pending:
                now = _renamed(now, "community", m)
            now, pending = written(now, "members"), []
        if not more:
            return now


def _moved(links: DataFrame, now: DataFrame, m2: float, most_still: int = 3) -> DataFrame:
    """(item_id, community): items of a division moved to the neighbouring community of the largest gain, until that raises the modularity no more.

    In each round a third of the items, by a hash of item and round, move if they gain, so that two neighbours seldom swap. The best
    division met is the result; most_still rounds in a row without a better one end it.
    """
    ways = F.explode(F.array(F.struct(F.col("a").alias("item_id"), F.col("b").alias("other"), "w"), F.struct(F.col("b").alias("item_id"), F.col("a").alias("other"), "w")))
    both = written(links.where("a <> b").select(ways.alias("e")).select("e.*"), "ways")
    weights = written(_masses(links).toDF("item_id", "k"), "weights")
    linked = now.join(weights.select("item_id"), "item_id", "left_semi")  # others have no neighbours
    best, best_q, still, r = linked, _quality(links, linked), 0, 0
    while still < most_still:
        placed = linked.join(weights, "item_id")
        mass = placed.groupBy("community").agg(F.sum("k").alias("mass"))
        toward = both.join(linked.toDF("other", "community"), "other").groupBy("item_id", "community").agg(F.sum("w").alias("into"))
        own = placed.select("item_id", "k", F.col("community").alias("at"))
        every = toward.join(own, "item_id").unionByName(own.select("item_id", F.col("at").alias("community"), F.lit(0.0).alias("into"), "k", "at"))
        every = every.groupBy("item_id", "community", "k", "at").agg(F.sum("into").alias("into")).join(mass, "community")
        stays = F.col("community") == F.col("at")
        gain = F.round(F.col("into") - F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) / m2, 12)
        first = every.groupBy("item_id", "at").agg(F.min(F.struct((-gain).alias("minus"), (~stays).alias("moves"), "community")).alias("f"))
        turn = F.pmod(F.xxhash64("item_id", F.lit(r)), F.lit(3)) == 0
        step = first.select("item_id", F.when(turn, F.col("f.community")).otherwise(F.col("at")).alias("community"), F.col("f.moves").alias("gains"))
        step, gaining = written_counted(step, "moves", F.col("gains"))
        if not gaining:
            break
        linked, r = step.drop("gains"), r + 1
        q = _quality(links, linked)
        best, best_q, still = (linked, q, 0) if q > best_q + 1e-9 else (best, best_q, still + 1)
    return best.unionByName(now.join(weights.select("item_id"), "item_id", "left_anti"))


def communities(node_table: DataFrame, kept: DataFrame) -> DataFrame:
    """(item_id, community, size): communities of an undirected weighted graph by parallel agglomeration.

    Every item starts alone. In each round communities that are each other's best partner by modularity gain merge, and hubs take in
    several; the links between two merged communities become one. When no merge gains, single items are moved while that raises the
    modularity. Each round writes its small tables and reads them again, so plans stay short. Communities are numbered by falling size,
    then by their least item. Items without edges stay alone.
    """
    links = kept.groupBy(F.least("item_a", "item_b").alias("a"), F.greatest("item_a", "item_b").alias("b")).agg(F.sum(F.col("jaccard").cast("double")).alias("w"))
    links = written(links.where("w > 0"), "links")
    now = written(node_table.select("item_id", F.col("item_id").alias("community")), "members")
    m2 = 2 * (links.agg(F.sum("w")).first()[0] or 0.0)
    if m2:
        now = _moved(links, _agglomerated(links, now, m2), m2)
    sizes = now.groupBy("community").agg(F.count("*").alias("size"), F.min("item_id").alias("first"))
    numbered = sizes.withColumn("number", F.row_number().over(W.orderBy(F.desc("size"), "first")) - 1)  # one row per community
    return now.join(numbered, "community").select("item_id", F.col("number").alias("community"), "size")


def modularity(member: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: the modularity of a division (item_id, community) of the graph; null without edges."""
    links = _both_ways(kept, F.col("jaccard").alias("w"))
    at = member.select("item_id", "community")
    inside = links.join(at, "item_id").join(at.select(F.col("item_id").alias("other"), F.col("community").alias("there")), "other")
    by = inside.groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("there"), F.col("w")).otherwise(0.0)).alias("inner"), F.sum("w").alias("mass"))
    m2 = F.sum("mass").over(W.partitionBy())
    each = by.select((F.col("inner") / m2 - F.pow(F.col("mass") / m2, 2)).alias("q"))
    return each.agg(F.sum("q").alias("modularity"))
