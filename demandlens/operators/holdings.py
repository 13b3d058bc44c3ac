"""Entities with all that is known of them, one row each, so that they meet their records once and are then counted in many ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.sources.shared import shuffle_tasks, written

#: Marks of a cell: the entity has the item; the record has an item; the cell is the first of its record and source.
OWN, LISTED, FIRST = 1, 2, 4
#: Entities are dealt into so many buckets; the lines of one with more than LINES cells beyond twice its bucket's fair share are summed up before they are listed.
BUCKETS, LINES = 65_536, 100_000


def has(mark: int) -> Column:
    return F.col("marks").bitwiseAND(F.lit(mark)) != 0


def holdings(cells: DataFrame, entities: DataFrame, sent: Callable[[DataFrame, str], DataFrame], lines: int = LINES) -> DataFrame:
    """(entity_id, rows, items, cells) of each entity with cells, also of those that entities does not have, written.

    cells (entity_id, item_id, source_id, marks, records, dated): what a record says, once for each of its items and sources, which are best
    numbers, as they are narrow; dated is how many rows of the source map the record has. rows are the entity's rows of entities (role_id,
    event_date, measure), items its own items once each in order, null last. Cells reach their entity in one shuffle. Those of entities with
    very many are first summed by all tasks, so that a list is no longer than the items and sources of its entity. sent writes and counts a table.
    """
    key, values = ["entity_id", "item_id", "source_id", "marks"], ["records", "dated"]
    cells = cells.where("entity_id is not null")
    bucket = F.pmod(F.hash("entity_id"), F.lit(BUCKETS)).alias("_bucket")
    full = cells.groupBy(bucket).agg(F.count("*").alias("n"))
    full = written(full.crossJoin(F.broadcast(full.agg((F.sum("n") * 2 / BUCKETS + lines).alias("_most")))).where("n > _most"), "full_buckets")  # BUCKETS rows at most
    busy = cells.select("entity_id", bucket).join(F.broadcast(full), "_bucket").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("_most").alias("_most")).where("n > _most")
    busy = sent(busy.select("entity_id"), "busy_entities")
    summed = cells.join(busy, "entity_id", "left_semi").groupBy(*key).agg(*[F.sum(v).alias(v) for v in values])
    dealt = cells.join(busy, "entity_id", "left_anti").select(*key, *values).unionByName(summed).repartition(shuffle_tasks(cells.sparkSession), "entity_id")
    listed = dealt.groupBy("entity_id").agg(F.collect_list(F.struct(*key[1:], *values)).alias("cells"))
    rows = entities.where("entity_id is not null").groupBy("entity_id").agg(F.collect_list(F.struct("role_id", "event_date", "measure")).alias("rows"))
    items = F.array_sort(F.array_distinct(F.transform(F.filter("cells", lambda c: c["marks"].bitwiseAND(F.lit(OWN)) != 0), lambda c: c["item_id"])))
    sourced = F.filter("cells", lambda c: c["source_id"].isNotNull())
    return written(listed.join(rows, "entity_id", "left").select("entity_id", "rows", items.alias("items"), sourced.alias("cells")), "holdings")


def _roles() -> Column:
    """The roles of an entity, once each; none where entities does not have it."""
    return F.array_sort(F.array_distinct(F.coalesce(F.transform("rows", lambda r: r["role_id"]), F.expr("cast(array() as array<string>)"))))


def by_scope(counts: DataFrame, *keys: str, n: str = "n", whole: str = "global") -> DataFrame:
    """(scope, *keys, n): sums for the text whole and for each value of role_id, or of the list roles."""
    scopes = F.array_append(F.col("roles"), F.lit(whole)) if "roles" in counts.columns else F.array(F.lit(whole), F.col("role_id").cast("string"))
    return counts.withColumn("scope", F.explode(scopes)).where("scope is not null").groupBy("scope", *keys).agg(F.sum(n).alias(n))


def pairs(held: DataFrame) -> DataFrame:
    """(role_id, event_date, measure, item_id): pairs of entity and item joined with entities."""
    return held.select("items", F.inline("rows")).select("role_id", "event_date", "measure", F.explode("items").alias("item_id"))


def supports(held: DataFrame) -> DataFrame:
    """(roles, item_id, n): entities with each item, by the roles that they have."""
    return held.select(_roles().alias("roles"), F.explode("items").alias("item_id")).groupBy("roles", "item_id").agg(F.count("*").alias("n"))


def co_counts(held: DataFrame) -> DataFrame:
    """(roles, item_a, item_b, n): entities with both items, item_a < item_b, by the roles that they have."""
    first = held.select(_roles().alias("roles"), F.array_compact("items").alias("items")).select("roles", "items", F.posexplode("items").alias("_at", "item_a"))
    rest = F.slice("items", F.col("_at") + 2, F.size("items"))
    return first.select("roles", "item_a", F.explode(rest).alias("item_b")).groupBy("roles", "item_a", "item_b").agg(F.count("*").alias("n"))


def records(held: DataFrame) -> DataFrame:
    """(roles, source_id, item_id, marks, n): records of entities that are there, by their roles."""
    each = held.where("rows is not null").select(_roles().alias("roles"), F.inline("cells"))
    return each.groupBy("roles", "source_id", "item_id", "marks").agg(F.sum("records").alias("n"))


def evidence(held: DataFrame) -> DataFrame:
    """(source_id, role_id, has_items, n, newest): rows of the source map joined with entities, and the newest event among them."""
    each = held.select("cells", F.inline("rows")).select("role_id", "event_date", F.inline("cells")).where(has(FIRST))
    return each.groupBy("source_id", "role_id", has(LISTED).alias("has_items")).agg(F.sum("dated").alias("n"), F.max("event_date").alias("newest"))
