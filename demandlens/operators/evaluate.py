"""Data tests, evaluation against gold labels, quality gates, deterministic splits and samples, label stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.operators.metrics import share, violations
from demandlens.operators.slices import bad_number


def star_checks(entities: DataFrame, source_map: DataFrame, items: DataFrame, entity_items: DataFrame, referred: DataFrame | None = None) -> DataFrame:
    """(test, violations) of the star: unique keys, required values, sane numbers, references.

    Callers that know which rows of source_map and entity_items may be violations, with all that share their keys, can leave the others out.
    referred: the entities to which rows of source_map may refer, where that is known to be fewer.
    """

    def repeated(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

    return violations({
        "entities_unique": repeated(entities, "entity_id"), "items_unique": repeated(items, "item_id"), "records_unique": repeated(source_map, "record_id", "source_id"), "relations_unique": repeated(entity_items, "record_id", "item_id"),
        "entities_id_present": entities.where("entity_id is null"), "items_id_present": items.where("item_id is null"), "records_source_present": source_map.where("source_id is null"),
        "measure_sane": entities.where(bad_number(F.col("measure"))), "cost_ordered": items.where("cost_min > cost_expected or cost_expected > cost_max"),
        "records_reference": source_map.join(entities if referred is None else referred, "entity_id", "left_anti"), "relations_reference": entity_items.join(items, "item_id", "left_anti"),
    })


def require_clean(checks: DataFrame) -> None:
    """Raises if any check has violations. The checks are a few rows."""
    bad = [(r["test"], r["violations"]) for r in checks.where("violations > 0").collect()]
    if bad:
        raise ValueError(f"data tests failed: {bad}")


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / F.nullif(p + r, F.lit(0.0))


def binary(df: DataFrame, gold: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """True and false positives and negatives, precision, recall, F1, false-merge and miss rates; an empty basis gives null."""
    g, p = F.col(gold), F.col(predicted)
    row = df.groupBy(*(by or [])).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    row = row.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "false_merge_rate": share(F.col("fp"), F.col("fp") + F.col("tn")), "miss_rate": share(F.col("fn"), F.col("tp") + F.col("fn"))})
    return row.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(gold, predicted, n)."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, support, predicted_count, precision, recall, f1). A class with support that is never predicted has precision 0."""
    both = F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    sides = df.select(F.explode(both).alias("x"), (F.col(gold) == F.col(predicted)).alias("hit")).groupBy("x.label").agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted_count"), F.sum(F.when(F.col("hit"), F.col("x.g")).otherwise(0)).alias("tp"))
    sides = sides.withColumn("precision", F.when((F.col("predicted_count") == 0) & (F.col("support") > 0), 0.0).otherwise(share(F.col("tp"), F.col("predicted_count")))).withColumn("recall", share(F.col("tp"), F.col("support")))
    return sides.withColumn("f1", F.when(F.col("support") > 0, F.coalesce(f1(F.col("precision"), F.col("recall")), F.lit(0.0)))).drop("tp")


def macro(classes: DataFrame) -> DataFrame:
    """One row: means over the classes with support."""
    return classes.where("support > 0").agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.count("*").alias("classes"))


def multi_label(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: micro and mean precision, recall and F1 of label arrays, share of exact matches. Two empty lists count as 1."""
    g, p = F.array_distinct(gold), F.array_distinct(predicted)
    each = df.select(F.size(F.array_intersect(g, p)).alias("tp"), F.size(g).alias("g"), F.size(p).alias("p"))
    empty = (F.col("g") == 0) & (F.col("p") == 0)
    each = each.withColumn("rp", F.when(empty, 1.0).otherwise(F.coalesce(share(F.col("tp"), F.col("p")), F.lit(0.0)))).withColumn("rr", F.when(empty, 1.0).otherwise(F.coalesce(share(F.col("tp"), F.col("g")), F.lit(0.0))))
    each = each.withColumn("rf", F.coalesce(f1(F.col("rp"), F.col("rr")), F.lit(0.0)))
    row = each.agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.avg("rp").alias("macro_precision"), F.avg("rr").alias("macro_recall"), F.avg("rf").alias("macro_f1"), F.avg(((F.col("tp") == F.col("g")) & (F.col("g") == F.col("p"))).cast("double")).alias("exact_match"), F.count("*").alias("n"))
    row = row.withColumn("micro_precision", share(F.col("tp"), F.col("p"))).withColumn("micro_recall", share(F.col("tp"), F.col("g")))
    return row.withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall"))).drop("tp", "g", "p")


def gate(row: DataFrame, sizes: dict[str, Column], qualities: dict[str, Column]) -> DataFrame:
    """row with checks (name=true or false, joined) and gate: INSUFFICIENT if a size check fails, FAILED if a quality check does, else PASSED."""

    def fine(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    every = {**sizes, **qualities}
    checks = F.array_join(F.array(*[F.concat(F.lit(f"{n}="), fine(c).cast("string")) for n, c in every.items()]), ",")
    ok_sizes, ok_all = (reduce(lambda a, b: a & b, [fine(c) for c in cs.values()], F.lit(True)) for cs in (sizes, every))
    return row.withColumn("checks", checks).withColumn("gate", F.when(~ok_sizes, "INSUFFICIENT").when(~ok_all, "FAILED").otherwise("PASSED"))


def split(key: Column, seed: str, held: int = 3) -> Column:
    """held_out for held of ten keys, by a hash of seed and key, else development."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.when(h % 10 < held, "held_out").otherwise("development")


def round_robin(df: DataFrame, stratum: str, key: str, seed: str, limit: int) -> DataFrame:
    """limit rows, one of each stratum in turn, within a stratum by a hash of seed and key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    ranked = df.withColumn("_h", h).withColumn("_k", F.row_number().over(W.partitionBy(stratum).orderBy("_h", key)))
    # at most limit rows of a stratum can be taken, so the others go before the sort
    return ranked.where(F.col("_k") <= limit).orderBy("_k", F.asc_nulls_first(stratum)).limit(limit).drop("_h", "_k")


def hard_first(df: DataFrame, hard: Column, length: Column, key: str, seed: str, limit: int) -> DataFrame:
    """limit rows: hard ones first, then the longest, then by a hash of seed and key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return df.orderBy(hard.desc(), length.desc(), h, key).limit(limit)


def readiness(labels: DataFrame, samples: DataFrame, key: str, seed: str, needed: int) -> DataFrame:
    """One row: labels, distinct keys, orphans, wrong splits, held-out labels, labels missing to the gate. labels has key and split."""
    marked = labels.join(samples.select(key, F.lit(1).alias("_s")).distinct(), key, "left")
    row = marked.agg(F.count("*").alias("labels"), F.countDistinct(key).alias("distinct_keys"), F.count_if(F.col("_s").isNull()).alias("orphans"), F.count_if(F.col("split") != split(F.col(key), seed)).alias("wrong_splits"), F.count_if(F.col("split") == "held_out").alias("held_out"))
    return row.withColumn("remaining", F.greatest(F.lit(0), F.lit(needed) - F.col("labels")))


def integrity(labels: DataFrame, samples: DataFrame, key: str, seed: str) -> DataFrame:
    """(kind, key): labels given twice, without a sample, or with a split that is not the key's."""
    twice = labels.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), F.col(key).alias("key"))
    orphan = labels.join(samples, key, "left_anti").select(F.lit("orphan").alias("kind"), F.col(key).alias("key"))
    wrong = labels.where(F.col("split") != split(F.col(key), seed)).select(F.lit("wrong_split").alias("kind"), F.col(key).alias("key"))
    return twice.unionByName(orphan).unionByName(wrong)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Label store (key, value, annotator, annotated_at, updated_at, version) after new labels (key, value, annotator, at): latest wins.

    A new label raises the version by one and keeps the first annotated_at; of several new ones of a key the latest counts, once.
    """
    latest = new.groupBy(key).agg(F.max_by(F.struct("value", "annotator"), F.struct("at", "annotator", "value")).alias("l"), F.max("at").alias("at"))
    both = stored.join(latest, key, "full")
    fresh = F.col("at").isNotNull()
    return both.select(
        key, F.when(fresh, F.col("l.value")).otherwise(F.col("value")).alias("value"), F.when(fresh, F.col("l.annotator")).otherwise(F.col("annotator")).alias("annotator"), F.coalesce("annotated_at", "at").alias("annotated_at"),
        F.when(fresh, F.col("at")).otherwise(F.col("updated_at")).alias("updated_at"), (F.coalesce("version", F.lit(0)) + fresh.cast("int")).alias("version"),
    )


def differing(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): which fields differ between two rows of a key; null equals null."""
    a, b = left.select(key, *[F.col(f).alias(f"l_{f}") for f in fields]), right.select(key, *[F.col(f).alias(f"r_{f}") for f in fields])
    return a.join(b, key).select(key, F.array_compact(F.array(*[F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields])).alias("fields"))


#: What published text must not hold: web addresses and local paths.
RESTRICTED = "(?i)https?://|file://|(?:^|\\s)/(?:home|root|users)/|[a-z]:\\\\"


def restricted(df: DataFrame, forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(column, kind, n): forbidden columns, and text columns with restricted content."""
    texts = [c for c, t in df.dtypes if t == "string"]
    counts = [F.count_if(F.col(c).rlike(RESTRICTED)).alias(c) for c in texts]
    found = df.agg(F.count("*").alias("_rows"), *counts)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("restricted_content").alias("kind"), F.col(c).alias("n")) for c in texts], *[F.struct(F.lit(c).alias("column"), F.lit("forbidden_column").alias("kind"), F.col("_rows").alias("n")) for c in forbidden if c in df.columns])
    return found.select(F.explode(pairs).alias("x")).select("x.*").where("n > 0")


def valid_mapping(mapping: DataFrame, catalogue: DataFrame, group: str, member: str) -> DataFrame:
    """(kind, value): groups without a member of the catalogue, and members that are not in it."""
    unknown = mapping.join(catalogue, member, "left_anti").select(F.lit("unknown_member").alias("kind"), F.col(member).alias("value")).distinct()
    known = mapping.join(catalogue, member, "left_semi").select(group).distinct()
    return unknown.unionByName(mapping.select(group).distinct().join(known, group, "left_anti").select(F.lit("empty_group").alias("kind"), F.col(group).alias("value")))


def artifact_audit(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """(name, status) of published files (path, length, content of the binaryFile reader) against an inventory (name, bytes, sha256)."""
    seen = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("seen_bytes"), F.sha2("content", 256).alias("seen_sha256"))
    both = inventory.join(seen, "name", "full")
    status = F.when(F.col("seen_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when((F.col("bytes") == F.col("seen_bytes")) & (F.col("sha256") == F.col("seen_sha256")), "ok").otherwise("changed")
    return both.select("name", status.alias("status"))
