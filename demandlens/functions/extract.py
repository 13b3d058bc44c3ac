"""Rule-based extraction of items from texts, evidence from structured lists, and which evidence wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Confidence and rank of the kinds of rules, and the confidence of structured evidence; fixed values.
CANONICAL, ALIAS, SHORT, STRUCTURED = (0.98, 3), (0.95, 2), (0.90, 1), 0.85
#: What may not stand beside a term; js is also no term after a dot. Fixed values.
SIGNS, BEFORE, BEFORE_JS = "A-Za-z0-9_", "(?<![A-Za-z0-9_])", "(?<![A-Za-z0-9_.])"


def bounded(term: Column) -> Column:
    """A pattern for a term in any case between signs that are not ASCII letters, digits or underscores; what the term holds stands for itself."""
    quoted = F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?i)"), F.when(F.lower(term) == "js", BEFORE_JS).otherwise(BEFORE), quoted, F.lit(f"(?![{SIGNS}])"))


def rules_frame(catalogue: DataFrame, short: DataFrame | None = None) -> DataFrame:
    """(item, term, method, confidence, rank, pattern) of a catalogue (item, name, aliases).

    short (item, pattern): items whose name is too short to be told by itself, with a pattern of the name in its context, which stands for
    the name. pattern is null where the term decides alone.
    """

    def kind(method: str, of: tuple[float, int]) -> Column:
        return F.struct(F.lit(method).alias("method"), F.lit(of[0]).alias("confidence"), F.lit(of[1]).alias("rank"))

    named = catalogue.select("item", F.col("name").alias("term"))
    named = named.join(short.select("item", "pattern"), "item", "left") if short is not None else named.withColumn("pattern", F.lit(None).cast("string"))
    named = named.withColumn("k", F.when(F.col("pattern").isNotNull(), kind("rule_short_context", SHORT)).otherwise(kind("rule_canonical", CANONICAL)))
    other = catalogue.select("item", F.explode("aliases").alias("term"), F.lit(None).cast("string").alias("pattern"), kind("rule_alias", ALIAS).alias("k"))
    return named.unionByName(other).select("item", "term", "k.*", "pattern").distinct()


def token_matches(docs: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, item, method, confidence, start, matched) of texts and rules (as rules_frame gives them), one best match for each text and item.

    Best is the highest confidence, then method, then the earliest place; full ties keep the longer term. A text can hold a term only if it
    has the term's first ASCII word among its own, so texts meet rules of any number by an equality join on words; terms without such a
    word meet them by their first two characters. Only what has met is looked at with the rule's pattern. Null texts and terms match
    nothing; repeated rules count once; only texts with a match give rows.
    """
    word = F.regexp_extract(F.lower("term"), "[a-z0-9_]+", 0)
    known = rules.where(F.length("term") > 0).distinct().select(
        "item", "term", "method", "confidence", "rank", F.col("pattern").isNotNull().alias("own"), F.coalesce("pattern", bounded(F.col("term"))).alias("pattern"), F.when(word != "", word).otherwise(F.substring(F.lower("term"), 1, 2)).alias("token"), (word == "").alias("wordless")
    )
    low = F.lower(text_col)
    tokens = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0)
    if known.where("wordless").limit(1).count():
        starts = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.substring(low, i, F.lit(2)))
        signs = F.filter(F.concat(starts, F.transform(starts, lambda x: F.left(x, F.lit(1)))), lambda x: ~F.left(x, F.lit(1)).rlike("[a-z0-9_]"))
        tokens = F.concat(tokens, F.when(F.length(low) > 0, signs).otherwise(F.array().cast("array<string>")))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    met = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(tokens)).alias("token")).distinct().join(known, "token")
    asked = met.groupBy("_id").agg(F.collect_set(F.struct("item", "method", "confidence", "rank", "term", "own", "pattern")).alias("rules"))
    both = texts.join(asked, texts["id"].eqNullSafe(asked["_id"])).select("id", "text", F.explode("rules").alias("r"))
    found = both.withColumn("start", F.regexp_instr("text", F.col("r.pattern")) - 1).where("start >= 0")
    matched = F.when(F.col("r.own"), F.expr("regexp_extract(text, r.pattern, 0)")).otherwise(F.substring(F.col("text"), F.col("start") + 1, F.length("r.term")))
    best = found.groupBy("id", F.col("r.item").alias("item")).agg(
        F.max_by(F.struct(F.col("r.method").alias("method"), F.col("r.confidence").alias("confidence"), "start", matched.alias("matched")), F.struct("r.confidence", "r.rank", -F.col("start"), F.length("r.term"), "r.term")).alias("b")
    )
    return best.select("id", "item", "b.*")


def structured(docs: DataFrame, aliases: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(id, item, method, confidence, matched) of a JSON list of terms looked up in an alias table (term, item)."""
    terms = docs.select(F.col(id_col).alias("id"), F.explode(F.from_json(list_col, "array<string>")).alias("matched")).withColumn("term", F.lower(F.trim("matched")))
    return terms.join(aliases, "term").groupBy("id", "item").agg(F.min("matched").alias("matched")).select("id", "item", F.lit("structured").alias("method"), F.lit(STRUCTURED).alias("confidence"), "matched")


def by_precedence(evidence: list[DataFrame]) -> DataFrame:
    """(id, item, method, confidence, matched): of several evidence frames the first in the list wins, whatever its confidence."""
    every = None
    for k, df in enumerate(evidence):
        part = df.select("id", "item", "method", "confidence", "matched", F.lit(k).alias("precedence"))
        every = part if every is None else every.unionByName(part)
    w = W.partitionBy("id", "item").orderBy("precedence")
    return every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "precedence")


def alias_index(catalogue: DataFrame) -> DataFrame:
    """(term, item) of a catalogue (item, name, aliases), terms in lower case."""
    return catalogue.select("item", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term")).select(F.lower(F.trim("term")).alias("term"), "item").distinct()


def ambiguous_terms(index: DataFrame) -> DataFrame:
    """(term, items): terms of more than one item."""
    return index.groupBy("term").agg(F.countDistinct("item").alias("items")).where("items > 1")


def resolved(catalogue: DataFrame, defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """catalogue (item, category) with the rule of the item itself or else of its category (rule)."""
    return catalogue.join(overrides.select("item", F.col("rule").alias("_own")), "item", "left").join(defaults.select("category", F.col("rule").alias("_default")), "category", "left").withColumn("rule", F.coalesce("_own", "_default")).drop("_own", "_default")


def report(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """One row: texts, texts with items, relations, distinct items."""
    return docs.agg(F.count("*").alias("texts")).crossJoin(found.agg(F.countDistinct("id").alias("texts_with_items"), F.count("*").alias("relations"), F.countDistinct("item").alias("items")))
