"""Benchmark passages in documents: a prefix-filtered join on the rarest word of each window, then exact comparison. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import ascii_lower, written

#: Words of a window, and windows that one pass over the documents broadcasts; more windows take more passes.
SIZE, PASS_WINDOWS = 10, 100_000


def item_words(c: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case; null gives none."""
    return F.filter(F.split(ascii_lower(F.coalesce(c, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != "")


def windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(window, items): each distinct run of size words of an item, or the whole of a shorter one, with the ids of its items as text."""
    w = benchmark.select(F.col(id_col).cast("string").alias("item"), item_words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(size))
    each = w.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Per row of docs: doc_id, mark (hash of the text), n_words, hits (array of place and length of all occurrences), items (their ids, sorted).

    A window can only occur where its rarest word does (words ordered by their count over all documents), so that word is its prefix.
    Documents' words are joined with the prefixes; a match fits if enough words stand before and after it; then the words of the
    document at that place are compared with the window.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = texts.select("doc_id", F.xxhash64("text").alias("mark"), item_words(F.col("text")).alias("w"))
    listed = written(windows(benchmark, item_col, item_text, size).withColumn("window_id", F.monotonically_increasing_id()), "windows")

    vocabulary = listed.select(F.explode("window").alias("word")).distinct()
    n_words, n_windows = vocabulary.count(), listed.count()
    small = F.broadcast if n_words <= 10 * pass_windows else lambda d: d
    counted = split.select(F.explode("w").alias("word")).join(small(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    tokens = listed.select("window_id", F.posexplode("window").alias("at", "word"))
    rarity = tokens.join(counted, "word")  # a window with a word that no document has cannot occur
    whole = tokens.groupBy("window_id").agg(F.count("*").alias("length"))
    prefix = rarity.groupBy("window_id").agg(F.count("*").alias("found"), F.min(F.struct("n", "word", "at")).alias("p")).join(whole, "window_id").where("found = length")
    prefixes = written(listed.join(prefix.select("window_id", F.col("p.word").alias("word"), F.col("p.at").alias("at"), "length"), "window_id"), "prefixes")

    passes = max(1, -(-n_windows // pass_windows))
    end = F.array(F.lit(""))  # a word that stands for the end of each document, so that documents without occurrences stay
    ending = prefixes.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(None).cast("array<string>").alias("window"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).alias("at"), F.lit(0).alias("length"))
    found = None
    for k in range(passes):
        block = prefixes.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == k).select("word", "window", "items", "at", "length").union(ending)
        # bounded: a pass has about pass_windows windows
        placed = split.select("doc_id", "mark", "w", F.posexplode(F.concat("w", end)).alias("pos", "word")).join(F.broadcast(block), "word")
        start = F.col("pos") - F.col("at")
        fits = (start >= 0) & (start + F.col("length") <= F.size("w"))
        same = F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.col("window")
        hits = placed.where((F.col("word") == "") | (fits & same))
        part = hits.select("doc_id", "mark", F.size("w").alias("n_words"), (F.col("word") == "").alias("last"), F.struct(start.alias("start"), "length").alias("hit"), "items")
        found = part if found is None else found.union(part)
    one = found.groupBy("doc_id", "mark").agg(
        F.max("n_words").alias("n_words"),
        (F.sum(F.col("last").cast("long")) / passes).cast("long").alias("copies"),
        F.array_sort(F.collect_set(F.when(~F.col("last"), F.col("hit")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("last"), F.col("items")))))).alias("items"),
    )
    return one.select("doc_id", "mark", "n_words", "hits", "items", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


def covered(hits: Column) -> Column:
    """Words inside at least one of the sorted hits."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        hits,
        zero,
        lambda a, h: F.struct(F.greatest(a["end"], h["start"] + h["length"]).cast("long").alias("end"), (a["sum"] + F.greatest(F.lit(0).cast("long"), h["start"] + h["length"] - F.greatest(a["end"], h["start"].cast("long")))).cast("long").alias("sum")),
        lambda a: a["sum"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = SIZE, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Benchmark windows in whole documents: doc_id, mark, n_words, n_hit, n_items, items, contaminated; one row per row of docs.

    Null and blank texts have no words, items without words no window; an empty benchmark leaves every document clean and an empty
    table of documents gives no rows. Repeated rows stay; rows with a null id are kept; items with a null id hit but are not listed;
    other columns are ignored.
    """
    found = occurrences(docs, benchmark, id_col, text_col, item_col, item_text, size, pass_windows)
    hit = covered(F.col("hits"))
    return found.select("doc_id", "mark", F.col("n_words").cast("long"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (F.size("hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark window; the others stay as they were.

    Rows are told apart by id and text, so of rows with one id, or with none, only those whose own text has a window go. Null and empty
    texts stay, repeated rows go or stay together, columns of any names keep their values; an empty table gives no rows.
    """
    bad = written(contamination(docs, benchmark, id_col, text_col).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "contaminated")
    same = docs[id_col].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs[text_col].cast("string")) == bad["bad_mark"])
    return docs.join(bad, same, "left_anti")
