"""Spelling variants: words one letter apart, met by PartEnum signatures of their letters."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import ascii_lower, written

#: Least letters and occurrences of a word, how many times as frequent its form is, and parts of the letters of which two may differ.
LEAST_LETTERS, LEAST_COUNT, TIMES, PARTS = 6, 5, 5, 4
LETTERS = "a-zÀ-ÿ"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, drop_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters with A-Z in lower case and how often they occur in all texts, of at least so many letters and occurrences.

    drop_every leaves a letter out of a run if the CRC32 of `<id>:<run>` is a multiple of it: the one at that CRC32 modulo the length.
    Runs are counted before they are shuffled, so a word that makes up most of the texts costs one row a task.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col(text_col).cast("string")), F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))  # a shorter run stays short
    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        left_out = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        rows = rows.withColumn("h", h).select(F.when(F.col("h") % drop_every == 0, left_out).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_letters)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def signatures(word: Column, parts: int = PARTS) -> tuple[Column, Column]:
    """The letters of a word as places of a binary vector, to be named _places, and its PartEnum signatures for Hamming distances of at most two.

    The vector has a place for each letter and number of occurrence: the second e is another place than the first. The places are dealt
    by a hash into parts. Vectors that differ in at most two places differ in at most two parts, so they agree in all parts of one of the
    choices of parts - 2; each choice gives a signature. A part is the exclusive or of the hashes of its places, which a vector holds once each.
    """
    letters = F.array_sort(F.split(word, ""))
    places = F.transform(letters, lambda x, i: F.xxhash64(x, i - F.array_position(letters, x)))

    def part(q: int) -> Column:
        mine = F.filter(F.col("_places"), lambda h: F.pmod(F.shiftrightunsigned(h, 32), F.lit(parts)) == q)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda s, h: s.bitwiseXOR(h))

    each = [part(q) for q in range(parts)]
    return places, F.array(*[F.xxhash64(F.lit(k), *[each[q] for q in kept]) for k, kept in enumerate(combinations(range(parts), parts - 2))])


def keys(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, short, word): what words meet by. Two words one letter apart have a key in common, with short the length of the shorter.

    One letter put in, left out or replaced changes the letters as a multiset in one or two places, so near words share a signature. It also
    leaves the first half of the shorter word alone, or as many letters at the end. A signature is joined with one of these ends, which
    misses nothing and keeps apart what shares only letters. Each word stands both as the shorter and as the longer of a pair.
    """
    places, found = signatures(F.col("word"), parts)
    signed = words.select("word", places.alias("_places")).select("word", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short"), found.alias("_signatures"))
    half = F.expr("short div 2")
    ends = F.array(F.xxhash64(F.lit(0), "short", F.substring(F.col("word"), F.lit(1), half)), F.xxhash64(F.lit(1), "short", F.right("word", half)))
    met = F.flatten(F.transform("_signatures", lambda s: F.transform(F.col("_ends"), lambda e: F.xxhash64(s, e))))
    return signed.withColumn("_ends", ends).select(F.explode(met).alias("key"), "short", "word")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b): all words that differ by exactly one letter put in, left out or replaced, once each; a is the shorter, or the first of equal length.

    What has met by keys() is compared letter by letter.
    """
    every = written(keys(words, parts), "keys")
    a = every.where(F.length("word") == F.col("short")).select("key", "short", F.col("word").alias("a"))
    b = every.select("key", F.col("short").alias("b_short"), F.col("word").alias("b"))
    met = a.join(b, "key").where((F.col("short") == F.col("b_short")) & ((F.length("b") > F.col("short")) | (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms from each word ends. The way is halved each round; forms never go in a circle."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        now = step.select("word", "root")


def variants(counts: DataFrame, times: int = TIMES, parts: int = PARTS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counted words (word, n): each word's most frequent near word, if frequent enough to be its form.

    form is the near word of the largest n, ties to the least, if that is at least times the word's own; form_n is its n. root is where
    forms lead in the end, the word itself if it has none; as n grows by that factor with each step, ways are short. Words without near
    words stay, with n_near 0; no words give no rows.
    """
    if times < 2 or parts < 3:
        raise ValueError("times must be at least 2 and parts at least 3")
    counts = written(counts, "words")
    pairs = written(near_pairs(counts, parts), "near")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    other = counts.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = both.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best"))
    found = counts.join(best, "word", "left")
    is_form = -F.col("best.m") >= times * F.col("n")
    found = written(found.select("word", F.when(is_form, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None) -> DataFrame:
    """variants() of the words of all texts.

    Null texts have no words; a null id is the empty text where drop_every asks for it; repeated rows count each; other columns are ignored.
    """
    return variants(counted(docs, id_col, text_col, drop_every=drop_every))
