"""Row normalisation as column expressions. A value that cannot be read is null with a status; nothing is guessed."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of education bands in the order in which they are tried.
EDUCATION = (
    ("no_requirement", ("不限", "无学历要求")),
    ("doctorate", ("博士",)),
    ("master", ("硕士", "研究生")),
    ("bachelor", ("本科",)),
    ("associate", ("大专", "专科",)),
    ("high_school", ("高中", "中专", "中技")),
)
#: Fixed values of the experience reader.
NO_EXPERIENCE, ENTRY = ("不限", "无经验要求"), ("应届", "在校", "实习")
NUMBER = "([0-9]+(?:\\.[0-9]+)?)"
#: Working days of a month; monthly factors of pay units.
DAYS_PER_MONTH = 21.75
MONTHLY_FACTORS = {"year": 1 / 12, "month": 1.0, "week": 52 / 12, "day": 260 / 12, "hour": 2080 / 12}


def _nfkc_udf() -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return nfkc


def nfkc(c: Column) -> Column:
    """Unicode normal form KC. Spark has no such function, so this is a vectorised UDF, which hands ASCII on as it is."""
    return _nfkc_udf()(c)


def text(c: Column, compatible: bool = True) -> Column:
    """Trimmed lower-case text with single spaces; null if nothing is left. compatible: normal form KC first; switch it off where all data is ASCII."""
    c = nfkc(c) if compatible else c
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, "\\s+", " "))), F.lit(""))


def classify(c: Column, taxonomy: list[tuple[str, list[str]]], fallback: str = "other") -> tuple[Column, Column]:
    """(class, status): the first entry of an ordered taxonomy with a pattern that occurs in the text."""
    t = text(c)
    found = F.coalesce(*[F.when(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)) for name, patterns in taxonomy if name != fallback], F.lit(None).cast("string"))
    return F.when(t.isNull(), fallback).otherwise(F.coalesce(found, F.lit(fallback))), F.when(t.isNull(), "missing_at_source").when(found.isNull(), "fallback_other").otherwise("parsed")


def longest_prefix(df: DataFrame, column: str, aliases: DataFrame, lengths: list[int], out: str = "code") -> DataFrame:
    """df with the code of the longest alias (alias, code) that the normalised text starts with, and <out>_status.

    lengths: the distinct lengths of aliases. Each row looks up one prefix of each length, so the join is by equality.
    """
    key = f"_{out}_key"
    keyed = df.withColumn(key, text(F.col(column)))
    values = keyed.select(key).where(F.col(key).isNotNull()).distinct()
    tried = values.select(key, F.explode(F.array_distinct(F.array(*[F.left(F.col(key), F.lit(n)) for n in lengths]))).alias("alias"))
    found = tried.join(aliases.select(text(F.col("alias")).alias("alias"), "code"), "alias").groupBy(key).agg(F.max_by("code", F.struct(F.length("alias"), "code")).alias(out))
    status = F.when(F.col(key).isNull(), "missing_at_source").when(F.col(out).isNull(), "unparseable").otherwise("parsed")
    return keyed.join(found, key, "left").withColumn(f"{out}_status", status).drop(key)


def keyword_band(c: Column, rules: tuple[tuple[str, tuple[str, ...]], ...] = EDUCATION) -> tuple[Column, Column]:
    """(band, status) by the first rule with a word that the text contains."""
    t = text(c)
    band = F.coalesce(*[F.when(F.greatest(*[F.contains(t, F.lit(w)) for w in words], F.lit(False)), F.lit(name)) for name, words in rules])
    return band, F.when(t.isNull(), "missing_at_source").when(band.isNull(), "unparseable").otherwise("parsed")


def years(c: Column, unit: str = "年") -> Column:
    """Struct of low, high, band and status of a span of years: no requirement, entry words, range, within, above, exact, in this order."""
    t = F.regexp_replace(text(c), "[－—]", "-")

    def number(pattern: str, k: int = 1) -> Column:
        return F.expr("null").cast("double") if not pattern else F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).cast("double")

    span, within, above, exact = f"{NUMBER}\\s*-\\s*{NUMBER}{unit}", f"{NUMBER}{unit}(?:以内|以下)", f"{NUMBER}{unit}(?:以上|及以上)", f"{NUMBER}{unit}"

    def made(low: Column, high: Column) -> Column:
        band = F.when(high <= 1, "entry").when(low < 3, "junior").when(low < 5, "mid").when(low < 10, "senior").otherwise("expert")
        return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), band.alias("band"), F.lit("parsed").alias("status"))

    def given(low: float | None, high: float | None, band: str | None, status: str) -> Column:
        return F.struct(F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), F.lit(band).cast("string").alias("band"), F.lit(status).alias("status"))

    def has(words: tuple[str, ...]) -> Column:
        return F.greatest(*[F.contains(t, F.lit(w)) for w in words], F.lit(False))

    none = F.lit(None).cast("double")
    return (
        F.when(t.isNull(), given(None, None, None, "missing_at_source"))
        .when(has(NO_EXPERIENCE), given(0.0, None, "no_requirement", "parsed"))
        .when(has(ENTRY), given(0.0, 0.0, "entry", "parsed"))
        .when(t.rlike(span), F.when(number(span) > number(span, 2), given(None, None, None, "unparseable")).otherwise(made(number(span), number(span, 2))))
        .when(t.rlike(within), made(F.lit(0.0), number(within)))
        .when(t.rlike(above), made(number(above), none))
        .when(t.rlike(exact), made(number(exact), number(exact)))
        .otherwise(given(None, None, None, "unparseable"))
    )


def date(c: Column) -> tuple[Column, Column]:
    """(date, status) of ISO dates and times and of 2026/08/01 and 2026.08.01; anything else is not read."""
    t = text(c)
    iso = F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[t ][0-9:.]+(?:z|[+-][0-9:]+)?)?$"), F.try_to_date(F.left(t, F.lit(10)), "yyyy-MM-dd"))
    parts = F.when(t.rlike("^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"), F.try_to_date(t, "y/M/d"))
    dots = F.when(t.rlike("^[0-9]{4}\\.[0-9]{1,2}\\.[0-9]{1,2}$"), F.try_to_date(t, "y.M.d"))
    found = F.coalesce(iso, parts, dots)
    return found, F.when(t.isNull(), "missing_at_source").when(found.isNull(), "unparseable").otherwise("parsed")


def date_until(c: Column, cutoff: Column, placeholders: tuple[str, ...] = ("1970-01-01",)) -> Column:
    """The date of a text unless it is a placeholder or after the cutoff."""
    found, _ = date(c)
    return F.when((found <= cutoff) & ~found.cast("string").isin(*placeholders), found)


def salary(c: Column, compatible: bool = True) -> Column:
    """Struct of low, high, mid (monthly), annual, months and status of a written pay range: 20-30K·13薪, 200-300元/天, 20-30万/年.

    A range that falls, starts at zero or is not finite, and months outside 12 to 24, are invalid_range; nothing else is guessed.
    """
    t = F.regexp_replace(F.regexp_replace(F.lower(F.trim(nfkc(c) if compatible else c)), "\\s+", ""), "[￥¥]", "")
    known, start = f"^{NUMBER}-{NUMBER}(?:(k)(?:[·x*]?([0-9]{{1,2}})薪)?|(元)/[天日]|(万)/年)$", f"^{NUMBER}-{NUMBER}"

    def group(pattern: str, k: int) -> Column:
        return F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))

    parts = F.struct(
        F.coalesce(F.trim(c), F.lit("")).alias("raw"), t.alias("t"), group(known, 1).cast("double").alias("lo"), group(known, 2).cast("double").alias("hi"), group(known, 4).cast("int").alias("months"),
        F.coalesce(group(known, 3), group(known, 5), group(known, 6)).alias("unit"), group(start, 1).cast("double").alias("a"), group(start, 2).cast("double").alias("b"),
    )

    def read(p: Column) -> Column:
        lo, hi, months, month, day = p["lo"], p["hi"], p["months"], p["unit"] == "k", p["unit"] == "元"
        fine = (lo > 0) & (hi > 0) & (lo <= hi) & (hi < float("inf")) & F.coalesce(months.between(12, 24), F.lit(True))

        def scaled(x: Column) -> Column:
            return F.when(month, x * 1000).when(day, x * DAYS_PER_MONTH).otherwise(x * 10000 / 12)

        mid = scaled((lo + hi) / 2)
        annual = F.when(month, mid * F.coalesce(months, F.lit(12))).when(day, mid * 12).otherwise((lo + hi) / 2 * 10000)
        status = (
            F.when(p["raw"] == "", "missing_at_source").when(p["t"].isin("面议", "薪资面议"), "negotiable")
            .when(p["unit"].isNull(), F.when(p["a"] > p["b"], "invalid_range").otherwise("unparseable")).when(~fine, "invalid_range")
            .when(month, F.when(months.isNull(), "parsed_monthly").otherwise("parsed_monthly_with_months")).when(day, "parsed_daily").otherwise("parsed_annual")
        )
        good = status.startswith("parsed")
        return F.struct(F.when(good, scaled(lo)).alias("low"), F.when(good, scaled(hi)).alias("high"), F.when(good, mid).alias("mid"), F.when(good, annual).alias("annual"), F.when(good, F.when(month, months).otherwise(12)).alias("months"), status.alias("status"))

    # through an array of one, so that the parts are read once and the generated code stays small
    return F.element_at(F.transform(F.array(parts), read), 1)


def monthly(low: Column, high: Column, unit: Column) -> Column:
    """Struct of low, high and method of numbers per unit, turned into monthly ones; an unknown unit or bad range gives nulls."""
    factor = F.create_map(*[F.lit(x) for kv in MONTHLY_FACTORS.items() for x in kv])[F.lower(F.trim(unit))]
    fine = factor.isNotNull() & (low > 0) & (high > 0) & (low <= high)
    return F.struct(F.when(fine, low * factor).alias("low"), F.when(fine, high * factor).alias("high"), F.when(fine, F.concat(F.lit("from_"), F.lower(F.trim(unit)))).otherwise("unavailable").alias("method"))


def title_scope(c: Column, target: list[str], non_target: list[str], possible: list[str]) -> Column:
    """target, non_target or possible by the first list with a pattern in the title; possible if none has."""
    t = text(c)

    def any_of(patterns: list[str]) -> Column:
        return F.coalesce(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)

    return F.when(any_of(target), "target").when(any_of(non_target), "non_target").when(any_of(possible), "possible").otherwise("possible")


def years_from_fields(low: Column, high: Column, minimum: Column, seniority: Column) -> Column:
    """The written span of years of structured fields: from and to, else a minimum, else what the seniority stands for."""
    known = F.create_map(*[F.lit(x) for kv in {"intern": "实习", "entry": "1年以内", "junior": "1-3年", "middle": "3-5年", "senior": "5年以上"}.items() for x in kv])
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit("年"))).when(minimum.isNotNull(), F.concat(minimum.cast("string"), F.lit("年以上"))).otherwise(known[F.lower(seniority)])


def record_id(parts: list[Column], prefix: str = "record_", more: list[Column] | None = None) -> Column:
    """Content hash of a record's key; a record with an empty part gets one of all of its columns (more), never of its position."""
    given = [F.coalesce(F.trim(p.cast("string")), F.lit("")) for p in parts]
    own = F.sha2(F.concat_ws("|", *given), 256)
    whole = F.sha2(F.concat_ws("|", *given, *[F.coalesce(c.cast("string"), F.lit("")) for c in (more or [])]), 256)
    gap = F.greatest(*[g == "" for g in given], F.lit(False))
    return F.concat(F.lit(prefix), F.substring(F.when(gap, whole).otherwise(own), 1, 24))


def flags(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; null counts as not."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def script(c: Column) -> Column:
    """zh, en, mixed or other by the counts of Han characters and ASCII letters."""
    t = F.coalesce(c, F.lit(""))
    han, latin = F.length(F.regexp_replace(t, "[^\\x{4e00}-\\x{9fff}]", "")), F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return F.when((han == 0) & (latin == 0), "other").when(latin == 0, "zh").when(han == 0, "en").when(han >= 2 * latin, "zh").when(latin >= 2 * han, "en").otherwise("mixed")


def masked(c: Column) -> Column:
    """Text with addresses and long numbers hidden."""
    return F.regexp_replace(F.regexp_replace(c, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[EMAIL]"), "[0-9][0-9 -]{9,17}[0-9]", "[PHONE]")


def english_ratio(c: Column) -> Column:
    """ASCII letters over all characters that are not blank; null if there are none."""
    return F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / F.nullif(F.length(F.regexp_replace(c, "\\s", "")).cast("double"), F.lit(0.0))


def sections(parts: dict[str, Column], separator: str = "\n\n") -> Column:
    """Labelled sections joined, blank ones left out; null if all are."""
    kept = F.array_compact(F.array(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{n}: "), F.trim(c))) for n, c in parts.items()]))
    return F.when(F.size(kept) > 0, F.array_join(kept, separator))


def currency(columns: list[Column], signs: tuple[tuple[str, tuple[str, ...]], ...] = (("HKD", ("HKD", "HK$")), ("CNY", ("CNY", "RMB", "¥")), ("USD", ("USD", "US$")))) -> Column:
    """The first currency with a sign in any of the columns."""
    t = F.upper(F.concat_ws(" ", *columns))
    return F.coalesce(*[F.when(F.greatest(*[F.contains(t, F.lit(s)) for s in found], F.lit(False)), F.lit(name)) for name, found in signs])


def evidence_json(parts: dict[str, Column]) -> Column:
    """Compact JSON of the parts that are there; null if none is."""
    return F.when(F.coalesce(*[c.cast("string") for c in parts.values()]).isNotNull(), F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])))
