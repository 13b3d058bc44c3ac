"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from demandlens.sources.shared import fresh_path

__all__ = ["BLANKS", "LOWER", "UPPER", "ascii_lower", "fresh_path", "id_remainder", "words", "written", "written_counted"]

#: Characters of the white space class [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that no later job computes it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counted(df: DataFrame, name: str, condition: Column | None = None) -> tuple[DataFrame, int]:
    """What written gives, and how many of its rows meet a condition (all without one), counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, (F.count(F.lit(1)) if condition is None else F.count_if(condition)).alias("n")), name)
    return out, seen.get["n"]


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ in order; null gives none."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def id_remainder(c: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus
