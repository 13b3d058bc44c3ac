"""Slices: one set of filters that every metric shares."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slice:
    """Equality on dimensions, a closed date range, a set of sources. Empty fields filter nothing."""

    equal: dict[str, object] = field(default_factory=dict)
    date_from: str | None = None
    date_to: str | None = None
    sources: tuple[str, ...] = ()
    scope: str | None = None
    scope_col: str = "market_scope"
    date_col: str = "event_date"

    def takes_all(self, columns: list[str]) -> bool:
        """Whether it filters neither entities nor records."""
        return not self.sources and not self.predicates(columns)

    def predicates(self, columns: list[str]) -> list[Column]:
        """The filters on entities; the scope counts only where the entities have its column."""
        out = [F.col(c) == F.lit(v) for c, v in self.equal.items()]
        if self.date_from:
            out.append(F.col(self.date_col) >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            out.append(F.col(self.date_col) <= F.lit(self.date_to).cast("date"))
        if self.scope and self.scope_col in columns:
            out.append(F.col(self.scope_col) == self.scope)
        return out


def select(entities: DataFrame, source_map: DataFrame, s: Slice, key: str = "entity_id", source_col: str = "source_id") -> DataFrame:
    """The entities of a slice: those that pass its filters and have at least one record of its sources."""
    kept = entities.filter(reduce(lambda a, b: a & b, s.predicates(entities.columns), F.lit(True)))
    return kept.join(of_sources(source_map, s, source_col).select(key).distinct(), key, "left_semi") if s.sources else kept


def of_sources(source_map: DataFrame, s: Slice, source_col: str = "source_id") -> DataFrame:
    """The records whose source a slice admits, so that evidence of other sources does not count."""
    return source_map.filter(F.col(source_col).isin(*s.sources)) if s.sources else source_map


def present_sources(source_map: DataFrame, configured: list[str], source_col: str = "source_id") -> DataFrame:
    """The configured sources that have records."""
    return source_map.filter(F.col(source_col).isin(*configured)).select(source_col).distinct()


def recent_closed(df: DataFrame, as_of: str, days: int, date_col: str = "event_date") -> DataFrame:
    """Rows with a date in [as_of - days, as_of]."""
    end = F.lit(as_of).cast("date")
    return df.filter(F.col(date_col).between(F.date_sub(end, days), end))


def recent_open(df: DataFrame, as_of: str, days: int, date_col: str = "event_date") -> DataFrame:
    """Rows with a date of as_of - days or later, also after as_of."""
    return df.filter(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), days))


def bad_number(c: Column) -> Column:
    """Whether a double is NaN, infinite or negative; null is not."""
    return F.isnan(c) | (F.abs(c) == float("inf")) | (c < 0)


def in_theme(label: Column, theme: str) -> Column:
    """Whether a list of labels separated by semicolons has a theme."""
    return F.array_contains(F.transform(F.split(label, ";"), lambda x: F.trim(x)), theme)


def metadata(entities: DataFrame, source_map: DataFrame, key: str = "entity_id", source_col: str = "source_id", date_col: str = "event_date") -> DataFrame:
    """One row about a slice: its entities, sources, and first and last date. An empty slice gives 0, 0 and nulls."""
    # one row per entity on both sides first, so that records do not multiply entities
    own = entities.agg(F.count("*").alias("sample_size"), F.min(date_col).alias("date_from"), F.max(date_col).alias("date_to"))
    sources = source_map.join(entities.select(key), key, "left_semi").agg(F.countDistinct(source_col).alias("source_count"))
    return own.crossJoin(sources).select("sample_size", "source_count", "date_from", "date_to")
