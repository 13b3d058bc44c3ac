"""Queries by name, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from demandlens.plans import evaluation, graphs, ingestion, matching, metrics, models, normalisation, publish, scoring, slicing, trends
from demandlens.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "graphs", "ingestion", "matching", "metrics", "models", "normalisation", "publish", "scoring", "slicing", "trends"]
