"""Adjusted associations of items with a measure: least squares with categorical controls and robust (HC3) errors, from grouped sums."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.operators import ranking
from demandlens.sources.shared import written

MISSING = "__missing__"
STATISTICS = ["coefficient", "error", "low", "high", "p_value", "r2", "adjusted_r2", "aic", "bic", "residual_error", "condition"]


@dataclass(frozen=True)
class EffectRules:
    """Gates of the model; the defaults are fixed values. student: intervals and p-values by Student's t with the residual degrees of freedom."""

    low: float = 1000.0
    high: float = 300000.0
    least_n: int = 100
    least_with: int = 20
    least_without: int = 20
    level: float = 0.95
    condition: float = 100000.0
    student: bool = False


def student_cdf(t: float, degrees: float) -> float:
    """The distribution function of Student's t, by the incomplete beta function as a continued fraction evaluated from its end."""
    a, b, x = degrees / 2, 0.5, degrees / (degrees + t * t)
    flip = x > (a + 1) / (a + b + 2)  # the fraction settles fast on one side
    if flip:
        a, b, x = b, a, 1 - x
    fraction = 1.0
    for m in range(200, 0, -1):
        fraction = 1 + m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) / fraction
        fraction = 1 - (a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1)) / fraction
    front = 0.0 if x <= 0 else math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tail = (1 - front / fraction if flip else front / fraction) / 2
    return tail if t < 0 else 1 - tail


def student_point(q: float, degrees: float) -> float:
    """Where Student's t has a share of q below it."""
    low, high = -1.0, 1.0
    while student_cdf(low, degrees) > q:
        low *= 2
    while student_cdf(high, degrees) < q:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if student_cdf(middle, degrees) < q else (low, middle)
    return (low + high) / 2


def percent(coefficient: Column) -> Column:
    """A coefficient of the logarithm as percent."""
    return 100 * F.expm1(coefficient)


def model_rows(entities: DataFrame, controls: list[str], r: EffectRules, measure: str = "measure") -> DataFrame:
    """Entities with a measure in range: y its logarithm, controls as text with __missing__ for null."""
    kept = entities.where(F.col(measure).between(r.low, r.high))
    return kept.select("entity_id", F.ln(measure).alias("y"), *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in controls])


def gates(rows: DataFrame, pairs: DataFrame, items: DataFrame, r: EffectRules) -> DataFrame:
    """(item_id, n, with_item, without_item, status) before any fit: unavailable, insufficient_sample or candidate."""
    n = rows.agg(F.count("*").alias("n"))
    have = pairs.join(rows.select("entity_id"), "entity_id", "left_semi").groupBy("item_id").agg(F.count("*").alias("with_item"))
    joined = items.select("item_id").join(have, "item_id", "left").fillna(0, ["with_item"]).crossJoin(F.broadcast(n)).withColumn("without_item", F.col("n") - F.col("with_item"))  # one row
    enough = (F.col("n") >= r.least_n) & (F.col("with_item") >= r.least_with) & (F.col("without_item") >= r.least_without)
    return joined.select("item_id", "n", "with_item", "without_item", F.when(F.col("n") == 0, "unavailable").when(~enough, "insufficient_sample").otherwise("candidate").alias("status"))


@dataclass(frozen=True)
class Columns:
    """Intercept and drop-first dummies: the columns of the controls that do not depend on those before them."""

    controls: tuple[str, ...]
    place: dict[tuple[str, str], int]
    width: int

    def of(self, pdf: pd.DataFrame) -> np.ndarray:
        x = np.zeros((len(pdf), self.width))
        x[:, 0] = 1
        for c in self.controls:
            at = np.array([self.place.get((c, v), -1) for v in pdf[c]], np.int64)
            x[np.flatnonzero(at >= 0), at[at >= 0]] = 1
        return x


def _columns(cells: DataFrame, controls: list[str]) -> tuple[Columns, np.ndarray, np.ndarray, float]:
    """The columns kept, their Gram matrix and products with y over all rows, and the sum of squares of y.

    The driver gets the values of the controls and the sums over pairs of columns, never rows or combinations of values.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in controls])).alias("x")
    levels: dict[str, list[str]] = {c: [] for c in controls}
    for r in cells.select(named).select("x.c", "x.v").distinct().collect():
        levels[r["c"]].append(r["v"])
    place = {(c, v): k for k, (c, v) in enumerate(((c, v) for c in controls for v in sorted(levels[c])[1:]), 1)}
    wide = Columns(tuple(controls), place, 1 + len(place))

    def sums(parts):
        gram, right, squares = np.zeros((wide.width, wide.width)), np.zeros(wide.width), 0.0
        for pdf in parts:
            x = wide.of(pdf)
            gram += x.T @ (x * pdf["n"].to_numpy(float)[:, None])
            right += x.T @ pdf["sy"].to_numpy(float)
            squares += float(pdf["syy"].sum())
        i, j = np.nonzero(gram)
        yield pd.DataFrame({"i": [*i, *range(wide.width), -1], "j": [*j, *([-1] * wide.width), -1], "v": [*gram[i, j], *right, squares]})

    gram, right, squares = np.zeros((wide.width, wide.width)), np.zeros(wide.width), 0.0
    for r in cells.mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if r["j"] >= 0:
            gram[r["i"], r["j"]] = r["v"]
        elif r["i"] >= 0:
            right[r["i"]] = r["v"]
        else:
            squares = r["v"]
    kept: list[int] = []
    for j in range(wide.width):
        rest = gram[j, j]
        if kept:
            rest -= gram[j, kept] @ np.linalg.solve(gram[np.ix_(kept, kept)], gram[kept, j])
        if rest > 1e-9 * max(1.0, gram[j, j]):
            kept.append(j)
    new = {old: k for k, old in enumerate(kept)}
    narrow = Columns(wide.controls, {key: new[k] for key, k in place.items() if k in new}, len(kept))
    return narrow, gram[np.ix_(kept, kept)], right[kept], squares


def associations(entities: DataFrame, pairs: DataFrame, items: DataFrame, controls: list[str], r: EffectRules | None = None, measure: str = "measure") -> DataFrame:
    """Per item: coefficient of having it in ln(measure) ~ 1 + item + controls, HC3 error, interval, p-value and fit statistics.

    Rows with equal controls and item have equal design rows and leverages, so the fit needs only counts and sums of y and y squared of
    these cells, which stay in Spark tables. The controls' part of the normal equations is one small matrix for all items; what an item
    adds is its counts by column. A scan over the cells then adds up the robust error of many items at once, PASS_ITEMS a pass. The
    driver holds matrices of as many rows as the controls have values, and the solutions of one pass. Normal quantiles give intervals.
    status: unavailable, insufficient_sample, rank_deficient, estimated, estimated_with_warning (condition number too large).
    """
    r = r or EffectRules()
    rows = model_rows(entities, controls, r, measure)
    if not controls:
        rows, controls = rows.withColumn("_every", F.lit("every")), ["_every"]
    rows = written(rows, "model_rows")
    judged = written(gates(rows, pairs, items, r), "gates")
    sums = [F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    cells = written(rows.groupBy(*controls).agg(*sums), "cells")
    candidates = judged.where("status = 'candidate'").select("item_id")
    own = written(pairs.join(candidates, "item_id").join(rows, "entity_id").groupBy("item_id", *controls).agg(*sums), "item_cells")
    if not own.limit(1).count():
        return judged.select("item_id", "status", "n", "with_item", "without_item", *[F.lit(None).cast("double").alias(k) for k in STATISTICS])
    x, gram, right, squares = _columns(cells, controls)
    inverse, total = np.linalg.inv(gram), gram[0, 0]
    spread = squares - right[0] ** 2 / total  # of y around its mean

    def counts(parts):
        for pdf in parts:
            row, at = np.nonzero(x.of(pdf))
            yield pd.DataFrame({"item_id": pdf["item_id"].to_numpy()[row], "at": at, "n": pdf["n"].to_numpy(float)[row], "sy": pdf["sy"].to_numpy(float)[row]})

    def solved(parts):
        for pdf in parts:
            yield pd.DataFrame([_solved(i, n, sy, x.width, gram, inverse, right, squares) for i, n, sy in zip(pdf["item_id"], pdf["counts"], pdf["sy"], strict=True)], columns=["item_id", "deficient", *SOLUTION])

    by_column = own.mapInPandas(counts, "item_id string, at int, n double, sy double").groupBy("item_id", "at").agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"))
    per_item = by_column.groupBy("item_id").agg(F.collect_list(F.struct("at", "n")).alias("counts"), F.max(F.when(F.col("at") == 0, F.col("sy"))).alias("sy"))
    solution = per_item.mapInPandas(solved, "item_id string, deficient boolean, slope array<double>, beta array<double>, b double, own double, rest double, condition double")
    solution = written(ranking.numbered(solution, ["item_id"], "number").withColumn("number", F.col("number") - 1), "solution")

    errors = None
    for k in range(0, solution.count(), PASS_ITEMS):
        some = solution.where(~F.col("deficient") & F.col("number").between(k, k + PASS_ITEMS - 1))
        part = _robust(cells, own, controls, x, inverse, some.orderBy("number").collect())
        errors = part if errors is None else errors.unionByName(part)
    width = x.width + 1
    student = r.student and total > width
    z = student_point(0.5 + r.level / 2, total - width) if student else NormalDist().inv_cdf(0.5 + r.level / 2)

    def below(v: float) -> float:
        return student_cdf(v, total - width) if student else NormalDist().cdf(v)

    def told(parts):
        for pdf in parts:
            b, error, rss = pdf["b"].to_numpy(float), np.sqrt(np.maximum(pdf["meat"].to_numpy(float), 0)) / pdf["own"].to_numpy(float), np.maximum(pdf["rest"].to_numpy(float), 0)
            r2 = 1 - rss / spread if spread > 0 else np.zeros(len(b))
            likelihood = -total / 2 * (np.log(2 * np.pi * np.maximum(rss, 1e-300) / total) + 1)
            p_value = [2 * below(-abs(v) / e) if e > 0 else 0.0 for v, e in zip(b, error, strict=True)]
            yield pd.DataFrame({
                "item_id": pdf["item_id"], "fit": np.where(pdf["condition"] > r.condition, "estimated_with_warning", "estimated"), "coefficient": b, "error": error, "low": b - z * error, "high": b + z * error, "p_value": p_value, "r2": r2,
                "adjusted_r2": 1 - (1 - r2) * (total - 1) / (total - width), "aic": 2 * width - 2 * likelihood, "bic": width * np.log(total) - 2 * likelihood, "residual_error": np.sqrt(rss / (total - width)), "condition": pdf["condition"],
            })

    able = solution.where("not deficient").join(errors, "item_id") if total > width and errors is not None else None
    schema = "item_id string, fit string, " + ", ".join(f"{k} double" for k in STATISTICS)
    fits = able.mapInPandas(told, schema) if able is not None else entities.sparkSession.createDataFrame([], schema)
    status = F.when(F.col("status") != "candidate", F.col("status")).otherwise(F.coalesce("fit", F.lit("rank_deficient")))
    return judged.join(fits, "item_id", "left").select("item_id", status.alias("status"), "n", "with_item", "without_item", *STATISTICS)


#: Items whose solutions one scan over the cells takes along, and numbers in the largest matrix of a scan.
PASS_ITEMS, SCAN = 1000, 2_000_000
SOLUTION = ["slope", "beta", "b", "own", "rest", "condition"]


def _solved(item: str, counts: list, sy: float, width: int, gram: np.ndarray, inverse: np.ndarray, right: np.ndarray, squares: float) -> tuple:
    """An item's coefficient b, those of the controls (beta), the item regressed on the controls (slope) and what is left of it (own)."""
    c = np.zeros(width)
    for x in counts:
        c[x["at"]] = x["n"]
    slope, n = inverse @ c, c[0]
    own = n - c @ slope
    if own <= 1e-9 * max(1.0, n):
        return (item, True, [], [], None, None, None, None)
    plain = inverse @ right
    b = (sy - c @ plain) / own
    beta = plain - slope * b
    whole = np.block([[gram, c[:, None]], [c[None, :], np.array([[n]])]])
    values = np.linalg.eigvalsh(whole)
    condition = float(np.sqrt(values[-1] / values[0])) if values[0] > 0 else float("inf")
    return (item, False, slope.tolist(), beta.tolist(), float(b), float(own), float(squares - right @ beta - sy * b), condition)


def _robust(cells: DataFrame, own: DataFrame, controls: list[str], x: Columns, inverse: np.ndarray, solutions: list) -> DataFrame:
    """(item_id, meat): for each solution the sum over rows of squared own parts by squared residuals over (1 - leverage) squared.

    Each cell meets the sums of the items it has; rows of the cell without an item have what is left of the cell's sums.
    """
    names, number = [r["item_id"] for r in solutions], {r["item_id"]: k for k, r in enumerate(solutions)}
    slope, beta = (np.array([r[k] for r in solutions]).reshape(len(solutions), x.width).T for k in ("slope", "beta"))
    b, left = (np.array([r[k] for r in solutions]) for k in ("b", "own"))
    step = max(1, SCAN // max(1, len(solutions)))

    def scan(parts):
        meat = np.zeros(len(names))
        for whole in parts:
            for k in range(0, len(whole), step):
                pdf = whole.iloc[k : k + step]
                with_item = np.zeros((3, len(pdf), len(names)))
                for i, found in enumerate(pdf["found"]):
                    for f in found if found is not None else ():
                        if f["item_id"] in number:
                            with_item[:, i, number[f["item_id"]]] = f["n"], f["sy"], f["syy"]
                rows = x.of(pdf)
                base = np.einsum("ij,jk,ik->i", rows, inverse, rows)[:, None]
                part, fitted = rows @ slope, rows @ beta
                without = pdf[["n", "sy", "syy"]].to_numpy(float).T[:, :, None] - with_item
                for (n, sy, syy), d, f in ((with_item, 1 - part, fitted + b), (without, -part, fitted)):
                    residual = np.where(n > 0.5, np.maximum(syy - 2 * f * sy + n * f**2, 0), 0)
                    meat += (d**2 * residual / np.maximum(1 - base - d**2 / left, 1e-12) ** 2).sum(axis=0)
        yield pd.DataFrame({"item_id": names, "meat": meat})

    listed = own.groupBy(*controls).agg(F.collect_list(F.struct("item_id", "n", "sy", "syy")).alias("found"))  # at most one entry for each item
    joined = cells.join(listed, controls, "left")
    return joined.mapInPandas(scan, "item_id string, meat double").groupBy("item_id").agg(F.sum("meat").alias("meat"))


def rank_correlation(internal: DataFrame, external: DataFrame, aliases: DataFrame, diverge: int = 20) -> DataFrame:
    """Items of two ranked lists matched by alias: both ranks, their difference and whether it diverges, the correlation of ranks and its label.

    internal: (item_id, rank), external: (term, rank), aliases: (term, item_id) in lower case.
    """
    matched = external.withColumn("term", F.lower(F.trim("term"))).join(aliases, "term").groupBy("item_id").agg(F.min("rank").alias("external_rank"))
    both = internal.select("item_id", F.col("rank").alias("internal_rank")).join(matched, "item_id")
    r = both.agg(F.corr(F.col("internal_rank").cast("double"), F.col("external_rank").cast("double")).alias("correlation"))
    gap = F.col("internal_rank") - F.col("external_rank")
    label = F.when(F.col("correlation").isNull(), "unavailable").when(F.col("correlation") >= 0.70, "High").when(F.col("correlation") >= 0.40, "Medium").otherwise("Low")
    return both.crossJoin(F.broadcast(r)).select("item_id", "internal_rank", "external_rank", gap.alias("gap"), (F.abs(gap) >= diverge).alias("divergent"), "correlation", label.alias("agreement"))  # one row
