"""Quality rules: base limits, then robust multivariate outliers by minimum covariance determinant. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.llm.common import BLANKS, words, written, written_counted

SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Share of each group that the raw estimate rests on, share that a normal group keeps in the reweighted one.
CORE, REWEIGHT = 0.75, 0.975
#: Starts of a group, steps after which the best of them go on, how many go on.
STARTS, FIRST_STEPS, FINALISTS = 8, 2, 2
#: Rows that the whole weighs against a group's own: a group of as many rows is half its own estimate, half that of all rows.
PRIOR_ROWS = 60
#: Squared distance beyond which a row is rejected: the 0.999 point of chi squared with four degrees of freedom.
CUTOFF = 18.47
#: Standard deviations added to those of each transformed statistic, as most texts have none at all of three of them and their core would be
#: flat. Each alone can reach the cutoff within what the base limits allow.
FLOORS = (0.08, 0.5, 0.5, 0.8)
STATS = ("x0", "x1", "x2", "x3")
ROOT = [(i, j) for i in range(4) for j in range(i + 1)]
MEANS, COVARIANCE, CHOLESKY = [f"m{i}" for i in range(4)], [f"c{i}{j}" for i, j in ROOT], [f"l{i}{j}" for i, j in ROOT]
#: Width of the bins of the logarithm of a distance in which a group's nearest share is counted.
LOG_BIN = 0.01
#: Estimates (about 300 bytes each) that are broadcast; more are joined.
MOST_ESTIMATES = 100_000
#: Bits of a sort key that hold a word's place, enough for every array; the rest hold its window's hash.
PLACE_BITS = 31


def chi_squared(x: float, degrees: int) -> float:
    """The distribution function of chi squared for an even number of degrees of freedom."""
    term = total = 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_squared_point(q: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, degrees) < q else (low, middle)
    return high


def consistency(q: float, degrees: int = len(STATS)) -> float:
    """What the covariance of the nearest share q of a normal group is multiplied by to be that of the whole."""
    return q / chi_squared(chi_squared_point(q, degrees), degrees + 2)


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long and about whole texts; null has no words.

    Three-word windows are compared by 64-bit hashes: sorting keys of 33 bits of hash and the place finds all windows that may repeat,
    and sorting those by their full hash leaves the ones that do, so the work grows with n log n.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.withColumn("_t", text).withColumn("_w", words(F.col("_t")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    lines = F.when(F.contains("_t", F.lit("\n")), F.filter(F.split("_t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_lines", lines)
    n = F.size("_w")
    low = F.lit((1 << PLACE_BITS) - 1)
    df = df.withColumn("_h", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_k", F.sort_array(F.transform("_h", lambda x, i: x.bitwiseAND(F.bitwise_not(low).cast("long")).bitwiseOR(i.cast("long")))))

    def same_key(a: Column, b: Column) -> Column:
        return F.coalesce(F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), F.lit(False))

    maybe = F.filter("_k", lambda x, i: F.when(i > 0, same_key(F.get("_k", i - 1), x)).otherwise(False) | same_key(x, F.get("_k", i + 1)))
    df = df.withColumn("_p", F.transform(maybe, lambda x: x.bitwiseAND(low.cast("long")).cast("int")))
    df = df.withColumn("_s", F.when(F.size("_p") > 0, F.array_sort(F.transform("_p", lambda p: F.struct(F.get("_h", p).alias("h"), p.alias("p"))))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>")))
    surely = F.filter("_s", lambda x, i: F.coalesce(F.when(i > 0, F.get("_s", i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_r", F.sort_array(F.transform(surely, lambda x: x["p"])))
    covered = F.aggregate(F.transform("_r", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_r", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return (
        df.withColumn("word_chars", F.length(F.translate("_t", BLANKS, "")).cast("long"))
        .withColumn("n_symbols", (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .drop("_t", "_w", "_lines", "_h", "_k", "_p", "_s", "_r")
    )


def transformed() -> list[Column]:
    """The statistic vector: logarithms of mean word length and of the shares in percent of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("word_chars") / n).alias("x0"),
        F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("x1"),
        F.log1p(100 * F.col("n_dup_lines") / n).alias("x2"),
        F.log1p(100 * F.col("n_repeat_words") / n).alias("x3"),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of STATS by the columns MEANS and CHOLESKY, by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(STATS):
        rest = F.col(x) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for v in z:
        total = total + v * v
    return total


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows, mean and covariance of the statistics of each group: n, MEANS, COVARIANCE."""
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)], *[F.avg(F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i, j in ROOT])
    covariance = []
    for i, j in ROOT:
        c = F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
        covariance.append((F.greatest(c, F.lit(0.0)) if i == j else c).alias(f"c{i}{j}"))
    return sums.select(*keys, "n", *MEANS, *covariance)


def _rooted(estimates: DataFrame, factor: float = 1.0) -> DataFrame:
    """estimates with CHOLESKY and the logarithm of the determinant (depth) of the covariance times factor, floors added."""
    wide = estimates.withColumns({f"k{i}{j}": F.col(f"c{i}{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0) for i, j in ROOT})
    for i, j in ROOT:
        c = F.col(f"k{i}{j}")
        for k in range(j):
            c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        wide = wide.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l{j}{j}"))
    depth = F.lit(0.0)
    for i in range(len(STATS)):
        depth = depth + 2 * F.ln(f"l{i}{i}")
    return wide.withColumn("depth", depth).drop(*[f"k{i}{j}" for i, j in ROOT])


def _starts(rows: DataFrame, key: str, starts: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(key, start) and the moments of five rows each: of every class of a hash of the row and the start, the row with the least hash.

    Only least hashes and the rows that have them are shuffled. The second value broadcasts tables of the groups' estimates if these are
    few, so that rows stay where they are; with more groups it leaves the choice of the join to Spark.
    """
    classes = len(STATS) + 1
    mark = F.xxhash64(*STATS, "start")
    spread = rows.select(key, *STATS, F.explode(F.sequence(F.lit(1), F.lit(starts))).alias("start")).withColumn("mark", mark).withColumn("class", F.pmod("mark", F.lit(classes)))
    least, n = written_counted(spread.groupBy(key, "start", "class").agg(F.min("mark").alias("mark")), "starts")
    small = F.broadcast if n <= MOST_ESTIMATES else lambda table: table
    return _moments(spread.join(small(least), [key, "start", "class", "mark"]).groupBy(key, "start", "class").agg(*[F.min(x).alias(x) for x in STATS]), key, "start"), small


def _step(rows: DataFrame, state: DataFrame, key: str, core: float, small: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """state after a concentration step, and how many of its rows changed: moments of the nearest share of each group's rows, where they
    have a smaller determinant.

    The share is met up to one bin. Rows stay where they are; sums and counts of bins are what is shuffled.
    """
    bin = F.floor(F.ln(_distance() + 1e-9) / LOG_BIN).cast("long").alias("bin")
    near = rows.join(small(state.select(key, "start", *MEANS, *CHOLESKY)), key).select(key, "start", *STATS, bin)
    counts = near.groupBy(key, "start", "bin").agg(F.count("*").alias("n"))
    each = W.partitionBy(key, "start")
    upto = counts.select(key, "start", "bin", F.sum("n").over(each.orderBy("bin")).alias("upto"), F.sum("n").over(each).alias("total"))
    limits = written(upto.where(F.col("upto") >= F.lit(core) * F.col("total")).groupBy(key, "start").agg(F.min("bin").alias("limit")), "limits")
    found = _rooted(_moments(near.join(small(limits), [key, "start"]).where("bin <= limit"), key, "start"))
    old = state.select(key, "start", *[F.col(c).alias(f"_{c}") for c in ("n", *MEANS, *COVARIANCE, *CHOLESKY, "depth")])
    better = F.col("depth") < F.col("_depth") - 1e-9
    columns = [F.when(better, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("n", *MEANS, *COVARIANCE, *CHOLESKY, "depth")]
    return written_counted(old.join(found, [key, "start"]).select(key, "start", *columns, better.alias("moved")), "estimates", F.col("moved"))


def _best(state: DataFrame, key: str, n: int) -> DataFrame:
    return state.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy("depth", "start"))).where(F.col("_rank") <= n).drop("_rank")


def robust_estimates(rows: DataFrame, key: str, core: float = CORE, starts: int = STARTS) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(key, n, MEANS, COVARIANCE), and what broadcasts a table of the groups if they are few: reweighted minimum-covariance-determinant estimates of groups.

    From each of several starts of five rows, concentration steps take the nearest share of the rows, estimate from them and take the
    nearest again; after two steps the two starts with the least determinants go on until no step makes one smaller, and the least wins.
    Determinants are those of the covariance with the floors added, which is never flat. A factor makes the covariance of the nearest
    share that of a normal whole; the rows within the 0.975 point of that estimate then give the final one, with its own factor.
    A group is shared by all tasks: only sums, counts and the few rows of a start are shuffled.
    """
    first, small = _starts(rows, key, starts)
    state = written(_rooted(first), "estimates")
    for _ in range(FIRST_STEPS):
        state, _ = _step(rows, state, key, core, small)
    state, moved = written_counted(_best(state, key, FINALISTS), "estimates", F.col("moved"))
    while moved:  # ends, as determinants of finitely many subsets only become smaller
        state, moved = _step(rows, state, key, core, small)
    raw = written(_rooted(_best(state, key, 1).select(key, "n", *MEANS, *COVARIANCE), consistency(core)), "estimates")
    near = rows.join(small(raw.select(key, *MEANS, *CHOLESKY)), key).where(_distance() <= chi_squared_point(REWEIGHT, len(STATS)))
    factor = consistency(REWEIGHT)
    final = _moments(near, key).select(key, *MEANS, *[(F.col(c) * factor).alias(c) for c in COVARIANCE])
    return final.join(rows.groupBy(key).agg(F.count("*").alias("n")), key), small


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", core: float = CORE, starts: int = STARTS, cutoff: float = CUTOFF, prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """Verdict on every row of docs: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, d2, kept.

    base_failed: fewer than 50 words, or more than half of the words inside repeated three-word windows. The robust estimate of a
    language and source rests on its rows that pass, drawn towards that of all rows as if by prior_rows rows of those, so that a small
    group is judged much like the whole and a large one by itself. kept: not base_failed and a squared distance of at most cutoff. Null
    and empty texts fail the base limits; null languages and sources are groups like any other; repeated rows stay; if no row passes,
    none is kept; other columns are ignored.
    """
    group = F.to_json(F.array(F.col("lang"), F.col("source")))
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    stats = base_statistics(frame).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = written(stats.select("*", failed.alias("base_failed"), group.alias("g"), *transformed()), "statistics")
    # every row counts for its group and for the whole
    passing = stats.where("not base_failed").select(F.explode(F.array(F.col("g"), F.lit("all"))).alias("g"), *STATS)
    estimates, small = robust_estimates(passing, "g", core, starts)
    found = written(estimates, "robust")
    every = found.where("g = 'all'").select(*[F.col(c).alias(f"all_{c}") for c in (*MEANS, *COVARIANCE)])
    own = F.col("n") / (F.col("n") + F.lit(prior_rows))
    drawn = found.where("g <> 'all'").crossJoin(F.broadcast(every)).select("g", *[(own * F.col(c) + (1 - own) * F.col(f"all_{c}")).alias(c) for c in (*MEANS, *COVARIANCE)])  # every has one row
    final = written(_rooted(drawn).select("g", *MEANS, *CHOLESKY), "drawn")
    d2 = _distance()
    kept = ~F.col("base_failed") & F.coalesce(d2 <= cutoff, F.lit(False))
    joined = stats.join(small(final), "g", "left")
    return joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", d2.alias("d2"), kept.alias("kept"))
