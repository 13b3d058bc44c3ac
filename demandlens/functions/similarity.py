"""Text similarity that Spark does not have, as vectorised UDFs over candidate pairs only."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per character of b for each block of bits of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    """100 times twice the common subsequence over both lengths; 100 for two empty texts."""
    a, b = a or "", b or ""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def ratio_udf(once: bool = False) -> Callable[[Column, Column], Column]:
    """ratio, vectorised. once: it is evaluated where it stands, so that Spark moves no filter on it below a distinct, where pairs repeat."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([100.0 if x == y else ratio(x, y) for x, y in zip(a, b, strict=True)])

    return run.asNondeterministic() if once else run


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths of two texts allow a ratio of least; cheap, for use before the UDF."""
    n, m = F.length(a), F.length(b)
    return (n + m == 0) | (200.0 * F.least(n, m) / F.nullif((n + m).cast("double"), F.lit(0.0)) >= least)


def simhash(c: Column, gram: int = 3) -> Column:
    """64-bit SimHash of a text's character n-grams as a signed long; a bit is set if at least half of the grams have it; null below one gram.

    JVM functions only: grams are hashed once with xxhash64, and each sum counts several bits side by side, in fields as wide as the number
    of grams needs without the sum's sign: eight bits up to 127 grams, 16 up to 32,767, 32 beyond.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length(c) - gram + 1), lambda i: F.xxhash64(F.substring(c, i, F.lit(gram))))

    def word(hashes: Column, n: Column, width: int) -> Column:
        ones, top = sum(1 << at for at in range(0, 64, width)), width - 2
        start = (F.lit(1 << top) - F.shiftright(n + 1, 1)).cast("long") * F.lit(ones).cast("long")

        def place(k: int) -> Column:
            """The bits k, k + width and so on of the word: sums start so that half of the grams carry into the second highest bit of a field."""
            sums = F.aggregate(hashes, start, lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ones).cast("long")))
            return F.shiftleft(F.shiftrightunsigned(sums, top).bitwiseAND(F.lit(ones).cast("long")), k)

        return reduce(Column.bitwiseOR, [place(k) for k in range(width)])

    def words(h: Column) -> Column:
        n = F.size(h)
        return F.when(n < 1 << 7, word(h, n, 8)).when(n < 1 << 15, word(h, n, 16)).otherwise(word(h, n, 32))

    return F.when(F.length(c) >= gram, F.transform(F.array(grams), words)[0])


def blake2b_print(text: str | None, gram: int = 3) -> int | None:
    """The SimHash of simhash with the grams hashed by BLAKE2b to eight bytes (big-endian), as a signed number."""
    held = Counter(text[i : i + gram] for i in range(len(text or "") - gram + 1))
    if not held:
        return None
    digests = b"".join(hashlib.blake2b(g.encode(), digest_size=8).digest() for g in held)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    times = np.fromiter(held.values(), np.int64)
    return int(np.packbits(2 * (times @ bits) >= times.sum()).view(">i8")[0])


def simhash_udf(gram: int = 3) -> Callable[[Column], Column]:
    """simhash with BLAKE2b grams, for prints that must equal those of other programs; vectorised, but in Python."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([blake2b_print(t, gram) for t in texts], dtype="Int64")

    return run
