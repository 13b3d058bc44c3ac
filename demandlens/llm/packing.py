"""Packing of documents into windows: non-negative least squares over shallow length combinations, then a greedy rest."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.llm.common import written
from demandlens.llm.tokens import default_path, encoded_batches

WINDOW, END_ID = 4096, 2
#: Size classes are this share of a size wide, at most WIDTH; a window's filler class repeats at most MOST times.
FINE, WIDTH, MOST = 1 / 64, 16, 64


def size_class(length: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The room that a piece is given: its length up to the next multiple of a power of two, which is at most a 64th of it and at most width."""
    steps = np.exp2(np.floor(np.log2(np.maximum(1, np.asarray(length) * FINE)))).astype(np.int64)
    steps = np.minimum(width, steps)
    return -(-length // steps) * steps


def combinations(sizes: list[int], window: int, most: int = MOST) -> list[dict[int, int]]:
    """All of one to three sizes that fill the window exactly, and those of one size repeated up to most times beside at most one other."""
    have = set(sizes)
    out = {((window, 1),)} if window in have else set()
    for i, a in enumerate(sizes):
        for k in range(1, min(most, window // a) + 1):
            b = window - k * a
            if b == 0:
                out.add(((a, k),))
            elif b in have and b != a:
                out.add(tuple(sorted(((a, k), (b, 1)))))
        for b in sizes[i + 1 :]:
            c = window - a - b
            if c <= b:
                break
            if c in have:
                out.add(((a, 1), (b, 1), (c, 1)))
    return [dict(c) for c in sorted(out)]


def repeats(histogram: dict[int, int], combos: list[dict[int, int]], tolerance: float = 1e-7) -> np.ndarray:
    """Counts x >= 0 of the combinations that bring the sizes used closest to the histogram: exact non-negative least squares.

    The active-set method moves from one vertex to the next, so at most as many combinations are used as there are sizes and their
    counts are large enough to survive rounding. It ends where no unused combination would bring the sizes closer.
    """
    sizes = sorted(histogram)
    at, m = {s: i for i, s in enumerate(sizes)}, len(combos)
    x, wanted = np.zeros(m), np.array([histogram[s] for s in sizes], float)
    if not m:
        return x
    deep = max(map(len, combos))
    cols, times = np.zeros((m, deep), np.int64), np.zeros((m, deep))
    for j, c in enumerate(combos):
        for i, (s, n) in enumerate(c.items()):
            cols[j, i], times[j, i] = at[s], n
    lengths = np.sqrt((times**2).sum(axis=1))
    times /= lengths[:, None]  # columns of length one
    scale, used = max(1.0, float(np.abs(wanted).max())), []
    columns = np.zeros((len(sizes), 0))
    while True:
        left = wanted - columns @ x[used]
        slope = (times * left[cols]).sum(axis=1)
        slope[used] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance * scale or len(used) >= len(sizes):
            break
        column = np.zeros(len(sizes))
        np.add.at(column, cols[j], times[j])
        used, columns = [*used, j], np.column_stack((columns, column))
        while True:
            best = np.linalg.lstsq(columns, wanted, rcond=None)[0] if len(used) < 3 else _least(columns, wanted)
            now = x[used]
            if (best > 0).all():
                x[used] = best
                break
            low = best <= 0
            share = float((now[low] / np.maximum(1e-300, now[low] - best[low])).min())
            now = now + share * (best - now)
            stay = (now > tolerance * 1e-3) & ~(low & (now <= 1e-12 * scale))
            if stay.all():
                stay[np.flatnonzero(low)[now[low].argmin()]] = False
            x[used] = np.where(stay, now, 0)
            used, columns = [u for u, s in zip(used, stay, strict=True) if s], columns[:, stay]
            if not used:
                break
    return x / lengths


def _least(columns: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(columns.T @ columns, columns.T @ wanted)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(columns, wanted, rcond=None)[0]


def solved(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Combinations that fill the window and their rounded least-squares counts, the most used first, within the histogram."""
    left, out = dict(histogram), []
    combos = combinations(sorted(histogram), window)
    x = repeats(histogram, combos)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        times = min(int(x[j] + 0.5), *(left[s] // n for s, n in combos[j].items()))
        if times > 0:
            out.append((combos[j], times))
            for s, n in combos[j].items():
                left[s] -= n * times
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each size in a window) and how often each is used, which together use up the histogram of sizes.

    First the solved combinations; what is left goes largest first into windows.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    out = solved(left, window)
    for pattern, times in out:
        for s, n in pattern.items():
            left[s] -= n * times
    while left := {s: n for s, n in left.items() if n > 0}:
        room, pattern = window, {}
        for s in sorted(left, reverse=True):
            if n := min(left[s], room // s):
                pattern[s] = n
                room -= n * s
        times = min(left[s] // n for s, n in pattern.items())
        out.append((pattern, times))
        for s, n in pattern.items():
            left[s] -= n * times
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """Documents' ids cut at multiples of the window, with their CRC, the size class and the place in it among the task's pieces of that class."""
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b, ids, starts in encoded_batches(batches, 1, path, end_id):
            totals = np.diff(starts)
            counts = -(-totals // window)
            row = np.repeat(np.arange(len(totals)), counts)
            at = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
            length = np.minimum(window, totals[row] - at)
            size = size_class(length)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
            inside = np.arange(len(ordered)) - np.repeat(new, np.diff(np.concatenate((new, [len(ordered)]))))
            rank = np.empty(len(size), np.int64)
            rank[order] = seen[ordered] + inside
            seen += np.bincount(size, minlength=window + 1)
            first = starts[row] + at
            data = memoryview(ids.astype("<u4").tobytes())
            ends = np.append(first, len(ids)) * 4  # pieces follow one another, so one's end is the next one's start
            crc = np.fromiter((zlib.crc32(data[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)), np.int64, len(row))
            columns = [b.column(0).take(pa.array(row)), pa.array(totals[row]), pa.array(at), pa.array(length), pa.array(crc), pa.array(size.astype(np.int32)), pa.array(np.full(len(row), part, np.int32)), pa.array(rank)]
            if with_ids:
                columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "size", "part", "rank", *["ids"] * with_ids]
    return frame.mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, size int, part int, rank long" + ", ids binary" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of documents and the sequences of at most window tokens that they fill.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and unless with_ids is false ids (binary,
    little-endian unsigned 32-bit).
    Long documents are cut at multiples of the window; every other document stays whole. Null and empty texts have the end id alone.
    Null ids and repeated rows are kept, each row as a document of its own; an empty table gives no rows; other columns are ignored.
    The plan is made from the counts of size classes, a few hundred of them; the pieces themselves never pass through the driver. The plan
    has at most one row for each size in each pattern, so it is bounded by the classes and the patterns, and grows no further with the
    number of documents.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text_col, path or default_path(), end_id, window, with_ids), "pieces")
    counts = written(cut.groupBy("part", "size").agg(F.count("*").alias("n")), "counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, window):
        slot = 0
        for s, n in sorted(pattern.items(), reverse=True):
            rows.append((s, used[s], used[s] + n * times, n, sequence, slot))
            used[s] += n * times
            slot += n
        sequence += times
    planned = spark.createDataFrame(rows, "size int, lo long, hi long, each int, first long, slot int")
    before = counts.select("part", "size", (F.sum("n").over(W.partitionBy("size").orderBy("part")) - F.col("n")).alias("before"))
    ranked = cut.join(before, ["part", "size"]).withColumn("rank", F.col("rank") + F.col("before"))
    # bounded by the number of size classes and patterns, whatever the number of documents
    placed = ranked.join(F.broadcast(planned), (ranked["size"] == planned["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(k / F.col("each"))).withColumn("slot", F.col("slot") + k % F.col("each"))
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy("slot")) - F.col("length")
    return placed.select("doc_id", "start", "length", *["ids"] * with_ids, "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
