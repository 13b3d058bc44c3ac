"""Best-fit packing by sums of squares: each document goes where the squared counts of open bins per residual gap become smallest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import written
from demandlens.llm.packing import pieces
from demandlens.llm.tokens import default_path

WINDOW, END_ID = 4096, 1
#: Pieces that one task packs together, and the part of them whose bins it may hand on because they are the emptiest.
SHARE, HANDED_ON = 100_000, 16

KEYS = "part int, size int, rank long"


def sum_of_squares(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The bin of each piece. Pieces come in falling length, so that small ones fill the gaps that large ones leave.

    count[g] bins are open with a gap of g. A piece of length s turns a bin of gap g into one of gap g - s, which changes the sum of the
    squared counts by 2 (count[g - s] - count[g]) + 2; a bin that it fills is no longer open, so that the change is 1 - 2 count[g]. The least
    change wins, of equal ones the least gap. Only a piece that no open bin can hold opens a bin, since few bins are what is wanted.
    """
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and not (0 < lengths.min() and lengths.max() <= window):
        raise ValueError(f"lengths must be from 1 to {window}")
    count, at_gap = np.zeros(window + 1, np.int64), [[] for _ in range(window + 1)]
    out, bins = np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        held = count[s:window]
        open_gaps = np.flatnonzero(held)
        if len(open_gaps):
            before = held[open_gaps]
            change = 2 * (count[open_gaps] - before) + 2  # count[g - s], as open_gaps are counted from s
            if open_gaps[0] == 0:
                change[0] = 1 - 2 * before[0]
            gap = s + int(open_gaps[change.argmin()])
            count[gap] -= 1
            b = at_gap[gap].pop()
        else:
            gap, b = window, bins
            bins += 1
        out[i] = b
        if gap > s:
            count[gap - s] += 1
            at_gap[gap - s].append(b)
    return out


def _packed_share(window: int, turn: int, most_handed_on: int):
    """Packs the pieces of one share: their sequence, the place in it, and whether the share hands the sequence's pieces on."""

    def run(key, rows):
        rows = rows.sort_by([("length", "descending"), ("part", "ascending"), ("size", "ascending"), ("rank", "ascending")])
        lengths = rows["length"].to_numpy()
        bins = sum_of_squares(lengths, window)
        order = np.argsort(bins, kind="stable")
        rows, bins, lengths = rows.take(pa.array(order)), bins[order], lengths[order]
        filled = np.bincount(bins, lengths).astype(np.int64)
        ends = np.cumsum(lengths)
        offset = ends - lengths - (np.cumsum(filled) - filled)[bins]
        pieces_of = np.bincount(bins)
        emptiest = np.argsort(filled, kind="stable")
        goes_on = np.zeros(len(filled), bool)
        goes_on[emptiest[np.cumsum(pieces_of[emptiest]) <= most_handed_on]] = True
        goes_on &= filled < window
        sequence = (turn << 58) + (key[0].as_py() << 30) + bins
        columns = [rows[c] for c in ("doc_id", "start", "length", "ids_crc32", "part", "size", "rank")]
        return pa.table([*columns, pa.array(sequence), pa.array(offset), pa.array(goes_on[bins])], names=["doc_id", "start", "length", "ids_crc32", "part", "size", "rank", "sequence_id", "offset", "goes_on"])

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = True, share: int = SHARE) -> DataFrame:
    """Pieces of documents and the sequences of at most window tokens that hold them, as few as sum-of-squares packing comes to.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and unless with_ids is false ids (binary,
    little-endian unsigned 32-bit). Documents longer than the window are cut at its multiples, no others are.
    Pieces are dealt by a hash into shares of about share pieces, each packed by one task. A share hands the pieces of its emptiest
    sequences on, at most a sixteenth of its pieces; those are dealt into new, fewer shares, until one share holds all that is left. So
    rounds grow with the logarithm of the number of pieces, no task holds more than a share, and a few sequences at most stay open.
    Null and empty texts have the end id alone. Null ids and repeated rows are kept, each row as a document of its own; an empty table
    gives no rows; other columns are ignored. Equal input gives equal sequences, however often a task runs.
    """
    cut = written(pieces(docs, id_col, text_col, path or default_path(), end_id, window, with_ids), "pieces")
    slim = cut.select("doc_id", "start", "length", "ids_crc32", "part", "size", "rank")
    # a full piece is a sequence of its own, below all others; (part, rank) is unique among them
    out = slim.where(F.col("length") == window).withColumns({"sequence_id": -1 - (F.shiftleft(F.col("part").cast("long"), 40) + F.col("rank")), "offset": F.lit(0).cast("long")})
    todo, turn = slim.where(F.col("length") < window), 0
    while n := todo.count():
        shares = -(-n // share)
        dealt = todo.withColumn("share", F.pmod(F.xxhash64("part", "size", "rank", F.lit(turn)), F.lit(shares)))
        run = _packed_share(window, turn, share // HANDED_ON if shares > 1 else 0)
        schema = f"doc_id long, start long, length long, ids_crc32 long, {KEYS}, sequence_id long, offset long, goes_on boolean"
        packed = written(dealt.repartition(shares, "share").groupBy("share").applyInArrow(run, schema), "packed")
        out = out.unionByName(packed.where("not goes_on").drop("goes_on"))
        todo, turn = packed.where("goes_on").select(*slim.columns), turn + 1
    if with_ids:
        out = out.join(cut.select("part", "size", "rank", "ids"), ["part", "size", "rank"])
    return out.select("doc_id", F.floor(F.col("start") / window).cast("int").alias("piece"), "start", "length", *["ids"] * with_ids, "ids_crc32", "sequence_id", "offset")
