"""Near-duplicate groups from SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import written
from demandlens.operators.components import components

SHINGLE, SEED, NEAR, BLOCKS, CHUNK = 4, 42, 4, 7, 4096
#: Blocks of more than two prints (about 25 bytes each) that are broadcast, so that prints in no such block are never dealt out; more are joined.
MOST_BLOCKS = 1_000_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text; a bit is set if over half of the shingles' hashes have it."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    size = min(shingle, len(found))
    starts = np.concatenate(([0], ends[: len(found) - size])).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, also: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp) for each row of docs and the text columns also, fp as a signed long; a null text counts as empty and has fingerprint 0."""
    also = also or {}
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[c.alias(n) for n, c in also.items()])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["id", "fp", *b.schema.names[2:]])

    return frame.mapInArrow(run, ", ".join(["id long", "fp long", *[f"{n} string" for n in also]]))


def block_masks(near: int = NEAR, blocks: int = BLOCKS) -> list[int]:
    """Signed masks of all choices of blocks - near blocks: two prints that differ in at most near bits agree under one."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - near)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(prints: list[int], near: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that links prints within near bits."""
    left, us, vs = np.array(prints, np.int64).view(np.uint64), [], []
    while left.size > 1:
        front, left = [left[0]], left[1:]
        while front and left.size:
            x = front.pop()
            close = np.bitwise_count(left ^ x) <= near
            if close.any():
                hit = left[close]
                left = left[~close]
                front.extend(hit)
                us.extend([int(x.view(np.int64))] * hit.size)
                vs.extend(hit.view(np.int64).tolist())
    return us, vs


def links(prints: DataFrame, near: int = NEAR, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column fp) within near bits of each other.

    Blocks of two are compared at once. Larger ones are cut into chunks by hash, each pair of chunks is compared by itself and gives
    the edges of a spanning forest, so no task holds more than about two chunks and no group is written out as all its pairs.
    """
    masks = block_masks(near, blocks)
    # the prints are few bytes, which Spark would leave in few tasks, but each becomes 35 rows
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = written(prints.select("fp").repartition(tasks), "fingerprints").select("fp", F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("k.b", "k.key", "fp")
    sizes = written(keyed.groupBy("b", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"), "blocks")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= near
    pairs = sizes.where("n = 2").where(close).select("u", "v")

    parts = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    large = sizes.where("n > 2").select("b", "key", "n")
    units = (
        keyed.join(F.broadcast(large) if large.count() <= MOST_BLOCKS else large, ["b", "key"])
        .select("b", "key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("b", "key", "fp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .groupBy("b", "key", "i", "j")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
    )

    def run(batches):
        for b in batches:
            us, vs = [], []
            for fps in b.column(0).to_pylist():
                x, y = _forest(fps, near)
                us += x
                vs += y
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return pairs.union(units.mapInArrow(run, "u long, v long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, near: int, also: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp, root, component_id) for each row of docs and the columns also; root is the least fingerprint of the group."""
    marked = written(fingerprints(docs, id_col, text_col, also=also), "prints")
    prints = marked.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(prints.select("fp"), near))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """Groups of documents whose fingerprints are linked, directly or through others, by at most near differing bits.

    Returns one row per row of docs: doc_id, fp (signed long), fingerprint (16 hex digits), component_id (the least id of the group).
    Null and blank texts have fingerprint 0 and are linked like any other; repeated rows stay; rows with a null id are kept and
    never name a group unless all of its ids are null. An empty table gives no rows; other columns are ignored.
    """
    found = _grouped(docs, id_col, text_col, near)
    return found.select(F.col("id").alias("doc_id"), "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """docs without near duplicates: of each group one row stays, with all its columns.

    It is a row with the least id, or any row where all ids of the group are null; of several texts under that id the one with the least
    digest. Rows are told apart by id and digest, so groups without an id, or with an id that others have too, each keep their row.
    Null and blank texts are one group; of repeated rows one stays; columns of any names keep their values; an empty table gives no rows.
    """
    own = docs.columns
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    rows = _grouped(docs, id_col, text_col, near, {"digest": digest}).where(F.col("id").eqNullSafe(F.col("component_id")))
    equals = rows.groupBy("root", "id", "digest").agg(F.count("*").alias("copies"))
    firsts = equals.groupBy("root").agg(F.min(F.struct("digest", "id", "copies")).alias("f")).select(F.col("f.id").alias("first_id"), F.col("f.digest").alias("first_digest"), "f.copies")
    firsts = written(firsts, "firsts")
    same = docs[id_col].cast("long").eqNullSafe(firsts["first_id"]) & (F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256) == firsts["first_digest"])
    kept = docs.join(firsts, same, "left_semi")
    if not firsts.where("copies > 1").limit(1).count():
        return kept
    # equal digests are one group, so that one row per id and digest is one per group
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(id_col).cast("long").alias("id"), digest.alias("digest"))
    return rows.dropDuplicates(["id", "digest"]).select(*[F.col(f"row.`{c}`").alias(c) for c in own])
