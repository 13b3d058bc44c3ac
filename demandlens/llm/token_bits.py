"""Token ids in files of fixed bit width with block offsets, written and read by Spark tasks."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from demandlens.llm.common import fresh_path, written
from demandlens.llm.tokens import default_path, encoded_batches, vocabulary_size

MAGIC, BLOCK, END_ID, FILE_IDS = b"TBP1", 4096, 2, 2_000_000
FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
HEAD, HEAD_SIZE = "<4sBIQI", struct.calcsize("<4sBIQI")  # magic, bits, ids of a block, ids, documents


def width(vocabulary: int) -> int:
    """Bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids one after the other, lowest bit first; eight ids take bits bytes. Raises if an id needs more bits."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit into {bits} bits")
    if bits in (8, 16, 32):  # whole machine words
        out = np.zeros(-(-len(ids) // 8) * 8, f"<u{bits // 8}")
        out[: len(ids)] = ids
        return out.tobytes()
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for j in range(8):
        at = j * bits
        for k in range(at // 8, (at + bits - 1) // 8 + 1):
            shift = 8 * k - at
            part = lanes[:, j] >> np.uint64(shift) if shift >= 0 else lanes[:, j] << np.uint64(-shift)
            out[:, k] |= (part & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first count ids of what pack_bits made, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8).reshape(-1, bits).astype(np.uint64)
    out = np.zeros((len(raw), 8), np.uint64)
    for j in range(8):
        at = j * bits
        for k in range(at // 8, (at + bits - 1) // 8 + 1):
            shift = 8 * k - at
            out[:, j] |= raw[:, k] << np.uint64(shift) if shift >= 0 else raw[:, k] >> np.uint64(-shift)
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32).reshape(-1)[:count]


def to_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """One file: header, documents (has an id, id, ids), block offsets, blocks. A block has a multiple of eight ids, so it ends on a whole byte."""
    if block % 8:
        raise ValueError("a block must hold a multiple of eight ids")
    data, blocks = pack_bits(ids, bits), -(-len(ids) // block)
    table = b"".join(struct.pack("<?qQ", d is not None, d or 0, n) for d, n in zip(doc_ids, lengths.tolist(), strict=True))
    offsets = np.minimum(np.arange(blocks + 1) * (block // 8 * bits), len(data)).astype("<u8") + HEAD_SIZE + len(table) + 8 * (blocks + 1)
    return b"".join((struct.pack(HEAD, MAGIC, bits, block, len(ids), len(doc_ids)), table, offsets.astype("<u8").tobytes(), data))


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_ids, n = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        rows = list(struct.iter_unpack("<?qQ", data[HEAD_SIZE : HEAD_SIZE + 17 * n]))
        self.doc_ids = [d if has else None for has, d, _ in rows]
        self.starts = np.concatenate(([0], np.cumsum([x for _, _, x in rows]))).astype(np.int64)
        self.data, self.n_blocks = data, -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", self.n_blocks + 1, HEAD_SIZE + 17 * n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], unpacking only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (stop - 1) // self.block
        first, last = a * self.block, min(self.n_ids, (b + 1) * self.block)
        # full blocks end on whole bytes, so that blocks in a row unpack as one
        return unpack_bits(self.data[int(self.offsets[a]) : int(self.offsets[b + 1])], self.bits, last - first)[start - first : stop - first]


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, vocabulary: int | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes docs in ascending order of id (nulls first) and text to files of about file_ids ids under folder, which all executors share.

    Ids take the least bits that hold every id of the tokenizer's vocabulary, or of the given one; a larger id raises.
    Returns the list of files in order: part, seq, file, n_docs, n_ids. A task that runs twice writes files with other names; only those in
    the list count.
    """
    tokenizer = path or default_path()
    bits = width(max(vocabulary or vocabulary_size(tokenizer), end_id + 1))
    frame = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frame = frame.withColumn("mark", F.xxhash64("text"))  # parts rows with one id and gives them an order
    ordered = frame.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, seq, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal held, seq
            name = f"{uuid.uuid4().hex}.tok"
            doc_ids, lengths, ids = [d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(to_bytes(doc_ids, lengths, ids, bits))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(doc_ids), "n_ids": len(ids)}], FILES)
            held, seq = [], seq + 1
            return row

        for b, ids, starts in encoded_batches(batches, 1, tokenizer, end_id):
            held.append((b.column(0).to_pylist(), np.diff(starts), ids))
            if sum(len(h[2]) for h in held) >= file_ids:
                yield flush()
        if held:
            yield flush()

    return written(ordered.mapInArrow(run, "part int, seq int, file string, n_docs long, n_ids long"), "files")


def read(folder: str, files: DataFrame) -> DataFrame:
    """Documents of the listed files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    per_part = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = per_part.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row for each partition
    placed = files.join(before, "part").select("file", (F.col("before") + F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("first"))

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}", compression=None) as data:
                    f = TokenFile(data.read())
                ids = f.ids(0, f.n_ids).astype("<u4")
                values = pa.BinaryArray.from_buffers(pa.binary(), len(f.doc_ids), [None, pa.py_buffer((f.starts * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(f.starts[:-1] + first), pa.array(np.diff(f.starts)), values], ["doc_id", "start", "n_tokens", "ids"])

    # only names are dealt out; each task opens its files itself
    dealt = placed.repartition(min(20_000, max(1, files.count())), "file")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back: doc_id, start, n_tokens, ids.

    Null and empty texts have the end id alone. Rows with a null id come first; repeated ids follow one another in the order of a hash of
    their texts, each with its own place. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    files = write(docs, folder, id_col, text_col, path, end_id=end_id)
    if files.limit(1).count() == 0:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    return read(folder, files)
