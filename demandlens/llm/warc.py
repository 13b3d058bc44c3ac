"""WARC archives as seekable Zstandard bundles: one frame for each record, a seek table at the end, and an index of record places."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandlens.llm.common import fresh_path, written

#: Fixed values of the seekable format: the skippable frame's and the footer's magic numbers.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records after which a bundle ends; least payload that is stored once only; compression level.
BUNDLE_BYTES, LEAST_BYTES, LEVEL = 16_000_000, 0, 3
#: Payloads that occur more than once and whose digests (about 60 bytes each) are broadcast; with more of them all payloads are dealt by digest.
MOST_FIRSTS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, offset long, frame_bytes long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page-id:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    """The page id that record_id was made of."""
    found = (record or "")[len("<urn:page-id:") : -1]
    return int(found) if found else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(url: str | None) -> str:
    return "".join((url or "").splitlines()).strip()


def to_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the reply's head, with the payload's length, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean(url)}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_record(data: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (none for a revisit) of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame with the compressed and plain size of each frame."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
    body = entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Bundle:
    """Random access to the records of one bundle."""

    def __init__(self, data: bytes):
        count, _, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = data[len(data) - 9 - 8 * count : len(data) - 9]
        self.data, self.sizes = data, list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for c, _ in self.sizes:
            self.starts.append(self.starts[-1] + c)
        self.reader = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def record(self, frame: int) -> dict:
        c, d = self.sizes[frame]
        return from_record(self.reader.decompress(self.data[self.starts[frame] : self.starts[frame] + c], max_output_size=d))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record per row under folder, which all executors share, and returns the index of those that count.

    Of rows with equal payloads of at least least_bytes the one with the least id is a response, the others revisit it. A task that runs
    twice writes bundles with other names; only those in the index count.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # only payloads that occur more than once are looked up, and while these are few no payload leaves its task
    firsts = written(rows.select("digest", "page_id").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n"), "firsts")
    joined = rows.join(F.broadcast(firsts) if firsts.count() <= MOST_FIRSTS else firsts, "digest", "left")
    revisit = (F.length("payload") >= least_bytes) & F.coalesce(F.col("first") < F.col("page_id"), F.col("page_id").isNull() & F.col("first").isNotNull())
    marked = joined.select("page_id", "url", "payload", "first", F.coalesce(revisit, F.lit(False)).alias("revisit"))

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, frames, sizes, ids, total = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True), [], [], [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for f in frames:
                    out.write(f)
                out.write(seek_table(sizes))
            at, rows = 0, []
            for k, (page, (c, _)) in enumerate(zip(ids, sizes, strict=True)):
                rows.append((page, name, k, at, c))
                at += c
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["page_id", "bundle", "frame", "offset", "frame_bytes"])

        for b in batches:
            for page, url, data, refers, again in zip(*(b.column(i) for i in range(5)), strict=True):
                record = to_record(page.as_py(), url.as_py(), data.as_py(), refers.as_py(), again.as_py())
                frame = writer.compress(record)
                frames.append(frame)
                sizes.append((len(frame), len(record)))
                ids.append(page.as_py())
                total += len(record)
                if total >= bundle_bytes:
                    yield flush()
                    frames, sizes, ids, total = [], [], [], 0
        if frames:
            yield flush()

    return written(marked.mapInArrow(run, INDEX), "index")


def read(folder: str, index: DataFrame) -> DataFrame:
    """All indexed records, read frame by frame: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    bundle = Bundle(f.read())
                for k in range(0, len(bundle), 500):
                    rows = [bundle.record(i) for i in range(k, min(k + 500, len(bundle)))]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))

    # only names are dealt out; each task opens its bundles itself
    names = index.select("bundle").distinct()
    dealt = names.repartition(min(20_000, max(1, names.count())), "bundle")
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def lookup(folder: str, index: DataFrame) -> DataFrame:
    """The records of an index, or of a few of its rows, each by its own frame alone: page_id, record_type, payload."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        reader = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for bundle, offset, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{root}/{bundle}") as f:
                    r = from_record(reader.decompress(f.read_at(size, offset)))
                rows.append((r["page_id"], r["record_type"], r["payload"]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.binary()), strict=True)], ["page_id", "record_type", "payload"])

    return index.select("bundle", "offset", "frame_bytes").mapInArrow(run, "page_id long, record_type string, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes pages as bundles in the shared folder and reads them back, one row per row of pages.

    A null html is an empty payload, which is stored once like any other. Rows that repeat the least id of a payload are responses too;
    a null id revisits any other and is a response only where all ids are null. An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    index = write(pages, folder, id_col, url_col, html_col, least_bytes)
    if index.limit(1).count() == 0:
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return read(folder, index)
