import base64
import hashlib
import io

import zstandard

from demandlens.llm import warc
from demandlens.llm.common import fresh_path

ROWS = [(5, "http://a.example/", "<p>é one</p>", "i"), (3, "http://b.example/x", "<p>é one</p>", "i"), (9, None, None, "i"), (8, "u", "", "i"), (7, "line\r\nbreak", "long " * 20000, "i"), (None, "n", "<p>é one</p>", None), (3, "again", "<p>é one</p>", "i"), (11, "x", "alone\r\n\r\nbody", "i")]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, first string")


def test_round_trip(spark):
    rows = warc.round_trip(pages(spark)).collect()
    assert len(rows) == len(ROWS)
    html = {r[0]: (r[2] or "").encode() for r in ROWS}
    for r in rows:
        body = html[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if r.record_type == "response":
            assert bytes(r.payload) == body and r.refers_to is None
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert kinds == [(0, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3), (7, "response", None), (8, "response", None), (9, "revisit", 8), (11, "response", None)]
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_small_payloads_may_all_be_responses(spark):
    kinds = {r.page_id: r.record_type for r in warc.round_trip(pages(spark), least_bytes=5).collect()}
    assert kinds[9] == kinds[8] == "response" and kinds[5] == "revisit"


def test_index_finds_single_records(spark):
    folder = fresh_path(spark, "warc")
    index = warc.write(pages(spark), folder, bundle_bytes=200)
    some = warc.lookup(folder, index.where("page_id = 7")).collect()
    assert len(some) == 1 and some[0].payload == ("long " * 20000).encode()


def test_bundles_are_plain_zstandard_with_a_seek_table():
    records = [warc.to_record(i, "u", b"x" * i, None, False) for i in (1, 500, 3)]
    writer = zstandard.ZstdCompressor(write_content_size=True)
    frames = [writer.compress(r) for r in records]
    data = b"".join(frames) + warc.seek_table([(len(f), len(r)) for f, r in zip(frames, records, strict=True)])
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(records)
    assert warc.Bundle(data).record(1)["payload"] == b"x" * 500
