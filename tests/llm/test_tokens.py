import collections
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from demandlens.llm import packing, token_bits, tokens

ODD = ["", None, "a<|endoftext|>b <|endoftext|> c", "it's don't 'S", "É́ à Σας İstanbul", "x\x1cy\x0bz\x0cw", "12 3,4 ½ ²", "😀 👍🏽 漢字かな", " a b　c", "ß ÿ ÀÿÖ!!...", "<x> <|startoftext|", "a" * 3000, "`~^_[]{}\\|"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokens.default_path())


def want(reference, text):
    return [*reference.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_are_the_tokenizers(spark, reference):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    t = tokens.WordTokenizer(tokens.default_path(), memory=500)
    for k in range(0, len(texts), 40):
        part = texts[k : k + 40]
        ids, starts = t.encode(pa.array(part, pa.string()))
        for i, x in enumerate(part):
            assert ids[starts[i] : starts[i + 1]].tolist() == reference.encode(x or "", add_special_tokens=False).ids, x


def test_bits_round_trip():
    rng = np.random.default_rng(3)
    for bits in (1, 3, 7, 8, 15, 16, 17, 31, 32):
        for n in (0, 1, 7, 8, 9, 1000):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
            data = token_bits.pack_bits(ids, bits)
            assert len(data) == -(-n // 8) * bits
            assert (token_bits.unpack_bits(data, bits, n) == ids.astype(np.uint32)).all()
    ids = rng.integers(0, 49408, 10000).astype(np.uint32)
    f = token_bits.TokenFile(token_bits.to_bytes([5, None, 7], np.array([0, 9999, 1]), ids, 16, block=64))
    for a, b in ((0, 10000), (63, 65), (128, 128), (9990, 10000)):
        assert (f.ids(a, b) == ids[a:b]).all()
    assert f.doc_ids == [5, None, 7] and f.starts.tolist() == [0, 0, 9999, 10000]


def test_files_round_trip(spark, reference):
    docs = spark.createDataFrame([(i * 7 % 13, x, "e") for i, x in enumerate(ODD)] + [(99, "twice", ""), (99, "twice", ""), (None, "no id", "")], "doc_id long, text string, ids string").repartition(3)
    rows = sorted(token_bits.round_trip(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(13), 99, 99]
    texts = {i * 7 % 13: x for i, x in enumerate(ODD)} | {99: "twice", None: "no id"}
    at = 0
    for r in rows:
        ids = want(reference, texts[r.doc_id])
        assert (r.start, r.n_tokens) == (at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    assert token_bits.round_trip(docs.limit(0)).count() == 0


def test_packing_is_whole_and_tight(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs).collect()
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        covered[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for i, parts in covered.items():
        whole = b"".join(ids for _, ids, _ in sorted(parts))
        assert parts[0][2] == len(whole) // 4
        if i % 10 == 0:
            assert np.frombuffer(whole, "<u4").tolist() == want(reference, texts[i])
    assert set(covered) == set(texts)
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        used += at
    assert used / (4096 * len(sequences)) > 0.98


def test_plan_uses_every_length():
    rng = np.random.default_rng(4)
    lengths = packing.size_class(np.minimum(4096, rng.lognormal(5.5, 1.5, 20000).astype(int) + 1))
    histogram = {int(s): int(n) for s, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    found = packing.plan(histogram)
    used = collections.Counter()
    for pattern, times in found:
        assert sum(s * n for s, n in pattern.items()) <= 4096
        for s, n in pattern.items():
            used[s] += n * times
    assert used == histogram
    room = 4096 * sum(times for _, times in found)
    assert sum(s * n for s, n in histogram.items()) / room > 0.99
    assert packing.plan({}) == []
    solved = sum(sum(s * n for s, n in pattern.items()) * times for pattern, times in packing.solved(histogram))
    assert solved / sum(s * n for s, n in histogram.items()) > 0.8  # most of the room is placed by least squares


def test_repeats_are_the_exact_least_squares():
    rng = np.random.default_rng(6)
    for size in (1, 5, 12, 40):
        sizes = sorted({int(s) for s in rng.integers(1, 40, size)} | {20, 40})
        histogram = {s: int(n) for s, n in zip(sizes, rng.integers(1, 200, len(sizes)), strict=True)}
        combos = packing.combinations(sizes, 40)
        assert all(sum(s * n for s, n in c.items()) == 40 for c in combos) and {40: 1} in combos and {20: 2} in combos
        x = packing.repeats(histogram, combos)
        a = np.array([[c.get(s, 0) for c in combos] for s in sizes], float)
        slope = a.T @ (np.array([histogram[s] for s in sizes]) - a @ x)
        assert (x >= 0).all() and (slope < 1e-3).all() and np.abs(slope * x).max() < 1e-2  # what makes a solution the least one


def test_ids_beyond_the_width_are_refused():
    with pytest.raises(ValueError, match="70000"):
        token_bits.pack_bits(np.array([1, 70000]), 16)
    assert tokens.vocabulary_size(tokens.default_path()) == 49408


def test_repeated_ids_have_one_order(spark, reference):
    docs = [(7, "one text"), (7, "another longer text"), (7, None), (None, "b b b"), (None, "a")]
    found = [sorted((r.start, r.n_tokens, r.doc_id) for r in token_bits.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()) for rows, n in ((docs, 1), (docs[::-1], 4))]
    assert found[0] == found[1] and len(found[0]) == 5


def test_odd_rows(odd_documents, no_documents):
    rows = packing.pack(odd_documents).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * sum(r.length for r in rows if r.doc_id == 1)
    assert [r.length for r in rows if r.doc_id == 3] == [1]
    assert packing.pack(no_documents).count() == 0
