import collections
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from demandlens.llm import sum_squares, tokens


def slow_bins(lengths, window):
    """Sum-of-squares packing with the sum worked out anew for every choice."""
    gaps, order = [], sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sizes = []
    for i in order:
        s, best = lengths[i], None
        for gap in sorted({g for g in gaps if g >= s}):
            count = collections.Counter(g for g in gaps if g)
            count[gap] -= 1
            count[gap - s] += gap > s
            change = sum(n * n for n in count.values())
            if best is None or change < best[0]:
                best = (change, gap)
        if best is None:
            gaps.append(window - s)
            sizes.append([s])
        else:
            # any of the bins with this gap
            b = max((k for k, g in enumerate(gaps) if g == best[1]), key=lambda k: k)
            gaps[b] -= s
            sizes[b].append(s)
    return sorted(gaps)


def test_every_piece_makes_the_squares_least():
    rng = np.random.default_rng(1)
    for n, window in ((0, 10), (1, 10), (60, 12), (120, 40), (150, 100)):
        lengths = rng.integers(1, window + 1, n)
        bins = sum_squares.sum_of_squares(lengths, window)
        filled = np.bincount(bins, lengths, minlength=0).astype(int)
        assert sorted((window - filled).tolist()) == slow_bins(lengths.tolist(), window)
    with pytest.raises(ValueError, match="lengths"):
        sum_squares.sum_of_squares(np.array([0, 3]), 10)


def test_few_sequences():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6.3, 1.0, 20_000).astype(int), 1, 4095)
    used = sum_squares.sum_of_squares(lengths).max() + 1
    assert used <= -(-lengths.sum() // 4096) * 1.001 + 1


def whole(rows, window=4096):
    """Checks that pieces cover documents and sequences have no gaps; returns ids by document and the number of sequences."""
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.start == r.piece * window
        covered[r.doc_id].append((r.start, r.length, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    for parts in covered.values():
        assert all(length == window for _, length, _ in sorted(parts)[:-1])
    return {i: b"".join(ids for *_, ids in sorted(parts)) for i, parts in covered.items()}, len(sequences)


@pytest.mark.parametrize("share", [sum_squares.SHARE, 200])
def test_packing_is_whole_and_tight(spark, share):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sum_squares.pack(docs, share=share).collect()
    ids, used = whole(rows)
    reference = Tokenizer.from_file(tokens.default_path())
    for i, text in texts.items():
        if i % 10 == 0:
            assert np.frombuffer(ids[i], "<u4").tolist() == [*reference.encode(text or "", add_special_tokens=False).ids, 1]
    assert set(ids) == set(texts)
    least = -(-sum(r.length for r in rows) // 4096)
    assert used <= least * 1.005 + 1
    again = sum_squares.pack(docs.repartition(1), share=share, with_ids=False)
    assert again.select("sequence_id").distinct().count() <= least * 1.005 + 1 and again.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pieces_that_no_other_fits(spark):
    docs = spark.createDataFrame([(i, "word " * 2500) for i in range(300)] + [(1000, "a " * 8191), (1001, "a " * 8192)], "doc_id long, text string")
    ids, used = whole(sum_squares.pack(docs, share=50).collect())
    assert used == 300 + 2 + 2 and len(ids) == 302  # the document of 8,193 ids has one left over, which goes beside another


def test_odd_rows(odd_documents, no_documents):
    rows = sum_squares.pack(odd_documents).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * sum(r.length for r in rows if r.doc_id == 1)
    assert [(r.length, r.piece, bytes(r.ids)) for r in rows if r.doc_id == 3] == [(1, 0, b"\x01\0\0\0")]
    assert sum_squares.pack(no_documents).count() == 0
