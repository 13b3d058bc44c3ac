import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from demandlens.llm import spelling


def one_step(a, b):
    """Whether one letter put in, left out or replaced makes b of a."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_counts(docs, drop_every):
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if drop_every and h % drop_every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def slow_variants(n):
    near = {w: [o for o in n if one_step(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_pairs_are_all_pairs_one_letter_apart(spark, parts):
    random.seed(parts)
    words = {"".join(random.choice("abÀÿ") for _ in range(random.randint(6, 9))) for _ in range(250)}
    words |= {w[:k] + c + w[k:] for w in list(words)[:40] for k in (0, 3, len(w)) for c in "aÿ"} | {"zzzzzz", "zzzzzzz", "zzzzzzzz"}
    pairs = spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), parts=parts).collect()
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if one_step(a, b)}


def test_whole_tables_match_a_plain_search(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n = slow_counts(rows, 199)
    assert got(spelling.group_variants(docs, drop_every=199)) == slow_variants(n)


def test_forms_lead_to_roots(spark):
    n = {"letters": 4000, "letterz": 600, "lettez": 90, "letteez": 10, "lettxez": 10, "another": 7, "anothef": 5}
    counts = spark.createDataFrame(list(n.items()), "word string, n long")
    rows = {r.word: r for r in spelling.variants(counts).collect()}
    assert [rows[w].root for w in ("lettxez", "lettez", "letterz", "letters", "another")] == ["letters"] * 4 + ["another"]
    assert got(spelling.variants(counts)) == slow_variants(n)
    # of two near words of one count the first is the form
    n = {"aaaaab": 100, "aaaaac": 100, "aaaaad": 5}
    assert got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == slow_variants(n)
    assert spelling.variants(counts.limit(0)).count() == 0
    with pytest.raises(ValueError, match="times"):
        spelling.variants(counts, times=1)


def test_odd_rows(spark, odd_documents, no_documents):
    more = odd_documents.withColumn("word", F.lit("w")).withColumn("n", F.lit("n"))
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for every in (None, 2):
        assert got(spelling.group_variants(more, drop_every=every)) == slow_variants(slow_counts(rows, every))
    assert spelling.group_variants(no_documents, drop_every=199).count() == 0
    assert spelling.counted(spark.createDataFrame([(1, "LÉTTERS LéTTERS a×÷bcdef ") for _ in range(5)], "doc_id long, text string")).orderBy("word").collect() == [("a×÷bcdef", 5), ("lÉtters", 5), ("létters", 5)]
