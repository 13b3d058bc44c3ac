import random
import re

import xxhash

from demandlens.llm import simhash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(prints, near=4):
    """Least id of each id's group, by comparing all pairs."""
    root = dict.fromkeys(prints)
    for i in prints:
        root[i] = i

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= near:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in prints}


def test_fingerprint_matches_the_definition():
    random.seed(1)
    for n in (0, 1, 3, 4, 5, 70, 400):
        text = " ".join(random.choice(["The", "É", "ab", "Ünder", "x\ty", "z\n"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_print(text)
    assert simhash.fingerprint(None) == 0


def test_groups_match_all_pairs(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    prints = {r.doc_id: slow_print(r.text) for r in docs.collect()}
    want = slow_groups(prints)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.fingerprint == f"{prints[i]:016x}" for i, r in got.items())


def test_chunks_of_a_large_block_find_the_same_links(spark):
    random.seed(2)
    base = random.getrandbits(64)
    prints = {base}
    while len(prints) < 300:  # a cloud of prints that share most blocks
        x = random.choice(sorted(prints))
        for _ in range(random.randint(1, 6)):
            x ^= 1 << random.randrange(12)
        prints.add(x)
    ids = dict(enumerate(sorted(prints)))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    from demandlens.operators.components import components

    edges = simhash.links(spark.createDataFrame(signed, "fp long"), chunk=40)
    roots = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(edges).collect()}
    want = slow_groups(ids)
    groups = {}
    for i, x in ids.items():
        groups.setdefault(want[i], set()).add(x)
    mine = {}
    for x in prints:
        mine.setdefault(roots.get(x, x), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
    assert edges.count() < 35 * 300 * 9  # a forest for each pair of chunks, not all pairs


def test_odd_rows(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.component_id)
    assert by[1] == [1] and by[2] == [1, 1] and by[3] == by[4] == by[5] == [3]
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 6, 7, 8, 9] and ids.count(None) == 1


def test_groups_without_an_id_or_with_one_id_keep_a_row_each(spark):
    random.seed(3)
    texts = [" ".join(random.choice("abcdefgh") * random.randint(1, 9) for _ in range(60)) for _ in range(6)]
    prints = dict(enumerate(map(slow_print, texts)))
    assert len(set(slow_groups(prints).values())) == 6
    # three texts without an id, one of them twice and one also under an id; two texts under one id; one text under two ids
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (8, texts[2].upper()), (5, texts[3]), (5, texts[4]), (5, texts[4]), (6, texts[5]), (7, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert len(got) == 6
    assert set(got) == {(None, texts[0]), (None, texts[1]), (8, texts[2].upper()), (5, texts[3]), (5, texts[4]), (6, texts[5])}
