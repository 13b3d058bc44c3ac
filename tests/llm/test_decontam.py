import random
import re

from demandlens.llm import decontam


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def slow(text, items, size=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def check(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(d, b, **more).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, list(r["items"])) == slow(docs[r.doc_id], items), docs[r.doc_id]
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"])


def test_random_texts(spark):
    random.seed(6)
    vocabulary = ["a", "B", "c", "Éa", "éa", "x1", "YY"]
    items = [(i, " ".join(random.choice(vocabulary) for _ in range(random.choice([0, 1, 2, 9, 10, 11, 30])))) for i in range(30)] + [(100, None), (101, "?!"), (7, "a b c")]
    docs = [None, "", "..."] + [", ".join(random.choice(vocabulary) for _ in range(random.choice([1, 5, 40, 300]))) for _ in range(40)] + [f"zz {items[k][1]} zz. {items[k][1]}" for k in range(20)]
    check(spark, docs, items)
    check(spark, docs, items, pass_windows=20)


def test_odd_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog the quick brown"), (None, "Ein Text ohne Nummer mail an a b c de"), (3, None)], "item_id long, text string")
    rows = decontam.contamination(odd_documents, bench).collect()
    assert len(rows) == 11
    hit = [r.doc_id for r in rows if r.contaminated]
    assert sorted(i for i in hit if i) == [1, 2, 2] and None in hit
    assert [list(r["items"]) for r in rows if r.doc_id is None] == [[]]
    assert decontam.contamination(no_documents, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(odd_documents, bench.limit(0)).collect())
    kept = decontam.drop_contaminated(odd_documents, bench)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9]
    plan = decontam.contamination(odd_documents, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)
