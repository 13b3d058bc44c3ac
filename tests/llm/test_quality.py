import numpy as np
from pyspark.sql import functions as F

from demandlens.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs, labels)
    assert found.count() == docs.count()
    joined = found.where("held_out").join(labels, "doc_id")
    right = joined.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("a")).collect()
    assert min(r.a for r in right) > 0.85


def test_held_out_labels_are_not_seen(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: round(r.score, 9) for r in quality.score(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (7, 1), (6, 0), (9, 0), (None, 1), (8, None)], "doc_id long, quality int")
    rows = quality.score(odd_documents, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.score for r in quality.score(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert quality.score(no_documents, labels).count() == 0


def test_descent_reaches_the_optimum():
    """No weights have a smaller primal loss: the dual value of what is found equals it, and plain subgradient steps end no lower."""
    rng = np.random.default_rng(4)
    size, n = 30, 80
    rows = [np.sort(rng.choice(size, rng.integers(2, 9), replace=False)) for _ in range(n)]
    y, scale, cost = np.where(rng.random(n) > 0.4, 1.0, -1.0), rng.normal(size=size), np.full(n, 0.3)
    x = np.zeros((n, size))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / np.linalg.norm(scale[r])

    def loss(w):
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    w = quality.descend(rows, y, scale, cost, epochs=400)
    plain, best = np.zeros(size), np.inf
    for k in range(20000):
        inside = y * (x @ plain) < 1
        plain = plain - (plain - (cost * y * inside) @ x) / (k + 10)
        best = min(best, loss(plain))
    assert loss(w) <= best + 1e-6 and best - loss(w) < 1e-2
    assert np.allclose(quality.margins(rows, w, scale), x @ w)


def test_scores_are_those_of_the_model_applied_by_hand(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    for r in docs.collect():
        seen = set()
        codes = [ord(c) for c in r.text or ""]
        words = quality.shapes(r.text or "").tolist()
        for sizes, units, salt in ((quality.CHARS, codes, 0), (quality.SHAPES, words, 100)):
            for n in sizes:
                for k in range(len(units) - n + 1):
                    h = salt + n
                    for j in range(n):
                        h = ((h ^ units[k + j]) * int(quality.ODD[j])) & 0xFFFFFFFF
                        h ^= h >> 15
                    seen.add(h >> (32 - m["bits"]))
        at = np.array(sorted(seen | {0}))
        s = m["ratio"][at].astype(float)
        margin = float((m["weights"][at].astype(float) * s).sum() / max(1e-12, np.sqrt((s**2).sum())))
        want = 1 / (1 + np.exp(-(m["slope"] * margin + m["offset"])))
        assert abs(got[r.doc_id].score - want) < 1e-5 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_sample_is_bounded(spark):
    docs = spark.range(4000).select((F.col("id") % 40).alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("quality"))
    found = quality.score(docs, labels).groupBy("doc_id").count().collect()
    assert len(found) == 40 and all(r["count"] == 100 for r in found)
    assert quality.fit(docs, labels, sample=10) and quality.fit(docs, labels, sample_grams=1) is None
