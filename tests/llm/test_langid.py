import random

import numpy as np
from pyspark.sql import functions as F

from demandlens.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.count() == docs.count()
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()["a"]
    assert right > 0.97


def test_learning_does_not_see_held_out_rows(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert {r.lang_pred for r in langid.identify(other).collect()} <= {"en", "de", "fr", "es", "und"}


def test_odd_rows(odd_documents, no_documents):
    rows = {(r.doc_id, r.lang_pred) for r in langid.identify(odd_documents).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "und"), (7, "de")} <= rows
    assert all(0 <= r.score <= 1 for r in langid.identify(odd_documents).collect())
    assert langid.identify(no_documents).count() == 0
    unlabelled = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    kept = langid.keep_known(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == 7
    assert kept.where("lang is null").count() == 0
    assert langid.keep_known(unlabelled).count() == 7


def test_letters_are_those_of_unicode(spark):
    texts = ["²  ½", "①②", "12_34", "ª", "漢", "ʰ", "a", "٣", "💡", ""]
    docs = spark.createDataFrame([(100 + i, t, None) for i, t in enumerate(texts)] + [(i, f"the text of {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert [found[100 + i] == "und" for i in range(len(texts))] == [True, True, True, False, False, False, False, True, True, True]


def test_sample_is_bounded(spark):
    # null ids, one id for many rows, and copies of one row
    docs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "one text for all").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    model = langid.fit(docs, train=50, landmarks=50, held=(3, 99))
    assert model["marks"].shape[0] == 50


def test_regression_is_that_of_the_full_kernel():
    """With all rows as landmarks the values are those of weighted kernel ridge regression on the whole kernel matrix."""
    rng = random.Random(2)
    features = {lang: [langid.spectrum(" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(6)), bits=12) for _ in range(n)] for lang, letters, n in (("a", "abcde", 9), ("b", "cdefg", 14), ("c", "efghi", 5))}
    model = langid.solve(features, landmarks=99, bits=12, cut=1e-12)
    rows = [f for lang in "abc" for f in features[lang]]
    sets = [set(f.tolist()) for f in rows]
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in sets] for x in sets])
    weight = np.array([1 / len(features[lang]) for lang in "abc" for _ in features[lang]])
    y = np.array([[1.0 if lang == other else -1.0 for other in "abc"] for lang in "abc" for _ in features[lang]])
    alpha = np.linalg.solve(kernel + langid.RIDGE * np.diag(1 / weight), y)
    new = [langid.spectrum(t, bits=12) for t in ("abcab bcd", "ghi fgh", "xyz", "cde")]
    cross = np.array([[len(set(f.tolist()) & s) / np.sqrt(len(f) * len(s)) for s in sets] for f in new])
    marks = (model["marks"] / model["norms"][:, None]).T.astype(np.float32)
    got = langid.values(new, marks, model["weights"], 12)
    assert np.allclose(got, cross @ alpha, atol=1e-3)


def test_languages_are_bounded_and_names_do_not_clash(spark):
    rows = [(i, "the text of the whole and the end of it", "en") for i in range(40)] + [(100 + i, "der text von dem ganzen und das ende", "de") for i in range(30)] + [(200 + i, f"free text {i}", f"value {i}") for i in range(25)]
    docs = spark.createDataFrame([(*r, "a", 1.0) for r in rows], "doc_id long, text string, lang string, _demandlens_lang string, text_lang double")
    assert langid.fit(docs, languages=2)["langs"] == ["de", "en"]
    assert langid.fit(docs, languages=1, held=(3, 99))["langs"] == ["en"]
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == 95
    assert {(r._demandlens_lang, r.text_lang) for r in kept.collect()} == {("a", 1.0)}
