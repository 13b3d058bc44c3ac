from pyspark.sql import functions as F

import corpus_pipeline
from demandlens.llm import queries
from tests.llm.test_decontam import slow as hits
from tests.llm.test_langid import langid
from tests.llm.test_simhash import slow_groups, slow_print


def test_stages_decide_as_the_operators_do(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect() if langid.has_letter(r.text)}
    groups = slow_groups({i: slow_print(t) for i, t in kept.items()})
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    kept = {i: t for i, t in kept.items() if not hits(t, items)[1]}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in rows} == set(kept)
    assert all(r.length <= 4096 for r in rows)


def test_stages_keep_the_columns(spark, odd_documents, no_documents, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    for df in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, data)
            assert df.dtypes == odd_documents.dtypes
            assert all((r.found, r.spans, r.fp, r.start) == ("x", "y", "z", "s") for r in df.collect())
    assert "op4_packing" in queries.QUERIES


def test_rows_without_a_usable_id_are_not_lost(spark, data):
    """One row stays of each group of near copies, whatever its id; rows with one id and different texts are different documents."""
    texts = [f"{a} {b} {c} writes about {d} and {a} in the year of {b}" for a, b, c, d in [("one", "two", "three", "four"), ("harbour", "winter", "lantern", "salt"), ("clock", "meadow", "violin", "stone"), ("paper", "tiger", "bridge", "cloud")]]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (1, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.language(spark, docs, data), data)
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == sorted([(texts[0], 1), (texts[1], 5), (texts[2], None), (texts[3], None)])


def test_many_null_ids(spark, data):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id").cast("string"), F.sha2(F.col("id").cast("string"), 256)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert corpus_pipeline.language(spark, docs, data).count() == 100_000
    groups = corpus_pipeline.near_duplicates(spark, docs.limit(3000), data)
    assert groups.count() > 2900
