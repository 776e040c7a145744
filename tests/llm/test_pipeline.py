import corpus_pipeline
from pyspark.sql import functions as F


def brute_exact(rows):
    last = {}
    for r in rows:
        k = (r.text or "").encode().lower()
        if k not in last or r.doc_id > last[k].doc_id:
            last[k] = r
    return {r.doc_id for r in last.values()}


def test_stages_over_small_documents(spark):
    from tests.llm.test_near_dedup import brute_classes

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, d).cache()
    assert known.columns == docs.columns
    assert known.count() >= 0.98 * docs.filter(F.col("text").rlike("[A-Za-z]")).count()
    unique = stages["exact_dedup"](spark, known, d).cache()
    assert unique.columns == docs.columns
    assert {r.doc_id for r in unique.collect()} == brute_exact(known.collect())
    near = stages["near_dedup"](spark, unique, d).cache()
    classes = brute_classes([(r.doc_id, r.text) for r in unique.collect()])
    assert {r.doc_id for r in near.collect()} == set(classes.values())
    mix = stages["mix_sources"](spark, near, d).cache()
    assert mix.columns == docs.columns
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = stages["bpe_encode"](spark, mix, d)
    assert out.count() == mix.count()
    assert out.filter(~F.col("round_trip")).count() == 0


def test_run_equals_its_stages_and_handles_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat sat on the mat " * 3, None, None, 5), (2, None, "en", "s", 0), (3, "12 34", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in got} == {1}
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
