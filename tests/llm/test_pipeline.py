"""The pipeline's stages do what their operators say, one after the other."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    assert docs.select("text").distinct().count() == docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_dedup_stages_drop_surplus_rows_alone(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, "a"), (1, "a"), (None, "alone"), (2, "b"), (2, "c"), (3, "c"), (4, "d"), (4, "d"), (None, "e"), (None, "e"), (5, None), (6, "")] + [(7, "hot")] * 200 + [(None, "warm")] * 200 + [(8, "warm")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_exact(spark, docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a"), (None, "alone"), (2, "b"), (3, "c"), (4, "d"), (None, "e"), (6, ""), (7, "hot"), (8, "warm")], key=str)
    rows = [(1, words(1)), (2, words(1) + " more"), (2, words(2)), (3, words(2) + " more"), (4, words(3)), (4, words(3) + " more"), (None, words(1))]
    got = corpus_pipeline.drop_near(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in sorted(got, key=str)].count(None) == 1 and len(got) == 4
    assert {(1, words(1)), (2, words(2)), (None, words(1))} < set(map(tuple, got)) and sum(r["doc_id"] == 4 for r in got) == 1
