import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count() and {r.doc_id for r in out.select("doc_id").collect()} <= ids, name
    packed = corpus_pipeline.run(spark, sf)
    assert packed.count() > 0 and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
