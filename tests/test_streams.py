from pyspark.sql import functions as F

from urlgrove.streaming.ingest import campaign_counts, ingest


def test_ingest_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("http://a", "s", 1), ("http://b", "s", 2)], "url string, source string, ord int").write.mode("append").parquet(src)
    for more in ([], [("http://a", "s", 3), ("http://c", "s", 4)]):
        if more:
            spark.createDataFrame(more, "url string, source string, ord int").write.mode("append").parquet(src)
        stream = spark.readStream.schema("url string, source string, ord int").parquet(src)
        score = lambda df: df.withColumn("score", F.when(F.col("url") != "http://b", 0.9))
        ingest(spark, stream, score, str(tmp_path / "verdicts"), str(tmp_path / "ledger"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "verdicts")).collect()) == ["http://a", "http://c"]


def test_running_campaigns(spark, tmp_path):
    df = spark.createDataFrame([("f", 5), ("f", 1), ("g", 2)], "fingerprint string, t long").select("fingerprint", F.timestamp_seconds("t").alias("checked_at"))
    df.write.parquet(str(tmp_path / "v"))
    stream = campaign_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "v")))
    stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, campaign_counts(df).collect()))
