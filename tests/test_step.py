"""The ingestion step: each URL once wherever a run dies, buckets, swapped models, lists read anew."""

import json

import pytest
from pyspark.sql import functions as F

from urlgrove.functions.urls import url_parts
from urlgrove.streaming import step as S

SCHEMA = "url string, source string, ord int"


def offer(spark, path, rows):
    spark.createDataFrame([(u, s, n) for n, (u, s) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def scorer(version="1", least=0.0):
    def score(df):
        host = F.regexp_extract("url", "//([^/]*)", 1)
        risk = F.when(host.startswith("bad"), 0.9).when(host != "broken.com", 0.1)
        return df.withColumns({"score": risk + least, "label": F.when(risk > 0.5, "phishing").otherwise("safe"), "closest_domain": F.lit("brand.co.th"), "reason": F.lit("why")})

    return lambda: (version, score)


def go(spark, tmp, use=None, watch=("brand",), **more):
    watched = lambda: spark.createDataFrame([(b, True) for b in watch], "brand string, enabled boolean")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")
    S.ingest_feeds(spark, stream, f"{tmp}/out", f"{tmp}/cp", use or scorer(), watched, lambda: "2024-01-05 00:00:00", **more).awaitTermination()


def state(spark, tmp):
    rows = lambda t, *c: sorted(map(tuple, S.committed(spark, f"{tmp}/out", t).select(*c).collect()))
    return {
        "verdicts": rows("verdicts", "url", "source", "label", "model_version"), "alerts": rows("alerts", "url", "brand"), "ledger": rows("ledger", "url_hash", "source"), "polls": rows("polls", "source", "ingested", "offered"),
        "campaigns": sorted((r.fingerprint, r.url_count) for r in S.running_campaigns(spark, f"{tmp}/out").collect()),
    }


FEEDS = [
    [("http://bad1.top/a/1", "x"), ("http://good.com/", "x"), ("http://bad1.top/a/1", "x"), ("http://broken.com/", "y"), ("http://bad1.top/a/1", "y")],
    [("http://bad1.top/a/1", "x"), ("http://bad2.top/a/22", "x"), ("http://broken.com/", "y")],
]


@pytest.mark.parametrize("table", ["verdicts", "campaigns", "alerts", "ledger", "commits"])
def test_a_crash_after_any_write(spark, tmp_path, table):
    whole, hurt, fails = f"{tmp_path}/a", f"{tmp_path}/b", [1]

    def crash(batch, name):
        if batch == 1 and name == table and fails.pop() if fails else False:
            raise OSError("power cut")

    for feed in FEEDS:
        offer(spark, f"{whole}/in", feed)
        offer(spark, f"{hurt}/in", feed)
        go(spark, whole)
        try:
            go(spark, hurt, wrote=crash)
        except Exception as e:
            assert "power cut" in str(e)
            seen = state(spark, hurt)["verdicts"]
            assert len(seen) == (4 if table == "commits" else 3)  # nothing of a batch shows before its commit
            go(spark, hurt, wrote=crash)
    assert not fails and state(spark, hurt) == state(spark, whole)
    got = state(spark, whole)
    assert [v[:2] for v in got["verdicts"]] == [("http://bad1.top/a/1", "x"), ("http://bad1.top/a/1", "y"), ("http://bad2.top/a/22", "x"), ("http://good.com/", "x")]
    assert got["campaigns"] == [("brand.co.th|top|a/#", 3)] and len(got["alerts"]) == 3
    assert got["polls"] == [("x", 1, 2), ("x", 2, 3), ("y", 0, 1), ("y", 1, 2)]


def test_limits_come_before_the_ledger(spark, tmp_path):
    for feed in FEEDS:
        offer(spark, f"{tmp_path}/in", feed)
        go(spark, tmp_path, per_source=1)
    assert [v[0] for v in state(spark, tmp_path)["verdicts"]] == ["http://bad1.top/a/1"]  # the head of a static list brings nothing new


def test_models_swap_between_batches(spark, tmp_path):
    for k in range(4):
        offer(spark, f"{tmp_path}/in", [(f"http://bad{k}.top/a/1", "x"), ("http://bad0.top/a/1", "x")])
    asked = []

    def pointer():
        asked.append(1)
        return scorer("1" if len(asked) <= 2 else "2")()

    go(spark, tmp_path, use=pointer)
    got = state(spark, tmp_path)
    versions = {}
    for url, _, _, version in got["verdicts"]:
        versions.setdefault(url, []).append(version)
    assert len(asked) == 4 and all(len(v) == 1 for v in versions.values())
    assert sorted(v[0] for v in versions.values()) == ["1", "1", "2", "2"] and got["campaigns"] == [("brand.co.th|top|a/#", 4)]


def test_lists_are_read_anew_and_payloads_hold(spark, tmp_path):
    for feed, watch in zip(FEEDS, (["other"], ["brand"]), strict=True):
        offer(spark, f"{tmp_path}/in", feed)
        go(spark, tmp_path, watch=watch)
    (alert,) = S.committed(spark, f"{tmp_path}/out", "alerts").collect()
    assert json.loads(alert.payload)["url"] == alert.url == "http://bad2.top/a/22"


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path):
    offer(spark, f"{tmp_path}/in", [(f"http://h{k}.com/", "x") for k in range(400)])
    go(spark, tmp_path, per_source=None)
    asked = spark.createDataFrame([("http://h7.com/",), ("http://new.com/",)], "url string").select(F.sha2("url", 256).alias("url_hash"))
    seen = S.seen_before(spark, f"{tmp_path}/out", asked)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    files = {f.rsplit("bucket=", 1)[1][:2] for f in seen.inputFiles() if "bucket=" in f}
    read = {r.bucket for r in S.committed(spark, f"{tmp_path}/out", "ledger").where(F.col("bucket").isin([r.url_hash[:2] for r in asked.collect()])).select("bucket").distinct().collect()}
    assert len(read) <= 2 and len(files) > 100  # the table has many buckets, two at most are scanned
    assert S.compact(spark, f"{tmp_path}/out") == 0  # the last batch may be run again
    offer(spark, f"{tmp_path}/in", [("http://one.com/", "x")])
    go(spark, tmp_path)
    before = state(spark, tmp_path)
    assert S.compact(spark, f"{tmp_path}/out") == 1 and state(spark, tmp_path) == before
    offer(spark, f"{tmp_path}/in", [("http://h7.com/", "x"), ("http://new.com/", "x")])
    go(spark, tmp_path)
    assert len(state(spark, tmp_path)["verdicts"]) == 402


def test_a_bad_model_is_not_taken(spark, tmp_path):
    from urlgrove.plans import training

    df = training.weighted(url_parts(spark.range(60).select((F.col("id") % 2).cast("double").alias("y"), "id", F.lit("http://a").alias("url"))).withColumn("x", F.col("y") + F.rand(1) / 2), "y")
    models = [p.fit(df) for p in training.ensemble(["x"], "y", 2, 1)]
    use = S.promoted_scorer(spark, str(tmp_path), ["x"], lambda models, df: training.voted(models, df, "id"))
    training.promote(models, str(tmp_path), "1", ["x"], "passed")
    assert use()[0] == "1" and use()[1](df.select("id", "x", "weight")).count() == 60
    training.promote(models, str(tmp_path), "2", ["x", "other"], "passed")
    assert use()[0] == "1"  # its contract names other features
    training.promote(models, str(tmp_path), "3", ["x"], "passed")
    assert use()[0] == "3"
