"""Written forms, sources of lists, and streams of alerts, replies and suppressed repeats."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from urlgrove.plans import training
from urlgrove.sinks import tables as S
from urlgrove.sources import feeds
from urlgrove.streaming import ingest as I


@pytest.fixture
def feed(spark):
    rows = [("http://a/,x", 0.91234, "a.com", 1, 5), ('http://b/"q"', 0.7, None, None, 9), ("http://c/'\\", 0.8, "c.com", 0, 9)]
    return spark.createDataFrame(rows, "url string, score double, closest_domain string, edit_distance int, s long").withColumn("checked_at", F.timestamp_seconds("s"))


def test_feed_document(spark, feed):
    body = json.loads(S.feed_document(feed, "now", 24).first().body)
    assert (body["schema"], body["count"], body["window_hours"]) == ("phish.feed.v1", 3, 24)
    assert [i["url"] for i in body["indicators"]] == ['http://b/"q"', "http://c/'\\", "http://a/,x"]
    assert body["indicators"][2] == {"url": "http://a/,x", "score": 0.91234, "closest_domain": "a.com", "edit_distance": 1, "checked_at": "1970-01-01T00:00:05Z"}
    empty = json.loads(S.feed_document(feed.limit(0), "now", 24).first().body)
    assert empty["count"] == 0 and empty["indicators"] == []


def test_feed_csv(spark, feed):
    lines = [r.line for r in S.feed_csv(feed).orderBy("ord").collect()]
    assert lines == ["﻿url,score,closest_domain,edit_distance,checked_at", '"http://b/""q""",0.7000,,,1970-01-01T00:00:09Z', "http://c/'\\,0.8000,c.com,0,1970-01-01T00:00:09Z", '"http://a/,x",0.9123,a.com,1,1970-01-01T00:00:05Z']


def test_stix_bundle(spark, feed):
    from urlgrove.operators.verdicts import stix_objects

    objects = stix_objects(feed).withColumn("brand", F.lit(None).cast("string"))
    body = json.loads(S.stix_bundle(objects, "now", 24, "urlgrove").first().body)
    assert body["type"] == "bundle" and body["id"].startswith("bundle--") and len(body["objects"]) == 3
    assert {o["pattern"] for o in body["objects"]} >= {"[url:value = 'http://c/\\'\\\\']"} and body["objects"][0]["name"] == "Phishing URL targeting unknown"


def test_csv_parts_and_lists(spark, feed, tmp_path):
    S.csv(feed, str(tmp_path / "c"), ["url", "label", "score"], [F.desc("score")])
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == ["url", "label", "score"] and sorted(r.url for r in back.collect()) == sorted(r.url for r in feed.collect())
    S.parts(feed.select("url", F.when(F.col("score") > 0.8, "train").otherwise("holdout").alias("part")), str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").glob("part=*")) == ["part=holdout", "part=train"]
    trusted = spark.createDataFrame([("b.com", "B", "bank"), ("a.go.th", "A", "state")], "domain string, agency_name string, category string")
    S.trusted_list(trusted, str(tmp_path / "t"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "t" / "count").glob("*.json"))) == {"count": 2}
    assert sorted(r.domain for r in feeds.trusted_json(spark, str(tmp_path / "t" / "entries"), lines=True).collect()) == ["a.go.th", "b.com"]
    (tmp_path / "one.json").write_text(json.dumps({"count": 1, "entries": [{"domain": "x.th", "agency_name": "X", "category": None}]}, indent=1))
    assert [r.domain for r in feeds.trusted_json(spark, str(tmp_path / "one.json")).collect()] == ["x.th"]


def test_verdicts_have_bounded_texts(spark, tmp_path):
    v = spark.createDataFrame([("u" * 3000, "r" * 600, 5), (None, None, 90_000)], "url string, reason string, s long").withColumn("checked_at", F.timestamp_seconds("s"))
    for _ in range(2):
        S.append_verdicts(v, str(tmp_path / "v"))
    back = spark.read.parquet(str(tmp_path / "v"))
    assert back.count() == 4 and back.agg(F.max(F.length("url")), F.max(F.length("reason"))).first()[:] == (2048, 512)
    assert sorted(p.name for p in (tmp_path / "v").glob("day=*")) == ["day=1970-01-01", "day=1970-01-02"]


def test_delivery_log(spark):
    sent = spark.createDataFrame([("b", "u", "w", 200, None), ("b", "u", "w" * 600, None, "timeout"), ("b", "u", "w", 500, "HTTP 500"), ("b", "u", "w", 200, "")], "brand string, url string, webhook_url string, status_code int, error string")
    assert [(len(r.webhook_url), r.error, r.attempts) for r in S.delivery_log(sent).collect()] == [(1, None, 1), (512, "timeout", 2), (1, "HTTP 500", 2), (1, None, 1)]


def test_lists_and_domains(spark, tmp_path):
    (tmp_path / "l.txt").write_text("  a.com \n\n# no\nhttp://b\n")
    assert [r.url for r in feeds.lines(spark, str(tmp_path / "l.txt")).collect()] == ["a.com", "http://b"]
    (tmp_path / "s.csv").write_text('url,label,domain_age_days\nhttps://a,1,\n"http://b/,""x""",0,3\nftp://c,1,2\n')
    got = feeds.seed_csv(spark, str(tmp_path / "s.csv"), "url string, label int, domain_age_days double").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("https://a", 1, None), ('http://b/,"x"', 0, 3.0)], key=str)
    pages = spark.createDataFrame([(1, "see www.obec.go.th and Mail.X.ac.th"), (0, "obec.go.th!"), (2, None)], "page_id long, html string")
    assert sorted(map(tuple, feeds.country_domains(pages).collect())) == [("obec.go.th", 0), ("x.ac.th", 1)]


def test_a_batch_run_again_writes_once(spark, tmp_path):
    schema = "url string, source string, ord int"
    path = {n: str(tmp_path / n) for n in ("in", "v", "l", "cp")}
    spark.createDataFrame([], "url_hash string, source string, run string, batch long").write.parquet(path["l"])
    score = lambda df: df.withColumn("score", F.lit(0.9))
    go = lambda: I.ingest(spark, spark.readStream.schema(schema).parquet(path["in"]), score, path["v"], path["l"], path["cp"]).awaitTermination()
    for n in (1, 2):
        spark.createDataFrame([("http://a", "s", n), (f"http://n{n}", "s", n)], schema).write.mode("append").parquet(path["in"])
        go()
    # the last batch's commit is lost after its rows were written: Spark runs it again
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    go()
    assert sorted(r.url for r in spark.read.option("recursiveFileLookup", "true").parquet(path["v"]).collect()) == ["http://a", "http://n1", "http://n2"]
    # a new checkpoint reads all files again; the ledger still knows them, and nothing is overwritten
    shutil.rmtree(path["cp"])
    go()
    assert spark.read.option("recursiveFileLookup", "true").parquet(path["v"]).count() == 3


def test_one_source_fails_alone(spark, tmp_path):
    spark.createDataFrame([("http://a",)], "url string").write.parquet(str(tmp_path / "a"))
    read = lambda p: lambda: spark.readStream.schema("url string").parquet(str(tmp_path / p))
    start = lambda n, s: s.writeStream.format("parquet").option("path", str(tmp_path / f"out-{n}")).option("checkpointLocation", str(tmp_path / f"cp-{n}")).trigger(availableNow=True).start()

    def broken():
        raise OSError("no such feed")

    bad = lambda: read("a")().select(F.raise_error(F.lit("bad row")).cast("string").alias("url"))
    got = {r.source: r.error for r in I.poll_sources(spark, {"x": broken, "y": read("a"), "z": bad}, start, "2024-01-01 00:00:00").collect()}
    assert got["x"] == "no such feed" and got["y"] is None and got["z"]
    assert spark.read.parquet(str(tmp_path / "out-y")).count() == 1


def test_alert_outbox_reads_the_list_anew(spark, tmp_path):
    v = "url string, label string, score double, closest_domain string, reason string"
    watch = {"brand": "a"}
    of = I.watch_alerts_of(lambda: spark.createDataFrame([(watch["brand"], True)], "brand string, enabled boolean"), "now")
    for brand in ("a", "b"):
        watch["brand"] = brand
        spark.createDataFrame([(f"http://{x}", "phishing", 0.91239, f"{x}.com", "r") for x in "ab"] + [("http://s", "safe", 0.1, "a.com", "r")], v).write.mode("append").parquet(str(tmp_path / "v"))
        I.outbox(spark, spark.readStream.schema(v).parquet(str(tmp_path / "v")), of, str(tmp_path / "o"), str(tmp_path / "cp")).awaitTermination()
    got = [json.loads(r.payload) for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "o")).collect()]
    assert sorted(p["brand"] for p in got) == ["a", "b"] and got[0]["score"] == 0.9124 and got[0]["schema"] == "phish.alert.v1"


def test_chat_replies(spark):
    events = spark.createDataFrame([([("message", ("text", "see http://x now"), "t1"), ("message", ("image", None), "t2"), ("follow", None, "t3"), ("message", ("text", "no link"), "t4")],)], "events array<struct<type:string, message:struct<type:string, text:string>, replyToken:string>>")
    score = lambda df: df.withColumns({"label": F.lit("phishing"), "reason": F.lit("why")})
    assert [tuple(r) for r in I.chat_replies_of(score)(events).collect()] == [("t1", "Dangerous: http://x\nwhy")]


def test_suppressed_repeats_on_a_stream(spark, tmp_path):
    schema = "k string, ts timestamp"
    for n, rows in enumerate(([("u", 1), ("u", 5), ("w", 7)], [("u", 70), ("u", 90), ("u", 140), ("w", 66), ("w", 67)])):
        spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = I.ttl_suppressed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "ts")
        out.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.k, r.ts.timestamp()) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == [("u", 1), ("u", 70), ("u", 140), ("w", 7), ("w", 67)]


def test_models_are_promoted_by_the_gate(spark, tmp_path):
    df = training.weighted(spark.range(60).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2 + F.rand(1) / 2).alias("x"), "id"), "y")
    models = [p.fit(df) for p in training.ensemble(["x"], "y", 2, 1)]
    assert training.promote(models, str(tmp_path), "1", ["x"], "passed") and not training.promote(models, str(tmp_path), "2", ["x"], "below")
    assert len(training.promoted(spark, str(tmp_path), ["x"])) == 2
    with pytest.raises(ValueError):
        training.promoted(spark, str(tmp_path), ["x", "z"])


def test_history_and_batch_exports(spark):
    rows = spark.createDataFrame([(1, 5, 'http://a/,"x"', "phishing", 0.7, None, None, "two\nlines"), (2, 6, "http://b", "safe", 1.0, "b.com", 2, None)], "ord long, s long, url string, label string, score double, closest_domain string, edit_distance int, reason string").withColumn("checked_at", F.timestamp_seconds("s"))
    lines = lambda df: [r.line for r in df.orderBy("ord").collect()]
    assert lines(S.history_csv(rows)) == ["checked_at,url,label,score,closest_domain,edit_distance,reason", '1970-01-01T00:00:05Z,"http://a/,""x""",phishing,0.7,,,"two\nlines"', "1970-01-01T00:00:06Z,http://b,safe,1,b.com,2,"]
    assert lines(S.history_csv(rows, S.BULK_FIELDS))[2] == "http://b,safe,1,b.com,2,"
