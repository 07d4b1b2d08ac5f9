"""Replays, reports, checks and pages against plain Python."""

import collections
import random
import statistics

from pyspark.sql import functions as F

from urlgrove.functions.urls import url_parts
from urlgrove.operators import corpus, evaluation, replay
from urlgrove.operators import verdicts as V
from urlgrove.sinks import tables as sinks
from urlgrove.streaming import step

AS_OF = "2024-01-31 00:00:00"


def scored(spark, n=120):
    rows = [(f"http://bad{k}.top/a/{k}" if k % 3 == 0 else f"http://good{k}.com/", 0.9 if k % 3 == 0 else 0.1, "phishing" if k % 3 == 0 else "safe") for k in range(n)]
    df = spark.createDataFrame(rows, "url string, score double, label string").withColumns({"closest_domain": F.lit("b.com"), "reason": F.lit("r")})
    return url_parts(df).select(*df.columns, "host", "path")


def test_two_replays_are_one(spark, tmp_path):
    read = lambda: {t: sorted(map(str, step.committed(spark, str(tmp_path), t).collect())) for t in ("verdicts", "campaigns")}
    replay.replay_into(scored(spark), str(tmp_path), AS_OF, "1", total=300)
    first = read()
    replay.replay_into(scored(spark).repartition(7), str(tmp_path), AS_OF, "1", total=300)
    assert read() == first and len(first["verdicts"]) == 300
    v = step.committed(spark, str(tmp_path), "verdicts")
    assert sum(r.url_count for r in step.running_campaigns(spark, str(tmp_path)).collect()) == v.where("label = 'phishing'").count()
    replay.replay_into(scored(spark), str(tmp_path), AS_OF, "1", total=10, seed=7)  # another seed is another batch
    assert step.committed(spark, str(tmp_path), "verdicts").count() == 310


def test_replays_keep_their_weights(spark):
    urls = scored(spark, 900).select("url", (F.col("label") == "phishing").alias("risky"))
    rows = replay.replayed(urls, AS_OF, 14, 10**6).collect()
    n = collections.Counter(r.url for r in rows)
    assert {v for u, v in n.items() if "bad" in u} == {2, 3, 4, 5, 6} and {v for u, v in n.items() if "good" in u} == set(range(5, 12))
    assert len({r.check_id for r in rows}) == len(rows)
    assert all(r.checked_at.isoformat() > "2024-01-15" and r.checked_at.isoformat() <= "2024-01-31" for r in rows)
    back = collections.Counter((r.checked_at.hour + 23) % 24 for r in rows)
    share = sum(back[23 - h] for h in range(8, 16)) / len(rows)  # hours are counted back from midnight
    assert abs(share - sum(replay.HOURS[8:16]) / sum(replay.HOURS)) < 0.05
    assert replay.replayed(urls.limit(0), AS_OF).count() == 0


def test_class_report(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 1), r.random()) for _ in range(500)] + [(None, 0.5), (1, None)]
    got = {x.name: x for x in evaluation.class_report(spark.createDataFrame(rows, "y int, s double"), "y", "s", 0.6).collect()}
    known = [(y, int(s >= 0.6)) for y, s in rows if y is not None and s is not None]
    f = {}
    for c, name in ((0, "legitimate"), (1, "phishing")):
        hit, true, said = (sum(k) for k in zip(*((y == p == c, y == c, p == c) for y, p in known), strict=True))
        f[c] = (hit / said, hit / true, 2 * hit / (said + true), true)
        assert [got[name].precision, got[name].recall, got[name].f1, got[name].support] == [*(round(x, 4) for x in f[c][:3]), true]
    assert got["macro avg"].f1 == round((f[0][2] + f[1][2]) / 2, 4)
    assert got["weighted avg"].precision == round((f[0][0] * f[0][3] + f[1][0] * f[1][3]) / len(known), 4)
    assert got["accuracy"].f1 == round(sum(y == p for y, p in known) / len(known), 4)
    none = evaluation.class_report(spark.createDataFrame([], "y int, s double"), "y", "s").collect()
    assert [x.support for x in none] == [0] * 5 and all(x.f1 == 0 for x in none)


def test_medians_and_alignment(spark):
    r = random.Random(4)
    rows = [(g, round(r.random() ** 2, 4)) for g, n in (("a", 1), ("b", 2), ("c", 301), ("d", 40)) for _ in range(n)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, score double")
    by = collections.defaultdict(list)
    for g, s in rows:
        by[g] += [] if s is None else [s]
    assert {x.g: round(x.median, 6) for x in evaluation.medians(df, "g", "score").collect()} == {g: round(statistics.median(v), 6) for g, v in by.items()}
    summary = {x.g: x for x in evaluation.cohort_summary(df, "g").collect()}
    assert summary["c"].missed == sum(s < 0.3 for s in by["c"]) and summary["c"].n == 301
    got = evaluation.alignment(evaluation.cohort_summary(df, "g"), "g", "d", "c").first()
    assert got.alignment == round(got.primary - got.secondary, 4)
    assert evaluation.alignment(evaluation.cohort_summary(df, "g"), "g", "d", "nobody").first().alignment is None


def test_misses_go_when_a_run_has_none(spark, tmp_path):
    df = spark.createDataFrame([("u1", 0.1, "x"), ("u2", 0.29999, "y"), ("u3", 0.3, "z"), ("u4", None, "z")], "url string, score double, tld_type string")
    for rows, want in ((df, {"u1", "u2"}), (df.where("score > 0.5"), set())):
        sinks.missed(evaluation.missed(rows), str(tmp_path / "m"))
        got = spark.read.option("header", True).csv(str(tmp_path / "m")) if any((tmp_path / "m").glob("*.csv")) else spark.createDataFrame([], "url string")
        assert {x.url for x in got.collect()} == want


def test_corpus_checks(spark):
    good = [(f"b{k % 130}", 1, f"http://{k}") for k in range(910)]
    of = lambda rows: {x.name: x.passed for x in evaluation.corpus_checks(spark.createDataFrame(rows, "brand string, label int, url string"), "brand", "label", "url").collect()}
    assert all(of(good).values())
    assert of(good + [("b1", 0, "ftp://x")] + [("b1", None, None)]) == {"rows_per_brand": False, "brands": True, "rows": True, "labels": False, "schemes": False}
    assert of([])["rows"] is False


def test_pages_and_totals(spark):
    df = spark.createDataFrame([(k, k % 2, None if k == 4 else "x") for k in range(10)], "id int, odd int, kind string")
    got = V.page(df, {"odd": 0, "kind": None}, [F.desc("id")], 2, 1).collect()
    assert [(r.id, r.total) for r in got] == [(6, 5), (4, 5)]
    assert V.page(df, {"odd": 7}, ["id"]).count() == 0
    assert [r[0] for r in spark.createDataFrame([("abcdef",), ("abc",), (None,)], "t string").select(corpus.shortened(F.col("t"), 3)).collect()] == ["abc…", "abc", None]


def test_one_document_of_a_trusted_list(spark, tmp_path):
    import json

    import pytest

    from urlgrove.sources import feeds

    df = spark.createDataFrame([("b.go.th", "B", "gov"), ("a.co.th", "A", None)], "domain string, agency_name string, category string")
    body = sinks.trusted_document(df).first().body
    assert [e["domain"] for e in json.loads(body)["entries"]] == ["a.co.th", "b.go.th"] and json.loads(body)["count"] == 2
    (tmp_path / "t.json").write_text(body)
    assert sorted(r.domain for r in feeds.trusted_json(spark, str(tmp_path / "t.json")).collect()) == ["a.co.th", "b.go.th"]
    with pytest.raises(ValueError):
        sinks.trusted_document(df, 1)


def test_text_feeds_online_feeds_and_csv_lists(spark, tmp_path):
    from urlgrove.operators.brands import build_trusted
    from urlgrove.sources import feeds

    (tmp_path / "f.txt").write_text("http://a\n\n# c\nftp://b\n  https://c \n")
    assert sorted(r.url for r in feeds.text_urls(spark, str(tmp_path / "f.txt")).collect()) == ["http://a", "https://c"]
    body = '{"urls": [{"url": "http://a", "url_status": "online"}, {"url": "http://b", "url_status": "offline"}, {"url": "ftp://c", "url_status": "online"}, {"url": null, "url_status": "online"}]}'
    assert [r.url for r in feeds.online_urls(spark.createDataFrame([(body,), ("no json",), (None,)], "body string")).collect()] == ["http://a"]
    (tmp_path / "t.csv").write_text("domain,agency_name,category\n WWW.Obec.go.th ,One,edu\nobec.go.th.,Two,\n# no,x,y\nscb.co.th,Bank,\n,none,\n")
    got = sorted((r.domain, r.agency_name, r.category, r.label) for r in build_trusted(feeds.trusted_csv(spark, str(tmp_path / "t.csv"))).collect())
    assert got == [("obec.go.th", "One", "edu", "obec"), ("scb.co.th", "Bank", "other", "scb")]


def test_rebuild_keeps_first_dates(spark):
    schema = "url string, source string, collected_at string"
    old = spark.createDataFrame([("u1", "x", "2020"), ("gone", "x", "2020")], schema)
    curated, live = spark.createDataFrame([("u1", "c", "2024"), ("u2", "c", "2024")], schema), spark.createDataFrame([("u2", "l", "2024"), ("u3", "l", "2024")], schema)
    got = sorted((r.url, r.source, r.collected_at) for r in corpus.rebuild(old, curated, live, "url", "collected_at").collect())
    assert got == [("u1", "c", "2020"), ("u2", "c", "2024"), ("u3", "l", "2024")]


def test_rolling_counts_on_a_stream(spark, tmp_path):
    from urlgrove.streaming.ingest import rolling

    schema = "label string, checked_at timestamp"
    rows = spark.createDataFrame([("safe", 5), ("safe", 90_000), ("phishing", 7), ("safe", 6), ("safe", 400_000)], "label string, s long").select("label", F.timestamp_seconds("s").alias("checked_at"))
    rows.write.parquet(str(tmp_path / "in"))
    out = rolling(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window.start.day, r.label, r.n) for r in spark.table("rolled").collect()) == [(1, "phishing", 1), (1, "safe", 2), (2, "safe", 1), (5, "safe", 1)]


def test_brand_corpus(spark):
    curated = [(f"http://a/{k}", "a", k) for k in range(10)] + [("http://b/1", "b", 1)]
    live = [(f"http://live/{k}", "feed", "b", k) for k in range(5)] + [("http://c/1", "feed", "c", 1), ("http://b/1", "feed", "b", 9), ("http://a/99", "feed", "a", 1)]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = corpus.brand_corpus(df([("http://b/1", "2020"), ("gone", "2020")], "url string, collected_at string"), df(curated, "url string, brand string, ord int"), df([("a", "co.th", 0), ("b", "go.th", 1)], "brand string, suffix string, idx int"), df(live, "url string, source string, brand string, ord int"), "2024")
    got = {r.url: r for r in out.collect()}
    n = collections.Counter(r.target_brand for r in got.values())
    assert n == {"a": 8, "b": 8, "c": 1} and {u for u in got if u.startswith("http://a/")} == {f"http://a/{k}" for k in range(8)}
    assert got["http://b/1"].source == "curated" and got["http://b/1"].collected_at == "2020" and "gone" not in got and "http://a/99" not in got
    assert {"https://b-verify.top/login", "https://www.b.go.th.online/secure-update/auth", "https://b.go.th@click.com/login"} <= set(got)  # domains turn with brand and pattern


def test_golden_verdicts(spark):
    v = spark.createDataFrame([("a", "safe"), ("b", "suspicious"), ("c", "suspicious"), ("d", "phishing")], "url string, label string")
    want = spark.createDataFrame([("a", "safe"), ("b", "phishing"), ("c", "safe"), ("d", "phishing"), ("none", "safe")], "url string, want string")
    assert {r.url: r.passed for r in corpus.golden(v, want).collect()} == {"a": True, "b": True, "c": False, "d": True, "none": False}


def test_overrides_of_labelled_rows(spark):
    from urlgrove.operators.observations import with_overrides

    rows = spark.createDataFrame([("a", 5, None, None), ("b", None, 1, 90), ("c", None, None, None), ("d", 7, 0, None)], "url string, domain_age_days int, has_valid_cert int, cert_validity_days int")
    got = {r.url: (r.domain_age_days, r.whois_ok, r.is_known_registrar, r.has_valid_cert, r.tls_ok, r.cert_validity_days, r.cert_san_count) for r in with_overrides(rows).collect()}
    assert got == {"a": (5, 1, 0, 0, 0, -1, -1), "b": (-1, 0, 0, 1, 1, 90, -1), "c": (-1, 0, 0, 0, 0, -1, -1), "d": (7, 1, 0, 0, 1, -1, -1)}
    said = spark.createDataFrame([("a", "5", "0", "")], "url string, domain_age_days string, whois_ok string, tls_ok string").replace("", None)
    assert with_overrides(said).first().whois_ok == 0


def test_one_document_of_an_evaluation(spark):
    import json

    df = spark.createDataFrame([(1, 0.9, "p"), (0, 0.2, "q"), (1, 0.1, "p"), (1, 0.8, "q")], "y int, score double, g string")
    body = json.loads(evaluation.summary_document(evaluation.class_report(df, "y", "score"), evaluation.cohort_summary(df.where("y = 1"), "g"), "g", "p", "q").first().body)
    assert [c["name"] for c in body["classes"]] == ["accuracy", "legitimate", "macro avg", "phishing", "weighted avg"]
    assert [c["g"] for c in body["cohorts"]] == ["p", "q"] and body["alignment"] == {"primary": 0.5, "secondary": 1.0, "alignment": -0.5}


def test_pages_that_were_not_served_say_nothing(spark):
    from urlgrove.operators import rules

    trusted = spark.createDataFrame([("mybank.co.th", "mybank")], "domain string, label string")
    df = spark.createDataFrame([(1, "x.top", "x.top", "<title>mybank</title>", 200), (2, "x.top", "x.top", "<title>mybank</title>", 404), (3, "x.top", "x.top", "<title>mybank</title>", None)], "page_id int, host string, netloc string, html string, status int")
    assert {r.page_id: r.content_delta for r in rules.content_adjustment(df, trusted, "page_id").collect()} == {1: 0.15, 2: 0.0, 3: 0.0}
