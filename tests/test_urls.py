import pytest
from pyspark.sql import functions as F

from urlgrove.functions.idn import folded
from urlgrove.functions.urls import brand_label, fingerprint, is_ip, lexical, path_shape, registrable, url_parts
from urlgrove.operators import corpus, rules
from urlgrove.operators.brands import closest_brand, path_brands
from urlgrove.operators.verdicts import ttl_first


def one(spark, url):
    return lexical(url_parts(spark.createDataFrame([(url,)], "url string"))).first()


@pytest.mark.parametrize("host, ip", [("1.2.3.4", True), ("192.168.1.1", True), ("2001:db8::1", True), ("999.999.999.999", False), ("", False), ("nrct.go.th", False)])
def test_ip_hosts(spark, host, ip):
    assert spark.createDataFrame([(host,)], "h string").select(is_ip(F.col("h"))).first()[0] is ip


@pytest.mark.parametrize("host, n", [("nrct.go.th", 0), ("www.nrct.go.th", 1), ("a.b.nrct.go.th", 2), ("a.b.c.example.com", 3), ("198.51.100.7", 0)])
def test_subdomains(spark, host, n):
    assert one(spark, f"http://{host}/").num_subdomains == n


def test_lexical_row(spark):
    r = one(spark, "https://www.nrct.go.th")
    assert (r.has_https, r.has_ip, r.num_at, r.num_subdomains, r.num_dots, r.digit_to_letter_ratio) == (1, 0, 0, 1, 3, 0.0)
    r = one(spark, "http://nrct.go.th@odd.net:8080/login;x?a=1&b=2")
    assert (r.host, r.num_at, r.has_port, r.path, r.query_param_count, r.has_login_keyword) == ("odd.net", 1, 1, "/login", 2, 1)
    assert one(spark, "http://198.51.100.7/x").digit_to_letter_ratio == 9.0


@pytest.mark.parametrize("host, domain, label", [("www.nrct.go.th", "nrct.go.th", "nrct"), ("a.b.c.nrct.go.th", "nrct.go.th", "nrct"), ("www.example.com", "example.com", "example"), ("mail.tmb.co.th", "tmb.co.th", "tmb"), ("google.com", "google.com", "google")])
def test_registrable(spark, host, domain, label):
    df = spark.createDataFrame([(host,)], "h string").withColumn("l", F.split("h", r"\."))
    assert df.select(registrable(F.col("h"), F.col("l")), brand_label(F.col("h"), F.col("l"))).first()[:] == (domain, label)


def test_brand_matches(spark):
    trusted = spark.createDataFrame([("nrct.go.th", "nrct"), ("tmb.co.th", "tmb"), ("naresa.ac.th", "naresa")], "domain string, label string")
    urls = ["https://www.nrct.go.th", "http://nrct.com", "http://nrc7.xyz", "http://tmb.co.th", "http://naresа.com", "http://1.2.3.4/nrct", "http://evil.top/nrct/login"]
    df = lexical(url_parts(spark.createDataFrame([(u,) for u in urls], "url string")))
    got = {r.url: r for r in path_brands(closest_brand(df, trusted), trusted).collect()}
    pick = lambda u: (got[u].min_edit_distance, got[u].is_typosquat, got[u].closest_domain)
    assert pick(urls[0]) == (0, 0, "nrct.go.th")
    assert pick(urls[1]) == (0, 1, "nrct.go.th")
    assert pick(urls[2]) == (1, 1, "nrct.go.th")
    assert pick(urls[3])[1] == 0
    # one edit away already, hence a typosquat by its raw label; folded it is the brand itself
    assert pick(urls[4]) == (1, 1, "naresa.ac.th") and got[urls[4]].homoglyph_distance == 0
    assert pick(urls[5])[:2] == (999, 0) and got[urls[5]].path_brand_hit == 0
    assert got[urls[6]].path_brand_hit == 1


def test_shapes_and_fingerprints(spark):
    df = spark.createDataFrame([("/order/77/item-3",), ("/u/0123abcd99/pay",)], "p string")
    assert [r[0] for r in df.select(path_shape(F.col("p"))).collect()] == ["order/#/item-#", "u/$hex/pay"]
    f = spark.createDataFrame([("one-7.cc",), ("two-8.cc",)], "h string").select(fingerprint(F.lit("a.com"), F.col("h"), F.lit("/x/1")))
    assert len({r[0] for r in f.collect()}) == 1
    assert spark.range(1).select(folded(F.lit("сａο"))).first()[0] == "cao"


def test_score_thresholds_and_pins(spark):
    df = spark.createDataFrame([(0.3,), (0.299,), (0.7,)], "s double")
    assert [r[0] for r in df.select(rules.label_of(F.col("s"))).collect()] == ["suspicious", "safe", "phishing"]
    cols = "norm string, has_punycode int, homoglyph_distance int, is_typosquat int, has_login_keyword int, path_brand_hit int, has_suspicious_tld int, has_ip int, min_edit_distance int, has_https int, base_score double"
    rows = [("http://a@b.com/", 0, 9, 0, 0, 0, 0, 0, 0, 0, 0.1), ("https://a.go.th", 0, 0, 0, 0, 0, 0, 0, 0, 1, 0.9), ("http://x.top", 0, 9, 0, 0, 0, 1, 0, 9, 0, 0.2)]
    got = rules.final_score(rules.evaluate(spark.createDataFrame(rows, cols))).collect()
    assert [(r.label, r.score) for r in got] == [("phishing", 0.7), ("safe", 0.29), ("suspicious", 0.4)]


def test_fixed_life_cache(spark):
    df = spark.createDataFrame([("u", t) for t in (1, 5, 70, 90, 140)], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.ts.timestamp() for r in ttl_first(df, "k", "ts", 60).collect()) == [1, 70, 140]


def test_wilson_and_merge(spark):
    low, high = corpus.wilson(F.lit(378), F.lit(378))
    assert spark.range(1).select(low, high).first()[:] == (0.9899, 1.0)
    old, new = (spark.createDataFrame(r, "k string, v int") for r in ([("a", 1)], [("a", 2), ("b", 3)]))
    assert sorted(map(tuple, corpus.insert_only(old, new, "k").collect())) == [("a", 1), ("b", 3)]


def test_ttl_of_hot_keys_in_bounded_slices(spark):
    import random

    r, rows = random.Random(9), [("gone", None)]
    for key, n, span in (("hot", 4000, 40_000), ("dense", 500, 50), ("rare", 30, 100_000), (None, 200, 5_000), ("edge", 1, 1)):
        rows += [(key, -20_000 + r.randrange(span * 4) / 4) for _ in range(n)]
    rows += [("step", 60.0 * k) for k in range(50)]
    want = []
    for key in {k for k, _ in rows}:
        last = None
        for t in sorted(t for k, t in rows if k == key and t is not None):
            if last is None or t - last >= 60:
                want.append((key, t))
                last = t
    df = spark.createDataFrame(rows, "k string, s double").selectExpr("k", "timestamp_micros(cast(s * 1000000 as bigint)) as ts")
    out = ttl_first(df, "k", "ts", 60)
    got = [tuple(x) for x in out.selectExpr("k", "unix_micros(ts) / 1000000").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # no list holds all events of a key: each is of one slice of time
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_slice" in line for line in plan.splitlines() if "collect_list" in line)
