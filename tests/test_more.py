"""Blocks of trusted domains, feeds, observations, gate and model contract."""

import json

import pytest
from pyspark.sql import functions as F

from urlgrove.functions import idn
from urlgrove.functions.urls import lexical, url_parts
from urlgrove.operators import rules, targeting
from urlgrove.operators.brands import closest_brand, path_brands
from urlgrove.operators.observations import cert_time
from urlgrove.plans.training import check_contract, gate, retrained
from urlgrove.sources.feeds import json_entries


def test_blocks_of_trusted_domains(spark):
    trusted = spark.createDataFrame([(f"brand{k:02}.com", f"brand{k:02}") for k in range(40)], "domain string, label string")
    urls = lexical(url_parts(spark.createDataFrame([(f"http://bramd{k:02}.net/x",) for k in range(40)], "url string")))
    whole, cut = ({r.url: (r.closest_domain, r.min_edit_distance) for r in closest_brand(urls, trusted, n).collect()} for n in (1000, 7))
    assert whole == cut and whole["http://bramd07.net/x"] == ("brand07.com", 1)


def test_json_feed_of_both_forms(spark):
    rows = [(json.dumps([{"url": "http://a"}, {"url": "", "phish_detail_url": "http://b"}]),), (json.dumps({"entries": [{"url": "http://c"}, {"url": "ftp://d"}]}),), (' {"entries": []}',), ("not json",), (None,)]
    assert sorted(r.url for r in json_entries(spark.createDataFrame(rows, "body string")).collect()) == ["http://a", "http://b", "http://c"]


def test_certificate_times(spark):
    df = spark.createDataFrame([("Jan  5 12:00:00 2024 GMT",), ("Dec 15 00:00:00 2023 GMT",), ("soon",)], "t string")
    assert [str(r[0]) for r in df.select(F.to_date(cert_time(F.col("t")))).collect()] == ["2024-01-05", "2023-12-15", "None"]


@pytest.mark.parametrize("netloc, private", [("localhost", True), ("10.1.2.3", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("192.168.1.1:80", False), ("example.com", False)])
def test_private_hosts(spark, netloc, private):
    assert spark.range(1).select(targeting.is_private(F.lit(netloc))).first()[0] is private


def test_gate_and_contract(spark):
    of = lambda rows: gate(spark.createDataFrame(rows, "recall double"), "recall").first().status
    assert [of([]), of([(None,)]), of([(0.8,)]), of([(0.85,)])] == ["missing", "null", "below", "passed"]
    few = spark.range(3)
    assert [retrained(few, 5, "passed"), retrained(few, 3, "passed"), retrained(few, 3, "below")] == ["skipped", "promoted", "kept"]
    check_contract(json.dumps({"version": "1", "features": ["a"]}), ["a"], "1")
    with pytest.raises(ValueError):
        check_contract(json.dumps({"version": "1", "features": ["b", "a"]}), ["a", "b"], "1")


HOSTS = [
    # host, decoded, folded, mixed
    ("plain.example", "plain.example", "plain.example", False),
    ("xn--bcher-kva.example", "bücher.example", "bucher.example", True),
    ("XN--BCHER-KVA.example", "bücher.example", "bucher.example", True),
    ("xn--\u00e9.example", "xn--\u00e9.example", "xn--e.example", True),  # no valid label stays as it is
    ("xn--99999999999.example", "xn--99999999999.example", "xn--99999999999.example", False),
    ("сеорх.com", "сеорх.com", "ceopx.com", False),  # one script, no ASCII letter in the label
    ("pаy.com", "pаy.com", "pay.com", True),
    ("сρ.com", "сρ.com", "cp.com", True),  # Cyrillic beside Greek
    ("ｂａｎｋ.com", "ｂａｎｋ.com", "bank.com", False),
    ("漢字かな.jp", "漢字かな.jp", "漢字かな.jp", False),
    ("ไทย๑.th", "ไทย๑.th", "ไทย1.th", False),
    ("", "", "", False),
    (None, None, None, False),
]


def test_international_hosts(spark):
    df = spark.createDataFrame([(k, h) for k, (h, *_) in enumerate(HOSTS)], "k int, host string").withColumn("d", idn.decoded(F.col("host")))
    got = df.select("d", idn.folded(F.col("host")), idn.mixed_script(F.col("d"))).orderBy("k").collect()
    # Kana beside Han count as one script; Thai has no ASCII letters in its label
    assert [tuple(r) for r in got] == [tuple(h[1:]) for h in HOSTS]


def test_encoded_hosts_come_back(spark):
    hosts = ["pаypаl.com", "bücher.example", "plain.com", "сеорх.xn--p1ai"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("a", idn.encoded(F.col("h")))
    got = {r.h: (r.a, r.d) for r in df.withColumn("d", idn.decoded(F.col("a"))).collect()}
    assert got["plain.com"] == ("plain.com", "plain.com") and all(a.isascii() for a, _ in got.values())
    assert got["pаypаl.com"][1] == "pаypаl.com" and got["bücher.example"][0] == "xn--bcher-kva.example"


def test_homograph_rule_fires(spark):
    trusted = spark.createDataFrame([("mybank.com", "mybank")], "domain string, label string")
    urls = spark.createDataFrame([("http://" + h + "/x",) for h in ("mybаnk.com".encode("idna").decode(), "xn--bcher-kva.com", "other.com")], "url string")
    df = idn.international(path_brands(closest_brand(lexical(url_parts(urls)), trusted), trusted))
    got = sorted((r.homoglyph_distance, r.has_mixed_script, [h.rule_id for h in r.hits]) for r in rules.evaluate(df).collect())
    assert got[0][0] == 0 and got[0][1] == 1 and "IDN_HOMOGRAPH" in got[0][2]
    assert all("IDN_HOMOGRAPH" not in hits for _, _, hits in got[1:])
