"""Exact choices, assembled training sets and words inside texts, against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from urlgrove.functions.urls import brand_label, registrable, url_parts
from urlgrove.operators import assembly as A
from urlgrove.operators import mentions, rules, targeting


def key(url, seed=42):
    return hashlib.md5(f"{seed}|{url}".encode()).hexdigest()


def test_exactly_k_however_rows_are_dealt(spark):
    urls = [f"http://h{k}/x" for k in range(3000)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for k in (0, 17, 2999, 5000):
        want = sorted(urls, key=key)[:k]
        for n in (1, 13):
            assert sorted(r.url for r in A.first_rows(df.repartition(n), k, 42).collect()) == sorted(want)
    assert A.first_rows(df.limit(0), 5, 42).count() == 0
    assert {r.url for r in A.first_rows(df, 10, 1).collect()} != {r.url for r in A.first_rows(df, 10, 2).collect()}


@pytest.mark.parametrize("n", [0, 1, 5, 15, 200])
def test_shares_and_caps(spark, n):
    rows = spark.createDataFrame([(f"http://{c}{k}", c) for c in ("seed", "generic", "feed", "targeted") for k in range(n)], "url string, cohort string")
    cohorts = [A.Cohort("seed", train=0.7), A.Cohort("generic", train=0.7, cap=6), A.Cohort("feed", holdout=0.3, cap=100), A.Cohort("targeted", train=0.0)]
    got = {r.url: r.part for r in A.dealt(rows.repartition(3), cohorts, 42).collect()}
    want = {}
    for c in ("seed", "generic", "feed", "targeted"):
        order = sorted((f"http://{c}{k}" for k in range(n)), key=key)
        first = {"seed": round(n * 0.7), "generic": round(n * 0.7), "feed": round(n * 0.3), "targeted": 0}[c]
        for k, u in enumerate(order):
            if c == "feed":
                part = "holdout" if k < first else "train" if k < first + 100 else None
            else:
                part = "holdout" if k >= first else "train" if c != "generic" or k < 6 else None
            if part:
                want[u] = part
    assert got == want


def test_cohorts_need_one_share():
    for bad in ({}, {"train": 0.5, "holdout": 0.5}):
        with pytest.raises(ValueError):
            A.Cohort("x", **bad)


def test_assembly_has_no_leaks(spark):
    r = random.Random(1)
    word = lambda k: f"http://w{k}.net/{'login' if k % 3 else ''}"
    rows = [(word(r.randrange(300)), r.choice(["seed", "generic", "feed"]), k) for k in range(700)] + [("ftp://x", "seed", 1), ("http://a.mybrand.com/", "feed", 2), ("https://x.go.th.evil.top/", "feed", 3), ("http://real.go.th", "feed", 4)]
    legit = [(word(k),) for k in range(250, 700)] + [("file:///x",)]
    told = [(word(k), str(k % 2), k) for k in range(200, 400)] + [(word(1000), "x", 1), (word(1001), None, 1), ("ftp://y", "1", 1), (None, "1", 1)]
    df = lambda data, schema: spark.createDataFrame(data, schema)
    got = A.assemble(df(rows, "url string, cohort string, ord int"), df(legit, "url string"), df(told, "url string, label string, ord int"), df([(f"http://p{k}/",) for k in range(2000)], "url string"), df([("mybrand",)], "brand string"))
    out = got.collect()
    held, trained = {x.url for x in out if x.part == "holdout"}, {x.url for x in out if x.part == "train"}
    assert held and trained and not held & trained and A.leaks(got).count() == 0
    assert sum(x.label == 0 and x.part == "train" for x in out) == sum(x.label == 1 and x.part == "train" for x in out)
    assert {x.url: (x.cohort, x.part) for x in out if x.cohort == "targeted"} == {"http://a.mybrand.com/": ("targeted", "holdout"), "https://x.go.th.evil.top/": ("targeted", "holdout")}
    first = {}
    for u, c, _ in sorted(rows, key=lambda x: (["seed", "generic", "feed"].index(x[1]), x[2])):
        first.setdefault(u, c)
    assert all(first[x.url] == x.cohort for x in out if x.cohort in ("seed", "generic", "feed"))
    assert sum(x.cohort == "generic" and x.part == "train" for x in out) == min(90, round(0.7 * sum(c == "generic" for u, c in first.items())))
    assert all(x.url.startswith("http") for x in out)
    none = A.assemble(df([], "url string, cohort string, ord int"), df([], "url string"), df([], "url string, label string, ord int"), df([], "url string"), df([], "brand string"))
    assert none.count() == 0


def test_leaks_are_found(spark):
    df = spark.createDataFrame([("a", 1, "c", "train"), ("a", 1, "d", "holdout"), ("b", 1, "c", "train")], "url string, label int, cohort string, part string")
    assert [r.url for r in A.leaks(df).collect()] == ["a"]
    assert sorted((r.part, r.n, r.leaked) for r in A.audit(df).collect()) == [("holdout", 1, 1), ("train", 2, 1)]


def test_feed_caps_come_in_feed_order(spark):
    df = spark.createDataFrame([(f"u{k}", 100 - k) for k in range(50)], "url string, ord int")
    assert sorted(r.url for r in A.capped_feed(df, 3).collect()) == ["u47", "u48", "u49"]


def test_words_in_texts(spark):
    r = random.Random(4)
    texts = ["", None, "a", "abc", "日本語bank", *("".join(r.choice("abc ") for _ in range(r.randint(1, 30))) for _ in range(150))]
    words = ["", "a", "ab", "本", "bank", "bankers", *("".join(r.choice("abc") for _ in range(r.randint(1, 8))) for _ in range(80))]
    t, w = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in words], "word string")
    for least in (1, 3, 4, 6):
        got = {(x.text, x.word) for x in mentions.found_words(t, "text", w, "word", least).collect()}
        assert got == {(x, y) for x in texts if x for y in words if len(y) >= least and y in x}
    best = {x.text: x.best for x in mentions.longest_word(t, "text", w, "word", "best").collect()}
    assert best == {x: min((y for y in words if y and x and y in x), key=lambda y: (-len(y), y), default=None) for x in texts}


def test_content_of_pages(spark):
    trusted = spark.createDataFrame([("mybank.co.th", "mybank"), ("scb.co.th", "scb")], "domain string, label string")
    pages = [
        ("evil.top", "<TITLE x=1>\n MyBank login </title>", 0.15), ("www.mybank.xyz", "<title>mybank</title>", 0.0), ("evil.top", "<title>scb</title>", 0.0),
        ("evil.top", "<title>mybank</title><input id=1 type='password'>", 0.25), ("evil.top", "<input type=password>", 0.0), ("evil.top", "<title>www.x.go.th</title>", -0.1),
        ("localhost", "<title>mybank</title>", 0.0), ("10.0.0.1", "<input type='password'>", 0.0), ("evil.top", None, 0.0), ("evil.top", "x" * 70_000 + "<title>mybank</title>", 0.0),
    ]
    df = spark.createDataFrame([(k, h, h, b) for k, (h, b, _) in enumerate(pages)], "page_id int, host string, netloc string, html string")
    got = {r.page_id: r.content_delta for r in rules.content_adjustment(df, trusted, "page_id").collect()}
    assert got == {k: d for k, (_, _, d) in enumerate(pages)}


@pytest.mark.parametrize("host, domain, label", [("obec.go.th.", "obec.go.th", "obec"), ("a.obec.go.th.", "obec.go.th", "obec"), ("www.example.com.", "example.com", "example"), ("go.th.", "go.th", "go"), ("obec.go.th", "obec.go.th", "obec"), ("x", "x", "x"), ("", "", "")])
def test_final_dot(spark, host, domain, label):
    df = url_parts(spark.createDataFrame([(f"http://{host}/a",)], "url string"))
    assert tuple(df.select(registrable(F.col("host"), F.col("labels")), brand_label(F.col("host"), F.col("labels"))).first()) == (domain, label)


@pytest.mark.parametrize("url, suffix, imitates", [
    ("https://obec.go.th/login", True, False), ("https://obec.go.th", False, False), ("https://a.go.th.evil.com", True, True), ("https://x.in.th/kasikorn", False, False),
    ("https://kasikorn.in.th/", True, True), ("https://my-kasikorn.top/", False, True), ("https://kasikorn.top/", True, True), ("https://plain.top/", False, False),
])
def test_aims_at_the_country(spark, url, suffix, imitates):
    brands = spark.createDataFrame([("kasikorn",)], "brand string")
    df = url_parts(spark.createDataFrame([(url,)], "url string"))
    df = targeting.with_brand_token(targeting.with_brand_token(df, brands, F.col("labels"), "l"), brands, targeting.host_tokens(F.col("host")), "t")
    got = df.select(targeting.names_country_suffix(F.col("url"), F.col("host"), F.col("l")), targeting.imitates_country(F.col("url"), F.col("host"), F.col("t"))).first()
    assert tuple(got) == (suffix, imitates)
