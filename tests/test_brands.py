"""Nearest brands by keys and by blocks, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from urlgrove.functions.urls import lexical, url_parts
from urlgrove.operators import brands as B


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def words(r, n, letters="abcd", most=12):
    return list({"".join(r.choice(letters) for _ in range(r.randint(1, most))) for _ in range(n)})


def test_forms_that_are_left(spark):
    got = spark.range(1).select(B.shortened_forms(F.lit("abca"), 2)).first()[0]
    assert sorted(got) == sorted({"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"})
    assert spark.range(1).select(B.shortened_forms(F.lit("a"), 3)).first()[0] == ["a", ""]


@pytest.mark.parametrize("scanned, block", [(0, 7), (10_000, 7), (10_000, 10_000)])
def test_nearest_is_that_of_all_pairs(spark, scanned, block):
    r = random.Random(6)
    labels, known = [*words(r, 120), "x" * 30, "abcdabcdabcdabcdabcdabcdabcd", "ด้วย"], [*words(r, 60), "abcdabcdabcdabcdabcdabcdabcx"]
    trusted = spark.createDataFrame([(f"{w}.{t}", w) for w in known for t in ("th", "co")], "domain string, label string")
    got = {x.label: tuple(x.near) for x in B.nearest_domains(spark.createDataFrame([(w,) for w in labels], "label string"), "label", trusted, block, scanned).collect()}
    assert got == {w: min((distance(w, k), f"{k}.{t}") for k in known for t in ("th", "co")) for w in labels}


def test_neighbours_make_no_pair_table(spark):
    known = [f"brand{k:05}" for k in range(3000)]
    trusted = spark.createDataFrame([(f"{w}.com", w) for w in known], "domain string, label string")
    labels = spark.createDataFrame([(f"zzzz{k:04}yyyy",) for k in range(2000)] + [("brand00007x",)], "label string")
    found = B.neighbours(labels, "label", trusted)
    assert [(x.label, x.near.distance, x.near.domain) for x in found.collect()] == [("brand00007x", 1, "brand00007.com")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_urls_by_keys_and_by_blocks_agree(spark):
    r = random.Random(7)
    trusted = spark.createDataFrame([(f"{w}.com", w) for w in words(r, 50, "abcdef", 9)], "domain string, label string")
    urls = lexical(url_parts(spark.createDataFrame([(f"http://{w}.{t}/x",) for w in [*words(r, 80, "abcdef", 9), "аbcd"] for t in ("com", "net")], "url string")))
    cols = ["url", "closest_domain", "min_edit_distance", "homoglyph_distance", "is_whitelisted", "is_typosquat"]
    one, two = (sorted(map(str, B.closest_brand(urls, trusted, scanned=n).select(*cols).collect())) for n in (0, 10_000))
    assert one == two
