"""Assembly of labelled corpora: first-wins dedupe, caps, splits, merges, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import BRAND_PATTERNS, CHEAP_TLDS, SPOOF_TLDS

def hash_share(key: Column) -> Column:
    """A number from 0 to 2**32 - 1 by the key alone, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def cap_per_brand(df: DataFrame, brand: str, order: str, cap: int, used: DataFrame | None = None) -> DataFrame:
    """The first rows of each brand up to the cap, less what ``used`` (brand, used) has taken already."""
    df = df.withColumn("_n", F.row_number().over(W.partitionBy(brand).orderBy(order)))
    if used is not None:
        df = df.join(used, brand, "left").withColumn("_n", F.col("_n") + F.coalesce("used", F.lit(0))).drop("used")
    return df.where(F.col("_n") <= cap).drop("_n")


def split(df: DataFrame, key: str, holdout: float) -> DataFrame:
    """Add ``part`` by a hash of the key: no shuffle, stable for each row."""
    return df.withColumn("part", F.when(hash_share(F.col(key)) < int(holdout * (1 << 32)), "holdout").otherwise("train"))


def insert_only(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return existing.unionByName(new.join(existing, key, "left_anti"), allowMissingColumns=True)


def rebuild(existing: DataFrame, curated: DataFrame, live: DataFrame, key: str, stamp: str) -> DataFrame:
    """Keys of curated and live, curated first; the stamp of a known key stays."""
    both = curated.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    best = both.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("_p"))).where("_n = 1").drop("_n", "_p")
    known = existing.select(key, F.col(stamp).alias("_old"))
    return best.join(known, key, "left").withColumn(stamp, F.coalesce("_old", stamp)).drop("_old")


def attack_pattern(netloc: Column, host: Column) -> Column:
    inside = host.rlike(r"\.(go|ac|or|co|in)\.th") & ~host.rlike(r"\.(go|ac|or|co|in)\.th$")
    return (
        F.when(F.contains(netloc, F.lit("@")), "at_redirect").when(inside, "subdomain_spoof").when(host.rlike(rf"\.({'|'.join(CHEAP_TLDS)})$"), "cheap_tld")
        .when(F.contains(host, F.lit("xn--")), "punycode").when(host.rlike(r"^[0-9.]*[0-9][0-9.]*$"), "ip_host").otherwise("other")
    )


def expand_brands(brands: DataFrame, tlds: list[str] = SPOOF_TLDS, templates: list[str] = BRAND_PATTERNS) -> DataFrame:
    """brand, ord and url: ``brands`` (brand, suffix, idx) by template; the top-level domain turns with brand and template; the first of equal URLs stays."""
    out = brands.select("brand", "suffix", "idx", F.posexplode(F.array(*map(F.lit, templates))).alias("offset", "url"))
    tld = F.element_at(F.array(*map(F.lit, tlds)), (F.pmod(F.col("idx") + F.col("offset"), F.lit(len(tlds))) + 1).cast("int"))
    for mark, value in (("{b}", F.col("brand")), ("{c}", F.col("suffix")), ("{t}", tld)):
        out = out.withColumn("url", F.replace("url", F.lit(mark), value))
    return first_wins(out.select("brand", (F.col("idx") * len(templates) + F.col("offset")).alias("ord"), "url"), "url", "ord")


def brand_corpus(existing: DataFrame, curated: DataFrame, brands: DataFrame, live: DataFrame, today: str, cap: int = 8) -> DataFrame:
    """url, label, source, target_brand and collected_at of a corpus built anew.

    ``curated`` (url, brand, ord) comes before the expansion of ``brands`` (brand, suffix, idx), and a brand has ``cap`` of both at most; ``live`` (url, source,
    brand, ord) fills what a brand's cap leaves. A curated URL beats a live one, and one that ``existing`` (url, collected_at) has keeps its date.
    """
    place = lambda p: F.struct(F.lit(p).alias("p"), F.col("ord").cast("long").alias("o")).alias("_place")
    listed = curated.select("url", "brand", place(0)).unionByName(expand_brands(brands).select("url", "brand", place(1)))
    listed = cap_per_brand(listed, "brand", "_place", cap)
    used = listed.groupBy("brand").agg(F.count("*").alias("used"))
    live = cap_per_brand(live.select("url", "source", "brand", "ord"), "brand", "ord", cap, used)
    row = lambda df, source, order: first_wins(df, "url", order).select("url", F.lit(1).alias("label"), source.alias("source"), F.col("brand").alias("target_brand"), F.lit(today).alias("collected_at"))
    return rebuild(existing, row(listed, F.lit("curated"), "_place"), row(live, F.col("source"), "ord"), "url", "collected_at")


def golden(verdicts: DataFrame, expected: DataFrame) -> DataFrame:
    """url, want, label and passed of each row of ``expected`` (url, want): suspicious will do for phishing; a URL without a verdict fails."""
    out = expected.join(verdicts.select("url", "label"), "url", "left")
    passed = (F.col("label") == F.col("want")) | ((F.col("want") == "phishing") & (F.col("label") == "suspicious"))
    return out.select("url", "want", "label", F.coalesce(passed, F.lit(False)).alias("passed"))


def histogram(df: DataFrame, dims: list[str], top: int = 12) -> DataFrame:
    """The most frequent values of each dimension, in one pass."""
    long = df.unpivot([], dims, "dim", "value").groupBy("dim", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.desc("n"), "value"))
    return long.withColumn("rank", rank).where(F.col("rank") <= top)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share, four decimals; 0 and 0 for no trials."""
    p = k / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x: F.when(n == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / (1 + z * z / n))), 4))
    return bound(mid - half), bound(mid + half)


def metrics(df: DataFrame, truth: str, score: str, cut: float) -> DataFrame:
    hit = F.col(score) >= cut
    true = F.col(truth) == 1
    sums = df.agg(*(F.count_if(c).alias(n) for n, c in {"tp": hit & true, "fp": hit & ~true, "fn": ~hit & true, "tn": ~hit & ~true}.items()))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    low, high = wilson(tp, tp + fn)
    return sums.select("tp", "fp", "fn", "tn", share(tp + tn, tp + tn + fp + fn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), low.alias("recall_low"), high.alias("recall_high"))


def roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Points by score: counts of each sign at or above it. Scores have four decimals, so the running sum has a bounded number of rows."""
    by = df.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    above = W.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    return by.select(score, F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("fp"))


def shortened(text: Column, most: int = 60) -> Column:
    """The text, or its first ``most`` characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
