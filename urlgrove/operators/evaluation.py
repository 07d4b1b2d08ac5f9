"""Evaluation reports from counts: classes, cohorts, medians and alignment.

Scores are rounded to four digits before they are counted, so a table of counts by score has at most 10,001 rows a
cohort whatever the number of rows is, and medians are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .corpus import wilson


def share(a: Column, b: Column, digits: int = 4) -> Column:
    return F.coalesce(F.round(F.try_divide(a, b), digits), F.lit(0.0))


def class_report(df: DataFrame, truth: str, score: str, cut: float = 0.5) -> DataFrame:
    """name, precision, recall, f1 and support: a row a class, the plain and the weighted mean of the classes, and accuracy (as f1).

    One pass counts the four cells; grouping sets give the sums by truth and by prediction beside them.
    """
    cells = df.select((F.col(truth) == 1).cast("int").alias("t"), (F.col(score) >= cut).cast("int").alias("p")).where("t is not null and p is not null")
    sums = cells.groupingSets([["t", "p"], ["t"], ["p"], []], "t", "p").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    pick = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    t, p, g = F.col("t"), F.col("p"), F.col("g")
    one = sums.agg(*(x for c in (0, 1) for x in (pick((g == 0) & (t == c) & (p == c)).alias(f"hit{c}"), pick((g == 1) & (t == c)).alias(f"true{c}"), pick((g == 2) & (p == c)).alias(f"said{c}"))), pick(g == 3).alias("n"))
    of = {}
    for c in (0, 1):
        hit, true, said = F.col(f"hit{c}"), F.col(f"true{c}"), F.col(f"said{c}")
        of[c] = (F.coalesce(F.try_divide(hit, said), F.lit(0.0)), F.coalesce(F.try_divide(hit, true), F.lit(0.0)), F.coalesce(F.try_divide(2 * hit, said + true), F.lit(0.0)), true)
    row = lambda name, p, r, f, n: F.struct(F.lit(name).alias("name"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"), n.cast("long").alias("support"))
    mean = [(a + b) / 2 for a, b in zip(of[0][:3], of[1][:3], strict=True)]
    weighted = [F.coalesce(F.try_divide(a * of[0][3] + b * of[1][3], F.col("n")), F.lit(0.0)) for a, b in zip(of[0][:3], of[1][:3], strict=True)]
    accuracy = F.coalesce(F.try_divide(F.col("hit0") + F.col("hit1"), F.col("n")), F.lit(0.0))
    rows = [row("legitimate", *of[0]), row("phishing", *of[1]), row("macro avg", *mean, F.col("n")), row("weighted avg", *weighted, F.col("n")), row("accuracy", accuracy, accuracy, accuracy, F.col("n"))]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def medians(df: DataFrame, group: str, score: str) -> DataFrame:
    """(group, median): the middle score, or the mean of the two in the middle, of scores rounded to four digits."""
    counts = df.where(F.col(score).isNotNull()).groupBy(group, F.round(score, 4).alias("_s")).agg(F.count("*").alias("_n"))
    of = W.partitionBy(group)
    run = counts.withColumns({"_to": F.sum("_n").over(of.orderBy("_s")), "_all": F.sum("_n").over(of)})
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    at = lambda k: F.max(F.when((F.col("_to") >= k) & (F.col("_to") - F.col("_n") < k), F.col("_s")))
    return run.groupBy(group).agg(((at(low) + at(high)) / 2).alias("median"))


def cohort_summary(df: DataFrame, cohort: str, score: str = "score", high: float = 0.7, low: float = 0.3) -> DataFrame:
    """Of each cohort of phishing rows: n, recall and its 95 % interval at both cut-offs, mean and median score, misses below ``low``."""
    hits = df.groupBy(cohort).agg(F.count(score).alias("n"), F.count_if(F.col(score) >= high).alias("_h"), F.count_if(F.col(score) >= low).alias("_l"), F.round(F.avg(score), 4).alias("mean_score"))
    n = F.col("n")
    (h0, h1), (l0, l1) = wilson(F.col("_h"), n), wilson(F.col("_l"), n)
    out = hits.join(medians(df, cohort, score), cohort, "left")
    return out.select(cohort, "n", share(F.col("_h"), n).alias("recall_high"), h0.alias("high_from"), h1.alias("high_to"), share(F.col("_l"), n).alias("recall_low"), l0.alias("low_from"), l1.alias("low_to"), "mean_score", F.round("median", 4).alias("median_score"), (n - F.col("_l")).alias("missed"))


def alignment(summary: DataFrame, cohort: str, primary: str, secondary: str) -> DataFrame:
    """primary, secondary and their difference: recall of the cohort that matters less that of the other; null where one is missing."""
    of = lambda name: F.max(F.when(F.col(cohort) == name, F.col("recall_high")))
    return summary.agg(of(primary).alias("primary"), of(secondary).alias("secondary")).withColumn("alignment", F.round(F.col("primary") - F.col("secondary"), 4))


def summary_document(report: DataFrame, cohorts: DataFrame, cohort: str, primary: str, secondary: str) -> DataFrame:
    """One JSON text of an evaluation: the classes, the cohorts by name, and the alignment of two of them. A row a class and a cohort."""
    classes = report.agg(F.sort_array(F.collect_list(F.struct(*report.columns))).alias("classes"))
    names = [cohort, *(c for c in cohorts.columns if c != cohort)]
    held = cohorts.agg(F.sort_array(F.collect_list(F.struct(*names))).alias("cohorts"))
    fit = alignment(cohorts, cohort, primary, secondary).select(F.struct("primary", "secondary", "alignment").alias("alignment"))
    return classes.crossJoin(held).crossJoin(fit).select(F.to_json(F.struct("classes", "cohorts", "alignment")).alias("body"))


MISS_FIELDS = ["url", "score", "closest_domain", "min_edit_distance", "is_typosquat", "has_punycode", "has_mixed_script", "tld_type"]


def missed(df: DataFrame, score: str = "score", low: float = 0.3) -> DataFrame:
    """The rows below ``low`` with what explains them; rows without a score aren't misses."""
    have = [c for c in MISS_FIELDS if c in df.columns and c != "score"]
    return df.where(F.col(score) < low).select(F.round(score, 4).alias("score"), *have)


def corpus_checks(rows: DataFrame, brand: str, label: str, url: str, cap: int = 8, brands: int = 130, least: int = 900) -> DataFrame:
    """(name, passed, value) of a brand corpus: rows per brand, brands, rows, labels that aren't 1, URLs that aren't http(s)."""
    by = rows.groupBy(brand).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(label) != 1, F.lit(True))).alias("bad"), F.count_if(~F.coalesce(F.col(url).rlike("^https?://"), F.lit(False))).alias("odd"))
    total = by.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count(brand).alias("brands"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"))
    tests = {"rows_per_brand": ("most", F.col("most") <= cap), "brands": ("brands", F.col("brands") >= brands), "rows": ("rows", F.col("rows") >= least), "labels": ("bad", F.col("bad") == 0), "schemes": ("odd", F.col("odd") == 0)}
    return total.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), ok.alias("passed"), F.col(c).cast("long").alias("value")) for name, (c, ok) in tests.items()))).alias("t")).select("t.*")
