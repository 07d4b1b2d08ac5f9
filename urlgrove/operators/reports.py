"""Counts, audits and explanations over verdicts, sources and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def source_stats(polls: DataFrame) -> DataFrame:
    """Of each source: last poll, last error (null if none) and rows ingested. ``polls``: source, polled_at, error, ingested."""
    last = F.max_by("error", F.when(F.col("error").isNotNull(), F.col("polled_at")))
    return polls.groupBy("source").agg(F.max("polled_at").alias("last_polled_at"), last.alias("last_error"), F.sum(F.greatest("ingested", F.lit(0))).alias("total_ingested"), F.count("error").alias("errors"))


def corpus_audit(rows: DataFrame, brand: str, is_holdout: Column) -> DataFrame:
    by = rows.groupBy(brand).agg(F.count("*").alias("n"), F.count_if(is_holdout).alias("h"))
    total = F.sum("n")
    return by.agg(total.alias("total"), F.count("*").alias("brands"), F.round(total / F.count("*"), 4).alias("mean_per_brand"), F.max("n").alias("max_per_brand"), F.round(F.sum("h") / total, 4).alias("holdout_share"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, least and greatest value of each column."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "value")
    return long.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counting half, from counts by score (rounded scores have few values)."""
    by = df.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(W.orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    return by.agg(F.round(F.try_divide(F.sum("won"), F.sum("p").cast("double") * F.sum("n")), 6).alias("auc"))


def holdout_recall(df: DataFrame, cohort: str, cuts: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Of each cohort of phishing rows: recall at two cut-offs, mean score and misses."""
    share = lambda c: F.round(F.count_if(F.col("score") >= c) / F.count("*"), 4)
    return df.groupBy(cohort).agg(F.count("*").alias("n"), share(cuts[0]).alias("recall_high"), share(cuts[1]).alias("recall_low"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("score") < cuts[0]).alias("misses"))


def ranked_in(df: DataFrame, group: str, key: str) -> DataFrame:
    """Add ``nth`` (from 0): the row's place in its group by the digest of ``key``, then the key.

    Digests are cut into 4,096 ranges, so a group that holds a third of all rows is still ranked by many tasks.
    """
    df = df.withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn("_b", F.substring("_h", 1, 3))
    before = W.partitionBy(group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # at most 4,096 rows a group
    base = df.groupBy(group, "_b").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(W.partitionBy(group, "_b").orderBy("_h", key)) - 1
    return df.withColumn("_own", own).join(base, [group, "_b"]).withColumn("nth", F.col("_own") + F.col("_base")).drop("_h", "_b", "_own", "_base")


def maintained(existing: DataFrame, added: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """The table after inserts and deletes by key, with what happened to each key: kept, added, conflict or deleted."""
    known = existing.select(key).distinct()
    gone = removed.select(key).distinct()
    out = known.join(gone, key, "left_anti").select(key, F.lit("kept").alias("status")).unionByName(known.join(gone, key, "left_semi").select(key, F.lit("deleted").alias("status")))
    new = added.select(key).distinct()
    return out.unionByName(new.join(known, key, "left_anti").select(key, F.lit("added").alias("status"))).unionByName(new.join(known, key, "left_semi").select(key, F.lit("conflict").alias("status")))


#: What a reader is told for a rule or feature; language is data.
RULE_TEXTS = {"AT_TRICK": "the host is hidden behind @", "IDN_HOMOGRAPH": "look-alike letters of a brand", "TYPOSQUAT_CRED": "close to a brand, with words of a login", "PATH_BRAND_BAIT": "a brand in the path of a cheap domain", "IP_CRED": "a bare address with words of a login", "WHITELIST_EXACT": "a trusted domain", "CHEAP_TLD_PLAIN": "a cheap domain without encryption"}
FEATURE_TEXTS = [("has_ip", "a bare address"), ("has_punycode", "an encoded name"), ("is_typosquat", "close to a brand"), ("has_suspicious_tld", "a cheap domain"), ("has_login_keyword", "words of a login")]


def reason(hits: Column, label: Column) -> Column:
    """Up to three rule texts where the label isn't safe, else up to three feature texts, else a default."""
    table = F.create_map(*(F.lit(x) for pair in RULE_TEXTS.items() for x in pair))
    rules = F.slice(F.transform(F.filter(hits, lambda h: h.rule_id != "WHITELIST_EXACT"), lambda h: F.element_at(table, h.rule_id)), 1, 3)
    features = F.slice(F.array_compact(F.array(*(F.when(F.col(c) == 1, t) for c, t in FEATURE_TEXTS))), 1, 3)
    said = F.when((label != "safe") & (F.size(rules) > 0), rules).otherwise(features)
    return F.when(F.size(said) > 0, F.array_join(said, "; ")).otherwise(F.when(label == "safe", "nothing suspicious").otherwise("an unusual address"))


def reply(label: Column, url: Column, why: Column, limit: int = 2000) -> Column:
    head = F.when(label == "phishing", "Dangerous: ").when(label == "suspicious", "Take care: ").otherwise("Looks safe: ")
    return F.substring(F.concat(head, url, F.lit("\n"), why), 1, limit)


def explained(features: DataFrame, key: str, dictionary: dict[str, tuple[str, str]]) -> DataFrame:
    """A row a feature: its group and label by the dictionary (unknown ones: other, their own name) and whether the value is notable."""
    columns = [c for c in features.columns if c != key]
    long = features.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([key], columns, "feature", "value")
    names = features.sparkSession.createDataFrame([(f, g, t) for f, (g, t) in dictionary.items()], "feature string, group string, title string")
    v, f = F.col("value"), F.col("feature")
    notable = F.when(f.isin("has_https", "has_valid_cert"), v == 0).when(f == "homoglyph_distance", v > 0).when(f == "min_edit_distance", v.between(1, 2)).otherwise(f.like("has\\_%") & (v == 1))
    return long.join(F.broadcast(names), "feature", "left").select(key, "feature", "value", F.coalesce("group", F.lit("other")).alias("group"), F.coalesce("title", "feature").alias("title"), notable.alias("notable"))
