"""Exact choices by keyed rank, and the assembly of a training set from cohorts of labelled URLs.

A choice of exactly k rows of a group goes by a digest of seed and URL, so it is a seeded shuffle that
doesn't depend on how rows are partitioned. The digest of the k-th row is found by counting:
the first three hexadecimal digits of all rows, then the next three of the rows in the
bucket of the k-th, then the order inside that bucket alone. Nothing is sorted as a whole, a
group that holds a third of all rows is counted like any other, and what a row is compared with is
one digest for each cohort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..tables import stored
from .targeting import accepted_feedback, mentions_country, names_country_suffix, with_brand_token

#: Hexadecimal digits counted in each of two steps.
DIGITS = 3


@dataclass(frozen=True)
class Cohort:
    """How the URLs of a cohort are dealt: ``train`` or ``holdout`` is the share that comes first in the keyed order, the other part is the rest.

    ``cap`` is the most rows that may train; rows of the training part beyond it are in neither part.
    """

    name: str
    train: float | None = None
    holdout: float | None = None
    cap: int | None = None

    def __post_init__(self) -> None:
        if (self.train is None) == (self.holdout is None):
            raise ValueError(f"cohort {self.name} needs a share of train or of holdout, and not both")


#: The usual cohorts: a brand corpus, a snapshot of generic phishing with few rows for training, feeds, and feed rows that aim at watched brands, which never train.
COHORTS = [Cohort("seed", train=0.7), Cohort("generic", train=0.7, cap=90), Cohort("feed", holdout=0.3), Cohort("targeted", train=0.0)]


def keyed(url: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), url))


def cuts(rows: DataFrame, group: str, wanted: DataFrame, digest: str = "digest") -> DataFrame:
    """(group, mark, cut): the digest up to which exactly k rows of the group lie, for each row (group, mark, k) of ``wanted``.

    Digests are distinct in a group. More than there are rows means all; a k below 1 gives no row.
    ``wanted`` has a few rows a group.
    """
    rows = rows.select(group, F.col(digest).alias("_h"))
    left = wanted.select(group, "mark", F.col("k").cast("long").alias("k"), F.lit("").alias("_head"))
    for step, n in enumerate((DIGITS, 2 * DIGITS)):
        at = F.substring("_h", 1, n)
        inside = rows if not step else rows.withColumn("_head", F.substring("_h", 1, n - DIGITS)).join(F.broadcast(left.select(group, "_head").distinct()), [group, "_head"], "left_semi")
        counts = inside.groupBy(group, at.alias("_at")).agg(F.count("*").alias("_n"))  # at most 4,096 rows a group, then as many a mark
        met = counts.join(F.broadcast(left), group).where(F.col("_at").startswith(F.col("_head")))
        run = F.sum("_n").over(W.partitionBy(group, "mark").orderBy("_at"))
        whole = F.sum("_n").over(W.partitionBy(group, "mark"))
        met = met.withColumns({"_run": run, "_whole": whole}).withColumn("k", F.least("k", "_whole"))
        left = met.where("k > 0 and _run >= k and _run - _n < k").select(group, "mark", (F.col("k") - F.col("_run") + F.col("_n")).alias("k"), F.col("_at").alias("_head"))
    last = rows.withColumn("_head", F.substring("_h", 1, 2 * DIGITS)).join(F.broadcast(left), [group, "_head"])
    nth = F.row_number().over(W.partitionBy(group, "mark").orderBy("_h"))  # the rows of one bucket of 16 million
    return last.withColumn("_nth", nth).where("_nth = k").select(group, "mark", F.col("_h").alias("cut"))


def first_rows(rows: DataFrame, n: int, seed: int, url: str = "url") -> DataFrame:
    """Exactly ``n`` rows (all, if fewer) of distinct URLs, by the keyed order."""
    rows = stored(rows.withColumns({"_all": F.lit(0), "digest": keyed(F.col(url), seed)}), "ranked")
    wanted = rows.sparkSession.createDataFrame([(0, "n", n)], "_all int, mark string, k long")
    cut = cuts(rows, "_all", wanted).select("_all", "cut")
    return rows.join(F.broadcast(cut), "_all").where("digest <= cut").drop("_all", "digest", "cut")


def dealt(rows: DataFrame, cohorts: list[Cohort], seed: int) -> DataFrame:
    """``rows`` (url, cohort; distinct URLs) with part: train or holdout. Shares are exact: the nearest whole number, halves to the even one."""
    spark = rows.sparkSession
    rules = spark.createDataFrame([(c.name, c.train if c.holdout is None else c.holdout, c.holdout is None, c.cap) for c in cohorts], "cohort string, share double, train_first boolean, cap long")
    rows = stored(rows, "cohorts")
    sizes = rows.groupBy("cohort").agg(F.count("*").alias("_n")).join(F.broadcast(rules), "cohort")  # a row a cohort
    first = F.bround(F.col("_n") * F.col("share")).cast("long")
    sizes = sizes.withColumn("_first", first).withColumn("_last", F.when(F.col("train_first"), F.least("_first", F.coalesce("cap", "_first"))).otherwise(F.least("_n", F.coalesce(F.col("_first") + F.col("cap"), "_n"))))
    wanted = sizes.select("cohort", F.explode(F.array(F.struct(F.lit("first").alias("mark"), F.col("_first").alias("k")), F.struct(F.lit("last").alias("mark"), F.col("_last").alias("k")))).alias("w")).select("cohort", "w.mark", "w.k")
    rows = rows.withColumn("digest", keyed(F.col("url"), seed))
    wanted = stored(wanted, "wanted")
    at = cuts(rows, "cohort", wanted).groupBy("cohort").agg(F.max(F.when(F.col("mark") == "first", F.col("cut"))).alias("_at"), F.max(F.when(F.col("mark") == "last", F.col("cut"))).alias("_end"))
    rows = rows.join(F.broadcast(rules.select("cohort", "train_first")), "cohort").join(F.broadcast(at), "cohort", "left")
    leads, kept = F.coalesce(F.col("digest") <= F.col("_at"), F.lit(False)), F.coalesce(F.col("digest") <= F.col("_end"), F.lit(False))
    part = F.when(F.col("train_first"), F.when(kept, "train").when(~leads, "holdout")).otherwise(F.when(leads, "holdout").when(kept, "train"))
    return rows.withColumn("part", part).where("part is not null").drop("digest", "_at", "_end", "train_first")


def capped_feed(feed: DataFrame, most: int, order: str = "ord") -> DataFrame:
    """The first ``most`` rows of a feed in its own order: a limit of the feed, taken before feeds are united."""
    return feed.orderBy(order).limit(most)


def assemble(rows: DataFrame, legit: DataFrame, feedback: DataFrame, pool: DataFrame, brands: DataFrame, cohorts: list[Cohort] = COHORTS, feed: str = "feed", targeted: str = "targeted", seed: int = 42) -> DataFrame:
    """url, label, cohort and part of the whole training set and its holdouts.

    ``rows`` (url, cohort, ord) are phishing URLs; one that several cohorts hold counts for the first of ``cohorts``, so no
    URL trains and is held out. Rows of the cohort ``feed`` that aim at ``brands`` (brand) move to ``targeted``. ``legit`` (url) are
    harmless ones; ``feedback`` (url, label, ord) trains only. None of these may stand in a holdout. ``pool`` (url) fills the
    phishing class of the training part up to the harmless one, with exactly as many rows as are missing, if it has them.
    """
    web = lambda df: df.where(F.col("url").rlike("^https?://"))
    order = F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(cohorts) for x in (c.name, k))), F.col("cohort"))
    rows = web(rows).withColumn("_p", F.struct(order.alias("p"), "ord", "cohort")).groupBy("url").agg(F.min("_p").alias("_p")).select("url", "_p.cohort")
    parts = with_host(rows.where(F.col("cohort") == feed))
    aims = with_brand_token(parts, brands, F.col("labels"), "_brand").where(names_country_suffix(F.col("url"), F.col("host"), F.col("_brand"))).select("url", F.lit(targeted).alias("_aims"))
    rows = rows.join(aims, "url", "left").select("url", F.coalesce("_aims", "cohort").alias("cohort"))
    split = stored(dealt(rows, cohorts, seed), "split")
    held = split.where("part = 'holdout'").select("url")
    trained = split.where("part = 'train'").select("url")
    of = lambda df, label, cohort: df.select("url", F.lit(label).alias("label"), F.lit(cohort).alias("cohort"), F.lit("train").alias("part"))
    good = stored(of(web(legit).select("url").distinct().join(held, "url", "left_anti"), 0, "legit"), "legit")
    told = accepted_feedback(feedback, held)
    told = stored(told.select("url", "label", F.lit("feedback").alias("cohort"), F.lit("train").alias("part")), "feedback")
    balance = F.count_if(F.col("label") == 0) - F.count_if(F.col("label") == 1)
    need = good.unionByName(told).select("label").unionAll(trained.select(F.lit(1).alias("label"))).agg(balance.alias("k"))  # one row
    spare = web(pool).select("url").distinct().join(held.union(trained).union(told.select("url")).union(good.select("url")), "url", "left_anti")
    spare = stored(spare.withColumns({"_all": F.lit(0), "digest": keyed(F.col("url"), seed)}), "spare")
    cut = cuts(spare, "_all", need.select(F.lit(0).alias("_all"), F.lit("n").alias("mark"), "k"))
    filled = of(spare.join(F.broadcast(cut), "_all").where("digest <= cut"), 1, "pool")
    return split.select("url", F.lit(1).alias("label"), "cohort", "part").unionByName(good).unionByName(told).unionByName(filled)


def with_host(df: DataFrame) -> DataFrame:
    return url_parts(df).select(*df.columns, "host", "labels")


def leaks(assembled: DataFrame) -> DataFrame:
    """URLs that train and are held out: none, if the assembly is sound."""
    by = assembled.groupBy("url").agg(F.count_if(F.col("part") == "train").alias("trains"), F.count_if(F.col("part") == "holdout").alias("held"))
    return by.where("trains > 0 and held > 0").select("url")


def audit(assembled: DataFrame) -> DataFrame:
    """part, cohort, label, n, and how many of the URLs also stand in the other part."""
    assembled = stored(assembled, "assembled")
    bad = leaks(assembled).withColumn("_bad", F.lit(1))
    return assembled.join(bad, "url", "left").groupBy("part", "cohort", "label").agg(F.count("*").alias("n"), F.count("_bad").alias("leaked"))


def snapshot(urls: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """A snapshot of generic phishing from ``urls`` (url, source, ord): http(s) with a host, not about the country, first of each URL, exactly ``most`` by a seeded shuffle, sorted by URL."""
    rows = urls.withColumn("url", F.trim("url")).where(F.col("url").rlike("^https?://"))
    rows = with_host(rows).where((F.col("host") != "") & ~mentions_country(F.col("url")))
    rows = rows.groupBy("url").agg(F.min_by("source", "ord").alias("source"))
    return first_rows(rows, most, seed).orderBy("url")
