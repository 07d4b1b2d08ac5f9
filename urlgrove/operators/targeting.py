"""Which URLs aim at a country's brands, which are short links, and which labelled rows are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import PHISHING, SHORTENERS, SUSPICIOUS, TLD_TYPES
from ..functions.urls import has_suffix
from .mentions import longest_word

COUNTRY = rf"\.({'|'.join(s.removesuffix('.th') for s in TLD_TYPES)})\.th"


def gray_zone(score: Column) -> Column:
    return (score > SUSPICIOUS) & (score < PHISHING)


def is_shortener(netloc: Column) -> Column:
    return F.regexp_replace(F.lower(netloc), r"^www\.", "").isin(SHORTENERS)


def with_brand_token(df: DataFrame, brands: DataFrame, tokens: Column, out: str) -> DataFrame:
    """Add ``out``: whether one of the row's tokens is a brand of ``brands`` (brand). Equal lists of tokens are matched once."""
    lists = df.select(tokens.alias("_tokens")).distinct()
    hit = lists.withColumn("brand", F.explode("_tokens")).join(brands.select("brand").distinct(), "brand", "left_semi").select("_tokens").distinct().withColumn("_hit", F.lit(True))
    return df.withColumn("_tokens", tokens).join(hit, "_tokens", "left").withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_tokens", "_hit")


def names_country_suffix(url: Column, host: Column, has_brand: Column) -> Column:
    """A country suffix with any text after it, or a brand as a label of a host outside the country."""
    return F.lower(url).rlike("(?s)" + COUNTRY + ".") | (~has_suffix(host, TLD_TYPES) & has_brand)


def host_tokens(host: Column) -> Column:
    return F.filter(F.split(host, r"[.\-_]"), lambda t: t != "")


def imitates_country(url: Column, host: Column, has_brand: Column) -> Column:
    """A country suffix inside the URL, or a brand among the host's tokens and no genuine country host."""
    return F.lower(url).rlike(COUNTRY + r"\.") | (~has_suffix(host, TLD_TYPES) & has_brand)


def mentions_country(url: Column) -> Column:
    return F.lower(url).rlike(r"\.th|thai")


def is_private(netloc: Column) -> Column:
    """Local names and private or loopback addresses; a port hides them, as netloc is compared whole."""
    return F.lower(netloc).isin("localhost", "localhost.localdomain", "[::1]") | netloc.rlike(r"^(127\.\d+|10\.\d+|192\.168|169\.254|172\.(1[6-9]|2\d|3[01]))\.\d+\.\d+$")


def brand_keywords(trusted: DataFrame, seeds: list[str] = []) -> DataFrame:  # noqa: B006
    """Distinct plain labels of four letters or more, with the seed codes."""
    words = trusted.select(F.col("label").alias("brand")).where(F.col("brand").rlike("^[a-z]{4,}$"))
    return words.union(words.sparkSession.createDataFrame([(s,) for s in seeds], "brand string")).distinct()


def attribute(urls: DataFrame, brands: DataFrame) -> DataFrame:
    """Add target_brand: the longest brand that the host contains, the smaller of equal ones; else the host's first label."""
    out = longest_word(urls, "host", brands, "brand", "_brand")
    return out.withColumn("target_brand", F.coalesce("_brand", F.split_part("host", F.lit("."), F.lit(1)))).drop("_brand")


def expanded(urls: DataFrame, redirects: DataFrame, netloc: str = "netloc") -> DataFrame:
    """Short links by their final URL where ``redirects`` (url, final_url) has it; all others as they are."""
    found = urls.join(redirects.select("url", "final_url"), "url", "left")
    return found.withColumn("expanded_url", F.when(is_shortener(F.col(netloc)), F.coalesce("final_url", "url")).otherwise(F.col("url"))).drop("final_url")


def accepted_feedback(rows: DataFrame, holdout: DataFrame) -> DataFrame:
    """First row of each http URL whose label reads as 0 or 1 and that isn't held out. ``rows``: url, label (string), ord."""
    rows = rows.where(F.col("url").rlike("^https?://") & F.trim("label").isin("0", "1")).join(holdout.select("url").distinct(), "url", "left_anti")
    return rows.groupBy("url").agg(F.min("ord").alias("ord"), F.min_by(F.trim("label").cast("int"), "ord").alias("label"))

