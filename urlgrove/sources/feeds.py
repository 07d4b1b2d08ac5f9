"""Threat feeds, chat events and reference lists as tables of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_urls(spark: SparkSession, path: str) -> DataFrame:
    """One URL a line; blank lines and # comments dropped, only http kept."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url like 'http%'")


def json_entries(raw: DataFrame, body: str = "body") -> DataFrame:
    """URLs of a JSON feed: an array of entries at the top or under ``entries``."""
    entry = "array<struct<url:string,phish_detail_url:string>>"
    # by the first mark: an array schema would read an object as an array of one
    listed = F.from_json(F.when(F.ltrim(body).startswith("["), F.col(body)), entry)
    entries = F.coalesce(listed, F.from_json(F.when(F.ltrim(body).startswith("{"), F.col(body)), f"struct<entries:{entry}>").getField("entries"))
    found = raw.select(F.explode(entries).alias("e")).select(F.coalesce(F.nullif("e.url", F.lit("")), F.col("e.phish_detail_url")).alias("url"))
    return found.where("url like 'http%'")


def online_urls(raw: DataFrame, body: str = "body") -> DataFrame:
    rows = raw.select(F.explode(F.from_json(body, "struct<urls:array<struct<url:string,url_status:string>>>").getField("urls")).alias("u"))
    return rows.where("u.url_status = 'online' and u.url like 'http%'").select("u.url")


def trusted_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("domain string, agency_name string, category string").option("header", True).csv(path)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def chat_texts(events: DataFrame) -> DataFrame:
    """``events``: array of structs; text messages only."""
    rows = events.select(F.explode("events").alias("e")).where("e.type = 'message' and e.message.type = 'text'")
    return rows.select("e.replyToken", F.col("e.message.text").alias("text"))


def first_url(text):
    return F.nullif(F.regexp_extract(text, r"(https?://\S+)", 1), F.lit(""))


def valid(url):
    u = F.trim(url)
    return (u != "") & ~F.contains(u, F.lit(" ")) & (F.contains(u, F.lit(".")) | F.contains(u, F.lit("://"))) & F.length(u).between(3, 2048)


def page_domains(pages: DataFrame, pattern: str) -> DataFrame:
    """Domains that pages mention, first page first."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all(F.lower("html"), F.lit(pattern), F.lit(0))).alias("pos", "domain"))
    return rows.groupBy("domain").agg(F.min("page_id").alias("page_id"), F.count("*").alias("mentions"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of a text list without blank ones and # comments, whatever their scheme."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def trusted_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Entries of a trusted list: one document {count, entries[]}, or JSON lines of entries if ``lines``."""
    entry = "domain string, agency_name string, category string"
    rows = spark.read.schema(f"{entry}, entries array<struct<{entry.replace(' string', ':string')}>>").option("multiLine", not lines).json(path)
    rows = rows.select(F.explode(F.coalesce("entries", F.array(F.struct("domain", "agency_name", "category")))).alias("e")).select("e.*")
    return rows.where("domain is not null").withColumn("ord", F.monotonically_increasing_id())


def seed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a labelled CSV with http(s) URLs; blanks are nulls, columns are read as ``schema`` says."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path).where(F.col("url").rlike("^https?://"))


def country_domains(pages: DataFrame, pattern: str = r"[a-z0-9.-]+\.(?:go|ac|or|co)\.th") -> DataFrame:
    """Registrable domains that pages mention (html): a leading www., th. or en. goes, the last three labels stay; first page wins."""
    found = page_domains(pages, pattern).withColumn("name", F.regexp_replace(F.col("domain"), r"^(www|th|en)\.", ""))
    return found.select(F.substring_index("name", ".", -3).alias("domain"), "page_id").groupBy("domain").agg(F.min("page_id").alias("page_id"))
