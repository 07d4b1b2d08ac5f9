"""Written forms of verdicts, labelled rows, reference lists, metrics and alerts.

Tables of any size are written by all tasks, in many files. Only documents of a bounded number of
rows (feeds of at most ``FEED_ROWS``, metrics of one row) become one value or one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most rows of one feed document.
FEED_ROWS = 2000
URL_CHARS, REASON_CHARS, WEBHOOK_CHARS = 2048, 512, 512
FEED_FIELDS = ["url", "score", "closest_domain", "edit_distance", "checked_at"]
FEEDBACK_FIELDS = ["created_at", "url", "verdict_given", "correct_verdict", "comment", "source"]
BOM = "﻿"


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def only(df: DataFrame, fields: list[str]) -> DataFrame:
    """These columns in this order; those that ``df`` lacks are null."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields))


def csv(df: DataFrame, path: str, fields: list[str], order: list | None = None) -> None:
    """CSV files with a fixed header; missing values are blank, quotes are doubled."""
    df = only(df, fields)
    df = df.orderBy(*order) if order else df
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    """Verdicts by day of check, with bounded texts."""
    rows = verdicts.withColumns({"url": F.substring("url", 1, URL_CHARS), "reason": F.substring("reason", 1, REASON_CHARS), "day": F.to_date("checked_at")})
    rows.write.mode("append").partitionBy("day").parquet(path)


def parts(df: DataFrame, path: str, part: str = "part") -> None:
    """One folder for each part that has rows, from one pass over the rows."""
    df.write.mode("overwrite").partitionBy(part).option("header", True).csv(path)


def missed(rows: DataFrame, path: str) -> None:
    """URLs that an evaluation missed, lowest scores first; a run without misses leaves no row of an older one."""
    csv(rows, path, rows.columns, ["score", "url"])


def trusted_document(trusted: DataFrame, most: int = 100_000) -> DataFrame:
    """One JSON text {count, entries[]} in order of domain: for lists of at most ``most`` entries; a longer one goes to ``trusted_list``."""
    if trusted.limit(most + 1).count() > most:
        raise ValueError(f"the list has more than {most} entries")
    entry = F.struct("domain", "agency_name", "category")
    listed = trusted.agg(F.count("*").alias("count"), F.sort_array(F.collect_list(entry)).alias("entries"))
    return listed.select(F.to_json(F.struct("count", "entries")).alias("body"))


def trusted_list(trusted: DataFrame, path: str) -> None:
    """Entries as JSON lines in order of domain, and their count beside them."""
    trusted.orderBy("domain").write.mode("overwrite").json(f"{path}/entries")
    trusted.agg(F.count("*").alias("count")).write.mode("overwrite").json(f"{path}/count")


def metrics(values: DataFrame, path: str) -> None:
    """A row of figures, nested or plain, as JSON."""
    values.limit(1).coalesce(1).write.mode("overwrite").json(path)


def feed_document(rows: DataFrame, generated_at: str, hours: int) -> DataFrame:
    """One JSON text of at most FEED_ROWS indicators, newest first."""
    item = F.struct("url", "score", "closest_domain", "edit_distance", iso(F.col("checked_at")).alias("checked_at"))
    rows = rows.orderBy(F.desc("checked_at"), "url").limit(FEED_ROWS)
    order = F.struct((-F.unix_micros("checked_at")).alias("at"), F.col("url").alias("u"), item.alias("item"))
    listed = rows.agg(F.count("*").alias("count"), F.transform(F.sort_array(F.collect_list(order)), lambda x: x.item).alias("indicators"))
    body = F.struct(F.lit("phish.feed.v1").alias("schema"), F.lit(generated_at).alias("generated_at"), F.lit(hours).alias("window_hours"), "count", "indicators")
    return listed.select(F.to_json(body).alias("body"))


HISTORY_FIELDS = ["checked_at", "url", "label", "score", "closest_domain", "edit_distance", "reason"]
BULK_FIELDS = HISTORY_FIELDS[1:]


def csv_lines(rows: DataFrame, fields: list[str], feed: bool = True) -> DataFrame:
    """(ord, line): a header, then rows by their ``ord``; quotes doubled, nulls blank. A feed has a byte order mark and scores with four digits, other exports have neither."""
    shown = {"score": F.format_string("%.4f", "score") if feed else F.regexp_replace(F.col("score").cast("string"), r"\.0$", "")}
    plain = lambda c: F.coalesce(shown.get(c, F.col(c)).cast("string"), F.lit(""))
    quoted = lambda c: F.when(plain(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(plain(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(plain(c))
    head = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("ord"), F.lit(BOM * feed + ",".join(fields)).alias("line"))
    return head.unionByName(rows.select(F.col("ord").cast("long"), F.concat_ws(",", *map(quoted, fields)).alias("line")))


def history_csv(rows: DataFrame, fields: list[str] = HISTORY_FIELDS) -> DataFrame:
    """Lines of checked URLs in their order (``ord``), with the columns of a history or, by BULK_FIELDS, of a batch."""
    rows = rows.withColumn("checked_at", iso(F.col("checked_at"))) if "checked_at" in fields else rows
    return csv_lines(rows, fields, feed=False)


def feed_csv(rows: DataFrame) -> DataFrame:
    """Lines of at most FEED_ROWS indicators, newest first."""
    from pyspark.sql import Window as W

    rows = rows.orderBy(F.desc("checked_at"), "url").limit(FEED_ROWS)  # bounded, so one window
    rows = rows.withColumn("ord", F.row_number().over(W.orderBy(F.desc("checked_at"), "url")))
    return csv_lines(rows.withColumn("checked_at", iso(F.col("checked_at"))), FEED_FIELDS)


def stix_bundle(objects: DataFrame, generated_at: str, hours: int, source: str) -> DataFrame:
    """One JSON text: a bundle of the indicator ``objects`` (id, created, pattern, confidence, brand) of a feed."""
    o = objects.limit(FEED_ROWS)
    item = F.struct(
        F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), "id", "created", F.col("created").alias("modified"),
        F.concat(F.lit("Phishing URL targeting "), F.coalesce("brand", F.lit("unknown"))).alias("name"), F.array(F.lit("malicious-activity")).alias("indicator_types"),
        F.lit("stix").alias("pattern_type"), "pattern", F.col("created").alias("valid_from"), "confidence",
    )
    listed = o.agg(F.sort_array(F.collect_list(F.struct("created", "id", item.alias("item"))), asc=False).alias("all"))
    items = F.transform("all", lambda x: x.item)
    name = F.sha2(F.concat_ws("|", F.lit(generated_at), F.array_join(F.transform("all", lambda x: x.id), "|")), 256)
    body = F.struct(F.lit("bundle").alias("type"), F.concat(F.lit("bundle--"), name).alias("id"), items.alias("objects"), F.struct(F.lit(generated_at).alias("generated_at"), F.lit(hours).alias("window_hours"), F.lit(source).alias("source")).alias("_meta"))
    return listed.select(F.to_json(body).alias("body"))


def label_rows(feedback: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """url, label (1 iff the right verdict is phishing) and source of the feedback of the last days."""
    recent = feedback.where(F.col("created_at") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.select("url", F.when(F.col("correct_verdict") == "phishing", "1").otherwise("0").alias("label"), F.lit("feedback").alias("source"))


def alert_payload(fired_at: str) -> Column:
    """The JSON text of one alert, from columns of a watched verdict."""
    return F.to_json(F.struct(F.lit("phish.alert.v1").alias("schema"), "brand", "url", "label", F.round("score", 4).alias("score"), "closest_domain", "reason", F.lit(fired_at).alias("fired_at")))


def delivery_log(sent: DataFrame) -> DataFrame:
    """Outcomes of deliveries (brand, url, webhook_url, status_code, error) with bounded texts; an error left over means two attempts."""
    error = F.nullif("error", F.lit(""))
    return sent.select("brand", F.substring("url", 1, URL_CHARS).alias("url_checked"), F.substring("webhook_url", 1, WEBHOOK_CHARS).alias("webhook_url"), "status_code", error.alias("error"), F.when(error.isNotNull(), 2).otherwise(1).alias("attempts"))
