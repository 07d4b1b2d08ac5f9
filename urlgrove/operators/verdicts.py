"""Analytics over the verdict log: url, host, label, score, closest_domain, checked_at, ..."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.constants import LOSS_PER_BLOCK
from ..functions.urls import fingerprint
from .scored import DAY, within

LABELS = ["phishing", "safe", "suspicious"]


def since(ts: Column, as_of: str, interval: str) -> Column:
    return (ts >= F.expr(f"timestamp'{as_of}' - interval {interval}")) & (ts <= F.lit(as_of).cast("timestamp"))


def counts_by_label() -> list[Column]:
    return [F.count_if(F.col("label") == name).alias(name) for name in LABELS]


def label_counts(v: DataFrame) -> DataFrame:
    """Every label with its count, zero where none."""
    return v.agg(*counts_by_label()).unpivot([], LABELS, "label", "n")


def top_targets(v: DataFrame, n: int = 10) -> DataFrame:
    risky = v.where("label <> 'safe' and closest_domain is not null")
    return risky.groupBy("closest_domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "closest_domain").limit(n)


def daily(v: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Counts by day for the last days, empty ones included."""
    calendar = v.sparkSession.range(days).select(F.date_sub(F.to_date(F.lit(as_of)), F.col("id").cast("int")).alias("day"))
    counts = v.groupBy(F.to_date("checked_at").alias("day")).agg(*counts_by_label())
    return calendar.join(counts, "day", "left").na.fill(0, LABELS)


def hourly(v: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Counts by hour of day, and each as a share of the largest."""
    counts = within(v, as_of, f"{days} days").groupBy(F.hour("checked_at").alias("hour")).agg(F.count("*").alias("n"))
    hours = v.sparkSession.range(24).select(F.col("id").cast("int").alias("hour")).join(counts, "hour", "left").na.fill(0, ["n"])
    top = hours.agg(F.greatest(F.lit(1), F.max("n")).alias("top"))
    return hours.crossJoin(F.broadcast(top)).select("hour", "n", F.round(F.col("n") / F.col("top"), 6).alias("share"))


def rate(v: DataFrame) -> DataFrame:
    share = F.try_divide(F.count_if(F.col("label") != "safe"), F.count("*"))
    return v.agg(F.count("*").alias("total"), F.coalesce(F.round(share, 4), F.lit(0.0)).alias("phishing_rate"))


def reputation(v: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """All hosts at once."""
    v = within(v, as_of, f"{days} days")
    return v.groupBy("host").agg(F.count("*").alias("total"), F.min("checked_at").alias("first_seen"), F.max("checked_at").alias("last_seen"), F.round(F.avg("score"), 9).alias("mean_score"), F.max("score").alias("max_score"), *counts_by_label())


def timeline(v: DataFrame) -> DataFrame:
    return v.groupBy("host", F.to_date("checked_at").alias("day")).agg(F.count("*").alias("checks"), F.round(F.avg("score"), 9).alias("mean_score"), F.max("score").alias("max_score"), *counts_by_label())


def recent(v: DataFrame, n: int = 20) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("host").orderBy(F.desc("checked_at"), "check_id"))
    return v.withColumn("rank", rank).where(F.col("rank") <= n).select("host", "rank", "check_id", "url", "label", "checked_at")


def campaigns(v: DataFrame, labels: list[str], min_count: int = 1) -> DataFrame:
    """One row per fingerprint; order of arrival plays no part."""
    v = v.where(F.col("label").isin(labels)).withColumn("fingerprint", fingerprint(F.col("closest_domain"), F.col("host"), F.col("path")))
    out = v.where(~F.col("fingerprint").endswith("||")).groupBy("fingerprint").agg(F.count("*").alias("url_count"), F.min("checked_at").alias("first_seen"), F.max("checked_at").alias("last_seen"))
    return out.where(F.col("url_count") >= min_count)


def found_campaigns(rollup: DataFrame, min_count: int = 1, brand: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of campaigns of at least ``min_count`` URLs whose brand domain matches (any case, % and _ as in ILIKE), last seen first, with their total."""
    found = rollup.where(F.col("url_count") >= min_count)
    found = found if brand is None else found.where(F.split_part("fingerprint", F.lit("|"), F.lit(1)).ilike(f"%{brand}%"))
    return page(found, {}, [F.desc("last_seen"), "fingerprint"], limit, offset)


def checks_by_cache(v: DataFrame, seconds: int = 60) -> DataFrame:
    """label, cached and n: a check is answered from the cache where its URL was stored less than ``seconds`` before."""
    stored = ttl_first(v, "url", "checked_at", seconds).select(F.col("url").alias("_u"), F.col("ts").alias("_t"), F.lit(True).alias("_first"))
    out = v.select("url", "label", "checked_at").join(stored, (F.col("url") == F.col("_u")) & (F.col("checked_at") == F.col("_t")), "left")
    return out.groupBy("label", F.col("_first").isNull().alias("cached")).agg(F.count("*").alias("n"))


def history(v: DataFrame, label: str | None = None, search: str | None = None, start: str | None = None, end: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if label:
        v = v.where(F.col("label") == label)
    if search:
        v = v.where(F.col("url").ilike(f"%{search}%"))
    if start:
        v = v.where(F.col("checked_at") >= F.lit(start).cast("timestamp"))
        v = v.where(F.col(DAY) >= F.to_date(F.lit(start))) if DAY in v.columns else v
    if end:
        v = v.where(F.col("checked_at") <= F.lit(end).cast("timestamp"))
        v = v.where(F.col(DAY) <= F.to_date(F.lit(end))) if DAY in v.columns else v
    return v.orderBy(F.desc("checked_at"), "check_id").offset(offset).limit(limit)


def page(rows: DataFrame, equal: dict[str, object], order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the rows whose columns have these values (None: any), in order, with ``total``, the number of all such rows."""
    for c, value in equal.items():
        rows = rows if value is None else rows.where(F.col(c) == F.lit(value))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def indicators(v: DataFrame, as_of: str, hours: int = 24, limit: int = 2000) -> DataFrame:
    v = within(v, as_of, f"{hours} hours").where("label = 'phishing'")
    return v.orderBy(F.desc("checked_at"), "check_id").limit(limit)


def stix_objects(v: DataFrame) -> DataFrame:
    """One indicator a row; quotes and backslashes in the pattern are escaped."""
    at = F.date_format("checked_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    quoted = F.replace(F.replace("url", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    name = F.sha2(F.concat_ws("|", "url", at), 256)
    return v.select(F.concat(F.lit("indicator--"), name).alias("id"), at.alias("created"), F.concat(F.lit("[url:value = '"), quoted, F.lit("']")).alias("pattern"), F.round(F.col("score") * 100).cast("int").alias("confidence"))


def impact(v: DataFrame, watch: DataFrame, feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    inside = within(v, as_of, f"{days} days")
    kpi = inside.agg(*counts_by_label(), F.count_distinct(F.when(F.col("label") == "phishing", F.col("closest_domain"))).alias("targets"))
    live = campaigns(v, ["phishing", "suspicious"]).where(since(F.col("last_seen"), as_of, f"{days} days")).agg(F.count("*").alias("campaigns"))
    # rows of one: four aggregates side by side
    out = kpi.crossJoin(live).crossJoin(watch.agg(F.count("*").alias("watched"))).crossJoin(feedback.agg(F.count("*").alias("feedback")))
    blocked = F.col("phishing") + F.col("suspicious")
    return out.withColumn("total", F.col("phishing") + F.col("safe") + F.col("suspicious")).withColumn("estimated_loss", blocked * LOSS_PER_BLOCK)


def watch_alerts(v: DataFrame, watch: DataFrame) -> DataFrame:
    """Phishing verdicts whose closest domain's first label is an enabled watched brand."""
    hits = v.where("label = 'phishing' and closest_domain is not null").withColumn("brand", F.split_part("closest_domain", F.lit("."), F.lit(1)))
    return hits.join(watch.where("enabled").select("brand"), "brand")


#: Lives that a slice of a key's events spans: no slice keeps more events than that, and one.
SLICE = 16


def _ends(life: int):
    """Of each slice, the events that may be its first kept one, with the last kept one that follows; of equal ends the latest entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nths, entries, lasts = [], [], [], []
            for n, times in enumerate(batch.column("times")):
                t = times.values.to_numpy()
                after = np.searchsorted(t, t + life)
                at = np.arange(min(after[0] + 1, len(t)))
                last = at
                while (more := after[last] < len(t)).any():
                    last = np.where(more, after[last], last)
                latest = np.append(last[1:] != last[:-1], True)
                keys += [n] * int(latest.sum())
                entries.append(t[at[latest]])
                lasts.append(t[last[latest]])
            if keys:
                part = batch.take(pa.array(keys))
                columns = [part.column("_key"), part.column("_slice"), pa.array(np.concatenate(entries)), pa.array(np.concatenate(lasts))]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "_slice", "entry", "last"])

    return run


def _carried(life: int):
    """The last event kept before each slice (null before the first); rows come by key, slice and entry."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, key, nth, anchor, done = False, None, None, None, False
        for batch in batches:
            at, anchors = [], []
            for n, (k, s, entry, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", "_slice", "entry", "last")), strict=True)):
                if not begun or k != key:
                    begun, key, nth, anchor = True, k, None, None
                if s != nth:
                    nth, done = s, False
                    at.append(n)
                    anchors.append(anchor)
                if not done and (anchor is None or entry >= anchor + life):
                    anchor, done = last, True
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("_key"), part.column("_slice"), pa.array(anchors, pa.int64())], ["_key", "_slice", "anchor"])

    return run


def _kept(life: int):
    """The events that each slice keeps after its anchor."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for n, (times, anchor) in enumerate(zip(batch.column("times"), batch.column("anchor").to_pylist(), strict=True)):
                t = times.values.to_numpy()
                at = 0 if anchor is None else int(np.searchsorted(t, anchor + life))
                while at < len(t):
                    keys.append(n)
                    out.append(int(t[at]))
                    at = int(np.searchsorted(t, t[at] + life))
            part = batch.take(pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(out, pa.int64())], ["_key", "_us"])

    return run


def ttl_first(events: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Events that a cache of fixed life would log: a repeat within ``seconds`` of the stored event is dropped and doesn't extend its life.

    A life holds one kept event at most, so a key's events are cut into slices of SLICE lives, whatever their number.
    Each slice says which kept event it ends with for each event it may start from; the last kept event is carried
    across a key's slices in order, row by row, and every slice then lists its own.
    """
    life = seconds * 1_000_000
    us = events.select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")).where("_us is not null").distinct()
    slices = us.groupBy("_key", F.floor(F.col("_us") / F.lit(SLICE * life)).alias("_slice")).agg(F.sort_array(F.collect_list("_us")).alias("times"))
    of_key = f"_key {events.select(key).schema[0].dataType.simpleString()}"
    ends = slices.mapInArrow(_ends(life), f"{of_key}, _slice long, entry long, last long")
    ordered = ends.repartition("_key").sortWithinPartitions("_key", "_slice", "entry")
    carried = ordered.mapInArrow(_carried(life), f"{of_key}, _slice long, anchor long").withColumnsRenamed({"_key": "_k", "_slice": "_s"})
    entered = slices.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s"))).select("_key", "times", "anchor")
    kept = entered.mapInArrow(_kept(life), f"{of_key}, _us long")
    return kept.select(F.col("_key").alias(key), F.timestamp_micros("_us").alias("ts"))
