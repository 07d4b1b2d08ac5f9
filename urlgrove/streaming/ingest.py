"""Feed ingestion and stateful operators on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import exists


def new_only(feed: DataFrame, ledger: DataFrame, per_source: int | None = None) -> DataFrame:
    """URLs of (url, source, ord) that the ledger (url_hash, source) lacks, once each. The limit comes before the ledger check."""
    from pyspark.sql import Window as W

    if per_source:
        feed = feed.withColumn("_n", F.row_number().over(W.partitionBy("source").orderBy("ord"))).where(F.col("_n") <= per_source).drop("_n")
    feed = feed.withColumn("url_hash", F.sha2("url", 256))
    return feed.groupBy("url_hash", "source").agg(F.min_by("url", "ord").alias("url"), F.min("ord").alias("ord")).join(ledger, ["url_hash", "source"], "left_anti")


def _named_once(spark: SparkSession, checkpoint: str) -> Callable[[], str]:
    """The query's id, which Spark keeps in the checkpoint: a new checkpoint never overwrites batches of an older one."""
    found: list[str] = []

    def name() -> str:
        if not found:
            found.append(spark.read.json(f"{checkpoint}/metadata").first()["id"])
        return found[0]

    return name


def ingest(spark: SparkSession, stream: DataFrame, score: Callable[[DataFrame], DataFrame], verdicts: str, ledger: str, checkpoint: str):
    """Start a query that scores unseen URLs and writes verdicts, then the ledger; URLs without a score stay unseen.

    A batch writes folders of its own. When it is run again after a failure, the ledger's rows
    of that batch don't count and both folders are overwritten, so each verdict is written once.
    """
    run = _named_once(spark, checkpoint)

    def batch(df: DataFrame, n: int) -> None:
        own = f"run={run()}/batch={n}"
        schema = "url_hash string, source string, run string, batch long"
        known = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(ledger) if exists(spark, ledger) else spark.createDataFrame([], schema)
        seen = known.where(~(F.col("run").eqNullSafe(F.lit(run())) & (F.col("batch") >= n))).select("url_hash", "source")
        done = score(new_only(df, seen)).where("score is not null").persist()
        done.write.mode("overwrite").parquet(f"{verdicts}/{own}")
        done.select("url_hash", "source", F.lit(run()).alias("run"), F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{ledger}/{own}")
        done.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll_sources(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], start: Callable[[str, DataFrame], object], polled_at: str) -> DataFrame:
    """Poll each source by a query of its own; one that fails doesn't stop the others.

    ``start`` takes a source's name and stream and returns the started query. Rows: source, polled_at, error (null if none).
    """
    rows, running = [], []
    for name, read in sources.items():
        try:
            running.append((name, start(name, read())))
        except Exception as e:  # noqa: BLE001  a source may fail in any way; its row says how
            rows.append((name, str(e)[:500]))
    for name, query in running:
        try:
            query.awaitTermination()
            rows.append((name, None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, str(e)[:500]))
    return spark.createDataFrame(rows, "source string, error string").withColumn("polled_at", F.lit(polled_at).cast("timestamp"))


def outbox(spark: SparkSession, stream: DataFrame, payloads: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that writes what ``payloads`` makes of each batch, once. Lists and models read inside it are those of that time."""
    run = _named_once(spark, checkpoint)

    def batch(df: DataFrame, n: int) -> None:
        payloads(df).write.mode("overwrite").parquet(f"{path}/run={run()}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch_alerts_of(watch: Callable[[], DataFrame], fired_at: str) -> Callable[[DataFrame], DataFrame]:
    """Payloads of watched phishing verdicts; the watch list is read anew for each batch."""
    from ..operators.verdicts import watch_alerts
    from ..sinks.tables import alert_payload

    return lambda v: watch_alerts(v, watch()).select("brand", "url", alert_payload(fired_at).alias("payload"))


def chat_replies_of(score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Replies to the first link of each chat text. ``score`` adds label and reason to rows with a url."""
    from ..operators.reports import reply
    from ..sources.feeds import chat_texts, first_url

    def replies(events: DataFrame) -> DataFrame:
        links = chat_texts(events).withColumn("url", first_url(F.col("text"))).where("url is not null")
        return score(links).select("replyToken", reply(F.col("label"), F.col("url"), F.col("reason")).alias("reply"))

    return replies


def ttl_suppressed(stream: DataFrame, key: str, ts: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events that come at least ``seconds`` after the last kept one of their key, as ``ttl_first`` does for tables.

    The state of a key is one timestamp; it goes when the watermark has passed its life. Rows of a batch are taken in order of time.
    """
    import pandas as pd

    def kept(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get[0] if state.exists else None), []
        for t in sorted(t for f in frames for t in f[ts].dropna()):
            micros = t.value // 1000
            if last is None or micros - last >= seconds * 1_000_000:
                out.append(t)
                last = micros
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({key: [keys[0]] * len(out), ts: out})

    rows = stream.select(key, ts).withWatermark(ts, late)
    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(kept, f"`{key}` {kind}, `{ts}` timestamp", "last long", "append", "EventTimeTimeout")


def campaign_counts(stream: DataFrame) -> DataFrame:
    """Running rollup; late rows only widen first and last."""
    return stream.groupBy("fingerprint").agg(F.count("*").alias("url_count"), F.min("checked_at").alias("first_seen"), F.max("checked_at").alias("last_seen"))


def rolling(stream: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("checked_at", late).groupBy(F.window("checked_at", size), "label").agg(F.count("*").alias("n"))
