"""The whole ingestion step of a feed: verdicts, campaigns, alerts, poll counts and ledger of a batch under one batch id.

Every table lies in folders ``{root}/{table}/run=R/batch=N``. A batch writes its folder in each table, the ledger last, and
then its row in ``commits``; readers see committed batches only. Spark runs a batch that wasn't finished again, under the
same number and on the same files, and its folders are written over, so wherever a run dies each URL
ends in each table once. A run is the query's id in its checkpoint: a new checkpoint never touches folders of an older one.

The ledger of seen (url_hash, source) is kept by the first digits of the hash. A batch reads the buckets that its own
hashes fall into and no others, and joins on the keys, whatever the ledger's size. ``compact`` rewrites the
many small files of old batches.

The scorer is asked for once a batch: a promoted model takes over between two batches of a running stream while
ledger and campaigns go on, no row is scored by both, and every row says by which.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_parts
from ..operators import verdicts as V
from ..sinks.tables import alert_payload
from ..tables import exists, temporary
from .ingest import _named_once, new_only

#: Hexadecimal digits of a ledger's bucket; 256 buckets.
BUCKET_DIGITS = 2

SCHEMAS = {
    "verdicts": "url_hash string, source string, url string, score double, label string, closest_domain string, reason string, checked_at timestamp, model_version string",
    "campaigns": "fingerprint string, url_count long, first_seen timestamp, last_seen timestamp",
    "alerts": "brand string, url string, payload string",
    "polls": "source string, polled_at timestamp, ingested long, offered long",
    "ledger": "url_hash string, source string",
    "commits": "model_version string, rows long",
}

Scorer = Callable[[DataFrame], DataFrame]


def _read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """All rows of a table with run and batch, committed or not."""
    keys = "run string, batch long" + (", bucket string" if table == "ledger" else "")
    schema = f"{SCHEMAS[table]}, {keys}"
    if not exists(spark, f"{root}/{table}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of a table's committed batches."""
    return _read(spark, root, table).join(_read(spark, root, "commits").select("run", "batch"), ["run", "batch"], "left_semi")


def running_campaigns(spark: SparkSession, root: str) -> DataFrame:
    """Campaigns over all committed batches; batches may come in any order."""
    c = committed(spark, root, "campaigns")
    return c.groupBy("fingerprint").agg(F.sum("url_count").alias("url_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def bucket(url_hash: str = "url_hash"):
    return F.substring(url_hash, 1, BUCKET_DIGITS)


def seen_before(spark: SparkSession, root: str, hashes: DataFrame, run: str | None = None, batch: int = 0) -> DataFrame:
    """(url_hash, source) of the committed ledger in the buckets of ``hashes``: at most 16**BUCKET_DIGITS names go into the filter.

    What ``run`` wrote in this batch or a later one doesn't count: a batch that was committed but not finished is run again and must find the same.
    """
    buckets = [r[0] for r in hashes.select(bucket()).distinct().collect()]
    again = F.col("run").eqNullSafe(F.lit(run)) & (F.col("batch") >= batch)
    return committed(spark, root, "ledger").where(F.col("bucket").isin(buckets) & ~again).select("url_hash", "source")


def write_batch(tables: dict[str, DataFrame], root: str, run: str, batch: int, version: str, wrote: Callable[[str], None] = lambda table: None) -> None:
    """Write a batch's rows of each table, in the order given, and commit them. Written again, it stands there once."""
    spark = SparkSession.active()
    own, rows = f"run={run}/batch={batch}", 0
    for name, df in tables.items():
        out = df.select(*(c.split()[0] for c in SCHEMAS[name].split(", ")))
        if name == "ledger":
            out.withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/{own}")
        else:
            out.write.mode("overwrite").parquet(f"{root}/{name}/{own}")
        wrote(name)
    if "verdicts" in tables:
        rows = spark.read.schema(SCHEMAS["verdicts"]).parquet(f"{root}/verdicts/{own}").count()
    spark.createDataFrame([(version, rows)], SCHEMAS["commits"]).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/{own}")
    wrote("commits")


def tables_of(scored: DataFrame, feed: DataFrame, watch: DataFrame, at: str) -> dict[str, DataFrame]:
    """What a batch adds to each table. ``scored`` has the columns of verdicts, ``feed`` the offered rows (url, source).

    Feeds add only phishing verdicts to campaigns. Sources without a new URL have their row in polls.
    """
    parts = url_parts(scored).select("url", "label", "closest_domain", "checked_at", "host", "path")
    alerts = V.watch_alerts(scored, watch).select("brand", "url", alert_payload(at).alias("payload"))
    got = scored.groupBy("source").agg(F.count("*").alias("ingested"))
    polls = feed.groupBy("source").agg(F.count("*").alias("offered")).join(got, "source", "left")
    polls = polls.select("source", F.lit(at).cast("timestamp").alias("polled_at"), F.coalesce("ingested", F.lit(0)).alias("ingested"), "offered")
    return {"verdicts": scored, "campaigns": V.campaigns(parts, ["phishing"]), "alerts": alerts, "polls": polls, "ledger": scored}


def ingest_feeds(
    spark: SparkSession, stream: DataFrame, root: str, checkpoint: str, scorer: Callable[[], tuple[str, Scorer]], watch: Callable[[], DataFrame],
    now: Callable[[], str], per_source: int | None = 100, wrote: Callable[[int, str], None] = lambda batch, table: None, trigger: dict | None = None,
):
    """Start the query over ``stream`` (url, source, ord).

    ``scorer`` gives a version and a function that adds score, label, closest_domain and reason; rows left without a score stay
    unseen and are tried again when a feed offers them. ``per_source`` cuts a batch's offer before the ledger is asked. ``watch``
    and ``now`` are read anew for each batch; ``wrote`` is told of each table that a batch has written.
    """
    run = _named_once(spark, checkpoint)

    def batch(df: DataFrame, n: int) -> None:
        version, score = scorer()
        at = now()
        df = df.persist()
        hashes = df.select(F.sha2("url", 256).alias("url_hash"))
        fresh = new_only(df, seen_before(spark, root, hashes, run(), n), per_source)
        with temporary(spark):
            scored = score(fresh).where("score is not null").withColumns({"checked_at": F.lit(at).cast("timestamp"), "model_version": F.lit(version)}).persist()
            write_batch(tables_of(scored, df, watch(), at), root, run(), n, version, lambda table: wrote(n, table))
        scored.unpersist()
        df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def promoted_scorer(spark: SparkSession, path: str, features: list[str], apply: Callable[[list, DataFrame], DataFrame]) -> Callable[[], tuple[str, Scorer]]:
    """A scorer that follows the pointer of promoted models. A model whose contract doesn't hold isn't taken; the last good one goes on."""
    from ..plans.training import promoted

    held: dict[str, tuple[str, list]] = {}

    def now() -> tuple[str, Scorer]:
        version = spark.read.json(f"{path}/current").first()["version"]
        if not held or held["now"][0] != version:
            try:
                held["now"] = (version, promoted(spark, path, features))
            except ValueError:
                if not held:
                    raise
        version, models = held["now"]
        return version, lambda df: apply(models, df)

    return now


def compact(spark: SparkSession, root: str) -> int:
    """Rewrite the committed ledger as one file a bucket and remove the folders that it replaces; returns how many. No stream may be running.

    The last batch of each run stays as it is, as Spark may run it again. The new folder is committed before an
    old one goes, and a pair that stands twice counts once.
    """
    rows = committed(spark, root, "ledger")
    last = rows.groupBy("run").agg(F.max("batch").alias("_last"))
    rows = rows.join(last, "run").where((F.col("batch") < F.col("_last")) | F.col("run").startswith("compact-"))
    old = [(r.run, r.batch) for r in rows.select("run", "batch").distinct().collect()]  # a row a batch
    if not old:
        return 0
    pairs = rows.select("url_hash", "source").distinct()
    write_batch({"ledger": pairs}, root, f"compact-{uuid.uuid4().hex}", 0, "")
    for run, batch in old:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/ledger/run={run}/batch={batch}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(old)
