"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A lookup side of at most this many rows of fixed width is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


#: Rows of an Arrow batch, where the session has Spark's own number.
BATCH_ROWS, SPARK_BATCH_ROWS = 1_000, "10000"


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Texts are wide: Arrow batches of fewer rows, unless the session says otherwise. They are held in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == SPARK_BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write go when it has ended, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Written tables of one job: they cut the lineage, survive lost executors and let AQE split skewed joins."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
        with shuffles_dropped(self.spark):
            df.write.option("compression", codec).parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark._jvm
        for tag in tags:
            path = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (few fixed-width columns) marked for broadcast if a count shows that it fits; else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ranked(df: DataFrame, keys: list[str], weight: str, out: str, scratch: Scratch, tag: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over all rows whose ``keys`` sort before this row's.

    The keys must be distinct. Rows are range-partitioned and written; the sums of whole
    partitions (one row per file) are the only thing that one task adds up.
    """
    from pyspark.sql import Window as W

    spark = scratch.spark
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.save(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), tag)
    sums = dealt.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    return (
        dealt.join(F.broadcast(sums), "_part")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .drop("_part", "_base")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast: clashing extra columns of the caller play no part."""
    have = {f.name for f in df.schema.fields}
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores behind them as keep them apart from the columns of ``df``."""
    have = {c.lower() for c in df.columns}
    tail = ""
    while any((n + tail).lower() in have for n in names):
        tail += "_"
    return [n + tail for n in names]


BINARY, LONG, INT, STRING = T.BinaryType(), T.LongType(), T.IntegerType(), T.StringType()
