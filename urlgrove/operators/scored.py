"""Scored verdicts stored once and read by every later question.

Rows lie in folders of days, sorted by host inside files: a question about a time reads its days, one
about a host skips the row groups of others, and no reader computes features, brands or rules again.
The contract (version and columns of the features) is written beside the rows, and a reader that expects
another is refused.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "day"


def store(verdicts: DataFrame, path: str, version: str) -> None:
    """Write ``verdicts`` (checked_at, host, ...). Days are cut by ranges of (day, host), so a large day has many files and a small one few."""
    rows = verdicts.withColumn(DAY, F.to_date("checked_at"))
    rows.repartitionByRange(DAY, "host").sortWithinPartitions(DAY, "host").write.mode("overwrite").partitionBy(DAY).parquet(f"{path}/rows")
    contract = json.dumps({"version": version, "schema": verdicts.schema.jsonValue()})
    verdicts.sparkSession.createDataFrame([(contract,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def load(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The stored rows with their ``day``."""
    contract = json.loads(spark.read.text(f"{path}/contract").first()[0])
    if contract["version"] != version:
        raise ValueError(f"the stored rows hold contract {contract['version']}, not {version}")
    from pyspark.sql.types import DateType, StructType

    schema = StructType.fromJson(contract["schema"]).add(DAY, DateType())
    return spark.read.schema(schema).parquet(f"{path}/rows")


def within(v: DataFrame, as_of: str, interval: str) -> DataFrame:
    """Rows of the time up to ``as_of``; where rows have a day, only the folders of these days are read."""
    start, end = F.expr(f"timestamp'{as_of}' - interval {interval}"), F.lit(as_of).cast("timestamp")
    if DAY in v.columns:
        v = v.where(F.col(DAY).between(F.to_date(start), F.to_date(end)))
    return v.where(F.col("checked_at").between(start, end))
