"""Sharding by rendezvous hashing over weighted shards.

Each record's key is hashed with every shard's number; the shard of the greatest
-weight / ln(u), u being that hash as a number between 0 and 1, takes the record. Only key, shards
and weights decide, so a new shard takes records from the others and moves no other
record, a shard that goes gives up its own records alone, and a shard's share follows its weight.
The shards are a parameter (a few, up to thousands; a hash for each and record).

Assignment is a narrow map over built-in functions. Slots (a record's place in its shard) come
from a range partitioning of a narrow table by shard, key, checksum, size and row number: a hot key or
group of copies is cut like any other range, a range is ranked on its own, and the counts
of the ranges (a row each) are all that one task sums up.

Size is the UTF-8 bytes of the text (null: none) plus 1. Null keys are one key of their own
(the empty string); equal keys share a shard; repeated rows take a slot each, and which of two
equal rows takes which isn't told apart. Very long texts are only measured. An empty table
gives an empty one; extra columns play no part in ``sharded``, and pass through ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, pick, ranked

#: Bits of a hash that count, as hexadecimal digits: 52 fit a double.
DIGITS = 13

SEED = 11


def uniform(key: Column, shard: int, seed: int = SEED) -> Column:
    """A number between 0 and 1, both excluded, by key and shard."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{shard}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(1 << (4 * DIGITS))


def bid(key: Column, shard: int, weight: float, seed: int = SEED) -> Column:
    """What the shard offers for the key; of equal offers the smaller shard wins."""
    if not weight > 0:
        raise ValueError(f"the weight of shard {shard} must be above 0")
    return F.struct((F.lit(-float(weight)) / F.ln(uniform(key, shard, seed))).alias("score"), F.lit(-shard).alias("less"))


def best(key: Column, weights: dict[int, float], seed: int = SEED) -> Column:
    """The winning offer for the key. ``weights``: number and weight of each shard."""
    offers = [bid(key, s, w, seed) for s, w in sorted(weights.items())]
    return F.greatest(*offers) if len(offers) > 1 else offers[0]


def shard_of(offer: Column) -> Column:
    return (-offer.getField("less")).cast("int")


def assigned(df: DataFrame, key: str, weights: dict[int, float], seed: int = SEED, out: str = "shard") -> DataFrame:
    """Add the shard of each row's key."""
    return df.withColumn(out, shard_of(best(F.col(f"`{key}`"), weights, seed)))


def moved(df: DataFrame, key: str, before: dict[int, float], after: dict[int, float], seed: int = SEED) -> DataFrame:
    """source, target, records: the records that change from one shard to another when the shards do; a row a pair of shards."""
    was, now = shard_of(best(F.col(f"`{key}`"), before, seed)), shard_of(best(F.col(f"`{key}`"), after, seed))
    return df.select(was.alias("source"), now.alias("target")).where("source <> target").groupBy("source", "target").agg(F.count("*").alias("records"))


def sharded(docs: DataFrame, weights: dict[int, float], grown: dict[int, float], scratch: Scratch, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, and grown_shard: where the record is once the shards ``grown`` have joined."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    rows = pick(docs, {"doc_id": "long", "text": "string"}).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), best(key, weights, seed).alias("offer"))
    more = F.greatest("offer", *(bid(key, s, w, seed) for s, w in sorted(grown.items()))) if grown else F.col("offer")
    rows = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("offer")).alias("shard"), shard_of(more).alias("grown_shard"), F.monotonically_increasing_id().alias("row"))
    # written once: row numbers stay what they are if a later task is run again
    rows = scratch.save(rows, "rows")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).collect()  # a row a shard
    start, starts = 0, []
    for s, n in sorted((r.shard, r.n) for r in sizes):
        starts += [F.lit(s), F.lit(start).cast("long")]
        start += n
    placed = ranked(rows.withColumn("one", F.lit(1).cast("long")), ["shard", "doc_id", "text_crc32", "size", "row"], "one", "place", scratch, "dealt")
    slot = F.col("place") - F.element_at(F.create_map(*starts), F.col("shard")) if starts else F.col("place")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, key: str, weights: dict[int, float], path: str, rows_per_file: int = 100_000, seed: int = SEED) -> None:
    """``docs`` as Parquet, a folder a shard. Shards are cut into files by a rebalance that Spark splits where one is large."""
    dealt = assigned(docs, key, weights, seed, "__shard").hint("rebalance", "__shard")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("__shard").parquet(path)
