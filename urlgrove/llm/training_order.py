"""Training-order materialisation: fixed-stride shards in a keyed random order.

Texts are tokenised once, into sequences that are stored unpadded. Every stored sequence
has an index from 0; a keyed Feistel permutation over the next power of four, walked until
it falls below the number of sequences, gives its global slot. Slot s is record
s % per_shard of shard s // per_shard, at byte (s % per_shard) * stride: readers resume
anywhere by arithmetic. Slots are dealt by range, many shards to a task, in ``waves``, so
that only a share of the corpus lies in the shuffle beside the stored and the written
sequences; records are padded as they are written. Spark's own writer puts the shards down
(commit protocol, any file system). No task holds more than a slice of its rows, and no
global sort or counter runs through one task.

A record is slot, doc_id (-2**63 stands for null), piece, number of tokens, the ids as
integers of ``width`` bytes padded with zeros, and a line feed. Null text counts as empty;
very long texts are cut into as many sequences as they need; there are no ties, as slots are
distinct; repeated rows are sequences of their own; an empty table gives an empty table and
no shards; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import map_slices, tidy
from .byte_bpe import binary
from .packing import tokenize
from .store import Scratch, shuffles_dropped, small

HEAD = "<QqII"
NO_ID = -(1 << 63)
#: Bytes of shards that one task writes, unless there are few.
TASK_BYTES = 256 << 20


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A permutation of range(n), by cycle-walking a Feistel network over 2 * half bits."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, x = np.uint64((1 << half) - 1), index.astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(rounds):
            h = right + np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
            left, right = right, left ^ ((h ^ (h >> np.uint64(31))) & mask)
        return left << np.uint64(half) | right

    x = once(x)
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def stride(length: int, width: int = 2) -> int:
    return struct.calcsize(HEAD) + width * length + 1


def write_shards(stored: DataFrame, n: int, to: str, length: int, per_shard: int, key: int, width: int, waves: int) -> None:
    """``stored``: sequences with a dense ``index``. Each wave writes a range of the shards, so only its share is in the shuffle."""
    shards, size = -(-n // per_shard), stride(length, width)

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(), n, key))

    def run(part: pa.RecordBatch) -> dict:
        rows = part.num_rows
        out = np.zeros((rows, size), np.uint8)
        head = np.zeros(rows, np.dtype([("slot", "<u8"), ("doc", "<i8"), ("piece", "<u4"), ("n", "<u4")]))
        head["slot"], head["piece"], head["n"] = (part.column(c).to_numpy() for c in (1, 3, 4))
        head["doc"] = part.column(2).fill_null(NO_ID).to_numpy()
        out[:, : head.itemsize] = head.view(np.uint8).reshape(rows, -1)
        for k, ids in enumerate(part.column(5)):
            body = ids.as_buffer()
            out[k, head.itemsize : head.itemsize + body.size] = np.frombuffer(body, np.uint8)
        # the writer ends each record with the line feed
        return {"shard": part.column(0), "record": binary(np.ascontiguousarray(out[:, :-1]).ravel(), np.arange(rows + 1) * (size - 1))}

    placed = stored.withColumn("slot", slot("index")).withColumn("shard", F.floor(F.col("slot") / per_shard).cast("int"))
    waves = min(waves, shards)
    for wave in range(waves):
        low, high = shards * wave // waves, shards * (wave + 1) // waves
        tasks = max(1, min(high - low, n * size // waves // TASK_BYTES + int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        dealt = placed.where(F.col("shard").between(low, high - 1)).select("shard", "slot", "doc_id", "piece", "n_tokens", "ids")
        dealt = dealt.repartitionById(tasks, F.floor((F.col("shard") - low) * tasks / (high - low)).cast("int")).sortWithinPartitions("shard", "slot")
        records = map_slices(dealt, run, "shard int, record binary", 2000)
        # the text writer puts the bytes down as they are and ends each record with one line feed
        with shuffles_dropped(stored.sparkSession):
            records.select("shard", F.col("record").cast("string").alias("value")).write.mode("append").partitionBy("shard").option("lineSep", "\n").text(to)


RECORD = "doc_id long, piece int, n_tokens int, slot long, shard int, offset long, ids_crc32 long"


def read_shards(spark, to: str, length: int, per_shard: int, shards: list[int] | None = None, width: int = 2) -> DataFrame:
    """Records in stored order with their shard and byte offset, checked against the slot arithmetic. ids_crc32 is that of 32-bit ids."""
    size = stride(length, width)
    files = spark.read.schema("path string, modificationTime timestamp, length long, content binary, shard int").format("binaryFile").load(to)
    files = files.where(F.col("shard").isin(shards)) if shards is not None else files

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(content.as_buffer(), np.uint8)
                assert len(data) % size == 0, f"shard {shard} isn't a whole number of records"
                table = data.reshape(-1, size)
                head = np.ascontiguousarray(table[:, : struct.calcsize(HEAD)]).view(np.dtype([("slot", "<u8"), ("doc", "<i8"), ("piece", "<u4"), ("n", "<u4")]))[:, 0]
                assert (head["slot"] == shard * per_shard + np.arange(len(head), dtype=np.uint64)).all(), f"shard {shard} is out of order"
                crc = [zlib.crc32(row[24 : 24 + width * n].view(f"<u{width}").astype("<u4").tobytes()) for row, n in zip(table, head["n"].tolist(), strict=True)]
                doc = pa.array(head["doc"], mask=head["doc"] == NO_ID)
                columns = [doc, head["piece"].astype(np.int32), head["n"].astype(np.int32), head["slot"].astype(np.int64), np.full(len(head), shard, np.int32), np.arange(len(head)) * size, crc]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64() if k > 4 else None) for k, c in enumerate(columns)], [f.split()[0] for f in RECORD.split(", ")])
        tidy()

    return files.select("shard", "content").mapInArrow(run, RECORD)


def materialise(df: DataFrame, path: str, length: int = 512, per_shard: int = 1 << 14, key: int = 20240131, width: int = 2, waves: int = 4) -> DataFrame:
    """Write the shards to the shared folder and return them as read back. Ids that don't fit ``width`` bytes are an error."""
    spark = df.sparkSession
    scratch = Scratch(spark, "order")
    place = F.monotonically_increasing_id()
    pieces = tokenize(df, path, length, with_ids=width).select("doc_id", "piece", F.col("length").cast("int").alias("n_tokens"), "ids")
    pieces = pieces.withColumn("part", F.shiftright(place, 33)).withColumn("nth", place.bitwiseAND(F.lit((1 << 33) - 1)))
    stored = scratch.save(pieces, "sequences", "zstd")
    parts = stored.groupBy("part").agg(F.count("*").alias("rows"))  # one row a written partition
    parts = scratch.save(parts.select("part", "rows", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")), "parts")
    n = parts.agg(F.sum("rows")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], RECORD)
    indexed = stored.join(small(parts.select("part", "base")), "part").withColumn("index", F.col("base") + F.col("nth"))
    write_shards(indexed.drop("part", "nth", "base"), n, scratch.path("shards"), length, per_shard, key, width, waves)
    scratch.drop("sequences", "parts")
    return read_shards(spark, scratch.path("shards"), length, per_shard, width=width)
