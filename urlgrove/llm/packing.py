"""Best-fit-decreasing packing of token pieces into fixed-capacity sequences.

``tokenize`` cuts each document's ids into pieces of at most ``capacity``; ``best_fit``
packs any table of pieces. Best fit only looks at lengths, so the placement is decided
on the histogram of lengths, which has at most ``capacity`` rows however large the
corpus is: ``plan`` fills whole runs of equal bins at once, and a segment tree over the
remaining capacities finds the tightest open bin in logarithmic time. The plan gives,
for each length, which ranks go to which bins. Ranks within a length come from a
distributed running sum over salted buckets, so a length that holds a third of all
pieces is spread like any other. The pieces get their places by a join with the plan
(bounded by the capacity, checked, never by the rows).

Null text counts as empty: its document is the single id 0. Very long texts are cut into
pieces, in any number. Pieces of equal length are ranked by document, piece and digest, so
ties don't change the packing. Repeated rows, and rows of one doc_id with other texts, are
packed each. Rows with a null doc_id are packed too. An empty table gives an empty table.
Extra columns play no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .byte_bpe import binary
from .store import Scratch, pick, ranked
from .tokens import chunks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: int = 0) -> DataFrame:
    """One row per piece; ``with_ids`` adds the packed ids themselves, as unsigned integers of so many bytes (2 or 4)."""

    def run(part: pa.RecordBatch) -> dict:
        ids, at = chunks(path, False).encode(part.column(1))
        sizes = np.diff(at) + 1
        ends = np.cumsum(sizes)
        flat, last = np.empty(ends[-1], "<u4"), np.zeros(ends[-1], bool)
        last[ends - 1] = True
        flat[last], flat[~last] = end_id, ids
        n = -(-sizes // capacity)  # pieces of each document
        doc = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        start = piece * capacity
        length = np.minimum(capacity, sizes[doc] - start)
        stops = np.cumsum(length)
        data = memoryview(flat.tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((stops - length).tolist(), stops.tolist(), strict=True)]
        out = {"doc_id": part.column(0).take(pa.array(doc)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": crc}
        if with_ids == 2 and len(flat) and flat.max() > 0xFFFF:
            raise ValueError("ids above 65,535 don't fit 16 bits")
        return out | ({"ids": binary(flat.astype(f"<u{with_ids}"), np.append(0, stops))} if with_ids else {})

    return map_slices(pick(df, {"doc_id": "long", "text": "string"}), run, PIECE + ", ids binary" * bool(with_ids), 1000, 4 << 20)


class OpenBins:
    """Runs of equal bins by remaining capacity, under a segment tree of which capacities are open."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # (first bin, number of bins)

    def _mark(self, room: int, value: int) -> None:
        at = room + self.size
        while at and self.tree[at] != value:
            self.tree[at] = value
            at //= 2
            value = self.tree[2 * at] | self.tree[2 * at + 1] if at else 0

    def push(self, room: int, run: tuple[int, int]) -> None:
        self.runs[room].append(run)
        self._mark(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, 0)
        return run

    def tightest(self, length: int) -> int | None:
        """The smallest open remaining capacity of at least ``length``."""
        at = length + self.size
        if self.tree[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, ranks, first_bin, per_bin, at): rank r of a length goes to bin
    first_bin + (r - first_rank) // per_bin, at offset at + ((r - first_rank) % per_bin) * length."""
    bins, out, used = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            fresh = room is None
            room = capacity if fresh else room
            fits = room // length
            first, n = (used, -(-left // fits)) if fresh else bins.pop(room)
            used += n if fresh else 0
            full = min(n, left // fits)  # bins that take as many as fit
            at = capacity - room
            if full:
                out.append((length, rank, full * fits, first, fits, at))
                rank, left = rank + full * fits, left - full * fits
                if room - fits * length:
                    bins.push(room - fits * length, (first, full))
                first, n = first + full, n - full
            if n and left:  # then fewer than fits are left, and one bin takes them
                out.append((length, rank, left, first, left, at))
                if room - left * length:
                    bins.push(room - left * length, (first, 1))
                first, n, left = first + 1, n - 1, 0
            if n:
                bins.push(room, (first, n))
    return out


PLAN = "length long, first_rank long, ranks long, first_bin long, per_bin long, at long"


def best_fit(pieces: DataFrame, scratch: Scratch, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to written ``pieces`` (length from 1 to capacity)."""
    spark = scratch.spark
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(1 << 20)))
    # few rows a bucket: as many buckets of a length as pieces need, at most one a salt
    size = F.greatest(F.lit(1), F.ceil(F.col("_n") / 1_000)).cast("long")
    counts = pieces.groupBy("length").agg(F.count("*").alias("_n"))
    rows = counts.collect()  # at most `capacity` rows: the domain of length
    assert all(1 <= r.length <= capacity for r in rows), "piece lengths must be from 1 to the capacity"
    lengths = spark.createDataFrame([(r.length, r._n) for r in rows], "length long, _n long")
    salted = salted.join(F.broadcast(lengths), "length").withColumn("_bucket", F.pmod("_salt", size)).drop("_salt", "_n")
    from pyspark.sql import Window as W

    buckets = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    base = ranked(buckets, ["length", "_bucket"], "_rows", "_before", scratch, "buckets")
    first = {}
    total = 0
    for r in sorted(rows, key=lambda r: r.length):
        first[r.length], total = total, total + r._n
    starts = spark.createDataFrame(list(first.items()), "length long, _first long")
    base = base.join(F.broadcast(starts), "length").select("length", "_bucket", (F.col("_before") - F.col("_first")).alias("_before"))
    inner = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    placed = salted.withColumn("_rank", F.row_number().over(inner) - 1).join(base, ["length", "_bucket"])
    placed = placed.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_bucket")
    layout = spark.createDataFrame(plan({r.length: r._n for r in rows}, capacity), PLAN)
    by_length = layout.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "ranks", "first_bin", "per_bin", "at"))).alias("_plan"))
    found = F.filter("_plan", lambda p: (p.first_rank <= F.col("_rank")) & (F.col("_rank") < p.first_rank + p.ranks))[0]
    placed = placed.join(F.broadcast(by_length), "length").withColumn("_p", found).drop("_plan")
    nth = F.col("_rank") - F.col("_p.first_rank")
    return placed.select(
        *pieces.columns,
        (F.col("_p.first_bin") + F.floor(nth / F.col("_p.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("_p.at") + F.pmod(nth, F.col("_p.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(df: DataFrame, path: str, capacity: int = 2048) -> DataFrame:
    scratch = Scratch(df.sparkSession, "pack")
    pieces = scratch.save(tokenize(df, path, capacity), "pieces")
    return best_fit(pieces, scratch, capacity)
