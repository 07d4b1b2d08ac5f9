"""Exact top-k inner-product search with vector-approximation files.

Every distinct vector has, beside its exact integers, an approximation: one cell number of
a byte for each component, on a grid of 256 cells between its least and largest component.
The file of cells is written once, in blocks. A first scan reads cells only: queries meet
every block in blocks of their own, and for each query a block returns the vectors whose
bound of the score can still reach the k-th surest score of the block. The k-th surest over all
blocks then leaves few candidates. Their exact vectors are fetched by row number in the
order of the bounds: first the 2 k best, then those whose bound still reaches the exact k-th
score. What is not fetched is certain to lie behind.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without an id; scores are defined between equal dimensions only, so dimensions are
searched apart. Ties go to the smaller vec_id. Rows that share an id all count as rows of their
own: a query skips its own row and no other, and each row that asks gets its own list. Equal vectors are
told apart by id only, so of those beyond the k + 1 smallest ids none can be among the k best of any
query; they stay out of the file. An empty table, or one without queries, gives no rows. Other columns of
the input, whatever their names, play no part. Scores are 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import map_groups, map_slices
from .store import Scratch, pick

CELLS = 256
#: Bounds a task holds at once: queries x vectors of a block.
AT_ONCE = 1 << 20


def approximate(vec: np.ndarray) -> tuple[int, int, bytes]:
    """Least component, width of a cell and the cell of each component, one byte each."""
    low = int(vec.min())
    width = -(-(int(vec.max()) - low + 1) // CELLS)
    return low, width, ((vec - low) // width).astype(np.uint8).tobytes()


def bounds(low: np.ndarray, width: np.ndarray, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that each query (rows) can have with each approximated vector (columns)."""
    wide = np.abs(queries).sum(1, dtype=np.float64).max() * (np.abs(low).max() + float(width.max()) * CELLS)
    slack = 0.0 if wide < 1 << 52 else wide * 2.0**-40  # floats are exact below
    least = (queries.astype(np.float64) @ cells.T.astype(np.float64)) * width + queries.sum(1, dtype=np.float64)[:, None] * low - slack
    spread = (width - 1).astype(np.float64)
    up, down = np.maximum(queries, 0).sum(1, dtype=np.float64), np.minimum(queries, 0).sum(1, dtype=np.float64)
    return least + down[:, None] * spread, least + up[:, None] * spread + 2 * slack


def scan_block(have: list[dict], ask: list[dict], k: int) -> list[dict]:
    """The candidates of one block: those that k others of it don't surely precede."""
    have.sort(key=lambda r: r["vec_id"])  # of equal bounds the smaller id comes first
    ids, rows = np.array([r["vec_id"] for r in have], np.int64), [r["row"] for r in have]
    low, width = np.array([r["low"] for r in have], np.int64), np.array([r["width"] for r in have], np.int64)
    cells = np.frombuffer(b"".join(r["cells"] for r in have), np.uint8).reshape(len(have), -1)
    numbers, copies = np.array(rows, np.int64), np.array([r["copies"] for r in have], np.int64)
    out, step = [], max(1, AT_ONCE // len(have))
    for at in range(0, len(ask), step):
        part = ask[at : at + step]
        queries = np.frombuffer(b"".join(r["cells"] for r in part), "<i8").reshape(len(part), -1)
        least, most = bounds(low, width, cells, queries)
        for q, lo, hi in zip(part, least, most, strict=True):
            own = numbers == (-1 if q["own"] is None else q["own"])
            other = np.flatnonzero(copies > own)  # of copies of the query's row all but itself
            lo, hi = lo[other], hi[other]
            if len(other) > k:
                kth = np.partition(lo, len(lo) - k)[len(lo) - k]
                last = np.flatnonzero(lo == kth)[k - 1 - int((lo > kth).sum())]  # the k-th surest, by bound and id
                stay = np.flatnonzero((hi > kth) | (hi == kth) & (np.arange(len(hi)) <= last))
                other, lo, hi = other[stay], lo[stay], hi[stay]
            out += [
                {"query_id": q["vec_id"], "query": q["row"], "row": rows[i], "vec_id": int(ids[i]), "copies": int(copies[i] - own[i]), "least": float(a), "most": float(b)}
                for i, a, b in zip(other, lo, hi, strict=True)
            ]
    return out


CANDIDATE = "query_id long, query long, row long, vec_id long, copies long, least double, most double"


def integers(df: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and ``vec``: floor(scale * x) of each component as double."""
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & (F.size("vec") > 0)).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale)))


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """One row for each id and vector with its number of copies (k + 1 at most count); of equal vectors the k + 1 smallest ids."""
    once = vectors.groupBy("vec", "vec_id").agg(F.least(F.count("*"), F.lit(k + 1).cast("long")).alias("copies"))
    nth = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    return once.withColumn("_nth", nth).where(F.col("_nth") <= k + 1).drop("_nth")


def as_cells(vectors: DataFrame) -> DataFrame:
    """The approximation of each row's ``vec``."""

    def run(part: pa.RecordBatch) -> dict:
        vec = part.column(part.schema.get_field_index("vec"))
        ends = np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))
        file = [approximate(v) for v in np.split(vec.flatten().to_numpy(zero_copy_only=False), ends[:-1])]
        keep = {c: part.column(part.schema.get_field_index(c)) for c in ("row", "vec_id", "copies", "dim")}
        return keep | {"low": [f[0] for f in file], "width": [f[1] for f in file], "cells": [f[2] for f in file]}

    return map_slices(vectors.select("row", "vec_id", "copies", "dim", "vec"), run, "row long, vec_id long, copies long, dim int, low long, width long, cells binary")


def as_bytes(vectors: DataFrame) -> DataFrame:
    """The exact ``vec`` of queries as little-endian 64-bit integers, under the names of the file of cells."""

    def run(part: pa.RecordBatch) -> dict:
        vec = part.column(part.schema.get_field_index("vec"))
        ends = np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))
        keep = {c: part.column(part.schema.get_field_index(c)) for c in ("row", "vec_id", "dim", "own")}
        return keep | {"cells": [v.astype("<i8").tobytes() for v in np.split(vec.flatten().to_numpy(zero_copy_only=False), ends[:-1])]}

    return map_slices(vectors.select("row", "vec_id", "dim", "own", "vec"), run, "row long, vec_id long, dim int, own long, cells binary")


def exact_scores(candidates: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Candidates with the inner product of the exact vectors, fetched by row number."""

    def run(part: pa.RecordBatch) -> dict:
        a, b = (part.column(part.schema.get_field_index(c)) for c in ("vec", "asked"))
        ends = np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False))
        product = a.flatten().to_numpy(zero_copy_only=False) * b.flatten().to_numpy(zero_copy_only=False)
        keep = {c: part.column(part.schema.get_field_index(c)) for c in ("query", "vec_id", "copies")}
        return keep | {"score": np.add.reduceat(product, np.append(0, ends[:-1]))}

    both = candidates.join(vectors.select("row", "vec"), "row").join(queries.select(F.col("row").alias("query"), F.col("vec").alias("asked")), "query")
    return map_slices(both.select("query", "vec_id", "copies", "vec", "asked"), run, "query long, vec_id long, copies long, score long")


def kth(df: DataFrame, score: str, k: int, out: str) -> DataFrame:
    """Per query the ``score`` and id of its k-th row, where it has as many."""
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc(score), "vec_id"))
    df = df.select("query", F.col(score).cast("double").alias(out), F.col("vec_id").alias(f"{out}_id"), nth.alias("_nth"))
    return df.where(F.col("_nth") <= k).where(F.col("_nth") == k).drop("_nth")


def reaches(mark: str) -> Column:
    """A candidate's bound still reaches the marked score, or there is none."""
    return F.col(mark).isNull() | (F.col("most") > F.col(mark)) | (F.col("most") == F.col(mark)) & (F.col("vec_id") <= F.col(f"{mark}_id"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """``vectors``: vec_id, vec (array<bigint>). ``is_query``: a condition on vec_id."""
    scratch = Scratch(vectors.sparkSession, "topk")
    asks = vectors.where(is_query).groupBy("vec_id", "vec").agg(F.count("*").alias("times"))
    vectors = scratch.save(distinct_vectors(vectors, k).withColumn("dim", F.size("vec")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # own: the row of the file that holds the query itself, if the file has it
    asks = asks.join(vectors.where(is_query).select("vec_id", "vec", F.col("row").alias("own")), ["vec_id", "vec"], "left")
    asked = scratch.save(asks.withColumn("dim", F.size("vec")).withColumn("row", F.monotonically_increasing_id()), "queries")
    file = scratch.save(as_cells(vectors), "cells")
    blocks, q_blocks = -(-file.count() // block) or 1, -(-asked.count() // query_block) or 1
    part = lambda n: F.pmod(F.xxhash64("row"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # every pair of blocks meets once; a block is bounded, so a pair is
    left = file.select("dim", part(blocks).alias("b"), every(q_blocks).alias("q"), F.lit(False).alias("asks"), "row", "vec_id", "copies", "low", "width", "cells")
    right = as_bytes(asked).select("dim", every(blocks).alias("b"), part(q_blocks).alias("q"), F.lit(True).alias("asks"), "row", "vec_id", "own", "cells")

    def pair(rows: list[dict]) -> list[dict]:
        have, ask = [r for r in rows if not r["asks"]], [r for r in rows if r["asks"]]
        return scan_block(have, ask, k) if have and ask else []

    found = scratch.save(map_groups(left.unionByName(right, allowMissingColumns=True), ["dim", "b", "q"], pair, CANDIDATE), "found")
    order = F.row_number().over(W.partitionBy("query").orderBy(F.desc("most"), "vec_id"))
    live = found.join(kth(found, "least", k, "sure"), "query", "left").where(reaches("sure")).drop("sure", "sure_id")
    live = scratch.save(live.withColumn("nth", order), "candidates")
    first = scratch.save(exact_scores(live.where(F.col("nth") <= 2 * k), vectors, asked), "first")
    rest = live.where(F.col("nth") > 2 * k).join(kth(first, "score", k, "got"), "query").where(reaches("got"))
    scored = first.unionByName(exact_scores(rest, vectors, asked))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    each = scored.select("query", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    best = each.select("query", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
    # equal rows that ask get a list each
    lists = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return best.join(lists, "query").select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    df = df.select("vec_id", "embedding") if {"vec_id", "embedding"} <= set(df.columns) else pick(df, {"vec_id": "long", "embedding": "array<double>"})
    return top_k(integers(df), F.col("vec_id") % every == 0, k)
