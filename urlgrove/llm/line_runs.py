"""Line deduplication by a suffix array over line-id sequences.

Lines are numbered by their content; prefix doubling sorts the suffixes of all
documents: at depth k the suffixes that share their first k lines form one LCP
interval with one rank, and depth 2k sorts by the pair of ranks k lines apart.
Suffixes alone in their interval, or cut by a line that occurs nowhere else, are final
and leave the work, so every round handles only what still repeats.

A suffix that isn't the first of its interval, in corpus order, begins a later copy. Its
deepest such interval names its source, the first suffix there; the ranks of the shallower
intervals, from deep to shallow, then give the length of the longest common prefix of the
two (binary lifting), so each match is as long as source and copy stay equal. In each
document a match that reaches beyond all matches before it is a run, from where those end;
runs of at least ``min_lines`` lines' depth are deleted. Every line of a run stands in its
source.

Ranks come from a range-partitioned running sum over distinct rank pairs, hence a line
that fills a third of the corpus is one row there, and the joins back to rows are plain
skewed joins that AQE splits.

Lines are equal if two independent 64-bit digests of their bytes are. Blank lines take no
part and are never deleted. Null and empty texts have no lines. Rows without doc_id take no
part; rows that repeat a doc_id with the same text count once, and both lose the same lines;
rows of one doc_id with other texts are documents of their own. Ties of rank are broken by
document, digest of the text and position. Very long texts are taken whole; an empty table
gives an empty table; extra columns pass through, whatever their names (but for
``n_chars``, which follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import map_rows
from .store import Scratch, pick, ranked, unused

PLACE = ["doc_id", "version", "pos"]
SOURCE = ["source_doc_id", "source_version", "source_pos"]
MATCH = "doc_id long, version long, pos int, source_doc_id long, source_version long, source_pos int, depth int, n_lines int"


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, version (digest of the text), pos among non-blank lines, line and check (128 bits of the content)."""
    docs = pick(docs, {"doc_id": "long", "text": "string"}).where("doc_id is not null and text is not null")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    ids = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.xxhash64(F.lit("check"), x).alias("check")))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("version"), ids.alias("lines"))
    return hashed.select("doc_id", "version", F.posexplode("lines").alias("pos", "x")).select(*PLACE, "x.line", "x.check")


def intervals(docs: DataFrame, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """The suffix array's repeated part by depth 1, 2, 4, ...: (depth, rows of doc_id, version, pos and the rank of the interval)."""
    lines = scratch.save(line_table(docs), "lines")
    counts = lines.groupBy("line", "check").agg(F.count("*").alias("n")).where("n > 1")
    ranks = scratch.save(ranked(counts, ["line", "check"], "n", "rank", scratch, "order-1"), "ranks-1")
    active = lines.join(ranks.select("line", "check", "rank"), ["line", "check"]).select(*PLACE, "rank")
    active, depth, out = scratch.save(active.dropDuplicates(PLACE), "active-1"), 1, []
    scratch.drop("lines", "order-1", "ranks-1")
    while True:
        out.append((depth, active))
        ahead = active.select("doc_id", "version", (F.col("pos") - depth).alias("pos"), F.col("rank").alias("next"))
        pairs = scratch.save(active.join(ahead, PLACE), f"pairs-{depth}")
        counts = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
        ranks = ranked(counts, ["rank", "next"], "n", "deeper", scratch, f"order-{2 * depth}")
        ranks = scratch.save(ranks.select("rank", "next", "deeper"), f"ranks-{2 * depth}")
        if ranks.isEmpty():
            return out
        active = scratch.save(pairs.join(ranks, ["rank", "next"]).select(*PLACE, F.col("deeper").alias("rank")), f"active-{2 * depth}")
        scratch.drop(f"pairs-{depth}", f"order-{2 * depth}", f"ranks-{2 * depth}")
        depth *= 2


def matches(levels: list[tuple[int, DataFrame]], scratch: Scratch, min_lines: int) -> DataFrame:
    """Every suffix that shares ``min_lines`` lines or more with an earlier one: its place, source place, depth and n_lines, their common prefix."""
    found: DataFrame | None = None
    deeper: DataFrame | None = None
    for depth, active in reversed(levels):
        if found is not None:  # what came from deeper intervals may go on for ``depth`` lines more
            here = active.select("doc_id", "version", F.col("pos").alias("_at"), F.col("rank").alias("_rank"))
            there = active.select(F.col("doc_id").alias(SOURCE[0]), F.col("version").alias(SOURCE[1]), F.col("pos").alias("_source_at"), F.col("rank").alias("_source_rank"))
            on = found.withColumn("_at", F.col("pos") + F.col("n_lines")).withColumn("_source_at", F.col("source_pos") + F.col("n_lines"))
            on = on.join(here, ["doc_id", "version", "_at"], "left").join(there, [*SOURCE[:2], "_source_at"], "left")
            more = F.when(F.col("_rank") == F.col("_source_rank"), depth).otherwise(0)
            found = scratch.save(on.select(*PLACE, *SOURCE, "depth", (F.col("n_lines") + more).cast("int").alias("n_lines")), f"lifted-{depth}")
        if depth < min_lines:
            continue
        first = scratch.save(active.groupBy("rank").agg(F.min(F.struct(*PLACE)).alias("first")), f"first-{depth}")
        copies = active.join(first, "rank").where(F.struct(*PLACE) != F.col("first"))
        copies = scratch.save(copies.select(*PLACE, F.col("first.doc_id").alias(SOURCE[0]), F.col("first.version").alias(SOURCE[1]), F.col("first.pos").alias(SOURCE[2])), f"copies-{depth}")
        fresh = copies if deeper is None else copies.join(deeper.select(*PLACE), PLACE, "left_anti")
        fresh = fresh.withColumn("depth", F.lit(depth)).withColumn("n_lines", F.lit(depth))
        found, deeper = fresh if found is None else found.unionByName(fresh), copies
    return found if found is not None else scratch.spark.createDataFrame([], MATCH)


def repeated_runs(docs: DataFrame, scratch: Scratch, min_lines: int = 2) -> DataFrame:
    """Runs of later copies: doc_id, version, first_line, n_lines (of non-blank lines), source_doc_id, source_line. ``min_lines`` is a power of two."""
    found = matches(intervals(docs, scratch), scratch, min_lines)
    before = W.partitionBy("doc_id", "version").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)  # the lines of one document
    end = F.col("pos") + F.col("n_lines")
    runs = found.withColumn("done", F.coalesce(F.max(end).over(before), F.lit(0))).where(end > F.col("done"))
    start = F.greatest("pos", "done")
    return runs.select("doc_id", "version", start.alias("first_line"), (end - start).alias("n_lines"), "source_doc_id", (F.col("source_pos") + start - F.col("pos")).alias("source_line"))


def delete_runs(docs: DataFrame, scratch: Scratch, min_lines: int = 2) -> DataFrame:
    """``docs`` without the later copies; documents of which no line is left go; n_chars follows the text."""
    runs = scratch.save(repeated_runs(docs, scratch, min_lines), "runs")
    of, version, own = unused(docs, "cut_doc", "cut_version", "cut_runs")
    by_doc = runs.groupBy(F.col("doc_id").alias(of), F.col("version").alias(version)).agg(F.collect_list(F.struct("first_line", "n_lines")).alias(own))
    joined = docs.join(scratch.save(by_doc, "by-doc"), (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(version)), "left").drop(of, version)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts, gone = [], set()
        for k, (text, cut) in enumerate(zip(cols["text"], cols[own], strict=True)):
            if cut:
                drop, kept, at = {p for r in cut for p in range(r["first_line"], r["first_line"] + r["n_lines"])}, [], 0
                for line in text.split("\n"):
                    blank = not line.strip(" ")
                    if blank or at not in drop:
                        kept.append(line)
                    at += not blank
                if not any(x.strip() for x in kept):
                    gone.add(k)
                text = "\n".join(kept)
            texts.append(text)
        sizes = {"n_chars": [None if t is None else len(t) for t in texts]} if "n_chars" in names else {}
        out = {c: cols[c] for c in names} | {"text": texts} | sizes
        return {c: [v for k, v in enumerate(out[c]) if k not in gone] for c in names}

    return map_rows(joined, run, fields)
