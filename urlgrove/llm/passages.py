"""Substring deduplication over paragraphs, in two widths.

Lines of at least ``min_line`` words are paragraphs with MinHash bands (``bands`` picks
their number for the wanted recall); colliding paragraphs are verified by their exact
Jaccard similarity and clustered by components. Passages that repeat inside other lines
are found by floating paragraphs: windows of 32 words chosen by winnowing, so that any
two documents which share a passage of ``PASSAGE`` words share at least one window;
their only band is the whole window, and equality of 128 bits verifies them; the words before and
after a window that an earlier copy has as well go with it, so nothing of a shared
passage is left. In each cluster that spans several documents the paragraph of the
smallest doc_id stays, all others are removals; the removals of a document are merged
to spans of words.

Copies inside one document aren't removed. Null and empty texts have no paragraphs;
rows without doc_id take no part; repeated rows share their spans; rows of one doc_id with
other texts are documents of their own, told apart by a digest of the text; ties go to the
smallest doc_id, then to that digest; very long texts are taken whole; an empty table gives
an empty table; extra columns pass through, whatever their names (but for ``n_chars``, which
follows the text). Words are runs of non-white ASCII space, A-Z in lower case. Windows are
equal if two independent 64-bit digests of their words are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import map_groups, map_rows, map_slices
from .components import components
from .near_duplicates import Forest
from .shingles import batch_words, linked, mix, permutations, shingle_hashes
from .store import Scratch, pick, ranked, small, unused

#: Every shared passage of this many words is found: the window plus the winnowing guarantee.
WINDOW, PASSAGE = 32, 50

#: The first and last chosen window of a shared passage leave at most this many of its words at each end.
REACH = PASSAGE - WINDOW

#: Words of a surrounding that are compared before all the others.
FEW = 3

#: Lines of one band that are still in different components are compared in blocks of about this many, two at a time.
LIMIT = 100


def bands(similarity: float, recall: float, rows: int = 2) -> int:
    """The least number of bands of ``rows`` tokens at which pairs of this similarity collide with at least this probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def sliding(f, h: np.ndarray, n: int) -> np.ndarray:
    """``f`` (minimum or maximum) over each run of ``n`` values."""
    size, out = 1, h
    while 2 * size <= n:
        out, size = f(out[:-size], out[size:]), 2 * size
    return f(out[: len(h) - n + 1], out[n - size :]) if size < n else out


def window_hashes(hashes: np.ndarray) -> np.ndarray:
    """One digest for each run of 32 words."""
    h, size = hashes, 1
    while size < WINDOW and len(h) > size:
        h, size = mix(h[:-size] * np.uint64(0x9E3779B97F4A7C15) + h[size:]), 2 * size
    return h if size == WINDOW else np.empty(0, np.uint64)


def second_digest(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Another digest, independent of the first, of the windows that begin at these places."""
    place = np.arange(WINDOW)
    odd = mix((place + 1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
    out = np.empty(len(at), np.uint64)
    for k in range(0, len(at), 1 << 14):
        out[k : k + (1 << 14)] = mix(hashes[at[k : k + (1 << 14), None] + place] * odd).sum(axis=1)
    return mix(out)


def windows(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text (hashes of words) the starts and keys (two 64-bit digests) of the chosen windows of 32 words: those with the least hash of some run of 19.

    All texts of 50 words or more are one array; runs and windows that lie across two texts are left out.
    """
    none = np.empty(0, np.int64), np.empty((2, 0), np.uint64)
    out, runs = [none] * len(texts), PASSAGE - WINDOW + 1
    for k, h in enumerate(texts):
        if WINDOW <= len(h) < PASSAGE:  # fewer windows than a run: the least of all
            at = np.flatnonzero((w := window_hashes(h)) == w.min())
            out[k] = at, np.stack([w[at], second_digest(h, at)])
    long = [k for k, h in enumerate(texts) if len(h) >= PASSAGE]
    if not long:
        return out
    flat, sizes = np.concatenate([texts[k] for k in long]), np.array([len(texts[k]) for k in long])
    begins = np.cumsum(sizes) - sizes
    end = np.repeat(begins + sizes, sizes)
    w = window_hashes(flat)
    least = sliding(np.minimum, w, runs)
    least[np.arange(len(least)) + PASSAGE > end[: len(least)]] = 0
    inside = np.arange(len(w)) + WINDOW <= end[: len(w)]
    at = np.flatnonzero((sliding(np.maximum, np.pad(least, runs - 1), runs) == w) & inside)
    keys = np.stack([w[at], second_digest(flat, at)])
    cut = np.searchsorted(at, np.append(begins, len(flat)))
    for n, k in enumerate(long):
        out[k] = at[cut[n] : cut[n + 1]] - begins[n], keys[:, cut[n] : cut[n + 1]]
    return out


def inner(of: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of chosen windows (text, start and key, in order) whether equal ones come twice before them (1), twice behind them (2) or both (3), at one distance of at most REACH and with no other between.

    Such a text repeats itself. What a window in its midst has in common with an equal one elsewhere, on that side, its neighbours have too:
    either the neighbour's words hold it, or the other one has the same neighbour, as windows that aren't chosen between two equal ones
    have a greater hash; a first and a second one show what stands beside the repetition and what is repeated.
    """
    out, gap = np.zeros(len(at), np.int8), np.diff(at)
    same = (of[1:] == of[:-1]) & (key[:, 1:] == key[:, :-1]).all(axis=0) & (gap <= REACH)
    thrice = same[1:] & same[:-1] & (gap[1:] == gap[:-1])
    out[2:][thrice] |= 1
    out[:-2][thrice] |= 2
    return out


def line_units(hashes: np.ndarray, sizes: np.ndarray, n_bands: int, rows: int, min_line: int) -> tuple[np.ndarray, ...]:
    """Starts, numbers of words, keys and bands (a row each) of the lines of at least ``min_line`` words."""
    starts = np.cumsum(sizes) - sizes
    starts, sizes = starts[sizes >= min_line], sizes[sizes >= min_line]
    if not len(starts):
        return starts, sizes, np.empty((2, 0), np.uint64), np.empty((0, n_bands), np.uint64)
    bounds = np.stack([starts, starts + sizes - 4], 1).ravel()  # the shingles that lie inside each line
    x = (shingle_hashes(hashes) >> np.uint64(32)).astype(np.uint32)
    x = np.append(x, np.full(5, 0xFFFFFFFF, np.uint32))
    a, b = permutations(rows * n_bands, 7)
    sig = np.stack([np.minimum.reduceat(x * p + q, bounds)[::2] for p, q in zip(a[:, 0], b[:, 0], strict=True)]).astype(np.uint64).reshape(n_bands, rows, -1)
    band = mix(mix(sig[:, 0] + (np.arange(1, n_bands + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]) + sig[:, 1:].sum(axis=1))
    nth = np.arange(len(hashes)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(hashes)]])))
    keys = []
    for odd in (np.uint64(1), np.uint64(0xC2B2AE3D27D4EB4F)):
        placed = np.append(mix(hashes * odd * (2 * nth + 1).astype(np.uint64)), np.uint64(0))
        keys.append(mix(np.bitwise_xor.reduceat(placed, np.stack([starts, starts + sizes], 1).ravel())[::2] + sizes.astype(np.uint64)))
    return starts, sizes, np.stack(keys), band.T


def paragraphs(docs: DataFrame, n_bands: int, rows: int = 2, min_line: int = 20) -> DataFrame:
    """doc_id, version, start, n_words, line, key and check (128 bits of content), for windows ``inner``, and for lines the bands b0, b1, ..."""
    names = [f"b{k}" for k in range(n_bands)]

    def run(part: pa.RecordBatch) -> dict:
        texts = batch_words(part.column(2))
        offset = np.cumsum([0, *map(len, texts)])
        counts = [[len(x.split()) for x in (text or "").encode().split(b"\n")] for text in part.column(2).to_pylist()]
        # lines lie inside their texts, so those of all texts are found in one array
        starts, n, line_keys, band = line_units(np.concatenate([np.empty(0, np.uint64), *texts]), np.array([x for c in counts for x in c], np.int64), n_bands, rows, min_line)
        of_line = np.searchsorted(offset, starts, "right") - 1
        chosen = windows(texts)
        of_window = np.repeat(np.arange(len(texts)), [len(at) for at, _ in chosen])
        at = np.concatenate([np.empty(0, np.int64), *(a for a, _ in chosen)])
        window_keys = np.concatenate([np.empty((2, 0), np.uint64), *(k for _, k in chosen)], 1)
        key = np.concatenate([window_keys, line_keys], 1)
        line = np.repeat([False, True], [len(at), len(starts)])
        of = pa.array(np.append(of_window, of_line))
        start, size = np.append(at, starts - offset[of_line]), np.append(np.full(len(at), WINDOW), n)
        out = {"doc_id": part.column(0).take(of), "version": part.column(1).take(of), "start": start.astype(np.int32), "n_words": size.astype(np.int32), "line": line}
        out["inner"] = np.append(inner(of_window, at, window_keys), np.zeros(len(starts), np.int8))
        key, band = np.ascontiguousarray(key).view(np.int64), np.concatenate([np.zeros((len(at), n_bands), np.uint64), band])
        out |= {"key": key[0], "check": key[1]}
        return out | {c: pa.array(np.ascontiguousarray(band[:, k]).view(np.int64), mask=~line) for k, c in enumerate(names)}

    unit = "doc_id long, version long, start int, n_words int, line boolean, inner byte, key long, check long, " + ", ".join(f"{c} long" for c in names)
    return map_slices(versions(docs), run, unit)


def versions(docs: DataFrame) -> DataFrame:
    """doc_id, version (digest of the text) and text of the rows that take part."""
    return pick(docs, {"doc_id": "long", "text": "string"}).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"), "text")


DOC = ["doc_id", "version"]


def texts_of(docs: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, version, text and ``asked`` (an array of the ``fields``) of the documents that ``asked`` names, each text once."""
    by_doc = asked.groupBy(*DOC).agg(F.collect_list(F.struct(*fields)).alias("asked"))
    wanted = small(asked.select(*DOC).distinct())
    return versions(docs).join(wanted, DOC, "left_semi").dropDuplicates(DOC).join(by_doc, DOC)


def line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, shingles): the packed sorted shingles of the wanted lines (key, doc_id, version, start, n_words)."""
    texts = texts_of(docs, wanted, ["key", "start", "n_words"])

    def run(cols: dict[str, list]) -> dict[str, list]:
        out = {"key": [], "shingles": []}
        for hashes, lines in zip(batch_words(cols["text"]), cols["asked"], strict=True):
            for x in lines:
                out["key"].append(x["key"])
                out["shingles"].append(np.unique(shingle_hashes(hashes[x["start"] : x["start"] + x["n_words"]])).tobytes())
        return out

    return map_rows(texts.select("text", "asked"), run, "key long, shingles binary").dropDuplicates(["key"])


def similar_lines(docs: DataFrame, lines: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Verified links (a, b) between the keys of different lines: they join every verified pair that shares a band.

    In each band group every line is compared with the smallest key, which settles groups
    of copies, then with the line that has most links so far, which settles groups of
    copies edited from one original. Lines linked in any band form components; all pairs of
    different components that are left in a band are compared, block by block.
    """
    band_names = [c for c in lines.columns if c[0] == "b" and c[1:].isdigit()]
    reps = scratch.save(lines.groupBy("key").agg(F.min(F.struct(*DOC, "start", "n_words", *band_names)).alias("r")).select("key", "r.*"), "lines")
    rows = reps.select("key", F.explode(F.array(*band_names)).alias("band"))
    held = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("pivot")).where("n > 1")
    held = scratch.save(held, "held")
    members = scratch.save(rows.join(held, "band"), "collided")
    sets = scratch.save(line_sets(docs, reps.drop(*band_names).join(members.select("key").distinct(), "key")), "sets")

    def compare(cols: dict[str, list]) -> dict[str, list]:
        pairs = zip(cols["x"], cols["y"], strict=True)
        return {"a": cols["a"], "b": cols["b"], "same": [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in pairs]}

    def verified(pairs: DataFrame, tag: str) -> DataFrame:
        full = pairs.distinct().join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
        return scratch.save(map_rows(full.select("a", "b", "x", "y"), compare, "a long, b long, same boolean").where("same").select("a", "b"), tag)

    def mixed(links: DataFrame, tag: str) -> DataFrame:
        """The members, with their component, of the bands that hold several."""
        found = components(links, scratch, f"{tag}-components")
        colored = members.join(found, F.col("key") == F.col("node"), "left").select("band", "key", "n", "pivot", F.coalesce("root", "key").alias("color"))
        colored = scratch.save(colored, f"{tag}-colored")
        several = colored.groupBy("band").agg(F.min("color").alias("c0"), F.max("color").alias("c1"), F.mode("color", True).alias("major")).where("c0 < c1")
        return scratch.save(colored.join(several.select("band", "major"), "band"), tag)

    same = verified(members.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")), "same")
    left = mixed(same, "left")
    degrees = same.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("links"))
    hubs = left.where("key <> pivot").join(degrees, "key").groupBy("band").agg(F.max_by("key", F.struct("links", "key")).alias("hub"), F.max_by("color", F.struct("links", "key")).alias("of"))
    hubs = left.join(hubs, "band").where("color <> of").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    same = same.unionByName(verified(hubs, "hubs"))
    left = mixed(same, "rest")
    # the few lines outside a band's main component meet every block; where they aren't few, all blocks meet pair by pair
    counts = scratch.save(left.groupBy("band").agg(F.count_if(F.col("color") != F.col("major")).alias("others")), "counts")
    parts = F.ceil(F.col("n") / LIMIT).cast("int")
    few, outside, every = F.col("others") <= LIMIT, F.col("color") != F.col("major"), F.sequence(F.lit(0), parts - 1)
    dealt = left.join(counts, "band").withColumn("own", F.pmod(F.xxhash64("key"), parts).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.when(few & ~outside, F.array("own")).otherwise(every)))
    low, high = F.when(few, F.col("other")).otherwise(F.least("own", "other")), F.when(few, F.lit(0)).otherwise(F.greatest("own", "other"))
    dealt = dealt.select("band", (low.cast("long") * F.lit(1 << 31) + high).alias("pair"), "key", "color").join(sets, "key")

    def block(rows: list[dict]) -> list[dict]:
        of, tree, out = [np.frombuffer(r["shingles"], np.uint64) for r in rows], Forest(), []
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                a, b = tree.root(rows[i]["color"]), tree.root(rows[j]["color"])
                if a != b and linked(of[i], of[j], percent):
                    tree.join(a, b)
                    out.append({"a": rows[i]["key"], "b": rows[j]["key"]})
        return out

    more = scratch.save(map_groups(dealt, ["band", "pair"], block, "a long, b long"), "more")
    scratch.drop("lines", "held", "collided", "sets", "left-colored", "left", "rest-colored", "rest", "counts")
    return same.unionByName(more)


REMOVAL = ["doc_id", "version", "start", "n_words", "keep_doc_id", "cluster_id"]


def merge(removals: DataFrame) -> DataFrame:
    """Spans of each document: overlapping and adjacent removals joined; the first one's cluster and keeper stand for the span. A window holds the rows of one document."""
    end = F.col("start") + F.col("n_words")
    before = W.partitionBy(*DOC).orderBy("start", F.desc("n_words"))
    fresh = F.coalesce(F.col("start") > F.max(end).over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    spans = removals.withColumn("fresh", fresh).withColumn("span", F.sum(F.col("fresh").cast("int")).over(before.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("fresh"), F.struct("start", "keep_doc_id", "cluster_id"))).alias("f")
    return spans.groupBy(*DOC, "span").agg(first, F.max(end).alias("end")).select(*DOC, "f.start", (F.col("end") - F.col("f.start")).cast("int").alias("n_words"), "f.keep_doc_id", "f.cluster_id")


def edges(windows: DataFrame) -> DataFrame:
    """(cluster_id, check, side) of the removed windows that lie within REACH of an end of their run in a document: a common passage may go on beyond it."""
    own = W.partitionBy(*DOC).orderBy("start")
    fresh = F.coalesce(F.col("start") > F.lag("start").over(own) + WINDOW, F.lit(True))
    runs = windows.select(*DOC, "start", "cluster_id", "check", fresh.cast("int").alias("fresh")).withColumn("run", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, 0)))
    of_run = W.partitionBy(*DOC, "run")
    sides = F.array_compact(F.array(F.when(F.col("start") - F.min("start").over(of_run) < REACH, -1), F.when(F.max("start").over(of_run) - F.col("start") < REACH, 1)))
    ends = runs.withColumn("sides", sides).select("cluster_id", "check", F.explode("sides").alias("side"))
    return ends.distinct()


def widened(docs: DataFrame, held: DataFrame, scratch: Scratch) -> DataFrame:
    """Removed windows with the words to their left or right that some earlier copy has as well, up to REACH: the true ends of common passages.

    Any earlier document counts, not the keeper alone, as a longer passage may be shared with a later one than it.
    Of a text that repeats itself only the outer windows are looked at (see ``inner``): rows follow the passages, not their words.
    """
    at = scratch.save(edges(held.where(LATER)), "edges")
    fields = ["start", "cluster_id", "check", "keep_doc_id", "keep_version", "side", "nr"]
    outer = F.col("inner").bitwiseAND(F.when(F.col("side") < 0, 1).otherwise(2)) == 0
    open_ends = scratch.save(held.join(at, ["cluster_id", "check"]).where(outer).select(*DOC, *fields[:-1]), "open-ends")
    # documents by number in their order: the least of many is a long, which is hashed, where a struct would be sorted
    numbers = ranked(open_ends.select(*DOC).distinct().withColumn("one", F.lit(1).cast("long")), DOC, "one", "nr", scratch, "named").drop("one")
    open_ends = open_ends.join(small(scratch.save(numbers, "numbers")), DOC)

    def run(part: pa.RecordBatch) -> dict:
        col = dict(zip(part.schema.names, part.columns, strict=True))
        asked = col["asked"].flatten()
        of = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(col["asked"]), 0).to_numpy(zero_copy_only=False))
        texts = batch_words(col["text"])
        flat, offset = np.concatenate([np.empty(0, np.uint64), *texts]).view(np.int64), np.cumsum([0, *map(len, texts)])
        left = asked.field("side").to_numpy(zero_copy_only=False) < 0
        at = asked.field("start").to_numpy(zero_copy_only=False) + offset[of]
        # from the word beside the window outwards, up to the text's end
        step, first = np.where(left, -1, 1), np.where(left, at - 1, at + WINDOW)
        size = np.clip(np.where(left, at - offset[of], offset[of + 1] - at - WINDOW), 0, REACH)
        ends = np.append(0, np.cumsum(size))
        place = np.repeat(first, size) + np.repeat(step, size) * (np.arange(ends[-1]) - np.repeat(ends[:-1], size))
        near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[place] if ends[-1] else np.empty(0, np.int64)))
        rows = pa.array(of)
        return {c: col[c].take(rows) for c in DOC} | {c: asked.field(c) for c in fields} | {"near": near}

    seen = map_slices(texts_of(docs, open_ends, fields), run, "doc_id long, version long, start int, cluster_id long, check long, keep_doc_id long, keep_version long, side int, nr long, near array<long>")
    seen = scratch.save(seen.withColumn("around", F.xxhash64("near")), "around")
    scratch.drop("edges", "open-ends", "named", "numbers")
    # equal surroundings collapse; each length of what is left is looked up in the first document that has it
    of = ["cluster_id", "check", "side"]
    group = [*of, "around"]
    firsts = scratch.save(seen.groupBy(group).agg(F.min("nr").alias("first"), F.first("near").alias("near")), "surroundings")

    def shared_up_to(rows: DataFrame, low: int, high: int, tag: str) -> tuple[DataFrame, DataFrame]:
        """Of each surrounding the longest head, of ``low`` to ``high`` words, that an earlier document has; and the heads of several documents."""
        heads = F.transform(F.sequence(F.lit(low), F.least(F.size("near"), F.lit(high))), lambda n: F.struct(n.alias("nth"), F.xxhash64(F.slice("near", 1, n)).alias("head")))
        heads = rows.where(F.size("near") >= low).select(*group, "first", F.explode(heads).alias("h")).select(*group, "first", "h.nth", "h.head")
        heads = scratch.save(heads, f"heads-{tag}")
        several = heads.groupBy(*of, "nth", "head").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most").drop("most")
        several = scratch.save(several, f"several-{tag}")
        shared = heads.join(several, [*of, "nth", "head"]).where("least < first").groupBy(group).agg(F.max("nth").alias("shared"))
        shared = scratch.save(shared, f"shared-{tag}")
        scratch.drop(f"heads-{tag}")
        return shared, several

    # a few words rule out most surroundings; a longer head is shared only where its beginning is
    short, several = shared_up_to(firsts, 1, FEW, "short")
    begins = several.where(F.col("nth") == FEW).select(*of, "head")
    going_on = firsts.where(F.size("near") > FEW).withColumn("head", F.xxhash64(F.slice("near", 1, FEW))).join(begins, [*of, "head"], "left_semi").drop("head")
    long, _ = shared_up_to(scratch.save(going_on, "going-on"), FEW + 1, REACH, "long")
    shared = short.unionByName(long).groupBy(group).agg(F.max("shared").alias("shared"))
    reach = scratch.save(firsts.select(*group, "first", F.size("near").alias("whole")).join(shared, group, "left"), "reach")
    scratch.drop("several-short", "several-long", "going-on", "surroundings", "shared-short", "shared-long")
    more = seen.drop("near").join(reach, group).withColumn("more", F.when(F.col("nr") > F.col("first"), F.col("whole")).otherwise(F.coalesce("shared", F.lit(0))))
    more = more.where("more > 0").withColumn("start", F.col("start") - F.when(F.col("side") < 0, F.col("more")).otherwise(0))
    return more.withColumn("n_words", F.lit(WINDOW) + F.col("more")).where(LATER).select(*REMOVAL)


#: A paragraph that isn't in the document whose copy stays.
LATER = "not (doc_id = keep_doc_id and version = keep_version)"


def repeated_spans(docs: DataFrame, scratch: Scratch, percent: int = 75, recall: float = 0.99) -> DataFrame:
    """doc_id and version (digest of the text), start and n_words (in words), keep_doc_id (the document whose copy stays), cluster_id."""
    units = scratch.save(paragraphs(docs, bands(percent / 100, recall)), "units")
    lines = units.where("line")
    found = components(similar_lines(docs, lines, scratch, percent), scratch, "components")
    found = found.where(F.col("node") != F.col("root"))
    # a line's cluster is the root of its key (check 0); a window's is its key and check
    place = [*DOC, "start", "n_words", "line", "inner"]
    of_lines = lines.join(found, F.col("key") == F.col("node"), "left").select(*place, F.coalesce("root", "key").alias("cluster_id"), F.lit(0).cast("long").alias("check"))
    members = units.where("not line").select(*place, F.col("key").alias("cluster_id"), "check").unionByName(scratch.save(of_lines, "line-members"))
    cluster = ["cluster_id", "check"]
    # most windows stand alone: a count of fixed width rules them out before anything is sorted
    again = scratch.save(members.groupBy(*cluster).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    again = scratch.save(members.join(small(again), cluster).distinct(), "again-members")
    scratch.drop("units", "line-members", "again")
    keepers = again.groupBy(*cluster).agg(F.min(F.struct(*DOC)).alias("keep"), F.max(F.struct(*DOC)).alias("last"))
    keepers = keepers.where("keep < last").select(*cluster, F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.version").alias("keep_version"))
    held = scratch.save(again.join(scratch.save(keepers, "keepers"), cluster), "held-members")
    scratch.drop("again-members", "keepers")
    removals = held.where(LATER)
    wide = widened(docs, held.where("not line"), scratch)
    removals = removals.select(*REMOVAL).unionByName(wide)
    return merge(removals)


WORD = re.compile(r"[^\x20\x09-\x0d]+")


def cut(text: str, spans: list[dict]) -> str:
    """``text`` without the words of the spans; white space before a removed span goes with it."""
    at = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for s in sorted(spans, key=lambda s: s["start"]):
        first, last = s["start"], min(s["start"] + s["n_words"], len(at)) - 1
        if first > last:
            continue
        out.append(text[done : at[first - 1][1] if first else 0])
        done = at[last][1]
    return "".join([*out, text[done:]])


def delete_passages(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs`` with the later copies cut out of the texts; every document stays, n_chars follows the text."""
    spans = scratch.save(repeated_spans(docs, scratch, **options), "spans")
    of, version, cuts = unused(docs, "cut_doc", "cut_version", "cut_spans")
    by_doc = spans.groupBy(F.col("doc_id").alias(of), F.col("version").alias(version)).agg(F.collect_list(F.struct("start", "n_words")).alias(cuts))
    by_doc = scratch.save(by_doc, "by-doc")
    names, fields = docs.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [cut(t, s) if s and t else t for t, s in zip(cols["text"], cols[cuts], strict=True)]
        sizes = {"n_chars": [None if t is None else len(t) for t in texts]} if "n_chars" in names else {}
        return {c: cols[c] for c in names} | {"text": texts} | sizes

    own = (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(version))
    return map_rows(docs.join(by_doc, own, "left").drop(of, version), run, fields)
