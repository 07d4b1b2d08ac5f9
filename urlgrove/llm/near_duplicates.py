"""Near-duplicate documents by a chosen-path set-similarity join.

Documents with equal shingle sets collapse first; one document stands for each set and
carries a signature of minwise tokens. Each of several independent trees starts at a
root that holds everything and branches on chosen coordinates of the signature: the
documents of a child agree on the chosen token. A node of at most ``limit`` members is
compared exhaustively inside one task: signatures rule out the clearly dissimilar, the
rest are confirmed on their full sets, and only a spanning set of links leaves the
task. A larger node is first compared in random groups of ``limit`` that share pivots:
the members closest to the node's modal signature, so that copies edited from one
original, which link with it more than with each other, join at once; nodes whose members
all lie in one component then go. Of the others, those of up to ``blocks`` blocks are compared block
by block, the larger ones branch again, and at the last level all that is left is
compared block by block, so no candidate is ever capped.

The table is read twice: for the sketch, and once the first level has named its candidates, for
the texts of these and of the large nodes' members, which all later levels confirm from.

Recall: a pair at similarity s reaches the same node of a tree with the survival
probability of a branching process of mean ``branch * s``; at 0.75, 8 trees of branch 2
miss 1.5e-10 of pairs at level 1 and 3e-4 at level 3 (``miss``). The signature filter at
``floor`` misses 1e-4 of pairs at exactly 0.75 with 64 tokens.

Null or empty texts have an empty set, stand alone and are kept. Rows without doc_id
take no part and are kept, with a null component. Rows that repeat a doc_id are judged by
their texts: equal rows stay or go together, and of rows with other texts each has the
component of its own text. Ties go to the smallest doc_id, then to the text's digest. Very
long texts are taken whole; an empty table gives an empty table; extra columns pass through,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import bounds, map_groups, map_rows, map_runs, map_slices, slices
from .components import components
from .shingles import linked, minhash, shingle_sets
from .store import Scratch, pick, small, unused


#: Digests of documents that are broadcast to find their texts.
KEYS = 2_000_000


def miss(similarity: float, trees: int, branch: int, depth: int) -> float:
    """The share of pairs that no tree brings together at ``depth``."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - (1 - similarity * alive) ** branch
    return (1 - alive) ** trees


def sketch(df: DataFrame, tokens: int) -> DataFrame:
    """doc_id, version (digest of the text), n_shingles, set_key (a 128-bit digest of the set) and sig (packed minwise tokens); null for empty sets."""

    def run(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(part.column(2))
        return {
            "doc_id": part.column(0),
            "version": part.column(1),
            "n_shingles": [len(s) for s in sets],
            "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "sig": [minhash(s, tokens).tobytes() if len(s) else None for s in sets],
        }

    return map_slices(df.select("doc_id", "version", "text"), run, "doc_id long, version long, n_shingles long, set_key binary, sig binary")


class Forest(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            self[x] = x = self[self[x]]
        return x

    def join(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def packed(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of values of one width, a row each."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


#: Groups of up to so many members are compared together, and so many pairs at a time.
SMALL_GROUP, PAIRS = 32, 1 << 14


def similar(floor: float):
    """Function of whole groups (g1, g2), sorted by id: members whose signatures agree with a member of another component, by cluster.

    ``mates`` are the packed ids that a member is to be confirmed with. Roots are coordinates of the signature: a
    pair that also meets at an earlier root (``mask``: those compared exhaustively) is left to that root.
    """

    def run(batch: pa.RecordBatch) -> list[dict]:
        of = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
        once = bounds(of("g1"), of("g2"), of("id"))[:-1]
        g1, g2, ids, colors, k, mask = (of(c)[once] for c in ("g1", "g2", "id", "color", "k", "mask"))
        sigs = packed(batch.column(batch.schema.get_field_index("sig")), "<u4")[once]
        at, roots, least = bounds(g1, g2), np.arange(k.max(), dtype=np.int64), floor * sigs.shape[1]

        def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Of pairs, whether no earlier root has them."""
            if not len(roots) or not len(a):
                return np.ones(len(a), bool)
            same = sigs[a, : len(roots)] == sigs[b, : len(roots)]
            return ~(same & (mask[a].astype(np.int64)[:, None] >> roots & 1 == 1) & (roots < k[a][:, None])).any(axis=1)

        trees, mates = Forest(), {}

        def joined(a: np.ndarray, b: np.ndarray) -> None:
            """Pairs sorted by their first member."""
            heads = bounds(a)
            for x, y in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                i = int(a[x])
                mates[i] = ids[b[x:y]].tobytes()
                own = trees.root(i)
                for j in b[x:y].tolist():
                    if trees.root(j) != own:
                        trees.join(own, j)
                        own = trees.root(own)

        size = np.diff(at)
        for n in np.unique(size[(size > 1) & (size <= SMALL_GROUP)]).tolist():
            i, j = np.triu_indices(n, 1)
            starts = at[:-1][size == n]
            for c in range(0, len(starts), step := max(1, PAIRS // len(i))):
                a, b = ((starts[c : c + step, None] + x).ravel() for x in (i, j))
                a, b = (x[colors[a] != colors[b]] for x in (a, b))
                near = np.add.reduce((sigs[a] == sigs[b]).view(np.uint8), axis=1, dtype=np.uint16) >= least
                a, b = a[near], b[near]
                new = first(a, b)
                joined(a[new], b[new])
        for g in np.flatnonzero(size > SMALL_GROUP).tolist():
            start, stop = int(at[g]), int(at[g + 1])
            tokens = np.ascontiguousarray(sigs[start:stop].T)
            for i in range(stop - start - 1):
                agree = np.add.reduce((tokens[:, i + 1 :] == tokens[:, i : i + 1]).view(np.uint8), axis=0, dtype=np.uint16)
                b = start + i + 1 + np.flatnonzero((agree >= least) & (colors[start + i + 1 : stop] != colors[start + i]))
                a = np.full(len(b), start + i)
                new = first(a, b)
                joined(a[new], b[new])
        clusters, found = {}, []
        for i in sorted(trees):
            clusters.setdefault(trees.root(i), []).append(i)
        for members in clusters.values():
            name = xxhash.xxh3_64_intdigest(b"|".join(ids[i].tobytes() + mates.get(i, b"") for i in members)) - (1 << 63)
            found += [{"cluster": name, "id": ids[i].item(), "color": colors[i].item(), "mates": mates.get(i, b"")} for i in members]
        return found

    return run


def modal(rows: list[dict]) -> list[dict]:
    """Group function: the most frequent minwise token at each coordinate, over a node's sampled members."""
    sigs = np.frombuffer(b"".join(r["sig"] for r in rows), "<u4").reshape(len(rows), -1)
    often = []
    for column in sigs.T:
        tokens, n = np.unique(column, return_counts=True)
        often.append(tokens[n.argmax()])
    return [{"node": rows[0]["node"], "mode": np.array(often, "<u4").tobytes()}]


def pivots_of(signed: DataFrame, scratch: Scratch, tag: str, of_node: int, limit: int) -> DataFrame:
    """node and the ids of its ``of_node`` members that agree best with its modal signature.

    ``signed`` is (node, id, n, sig). The mode comes from one random group of about ``limit`` members; it only
    orders the members, and which of them are pivots changes the work, never the links that are confirmed.
    """
    drawn = signed.where(F.pmod(F.xxhash64("id", F.lit("mode")), F.ceil(F.col("n") / limit).cast("long")) == 0)
    modes = scratch.save(map_groups(drawn.select("node", "sig"), ["node"], modal, "node long, mode binary"), f"modes-{tag}")

    def agree(cols: dict[str, list]) -> dict[str, list]:
        x, y = (np.frombuffer(b"".join(cols[c]), "<u4").reshape(len(cols[c]), -1) for c in ("sig", "mode"))
        return {"node": cols["node"], "id": cols["id"], "agree": (x == y).sum(axis=1).tolist()}

    scored = map_rows(signed.join(small(modes), "node").select("node", "id", "sig", "mode"), agree, "node long, id long, agree int")
    best = F.row_number().over(W.partitionBy("node").orderBy(F.desc("agree"), "id"))
    return scored.withColumn("nth", best).where(F.col("nth") <= of_node).select("node", "id")


#: Shingles of a cluster that are numbered together.
NUMBERED = 8_000_000


def overlaps(sets: list[np.ndarray], percent: int):
    """Function of a set's place and others' that tells which of them it links with. Where many are asked for, shingles are numbered once and looked up."""
    size, codes, has = np.array([len(s) for s in sets]), [], np.empty(0, bool)

    def run(i: int, others: np.ndarray) -> np.ndarray:
        nonlocal codes, has
        low, high = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
        out = 100 * low >= percent * high
        asked = np.flatnonzero(out)
        if len(asked) < 8 or size.sum() > NUMBERED:
            out[asked] = [linked(sets[i], sets[j], percent) for j in others[asked].tolist()]
            return out
        if not codes:
            known, flat = np.unique(np.concatenate(sets), return_inverse=True)
            codes, has = np.split(flat, np.cumsum(size)[:-1]), np.zeros(len(known), bool)
        has[codes[i]] = True
        both = np.array([np.count_nonzero(has[codes[j]]) for j in others[asked].tolist()])
        has[codes[i]] = False
        out[asked] = 100 * both >= percent * (size[i] + size[others[asked]] - both)
        return out

    return run


def confirm(percent: int):
    """Function of whole clusters, sorted by id: links between mates, confirmed on full sets, that span each; members of one component count as linked."""

    def run(batch: pa.RecordBatch) -> list[dict]:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        of = lambda name: column(name).to_numpy(zero_copy_only=False)
        once = bounds(of("cluster"), of("id"))[:-1]
        text = batch.schema.get_field_index("text")
        sets = [s for part in slices(batch) for s in shingle_sets(part.column(text))]
        cluster, ids, colors = (of(c)[once] for c in ("cluster", "id", "color"))
        at, out, mates = bounds(cluster), [], column("mates")
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own, color = ids[a:b], np.unique(colors[a:b], return_inverse=True)[1]
            links = overlaps([sets[k] for k in once[a:b].tolist()], percent)
            for i in range(b - a):
                with_ = np.searchsorted(own, np.frombuffer(mates[int(once[a + i])].as_py(), np.int64))
                with_ = with_[color[with_] != color[i]]
                for j in with_[links(i, with_)].tolist() if len(with_) else ():
                    if color[j] != color[i]:
                        color[color == color[j]] = color[i]
                        out.append({"a": own[i].item(), "b": own[j].item()})
        return out

    return run


def classes(docs: DataFrame, scratch: Scratch, percent: int = 75, tokens: int = 64, trees: int = 8, branch: int = 2, limit: int = 100, block: int = 1000, blocks: int = 4, depth: int = 8, floor: float = 0.53, pivots: int = 4) -> DataFrame:
    """doc_id, version, n_shingles and ``keep``: the least (doc_id, version) of the row's component."""
    docs = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("version", F.xxhash64("text"))
    drawn = scratch.save(sketch(docs, tokens), "sketch")
    # one document stands for each set, under a number of its own: a doc_id may bear several texts
    sets = drawn.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "version")).alias("first"), F.first("sig").alias("sig"))
    sets = scratch.save(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    reps = sets.select("id", "sig")
    token = lambda c: F.expr(f"substring(sig, 4 * ({c}) + 1, 4)")
    roots = [F.xxhash64(F.lit(k // branch), F.lit(k), token(k)) for k in range(trees * branch)]
    rows = reps.select("id", F.col("id").alias("color"), F.posexplode(F.array(*roots)).alias("k", "node"))
    fresh = {"k": F.lit(0), "mask": F.lit(0).cast("long")}
    texts = found = None

    def texts_of(ids: DataFrame) -> DataFrame:
        """id and text: the only reading of the table after the sketch."""
        asked = scratch.save(ids.distinct().join(sets.select("id", F.col("first.doc_id").alias("doc_id"), F.col("first.version").alias("version")), "id"), "asked")
        some, key, both = docs, F.xxhash64("doc_id", "version"), small(asked)
        if both is asked and (keys := small(digests := asked.select(key.alias("key")).distinct(), KEYS)) is not digests:
            # too many for a broadcast of both columns: one of their digest still keeps the other texts out of the shuffle
            some = docs.join(keys, key == F.col("key"), "left_semi")
        return scratch.save(some.join(both, ["doc_id", "version"]).select("id", "text").dropDuplicates(["id"]), "texts")

    def links_of(groups: DataFrame, tag: str, wide: DataFrame | None = None) -> DataFrame:
        """Confirmed links inside groups (g1, g2, id, color, k, mask, sig) of bounded size."""
        nonlocal texts
        near = map_runs(groups, ["g1", "g2"], similar(floor), "cluster long, id long, color long, mates binary", ["id"])
        near = scratch.save(near.distinct(), f"near-{tag}")
        if texts is None:  # the later steps' rows are those of wide nodes
            texts = texts_of(near.select("id").unionByName(wide.select("id")))
        wanted = small(scratch.save(near.select("id").distinct(), f"wanted-{tag}"))
        full = near.join(texts.join(wanted, "id", "left_semi"), "id").select("cluster", "id", "color", "mates", "text")
        return scratch.save(map_runs(full, ["cluster"], confirm(percent), "a long, b long", ["id"]), f"links-{tag}")

    def colors(links: DataFrame, tag: str) -> DataFrame:
        """node and root of all links so far: new links are between the roots of the old ones."""
        if found is None:
            return scratch.save(components(links, scratch, f"components-{tag}"), f"colors-{tag}")
        if links.isEmpty():
            return found
        of = lambda side: small(found.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")))
        new = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        more = scratch.save(components(new, scratch, f"components-{tag}"), f"more-{tag}")
        moved = found.join(small(more.select(F.col("node").alias("root"), F.col("root").alias("up"))), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        return scratch.save(moved.unionByName(more.join(small(found.select("node")), "node", "left_anti")), f"colors-{tag}")

    for level in range(1, depth + 1):
        nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("of"), F.min("color").alias("c0"), F.max("color").alias("c1"))
        # nodes with the same members are compared once
        nodes = scratch.save(nodes.where("n > 1 and c0 < c1").groupBy("n", "of").agg(F.min("node").alias("node")).select("node", "n"), f"nodes-{level}")
        members = scratch.save(rows.join(nodes, "node"), f"members-{level}")
        # the roots of each document whose nodes are compared exhaustively: a pair is left to the first that it shares
        if level == 1:
            first_of = members.where(F.col("n") <= block * blocks).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
            first_of = scratch.save(first_of, "roots")
            masked = lambda df: df.join(first_of, "id", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long")))  # noqa: B023, E731
        else:
            masked = lambda df: df.withColumns(fresh)
        close, wide = masked(members.where(F.col("n") <= limit)), members.where(F.col("n") > limit)
        if level == 1:  # below, rows carry their signatures
            close, wide = close.join(reps, "id"), scratch.save(wide.join(reps, "id"), "wide")
        parts = F.ceil(F.col("n") / limit).cast("long")
        # of the large nodes, the groups of two for each document; the rest of their work comes below
        turn = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "node"))
        two = wide.withColumn("turn", turn).where("turn <= 2").drop("turn")
        dealt = close.unionByName(two.withColumns(fresh))
        dealt = dealt.select(F.col("node").alias("g1"), F.pmod(F.xxhash64("id", F.lit(level)), parts).alias("g2"), "id", "color", "k", "mask", "sig")
        some = not wide.isEmpty()
        if some:
            chosen = small(scratch.save(pivots_of(wide.select("node", "id", "n", "sig"), scratch, str(level), pivots, limit), f"pivots-{level}"))
            chosen = wide.join(chosen, ["node", "id"]).withColumns(fresh)
            chosen = chosen.select(F.col("node").alias("g1"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("g2"), "id", "color", "k", "mask", "sig")
            dealt = dealt.unionByName(chosen)
        found = colors(links_of(dealt, str(level), wide), str(level))
        if not some:
            break
        large = wide.drop("color").join(small(found.select(F.col("node").alias("id"), "root")), "id", "left").select("node", "id", "n", "k", F.coalesce("root", "id").alias("color"), "sig")
        mixed = large.groupBy("node").agg(F.min("color").alias("c0"), F.max("color").alias("c1"), F.mode("color", True).alias("major")).where("c0 < c1").select("node", "major")
        mixed = scratch.save(mixed, f"mixed-{level}")
        large = scratch.save(large.join(small(mixed), "node"), f"large-{level}")
        if large.isEmpty():
            break
        # up to ``blocks`` blocks (at the last level any number) are compared exhaustively: the few rows outside a
        # node's main component meet every block; where they aren't few, all blocks meet pair by pair
        parts = F.ceil(F.col("n") / block).cast("int")
        own, every = F.pmod(F.xxhash64("id"), parts).cast("int"), F.sequence(F.lit(0), parts - 1)
        others = large.where("color <> major").groupBy("node").agg(F.count("*").alias("others"))
        others = small(scratch.save(others, f"others-{level}"))
        whole = (large if level == depth else large.where(parts <= blocks)).join(others, "node").withColumn("own", own)
        whole = masked(whole)
        few, outside = F.col("others") <= block, F.col("color") != F.col("major")
        whole = whole.withColumn("other", F.explode(F.when(few & ~outside, F.array("own")).otherwise(every)))
        low, high = F.when(few, F.col("other")).otherwise(F.least("own", "other")), F.when(few, F.lit(0)).otherwise(F.greatest("own", "other"))
        found = colors(links_of(whole.select(F.col("node").alias("g1"), (low.cast("long") * F.lit(1 << 31) + high).alias("g2"), "id", "color", "k", "mask", "sig"), f"pairs-{level}"), f"pairs-{level}")
        large = large.where(parts > blocks)
        if level == depth or large.isEmpty():
            break
        first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(tokens)).cast("int")
        picks = [first] + [F.pmod(first + k + F.pmod(F.xxhash64("node", F.lit(k)), F.lit(tokens // branch)), F.lit(tokens)).cast("int") for k in range(1, branch)]
        below = large.withColumn("c", F.explode(F.array(*picks)))
        rows = scratch.save(below.select("id", "color", F.lit(-1).alias("k"), F.xxhash64("node", "c", F.expr("substring(sig, 4 * c + 1, 4)")).alias("node"), "sig"), f"rows-{level}")
        scratch.drop("wide", f"rows-{level - 1}", *(f"{t}-{level}" for t in ("members", "near", "large", "near-pairs")))
    scratch.drop("wide", "texts")
    linked_sets = scratch.save(sets.join(found, sets.id == found.node).select("set_key", "root", "first"), "linked")
    keepers = linked_sets.groupBy("root").agg(F.min("first").alias("keep"))
    of_set = scratch.save(linked_sets.join(keepers, "root").select("set_key", "keep"), "classes")
    firsts = sets.select("set_key", "first").join(of_set, "set_key", "left").select("set_key", F.coalesce("keep", "first").alias("keep"))
    out = drawn.select("doc_id", "version", "n_shingles", "set_key").join(scratch.save(firsts, "firsts"), "set_key", "left")
    own = F.struct("doc_id", "version")
    return out.select("doc_id", "version", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("keep", own)).alias("keep"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    found = classes(docs, Scratch(docs.sparkSession, "near"), **options).select("doc_id", "n_shingles", F.col("keep.doc_id").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group stays; columns and all other documents as they are."""
    scratch = Scratch(docs.sparkSession, "gone")
    found = classes(docs, scratch, **options)
    of, version = unused(docs, "gone_doc", "gone_version")
    gone = found.where(F.struct("doc_id", "version") != F.col("keep")).select(F.col("doc_id").alias(of), F.col("version").alias(version)).distinct()
    gone = small(scratch.save(gone, "ids"))
    return docs.join(gone, (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(version)), "left_anti")
