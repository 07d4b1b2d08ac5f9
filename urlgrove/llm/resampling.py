"""Quality filtering by importance resampling.

Two bag-of-hashed-n-grams models are counted, one over the target texts (labelled good)
and one over all texts; a document's log weight is the log ratio of its likelihoods, and
the Gumbel top-k trick draws k documents without replacement in proportion to weight.
The target holds no harmful texts: a third and fourth model, over the words of labelled
toxic and labelled clean texts, give the words that tell them apart (deviation of at least
``sure``), and a document whose words' log ratios sum to more than ``calm`` of held-out
clean documents reach has no weight and isn't drawn. Both passes over the texts are narrow
maps that count or score inside tasks; what leaves a task is a vector of fixed length and
the counts of labelled words, and the model that returns is of bounded size as well.

Importance weights are truncated at the bound that ``keep`` of the held-out target documents
reach: a document at or above it has weight 1, one below it exp((weight - bound) / temperature).
``size``, the number of documents drawn, is the sum of these weights unless given. So a document above the
bound is drawn but for the few that others near it displace, one far below hardly ever, and another seed draws
another sample. The k-th largest key is found by counting digits of the keys, so no sort, window
or driver list grows with the corpus. Keys equal to the k-th all stay.

Null or empty texts have log weight 0. Rows without doc_id are drawn by their text, and
``keep_good`` leaves them in. Repeated rows draw equal keys; rows of one doc_id with other
texts are judged each by its text. Very long texts are counted whole. Without target texts
every log weight is 0 and all rows are kept; without toxic labels no text is harmful. An empty
table gives an empty table; labels that repeat or contradict count as not good, and as
toxic if any says so. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices, slices, tidy
from .shingles import mix, numbered, word_hashes
from .store import Scratch, pick, small, unused

#: Runs of marks are words of their own.
MARKS = r"([^\pL\pN\pM_\s]+)"
#: Buckets of single words in the models of labelled texts.
WORD_BITS = 30
GRAMS, WORDS, DOCS = 0, 1, 2


def features(texts: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the bucket of each unigram and bigram, and the distinct buckets of its lower-case words."""
    texts = pc.fill_null(texts, "")
    distinct, which, at = numbered(pc.utf8_split_whitespace(pc.replace_substring_regex(texts, MARKS, r" \1 ")))
    hashes = word_hashes(distinct)[which] if distinct else np.empty(0, np.uint64)
    low = (word_hashes([w.decode().lower().encode() for w in distinct]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)[which] if distinct else np.empty(0, np.int64)
    out = []
    for k in range(len(texts)):
        h = hashes[at[k] : at[k + 1]]
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
        out.append(((np.append(h, pairs) >> np.uint64(32)).astype(np.int64) % buckets, np.unique(low[at[k] : at[k + 1]])))
    return out


def count_models(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, bucket, base, target, spread). GRAMS: counts over all texts, and over those with ``good``; WORDS and DOCS: numbers of labelled texts that
    are clean, and toxic (``harm``). ``spread``: of 64 classes of toxic texts, as a bit each, those that hold the word; copies of a text share a class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, total = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), np.zeros(2, np.int64)

        def rows(kind: int, bucket: np.ndarray, base: np.ndarray, of: np.ndarray, spread: np.ndarray | None = None) -> pa.RecordBatch:
            spread = np.zeros(len(bucket), np.int64) if spread is None else spread
            return pa.RecordBatch.from_pydict({"kind": np.full(len(bucket), kind, np.int32), "bucket": bucket.astype(np.int32), "base": base, "target": of, "spread": spread})

        for batch in batches:
            for part in slices(batch):
                of = features(part.column(0), buckets)
                good, harm = part.column(1).to_pylist(), part.column(2).to_pylist()
                raw += np.bincount(np.concatenate([f for f, _ in of]), minlength=buckets)
                if fit := [f for (f, _), g in zip(of, good, strict=True) if g]:
                    target += np.bincount(np.concatenate(fit), minlength=buckets)
                total += harm.count(False), harm.count(True)
                if known := [w * 2 + h for (_, w), h in zip(of, harm, strict=True) if h is not None]:
                    # the class of a text goes by its least word after mixing, which copies with few edits mostly share
                    least = [mix(w.astype(np.uint64) + np.uint64(1)).min(initial=0 if not len(w) else np.uint64(1 << 63)) for (_, w), h in zip(of, harm, strict=True) if h is not None]
                    bits = np.repeat(np.int64(1) << (mix(np.array(least, np.uint64)) % np.uint64(63)).astype(np.int64), [len(w) for w in known])
                    flat = np.concatenate(known)
                    order = np.argsort(flat, kind="stable")
                    word, first, n = np.unique(flat[order], return_index=True, return_counts=True)
                    if len(word):
                        spread = np.bitwise_or.reduceat(bits[order], first)
                        yield rows(WORDS, word >> 1, n * (1 - word % 2), n * (word % 2), spread * (word % 2))
        used = np.flatnonzero(raw)
        yield rows(GRAMS, used, raw[used], target[used])
        yield rows(DOCS, np.zeros(1), total[:1], total[1:])
        tidy()

    counted = docs.select("text", "good", "harm").mapInArrow(run, "kind int, bucket int, base long, target long, spread long")
    return counted.groupBy("kind", "bucket").agg(F.sum("base").alias("base"), F.sum("target").alias("target"), F.bit_count(F.bit_or("spread")).alias("spread"))


def log_ratio(counts: list, buckets: int, smooth: float = 30.0) -> np.ndarray:
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts:
        raw[r.bucket], target[r.bucket] = r.base, r.target
    if not target.sum():
        return np.zeros(buckets, np.float32)
    # pseudo-counts in proportion to the raw model: a bucket that target texts hardly show keeps its raw share
    prior = (raw + 1e-3) / (raw.sum() + 1e-3 * buckets)
    of = lambda c: (c + smooth * prior * buckets) / (c.sum() + smooth * buckets)
    return (np.log(of(target)) - np.log(of(raw))).astype(np.float32)


def telling_words(models: DataFrame, sure: float) -> dict[int, float]:
    """Log ratios of the words that toxic texts hold far more often than clean ones: by ``sure`` deviations, and in five texts at least."""
    total = models.where(F.col("kind") == DOCS).first()
    clean, toxic = (total.base, total.target) if total else (0, 0)
    if not clean or not toxic:
        return {}
    # a word of few classes counts once a class: a large group of copies isn't evidence for all its words
    texts = F.when(F.col("spread") < 48, F.least("target", "spread")).otherwise(F.col("target"))
    share, n = toxic / (clean + toxic), F.col("base") + texts
    far = (texts - n * share) / F.sqrt(n * share * (1 - share)) >= sure
    odds = F.log((texts + 0.5) / (toxic + 1)) - F.log((F.col("base") + 0.5) / (clean + 1))
    told = models.where((F.col("kind") == WORDS) & (texts >= 5) & far & (odds > 1)).select("bucket", odds.alias("odds"))
    return {r.bucket: r.odds for r in told.collect()}  # at most 2**WORD_BITS, in practice a list of insults


def weigh(docs: DataFrame, ratio: np.ndarray, words: dict[int, float], columns: list[str]) -> DataFrame:
    """``columns`` with weight and harm of the text."""
    buckets, context = len(ratio), docs.sparkSession.sparkContext
    known = np.array(sorted(words), np.int64)
    shared = context.broadcast((ratio, known, np.array([words[w] for w in known.tolist()])))  # vectors of bounded length
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in columns]

    def run(part: pa.RecordBatch) -> dict:
        ratio, known, odds = shared.value
        of = features(part.column(0), buckets)
        harm = [float(odds[np.isin(known, w, assume_unique=True)].sum()) for _, w in of] if len(known) else [0.0] * len(of)
        return {c: part.column(k + 1) for k, c in enumerate(columns)} | {"weight": [float(ratio[f].sum(dtype=np.float64)) for f, _ in of], "harm_score": harm}

    return map_slices(docs.select("text", *columns), run, ", ".join([*fields, "weight double", "harm_score double"]))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, from four counts of at most 65,536 rows each; None if there are fewer rows."""
    low, high = -(1 << 63), (1 << 63) - 1
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(column, shift)
        counts = df.where(F.col(column).between(low, high)).groupBy(digit.alias("digit")).count().collect()
        for digit_value, n in sorted(((r.digit, r["count"]) for r in counts), reverse=True):
            if n >= k:
                low, high = digit_value << shift, (digit_value << shift) + (1 << shift) - 1
                break
            k -= n
        else:
            return None
    return low


#: Log weights, harm scores and keys are fixed-point numbers of this step, so that sums and ranks don't depend on the order of rows.
STEP = 1_000_000


def fixed(c: Column) -> Column:
    return F.floor(c * STEP).cast("long")


def gumbel_top(rows: DataFrame, size: int | None, seed: int) -> DataFrame:
    """Add key and drawn to ``rows`` (name: long; log_weight: at most 0, null for rows that can't be drawn).

    Gumbel noise is added to the log weights and the ``size`` largest keys are drawn: that is sampling without replacement in
    proportion to exp(log_weight). Without a size it is the sum of the weights. ``rows`` are read several times: a stored table.
    """
    uniform = (F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = rows.withColumn("key", fixed(F.col("log_weight") - F.log(-F.log(uniform))))
    if size is None:
        mass = rows.agg(F.sum(fixed(F.exp("log_weight"))).alias("mass")).first().mass
        size = round((mass or 0) / STEP)
    least = kth_largest(keyed.where("key is not null"), "key", size) if size else None
    if size and least is None:  # fewer rows than that
        return keyed.withColumn("drawn", F.col("key").isNotNull())
    return keyed.withColumn("drawn", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if size else F.lit(False))


def draw(docs: DataFrame, labels: DataFrame, keep: float = 0.998, buckets: int = 1 << 16, temperature: float = 1.0, seed: int = 9, sure: float = 8.0, calm: float = 0.999, size: int | None = None, fold_seed: int = 9) -> DataFrame:
    """doc_id, version (digest of the text), weight, harm_score, log_weight (truncated), key (fixed-point Gumbel key) and drawn, of every row."""
    scratch = Scratch(docs.sparkSession, "resample")
    docs = pick(docs, {"doc_id": "long", "text": "string"}).withColumn("version", F.xxhash64("text"))
    labels = pick(labels, {"doc_id": "long", "quality": "int", "toxic": "int"})
    is_toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False)) & ~is_toxic).alias("good"), F.max(is_toxic).alias("harm"))
    known = docs.join(small(marks), "doc_id", "left")
    held = F.pmod(F.xxhash64("doc_id", F.lit(fold_seed)), F.lit(5)) == 0  # a fifth of the labelled texts only sets the bounds
    # labelled junk is neither target nor clean
    fit = known.select("text", (F.col("good") & ~held).alias("good"), F.when(~held & (F.col("good") | F.col("harm")), F.col("harm")).alias("harm"))
    models = scratch.save(count_models(fit, buckets), "models")
    ratio = log_ratio(models.where(F.col("kind") == GRAMS).collect(), buckets)  # at most `buckets` rows
    words = telling_words(models, sure)
    scored = scratch.save(weigh(known.withColumn("held", F.col("good") & held), ratio, words, ["doc_id", "version", "held"]), "scored")
    n_held = scored.where("held").count()
    scored = scored.withColumn("w", fixed(F.col("weight"))).withColumn("h", fixed(F.col("harm_score")))
    quiet = kth_largest(scored.where("held"), "h", int((1 - calm) * n_held) + 1) if n_held and words else None
    allowed = F.col("h") <= F.lit(max(quiet, 0)) if quiet is not None else F.lit(True)
    bound = kth_largest(scored.where("held"), "w", max(1, int(np.ceil(keep * n_held)))) if n_held else None
    below = F.least(F.lit(0.0), (F.col("w") - F.lit(bound)) / float(STEP) / temperature) if bound is not None else F.lit(0.0)
    scored = scored.select("doc_id", "version", F.coalesce("doc_id", "version").alias("name"), "weight", "harm_score", F.when(allowed, below).alias("log_weight"))
    return gumbel_top(scratch.save(scored, "weighted"), size, seed).drop("name")


def resample(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, weight, harm_score and Gumbel key of the documents drawn."""
    return draw(docs, labels, **options).where("drawn").select("doc_id", "weight", "harm_score", (F.col("key") / STEP).alias("gumbel_key"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents drawn, with their own columns. Documents without doc_id stay."""
    of, version = unused(docs, "gone_doc", "gone_version")
    gone = draw(docs, labels, **options).where("not drawn and doc_id is not null").select(F.col("doc_id").alias(of), F.col("version").alias(version)).distinct()
    gone = small(Scratch(docs.sparkSession, "gone").save(gone, "ids"))
    return docs.join(gone, (F.col("doc_id") == F.col(of)) & (F.xxhash64("text") == F.col(version)), "left_anti")
