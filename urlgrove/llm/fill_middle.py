"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and written in another order.

A text is split into blocks of BLOCK bytes. Two Fenwick trees over the blocks hold the
number of line ends and of code points of each; a descent by halving strides finds the
block of a cut from the number of lines before it and the code points before that block on
the way, and only that block is searched for the place. The trees of a text exist while its
row is handled, slices of a batch are bounded in rows and bytes, and no row meets another,
so there is no shuffle and a hot group of copies is spread as the input is.

The cuts and the form come from SHA-256 of the seed and doc_id, so a row is transformed
alike in every run. ``restore`` rebuilds the text from output and form by built-in functions.

Null and empty texts give form plain, the empty output and no lines; a text that holds a mark is
plain as well, since it couldn't be told apart on the way back. A null doc_id is hashed as no
digits. Repeated rows give repeated results, very long texts are taken whole, an empty table gives
an empty table, and extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .store import pick

BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE_END, CONTINUES = 10, 0x80


def fenwick(counts: np.ndarray) -> np.ndarray:
    """The tree over ``counts``: entry i, from 1, is the sum of the i & -i entries that end with the i-th."""
    total = np.append(0, np.cumsum(counts))
    i = np.arange(len(total))
    return total - total[i - (i & -i)]


def add(tree: np.ndarray, block: int, n: int) -> None:
    """Count ``n`` more in a block (from 0)."""
    i = block + 1
    while i < len(tree):
        tree[i] += n
        i += i & -i


def descend(tree: np.ndarray, beside: np.ndarray, k: int) -> tuple[int, int, int]:
    """The block (from 0) that holds the k-th unit of ``tree``, its place among the block's units (from 1), and the sum of ``beside`` before the block."""
    at, before, step = 0, 0, 1 << (len(tree) - 1).bit_length()
    while step:
        if at + step < len(tree) and tree[at + step] < k:
            at += step
            k -= int(tree[at])
            before += int(beside[at])
        step >>= 1
    return at, k, before


class Lines:
    """A text in UTF-8 with the trees of its blocks."""

    def __init__(self, text: bytes, block: int = BLOCK):
        pad = -len(text) % block
        self.bytes = np.frombuffer(text + bytes([CONTINUES]) * pad, np.uint8).reshape(-1, block)
        ends, points = (self.bytes == LINE_END).sum(1), ((self.bytes & 0xC0) != CONTINUES).sum(1)
        self.ends, self.points = fenwick(ends), fenwick(points)
        self.size, self.chars, whole = len(text), int(points.sum()), int(ends.sum())
        self.n = whole + bool(text and text[-1] != LINE_END)

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` lines."""
        if k <= 0:
            return 0, 0
        if k >= self.n:
            return self.size, self.chars
        block, nth, before = descend(self.ends, self.points, k)
        row = self.bytes[block]
        at = int(np.flatnonzero(row == LINE_END)[nth - 1]) + 1
        return block * self.bytes.shape[1] + at, before + int(((row[:at] & 0xC0) != CONTINUES).sum())


def transformed(text: bytes, doc_id: int | None, seed: int, rate: int, spm: int, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle (None if plain), and the output."""
    lines = Lines(text, block)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    if not text or h3 % 100 >= rate or any(x in text for x in (p, s, m)):
        return lines.n, "plain", None, None, text
    first, second = sorted((h1 % (lines.n + 1), h2 % (lines.n + 1)))
    (a, a_chars), (b, b_chars) = lines.cut(first), lines.cut(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < spm else ("psm", (p, prefix, s, suffix, m, middle))
    return lines.n, form, a_chars, b_chars - a_chars, b"".join(parts)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars and output. ``rate`` of 100 texts are cut, ``spm`` of 100 of those put the suffix first."""
    docs = pick(docs, {"doc_id": "long", "text": "string"})

    def run(part: pa.RecordBatch) -> dict:
        texts = part.column(1).cast(pa.binary()).to_pylist()
        rows = [transformed(t or b"", d, seed, rate, spm) for d, t in zip(part.column(0).to_pylist(), texts, strict=True)]
        n, form, prefix, middle, output = zip(*rows, strict=True)
        return {"doc_id": part.column(0), "n": n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": pa.array(output, pa.binary()).cast(pa.string())}

    return map_slices(docs, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(done: DataFrame) -> DataFrame:
    """Add ``restored``, the text from output and form. The parts hold no mark, so each mark ends the part before it."""
    past = len(PREFIX)
    second = F.when(F.col("form") == "psm", SUFFIX).otherwise(PREFIX)
    rest = lambda text, n: F.substring(text, n + 1, F.length(text))
    body = rest(F.col("output"), F.lit(past))
    one = F.when(F.col("form") == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    after = rest(body, F.length(one) + F.length(second))
    two = F.substring_index(after, MIDDLE, 1)
    middle = rest(after, F.length(two) + F.lit(past))
    text = F.when(F.col("form") == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return done.withColumn("restored", F.when(F.col("form") == "plain", F.col("output")).otherwise(text))


def digests(done: DataFrame) -> DataFrame:
    """The rows of ``transform`` with digests in place of the texts."""
    done = restore(done)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
