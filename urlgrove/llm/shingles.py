"""Word shingles as sorted arrays of 64-bit hashes, inside tasks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


def words(text: str | None) -> list[bytes]:
    """Runs of other characters than space and U+0009 to U+000D, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def numbered(lists: pa.ListArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of split texts, the number of each word in turn (empty ones left out), and where each text's begin."""
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    which = coded.indices.to_numpy()
    real = np.fromiter(map(bool, distinct), bool, len(distinct))[which] if distinct else np.empty(0, bool)
    at = np.append(0, np.cumsum(real))[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return distinct, which[real], at


def batch_words(texts: pa.Array | list) -> list[np.ndarray]:
    """The hashes of each text's words. Arrow splits the texts and numbers the distinct words, so each is hashed once a batch."""
    texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
    distinct, which, at = numbered(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    flat = word_hashes(distinct)[which] if distinct else np.empty(0, np.uint64)
    return [flat[at[k] : at[k + 1]] for k in range(len(texts))]


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """One hash for each run of ``n`` words; for fewer words, one for the whole sequence; none for no words."""
    if not len(hashes):
        return hashes
    size = min(n, len(hashes))
    out = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * ODD[k % 5] + hashes[k : len(hashes) - size + 1 + k])
    return out


#: Space and U+0009 to U+000D; the bytes of a word's last eight that count; longer words are hashed one by one.
SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256


def split_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of the texts in turn, eight bytes of all words at a time, and where each text's words begin."""
    texts = pc.ascii_lower(pc.fill_null(texts, ""))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = ends[-1] - ends[0]
    data = np.zeros(size + 8, np.uint8)
    data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    gap = SPACE[data[:size]]
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    for edge, of in ((ends[ends < size], first), (ends[ends > 0] - 1, last)):
        of[edge] = ~gap[edge]
    start, left = np.flatnonzero(first), np.flatnonzero(last) + 1
    left -= start
    at = np.searchsorted(start, ends)
    eight = np.ndarray((size + 1,), "<u8", data, strides=(1,))
    out, which = left.astype(np.uint64) * ODD[0], np.flatnonzero(left <= LONG_WORD)
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + left[i]].tobytes())
    for k in range(0, LONG_WORD, 8):
        if not len(which):
            break
        rest = left[which] - k
        out[which] = mix(out[which] * ODD[1] + (eight[start[which] + k] & MASKS[np.minimum(rest, 8)]))
        which = which[rest > 8]
    return out, at


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    x = np.sort(hashes)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_sets(texts: pa.Array | list, n: int = 5) -> list[np.ndarray]:
    """The distinct shingles of each text."""
    flat, at = split_hashes(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    runs = shingle_hashes(flat, n)
    return [distinct(runs[a : b - n + 1]) if b - a >= n else shingle_hashes(flat[a:b], n) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    return shingle_sets([text], n)[0]


def minhash(h: np.ndarray, t: int, seed: int = 7) -> np.ndarray:
    """``t`` minimum hashes of 32 bits, under random permutations of the hashes' upper halves; a non-empty set."""
    a, b = permutations(t, seed)
    x, out = (h >> np.uint64(32)).astype(np.uint32), np.full(t, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(out, (x[None, at : at + 512] * a + b).min(axis=1), out=out)
    return out


@lru_cache(maxsize=8)
def permutations(t: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 31, (t, 1)) * 2 + 1).astype(np.uint32), rng.integers(0, 1 << 32, (t, 1)).astype(np.uint32)


def linked(x: np.ndarray, y: np.ndarray, percent: int = 75) -> bool:
    """Whether 100 * intersection size >= percent * union size, of sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)
