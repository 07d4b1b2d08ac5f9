"""Near-duplicates: how often texts are read, and its steps against plainer forms."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ODD, brute_classes, prose

from urlgrove.llm import near_duplicates, shingles


def families(n=4, members=6):
    r, texts = random.Random(3), [*ODD, "A b", "a  B"]
    for k in range(n):
        base = prose(k, 80).split()
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
            texts.append(" ".join(w))
    return texts


def right(texts, got):
    root, sizes = brute_classes(texts)
    return {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {k: (root[k], sizes[k], root[k] == k) for k in range(len(texts))}


def test_texts_are_read_twice_at_any_depth(spark):
    texts = families()
    read = spark.sparkContext.accumulator(0)

    def row(k):
        read.add(1)
        return k, texts[k]

    docs = spark.createDataFrame(spark.sparkContext.parallelize(range(len(texts)), 2).map(row), "doc_id long, text string")
    assert right(texts, near_duplicates.near_duplicates(docs, limit=3, block=5, blocks=1, depth=2).collect())
    assert read.value == 2 * len(texts)


@pytest.mark.parametrize("keys", [True, False])
def test_more_candidates_than_a_broadcast_holds(spark, monkeypatch, keys):
    monkeypatch.setattr(near_duplicates, "small", lambda df, rows=0: F.broadcast(df) if keys and rows == near_duplicates.KEYS else df)
    texts = families()
    docs = spark.createDataFrame([*enumerate(texts), (8, texts[8])], "doc_id long, text string")
    assert right(texts, near_duplicates.near_duplicates(docs).collect())


def test_words_are_hashed_whole():
    r = random.Random(1)
    texts = [*ODD, "x" * 255, "x" * 256, "x" * 257, "a\0 a a\0\0", "12345678 123456781 1234567812345678 12345678123456781", "é\x85É\xa0z\x0b\x0c\r"]
    texts += ["".join(r.choice(" \n\tabAB\0é") for _ in range(r.randrange(60))) for _ in range(500)]
    flat, at = shingles.split_hashes(pa.array(texts, pa.string()).slice(2))
    words = [shingles.words(t) for t in texts[2:]]
    assert np.diff(at).tolist() == [len(w) for w in words]
    of = dict(zip(sum(words, []), flat.tolist(), strict=True))
    assert [of[w] for w in sum(words, [])] == flat.tolist() and len(set(of.values())) == len(of)
    assert [len(s) for s in shingles.shingle_sets(texts)] == brute_sizes(texts)


def brute_sizes(texts):
    words = [shingles.words(t) for t in texts]
    return [len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) if w else 0 for w in words]


def test_numbered_shingles_give_the_same_links():
    r = np.random.default_rng(2)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.append(base[r.random(200) < share], r.integers(0, 1 << 63, 20, dtype=np.uint64))) for share in np.linspace(0.3, 1, 60)]
    links, everyone = near_duplicates.overlaps(sets, 75), np.arange(60)
    got = [links(i, everyone[everyone != i]).tolist() for i in range(60)]
    assert got == [[shingles.linked(sets[i], sets[j]) for j in range(60) if j != i] for i in range(60)] and 0 < sum(map(sum, got)) < 3000
