"""Repeated and null ids, empty tables, clashing columns: rows are judged by document and text."""

import zlib

import numpy as np
from test_operators import DOC, prose, table

from urlgrove.llm import byte_bpe, line_runs, near_duplicates, packing, passages, training_order
from urlgrove.llm.queries import vocabulary
from urlgrove.llm.store import Scratch


def rows(spark, pairs):
    extra = DOC + ", version long, root string, mates string, __x int"
    return spark.createDataFrame([(d, t, "en", "s", None, "g", "i", 1, "r", "m", 2) for d, t in pairs], extra)


def test_near_duplicates_by_text(spark):
    a, u = prose(1, 60), prose(2, 60)
    df = rows(spark, [(1, a), (5, a), (5, u), (None, a), (7, None), (8, u), (8, u)])
    left = near_duplicates.drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None) == sorted([(1, a), (5, u), (7, None)], key=str) and left.where("doc_id is null").count() == 1


def test_passages_by_text(spark):
    p, u = prose(3, 80), prose(4, 60)
    df = rows(spark, [(1, p), (5, p), (5, u), (None, p), (7, None)])
    left = passages.delete_passages(df, Scratch(spark, "t"))
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted([("1", p), ("5", ""), ("5", u), ("None", p), ("7", "None")])


def test_lines_by_text(spark):
    df = rows(spark, [(1, "x one\ny two"), (5, "x one\nz"), (5, "u"), (None, "x one"), (7, None)])
    left = line_runs.delete_runs(df, Scratch(spark, "t"), min_lines=1)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted([("1", "x one\ny two"), ("5", "z"), ("5", "u"), ("None", "x one"), ("7", "None")])
    assert line_runs.repeated_runs(df.limit(0), Scratch(spark, "t")).count() == 0


def test_training_order_digests_and_empty_table(spark):
    path = vocabulary("word_bpe_49k.json")
    df = rows(spark, [(5, prose(1, 90)), (5, "İ, İ. ok"), (None, "null id"), (7, None), (7, None)])
    want = sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in packing.tokenize(df, path, 64).collect())
    assert sorted((str(r.doc_id), r.piece, r.n_tokens, r.ids_crc32) for r in training_order.materialise(df, path, 64, 4, width=4).collect()) == want
    assert training_order.materialise(table(spark, []), path).count() == 0


def test_round_trip_of_split_characters(spark):
    path = vocabulary("byte_bpe_50k.json")
    byte_bpe.check_ranks(path, vocabulary("byte_bpe_50k.tiktoken"))
    texts = ["日本語😀 é" * 40, "", None, "plain words"]
    got = {r.doc_id: r for r in byte_bpe.round_trip(table(spark, texts), path, slice_ids=3).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        spans = byte_bpe.spans(t, got[k].ids, byte_bpe.token_bytes(path))
        inside = lambda at: at < len(t.encode()) and t.encode()[at] & 0xC0 == 0x80  # noqa: B023, E731
        assert got[k].decoded == t.encode() and got[k].n_chars == len(t)
        assert got[k].n_split == sum(inside(s["byte_start"]) or inside(s["byte_end"]) for s in spans)
        begun = [len(t.encode()[: s["byte_end"]].decode(errors="ignore")) + inside(s["byte_end"]) for s in spans]
        assert got[k].offsets_crc32 == zlib.crc32(np.array([[s["byte_end"], b] for s, b in zip(spans, begun, strict=True)], "<u4").tobytes())
