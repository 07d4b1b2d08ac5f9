"""Byte-level BPE encoding and decoding of a text column.

``encode`` adds the packed ids and, on request, each token's span in bytes and in
characters; ``decode`` turns packed ids back into bytes through the byte table. Texts of
consecutive id slices come from ``whole_characters``: the bytes of a character that a
slice splits go to the slice that completes it. ``round_trip`` does all of it in one pass
and gives what a catalogue keeps. All are narrow Arrow maps: no shuffle, and memory is
bounded by a slice of a batch and the chunk memo.

Nulls and empty texts give no ids; very long texts are encoded whole; ties don't arise, as
every row stands for itself; repeated rows are kept; a null doc_id passes through; an empty
table gives an empty table; all other columns pass through unless they bear the name of an
output, which then replaces them.
"""

from __future__ import annotations

import base64
import codecs
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import map_rows, map_slices
from .tokens import chunks, token_bytes


def check_ranks(path: str, ranks: str) -> None:
    """The vocabulary file must hold the byte strings of the rank file under the same ids."""
    table = token_bytes(path)
    with open(ranks, "rb") as f:
        for token, rank in map(bytes.split, f):
            if table[int(rank)] != base64.b64decode(token):
                raise ValueError(f"rank {int(rank)} of {ranks} isn't id {int(rank)} of {path}")


def char_starts(data: bytes) -> np.ndarray:
    """For each byte of UTF-8 the index of the character that it belongs to, then the number of characters."""
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.append(np.cumsum(lead) - 1, lead.sum())


def spans(text: str, ids: bytes, table: list[bytes]) -> list[dict]:
    """Byte and character spans of the tokens. A token that holds part of a character covers that whole character."""
    ends = np.cumsum([len(table[i]) for i in np.frombuffer(ids, "<u4")], dtype=np.int64)
    if not len(ends):
        return []
    of, starts = char_starts(text.encode()), np.append(0, ends[:-1])
    return [dict(byte_start=int(a), byte_end=int(b), char_start=int(of[a]), char_end=int(of[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Add ``ids`` (binary: little-endian unsigned 32-bit integers) and ``offsets`` (array of spans) if named."""
    keep = [c for c in df.columns if c not in (ids, offsets)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep]
    schema = ", ".join([*fields, f"`{ids}` binary"] + ([f"`{offsets}` array<struct<byte_start:int,byte_end:int,char_start:int,char_end:int>>"] if offsets else []))

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [t or "" for t in cols[text]]
        flat, at = chunks(path, True).encode(texts)
        packed = [flat[at[k] : at[k + 1]].tobytes() for k in range(len(texts))]
        extra = {offsets: [spans(t, i, token_bytes(path)) for t, i in zip(texts, packed, strict=True)]} if offsets else {}
        return {c: cols[c] for c in keep} | {ids: packed} | extra

    return map_rows(df, run, schema)


class ByteTable:
    """All tokens' bytes in one array, so that ids of a whole batch are decoded at once."""

    def __init__(self, table: list[bytes]):
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's begin (one more offset at the end)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return np.empty(0, np.uint8), np.zeros(1, np.int64)
        at = np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        return self.data[at], np.append(0, ends)


TABLES: dict[str, ByteTable] = {}


def byte_table(path: str) -> ByteTable:
    if path not in TABLES:
        TABLES[path] = ByteTable(token_bytes(path))
    return TABLES[path]


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary) from packed ids. Ids outside the vocabulary, or ids cut short, are an error."""
    keep = [c for c in df.columns if c != out]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep]
    one = lambda packed: byte_table(path).decode(np.frombuffer(packed or b"", "<u4"))[0].tobytes()
    return map_rows(df, lambda cols: {c: cols[c] for c in keep} | {out: [one(i) for i in cols[ids]]}, ", ".join([*fields, f"`{out}` binary"]))


def whole_characters(parts: list[bytes]) -> list[str]:
    """Texts of consecutive id slices of one document: bytes of a character that a slice splits go to the slice that completes it."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(p, final=k == len(parts) - 1) for k, p in enumerate(parts)]


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of ``data`` as an Arrow column; ``ends`` are item offsets, from 0."""
    offsets = (ends * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


TRIP = "doc_id long, ids binary, decoded binary, n_chars long, n_split long, offsets_crc32 long, n_slices long"


def round_trip(df: DataFrame, path: str, text: str = "text", slice_ids: int = 1024) -> DataFrame:
    """doc_id, ids and decoded; n_chars by the spans, n_split (tokens that hold part of a character), offsets_crc32 (of the
    tokens' byte and character ends, unsigned 32-bit each), n_slices: texts of ``slice_ids`` ids each, joined and compared with the whole."""

    def run(part: pa.RecordBatch) -> dict:
        ids, at = chunks(path, True).encode(part.column(1))
        data, ends = byte_table(path).decode(ids)
        lead = np.append((data & 0xC0) != 0x80, True)
        chars = np.cumsum(lead)  # characters that begin up to and with each byte
        begun = np.append(0, chars)[ends]  # characters that begin before each token boundary
        inside = ~lead[ends]  # boundaries that fall inside a character
        split = np.append(0, np.cumsum(inside[:-1] | inside[1:]))
        out = {k: [] for k in ("n_chars", "n_split", "offsets_crc32", "n_slices")}
        for k in range(part.num_rows):
            a, b = at[k], at[k + 1]
            own = np.stack([ends[a + 1 : b + 1] - ends[a], begun[a + 1 : b + 1] - begun[a]], 1).astype("<u4")
            cuts = [*range(a, b, slice_ids), b]
            pieces = [data[ends[x] : ends[y]].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
            if len(pieces) > 1 and "".join(whole_characters(pieces)).encode() != data[ends[a] : ends[b]].tobytes():
                raise ValueError("slices of ids don't decode to the text")
            out["n_chars"].append(int(begun[b] - begun[a]))
            out["n_split"].append(int(split[b] - split[a]))
            out["offsets_crc32"].append(zlib.crc32(own.tobytes()))
            out["n_slices"].append(len(pieces))
        return {"doc_id": part.column(0), "ids": binary(ids, at), "decoded": binary(data, ends[at])} | out

    return map_slices(df.select("doc_id", text), run, TRIP, 1000, 4 << 20)
