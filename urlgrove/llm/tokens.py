"""Token ids of whole texts by the tokenizers library, inside tasks.

A text is cut at white space where the tokenizer's own pre-tokenizer always cuts, so
the ids of a text are the ids of its chunks in order. Arrow splits the texts of a batch
and numbers the distinct chunks; only those are looked up, in a memo of bounded bytes,
or encoded by the library; the ids of all chunks are then gathered by numpy. Texts with
characters for which such cuts aren't plainly safe are split one by one.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of chunks and ids that a worker remembers; beyond them it starts anew.
MEMO = 12 << 20
#: A space beside more white space: the cut before it isn't safe for byte-level patterns.
DOUBLE = re.compile(r" \s|\s |^ |\s$")
#: Runs of marks, which are one unit, and control characters that only Python counts as white space.
RUNS = re.compile(r"[^\w\s]{2}|_|[\x1c-\x1f]")
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: The same questions for Arrow's regular expressions, on the safe side: what they match is split one by one.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNSAFE_BYTES = rf"\x00| {WHITE}|{WHITE} |^ |{WHITE}$"
UNSAFE_WORDS = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-\x{ff}]|[^\pL\pN\s]{2}|_"


class Chunks:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, byte_level: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = byte_level
        self.byte_level = byte_level
        self.bytes_of: np.ndarray | None = None
        self.forget()

    def split(self, text: str) -> list[str]:
        if not self.byte_level:  # white space only separates words here, and case is dropped
            if not latin(text):
                return text.replace("\n", " ").split(" ")
            text = text.lower()
            if RUNS.search(text):
                return text.replace("\n", " ").split(" ")
            return text.replace(",", " , ").replace(".", " . ").split()
        if "\0" in text or DOUBLE.search(text):
            return SAFE.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def learn(self, new: list[str]) -> list[bytes]:
        """Packed ids of chunks. A full stop or comma after a letter that nothing composes with is a token run of its own, so it is encoded apart."""
        cores = {c: c[:-1] for c in new if c.endswith((",", ".")) and c[-2:-1].isalpha() and (self.byte_level or c.isascii() or latin(c))}
        wanted = list({*cores.values(), *(c for c in new if c not in cores), ",", "."} if cores else new)
        known = self.encode_words(wanted)
        rest = [c for c in wanted if c not in known]
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[c] = np.array(e.ids, "<u4").tobytes()
        return [known[cores[c]] + known[c[-1]] if c in cores else known[c] for c in new]

    def encode_words(self, wanted: list[str]) -> dict[str, bytes]:
        """Ids of the plain words among ``wanted``, encoded as texts of many words, which the pre-tokenizer cuts at their spaces; by the bytes of the ids each word gets its own back."""
        plain = [c for c in wanted if c[:1] == " " and c[1:].isalpha()] if self.byte_level else [c for c in wanted if c.isalpha() and (c.isascii() or latin(c))]
        out: dict[str, bytes] = {}
        if self.bytes_of is None:
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
            # one character of a vocabulary entry stands for one byte, but for the mark of a word's end
            self.bytes_of[list(vocab.values())] = [len(t.removesuffix("</w>")) for t in vocab]
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([("" if self.byte_level else " ").join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(c.encode()) for c in part])
            done = np.cumsum(self.bytes_of[ids])
            stops = np.searchsorted(done, ends)
            if len(done) and done[-1] == ends[-1] and (done[stops] == ends).all():  # else the words go one by one
                data, starts = ids.tobytes(), [0, *(4 * (stops + 1)).tolist()]
                out |= {c: data[starts[k] : starts[k + 1]] for k, c in enumerate(part)}
        return out

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where the memo holds each chunk; chunks that it lacks are learnt first."""
        if self.words.nbytes + self.flat.nbytes > MEMO:
            self.forget()
        at = pc.index_in(distinct, value_set=self.words)
        if at.null_count:
            new = distinct.filter(pc.is_null(at))
            learnt = self.learn(new.to_numpy(zero_copy_only=False).tolist())
            self.words = pa.concat_arrays([self.words, new])
            self.flat = np.append(self.flat, np.frombuffer(b"".join(learnt), "<u4"))
            self.sizes = np.append(self.sizes, np.fromiter(map(len, learnt), np.int64, len(learnt)) // 4)
            at = pc.index_in(distinct, value_set=self.words)
        return at.to_numpy()

    def forget(self) -> None:
        self.words, self.flat, self.sizes = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)

    def safe_chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.byte_level:
            return pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        apart = pc.replace_substring(pc.replace_substring(pc.utf8_lower(texts), ",", " , "), ".", " . ")
        return pc.ascii_split_whitespace(apart)

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more offset at the end). Null counts as empty."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        unsafe = pc.match_substring_regex(texts, UNSAFE_BYTES if self.byte_level else UNSAFE_WORDS)
        if not pc.any(unsafe).as_py():
            return self.gather(self.safe_chunks(texts))
        ids, sizes = [None] * len(texts), np.zeros(len(texts), np.int64)
        for of, which in ((self.safe_chunks, pc.invert(unsafe)), (lambda t: pa.array([self.split(x) for x in t.to_pylist()], pa.list_(pa.string())), unsafe)):
            part = texts.filter(which)
            if len(part):
                flat, at = self.gather(of(part))
                for k, i in enumerate(np.flatnonzero(which.to_numpy(zero_copy_only=False))):
                    ids[i] = flat[at[k] : at[k + 1]]
                    sizes[i] = at[k + 1] - at[k]
        return np.concatenate([*ids, np.empty(0, "<u4")]), np.append(0, np.cumsum(sizes))

    def gather(self, chunks: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        coded = chunks.flatten().dictionary_encode()
        which = self.places(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        of_text = np.append(0, ends)[np.asarray(chunks.offsets) - chunks.offsets[0].as_py()]
        if not len(which):
            return np.empty(0, "<u4"), of_text
        at = np.repeat((np.cumsum(self.sizes) - self.sizes)[which] - ends + sizes, sizes) + np.arange(ends[-1])
        return self.flat[at], of_text


def latin(text: str) -> bool:
    """Only characters that lose case one by one, and compose with nothing."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=4)
def chunks(path: str, byte_level: bool) -> Chunks:
    return Chunks(path, byte_level)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: its vocabulary entry through the byte alphabet. An added token is its text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back, vocab = byte_alphabet(), spec["model"]["vocab"]
    added = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    table = [b""] * (1 + max([*vocab.values(), *added]))
    for entry, i in vocab.items():
        table[i] = entry.encode() if i in added else bytes(back[c] for c in entry)
    for i, content in added.items():
        table[i] = content.encode()
    return table
