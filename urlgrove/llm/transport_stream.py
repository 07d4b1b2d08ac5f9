"""Media columns: byte payloads carried in MPEG transport streams.

``mux`` stores a payload losslessly as the elementary stream of a one-program
transport stream (188-byte packets: program association, program map, then
packetised elementary stream packets with presentation timestamps; access points
carry the random-access flag and a clock reference). ``demux`` reads such bytes
back: it parses the program tables, checks the continuity counters, reassembles the
elementary packets and returns the payload with timestamps and random-access points.

One access unit holds 4,096 samples of 8 bits and lasts 3,600 ticks of the 90 kHz
clock; every eighth is an access point. Null counts as empty text, which gives one
block of 64 zero bytes, and so does an empty one; texts of any length are one stream
each, held in a task one slice of rows at a time. Repeated rows are stored as often as
they come, equal texts as equal bytes; an empty table gives an empty one. Other columns
of the input, whatever their names, play no part; a null doc_id is kept as it is.

Damaged streams don't fail: lost packets are counted and the units they belong to are
listed as damaged. A packet sent twice in a row counts once, as the standard allows. After
a slip of bytes reading goes on at the next place from which packets follow each other;
the packet in which the slip lies counts as lost.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .arrow import map_rows
from .store import pick

# Fixed values of the container format (ISO/IEC 13818-1).
SYNC, PACKET, PAT_PID, PMT_PID, DATA_PID, PRIVATE_STREAM, STREAM_ID = 0x47, 188, 0x0000, 0x1000, 0x0100, 0x06, 0xBD
CRC_POLY = 0x04C11DB7
UNIT, TICKS, ACCESS_EVERY = 4096, 3600, 8


@functools.lru_cache(256)
def crc_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLY if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\0\0" + body
    return head + crc_mpeg(head).to_bytes(4, "big")


def psi_packet(pid: int, table: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\0" + table).ljust(PACKET, b"\xff")


TABLES = psi_packet(PAT_PID, section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + psi_packet(
    PMT_PID, section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0" + bytes([PRIVATE_STREAM]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\0")
)


def stamp(pts: int) -> bytes:
    """A 33-bit presentation timestamp with its marker bits."""
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def unstamp(b: bytes) -> int:
    return (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes) -> bytes:
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + stamp(pts) + unit
        access = k % ACCESS_EVERY == 0
        # the first packet of an access point: random-access flag and clock reference
        field = bytes([7, 0x50]) + (pts << 15 | 0x7E00).to_bytes(6, "big") if access else b""
        room = PACKET - 4 - len(field)
        first, rest = pes[:room], pes[room:]
        if len(first) < room:  # the only packet: stuffing fills the adaptation field
            field = (field or b"\1\0").ljust(PACKET - 4 - len(first), b"\xff") if field or room - len(first) > 1 else b"\0"
            field = bytes([len(field) - 1]) + field[1:]
        out.append(bytes([SYNC, 0x41, 0x00, (0x30 if field else 0x10) | counter]) + field + first)
        counter = counter + 1 & 15
        n = len(rest) // 184
        if n:
            block = np.empty((n, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, 0x01, 0x00
            block[:, 3] = 0x10 | (counter + np.arange(n)) & 15
            block[:, 4:] = np.frombuffer(rest, np.uint8, n * 184).reshape(n, 184)
            out.append(block.tobytes())
            counter = counter + n & 15
        if last := rest[n * 184 :]:
            pad = 184 - len(last)
            field = b"\0" if pad == 1 else bytes([pad - 1, 0]).ljust(pad, b"\xff")
            out.append(bytes([SYNC, 0x01, 0x00, 0x30 | counter]) + field + last)
            counter = counter + 1 & 15
    return b"".join(out)


def tables(packets: np.ndarray, pids: np.ndarray) -> int | None:
    """The elementary stream's packet identifier by the association and map tables; None if either is damaged."""

    def read(pid: int) -> bytes | None:
        for p in packets[(pids == pid) & (packets[:, 1] & 0x40 > 0)]:
            at = 5 + int(p[4]) if (p[3] >> 4) & 1 else PACKET
            body = p[at:].tobytes()
            if len(body) > 3 and crc_mpeg(body[: 3 + (int.from_bytes(body[1:3], "big") & 0xFFF)]) == 0:
                return body[: 3 + (int.from_bytes(body[1:3], "big") & 0xFFF)]
        return None

    pat = read(PAT_PID)
    pmt = read(int.from_bytes(pat[10:12], "big") & 0x1FFF) if pat else None
    if not pmt:
        return None
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    return int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF


def aligned(media: bytes) -> np.ndarray:
    """The packets of a stream, found anew after each slip: a packet starts at a sync byte with another one or two packets on."""
    data = np.frombuffer(media, np.uint8)
    whole = data[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    if len(whole) * PACKET == len(data) and (whole[:, 0] == SYNC).all():
        return whole
    sync = data == SYNC
    far = np.append(sync, np.ones(2 * PACKET, bool))  # the end of the bytes is as good as a sync byte
    starts = (sync & (far[PACKET : PACKET + len(data)] | far[2 * PACKET :]))[: max(0, len(data) - PACKET + 1)]
    at, found, places = 0, [], np.flatnonzero(starts)
    while at < len(starts):
        run = starts[at::PACKET]
        n = len(run) if run.all() else int(run.argmin())
        found.append(data[at : at + n * PACKET].reshape(n, PACKET))
        at += n * PACKET
        after = np.searchsorted(places, at)
        at = int(places[after]) if after < len(places) else len(starts)
    return np.concatenate(found) if found else whole[:0]


def repeats(own: np.ndarray) -> np.ndarray:
    """Packets that repeat the one before them, clock reference aside; of three equal ones the third is a fault."""
    clock = (own[:, 3] & 0x20 > 0) & (own[:, 4] >= 7) & (own[:, 5] & 0x10 > 0)
    plain = own.copy()
    plain[clock, 6:12] = 0
    same = np.append(False, (plain[1:] == plain[:-1]).all(axis=1))[: len(own)]
    return same & ~np.append(False, same[:-1])[: len(own)]


def demux(media: bytes) -> dict:
    """payload, pts (of each unit), access (indices of access points), lost (breaks of continuity), damaged (unit indices)."""
    packets = aligned(media)
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    pid = tables(packets, pids)
    own = packets[pids == pid] if pid is not None else packets[:0]
    flags = own[:, 3] >> 4
    own = own[(flags & 1) > 0]  # with payload
    own = own[~repeats(own)]
    flags = own[:, 3] >> 4
    broken = np.append(False, (np.diff(own[:, 3].astype(np.int32) & 15) & 15) != 1)
    begins = (own[:, 1] & 0x40) > 0
    skip = 4 + np.where(flags & 2, own[:, 4].astype(np.int32) + 1, 0)
    keep = np.arange(PACKET)[None, :] >= skip[:, None]
    firsts = np.flatnonzero(begins)
    body = own[keep].tobytes() if len(own) else b""
    ends = np.cumsum(PACKET - skip)
    payload, pts, access, damaged = [], [], [], []
    for k, i in enumerate(firsts):
        j = firsts[k + 1] if k + 1 < len(firsts) else len(own)
        pes = body[ends[i] - (PACKET - skip[i]) : ends[j - 1]]
        if pes[:3] != b"\0\0\1" or len(pes) < 14:
            damaged.append(k)
            continue
        pts.append(unstamp(pes[9:14]))
        unit = pes[9 + pes[8] :]
        if len(unit) != int.from_bytes(pes[4:6], "big") - 3 - pes[8] or broken[i + 1 : j].any():
            damaged.append(k)
        if flags[i] & 2 and own[i, 4] and own[i, 5] & 0x40:
            access.append(k)
        payload.append(unit)
    return dict(payload=b"".join(payload), pts=pts, access=access, lost=int(broken.sum()), damaged=damaged)


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def store(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored form of each text in ``media``."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        both = [padded(t) for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "n_bytes": [n for n, _ in both], "media": [mux(p) for _, p in both]}

    return map_rows(pick(df, {"doc_id": "long", "text": "string"}), run, "doc_id long, n_bytes long, media binary")


READ = "doc_id long, n_bytes long, media binary, payload binary, pts array<long>, access array<int>, lost int, damaged array<int>"


def read_back(df: DataFrame) -> DataFrame:
    """The stored bytes parsed: payload, timestamps, random-access points and what is damaged."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        read = [demux(m or b"") for m in cols["media"]]
        return {c: cols[c] for c in ("doc_id", "n_bytes", "media")} | {k: [r[k] for r in read] for k in ("payload", "pts", "access", "lost", "damaged")}

    return map_rows(df.select("doc_id", "n_bytes", "media"), run, READ)


def digests(df: DataFrame) -> DataFrame:
    """What a catalogue keeps of ``read_back``: digests and a feature string (units, access points, last timestamp, losses, mean sample)."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {
            "payload_bytes": [len(p) for p in cols["payload"]],
            "payload_sha256": [hashlib.sha256(p).hexdigest() for p in cols["payload"]],
            "tail_crc32": [zlib.crc32(p[-64:]) for p in cols["payload"]],
            "media_bytes": [len(m) for m in cols["media"]],
            "media_sha256": [hashlib.sha256(m).hexdigest() for m in cols["media"]],
            "feature": [
                f"units={len(t)};access={','.join(map(str, a))};last_pts={max(t, default=-1)};lost={lost};damaged={len(d)};mean={np.frombuffer(p, np.uint8).mean() if p else 0:.4f}"
                for t, a, lost, d, p in zip(cols["pts"], cols["access"], cols["lost"], cols["damaged"], cols["payload"], strict=True)
            ],
        } | {c: cols[c] for c in ("doc_id", "n_bytes")}

    return map_rows(df, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
