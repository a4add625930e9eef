"""Media columns as MPEG transport streams (operator 8).

A payload is carried by 188-byte packets: a program association table, a
program map table and packetised elementary stream (PES) packets, each with a
presentation time stamp; the first packet of a PES packet is a random-access
point. The reader parses both tables (with their CRC), checks every continuity
counter, reassembles the PES packets and lists time stamps and random-access
points with their places, so that a reader can seek.

Odd input: an empty payload is one that has no PES packet; null texts are
empty; a broken stream raises StreamError; a repeated packet (same counter, as
the standard allows) is read once; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame

from .common import Rows, id_and_text, small_batches, value_bytes, value_offsets

# Fixed values of the format.
PACKET, SYNC, PAT_PID, CLOCK = 188, 0x47, 0, 90_000
PMT_PID, ES_PID, PROGRAM, PRIVATE_STREAM, STREAM_ID = 0x1000, 0x0101, 1, 0x06, 0xBD
PES_BYTES = 18_400  # of payload in a PES packet
STEP = CLOCK // 25  # between two time stamps
ALIGN, FILL = 192, b" "


class StreamError(ValueError):
    """The stream breaks a rule of the format."""


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        table.append(c)
    return table


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ CRC_TABLE[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), key, 0xC1, 0, 0)
    whole = head + body
    return whole + struct.pack(">I", crc32_mpeg(whole))


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10 | counter & 15) + b"\0"
    return (head + section).ljust(PACKET, b"\xff")


PAT = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
PMT = _section(0x02, PROGRAM, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, PRIVATE_STREAM, 0xE000 | ES_PID, 0xF000))
TABLES = _table_packet(PAT_PID, PAT, 0) + _table_packet(PMT_PID, PMT, 0)


def _stamp(prefix: int, t: int) -> bytes:
    return bytes([prefix << 4 | (t >> 29 & 0xE) | 1, t >> 22 & 0xFF, (t >> 14 & 0xFE) | 1, t >> 7 & 0xFF, (t << 1 & 0xFE) | 1])


def mux(payload: bytes, pes_bytes: int = PES_BYTES) -> bytes:
    """The transport stream of a payload, one PES packet for each ``pes_bytes`` of it."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, len(payload), pes_bytes)):
        part = payload[at : at + pes_bytes]
        t = k * STEP % (1 << 33)
        pes = b"\0\0\1" + struct.pack(">BHBBB", STREAM_ID, len(part) + 8, 0x84, 0x80, 5) + _stamp(2, t) + part
        # First packet: adaptation field of 8 bytes with the random-access flag and the clock reference.
        pcr = struct.pack(">IH", t >> 1, (t & 1) << 15 | 0x7E00)
        room, first = PACKET - 4 - 8, pes[: PACKET - 4 - 8]
        stuff = room - len(first)
        out.append(struct.pack(">BHB", SYNC, 0x4000 | ES_PID, 0x30 | counter) + bytes([7 + stuff, 0x50]) + pcr + b"\xff" * stuff + first)
        counter = counter + 1 & 15
        rest = pes[len(first) :]
        full = len(rest) // (PACKET - 4)
        if full:
            grid = np.empty((full, PACKET), np.uint8)
            grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            grid[:, 3] = 0x10 | (counter + np.arange(full)) & 15
            grid[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, PACKET - 4)
            out.append(grid.tobytes())
            counter = counter + full & 15
        if tail := rest[full * (PACKET - 4) :]:
            pad = PACKET - 4 - len(tail) - 1  # bytes after the adaptation field's length
            field_ = bytes([pad]) + (b"\0" + b"\xff" * (pad - 1) if pad else b"")
            out.append(struct.pack(">BHB", SYNC, ES_PID, 0x30 | counter) + field_ + tail)
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a reader got: payload, (time stamp, payload place) of each PES packet, packet places of random-access points."""

    payload: bytes = b""
    stamps: list[tuple[int, int]] = field(default_factory=list)
    access: list[int] = field(default_factory=list)
    packets: int = 0
    program: int = 0
    stream_type: int = 0


def _read_section(packets: np.ndarray, pid: int, table_id: int) -> bytes:
    if not len(packets):
        raise StreamError(f"no packet of table {table_id}")
    raw = packets[0].tobytes()
    at = 4 + (1 + raw[4] if raw[3] & 0x20 else 0)
    at += 1 + raw[at]  # pointer field
    size = (raw[at + 1] & 0x0F) << 8 | raw[at + 2]
    section = raw[at : at + 3 + size]
    if section[0] != table_id or crc32_mpeg(section) != 0:
        raise StreamError(f"table {table_id} of pid {pid} is broken")
    return section


def demux(media: bytes) -> Stream:
    """Parse a transport stream of one program with one elementary stream."""
    if len(media) % PACKET:
        raise StreamError("not whole packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if len(grid) and not (grid[:, 0] == SYNC).all():
        raise StreamError("sync byte lost")
    pids = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    pat = _read_section(grid[pids == PAT_PID], PAT_PID, 0x00)
    program, pmt_pid = struct.unpack(">HH", pat[8:12])
    pmt_pid &= 0x1FFF
    pmt = _read_section(grid[pids == pmt_pid], pmt_pid, 0x02)
    info = struct.unpack(">H", pmt[10:12])[0] & 0x0FFF
    kind, es_pid = struct.unpack(">BH", pmt[12 + info : 15 + info])
    out = Stream(packets=len(grid), program=program, stream_type=kind)
    places = np.flatnonzero(pids == (es_pid & 0x1FFF))
    es = grid[places]
    if not len(es):
        return out
    counter = (es[:, 3] & 15).astype(np.int16)
    gap = np.diff(counter) & 15
    again = np.concatenate([[False], (gap == 0) & (es[1:] == es[:-1]).all(1)])
    if ((gap != 1) & ~again[1:]).any():
        raise StreamError(f"continuity lost at packet {int(places[1 + np.flatnonzero((gap != 1) & ~again[1:])[0]])}")
    es, places = es[~again], places[~again]
    adapted = (es[:, 3] & 0x20) > 0
    skip = np.where(adapted, 5 + es[:, 4].astype(np.int32), 4)
    unit = (es[:, 1] & 0x40) > 0
    if not unit[0]:
        raise StreamError("the stream begins inside a PES packet")
    access = adapted & (es[:, 4] > 0) & ((es[:, 5] & 0x40) > 0)
    out.access = places[access].tolist()
    parts, size = [], 0
    begins = np.flatnonzero(unit)
    for a, b in zip(begins, [*begins[1:], len(es)]):
        rows, cut = es[a:b], skip[a:b]
        pes = b"".join([rows[0, cut[0] :].tobytes(), rows[1:-1, 4:].tobytes() if (cut[1:-1] == 4).all() else b"".join(r[c:].tobytes() for r, c in zip(rows[1:-1], cut[1:-1])), rows[-1, cut[-1] :].tobytes() if b - a > 1 else b""])
        if pes[:3] != b"\0\0\1":
            raise StreamError("no PES start code")
        length = int.from_bytes(pes[4:6], "big")
        if length != len(pes) - 6:
            raise StreamError("a PES packet has lost bytes")
        if pes[7] & 0x80:
            s = pes[9:14]
            out.stamps.append(((s[0] & 0xE) << 29 | s[1] << 22 | (s[2] & 0xFE) << 14 | s[3] << 7 | s[4] >> 1, size))
        parts.append(pes[9 + pes[8] :])
        size += len(parts[-1])
    out.payload = b"".join(parts)
    return out


def feature(s: Stream) -> str:
    """Program, stream type, packets, PES packets, random-access points, last time stamp, mean byte of the payload."""
    last = s.stamps[-1][0] if s.stamps else -1
    mean = float(np.frombuffer(s.payload, np.uint8).mean()) if s.payload else 0.0
    return f"program={s.program};type={s.stream_type};packets={s.packets};pes={len(s.stamps)};access={len(s.access)};last={last};mean={mean:.6f}"


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text, filled up to a positive multiple of 192, as a transport stream."""
    rows = Rows(doc_id="long", n_bytes="long", media="binary")

    def run(batches):
        for batch in small_batches(batches):
            col = batch.column(1)
            at, data = value_offsets(col).tolist(), value_bytes(col)
            sizes, media = [], []
            for a, b in zip(at, at[1:]):
                n = b - a
                media.append(mux(bytes(data[a:b]) + FILL * (max(ALIGN, -(-n // ALIGN) * ALIGN) - n)))
                sizes.append(n)
            yield rows.batch(batch.column(0), sizes, media)

    return id_and_text(docs).mapInArrow(run, rows.schema)


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and features of the stored streams, all from the bytes read back."""
    rows = Rows(doc_id="long", n_bytes="long", payload_bytes="long", payload_sha256="string", tail_crc32="long", media_bytes="long", media_sha256="string", feature="string", stamps="array<long>", access_points="array<long>")

    def run(batches):
        for batch in small_batches(batches, column="media"):
            out = []
            for doc_id, n, media in zip(*(c.to_pylist() for c in batch.columns)):
                s = demux(media)
                out.append((doc_id, n, len(s.payload), sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), sha256(media).hexdigest(), feature(s), [t for t, _ in s.stamps], s.access))
            yield rows.batch(*zip(*out))

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, rows.schema)
