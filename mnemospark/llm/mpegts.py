"""Media columns: a text's bytes as an MPEG transport stream, and the stream read back.

Writing: the payload is cut into access units of ``UNIT`` bytes; each is one elementary
packet (PES) with a presentation timestamp, spread over 188-byte transport packets of one
PID. A program association table and a program map table come first and again before every
``TABLES_EVERY`` units; those units are marked as random-access points and carry a clock
reference. Reading: sync bytes, the two tables (section lengths and CRC-32), continuity
counters and PES headers are checked, packets are reassembled, and the payload, timestamps
and random-access points come back. Damage raises ``ValueError``; nothing is skipped.

Storing and reading are two steps, so a table of streams can be written in between and read by others. Timestamps and
random-access points are columns of arrays.

Nulls and empty texts are 64 zero bytes. All numbers follow from the text alone, so equal
texts have equal streams, and repeated rows are stored like others; timestamps start again after 2^33 ticks in very
long texts. There are no ties. An empty table gives no rows. Other columns are kept if asked; those named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mnemospark.llm.common import append_columns

PACKET, SYNC, MAP_PID, DATA_PID, PROGRAM = 188, 0x47, 0x1000, 0x0100, 1
#: Private data (stream id 0xBD, stream type 0x06): the payload is 8-bit samples, not video.
STREAM_ID, STREAM_TYPE = 0xBD, 0x06
UNIT, TABLES_EVERY, TICKS = 16_384, 8, 3_600
PAD = 64


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The CRC-32 of table sections: most significant bit first, no final inversion."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


ASSOCIATION = _table_packet(0, _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | MAP_PID >> 8, MAP_PID & 255])))
MAP = _table_packet(
    MAP_PID,
    _section(2, PROGRAM, bytes([0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | DATA_PID >> 8, DATA_PID & 255, 0xF0, 0])),
)


def padded(text: str | None) -> tuple[bytes, int]:
    """The payload (UTF-8, zero bytes up to a positive multiple of 64) and its unpadded length."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(PAD, -(-len(data) // PAD) * PAD), b"\0"), len(data)


def _stamp(ticks: int) -> bytes:
    """The five bytes of a presentation timestamp (33 bits)."""
    t = ticks % 2**33
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, 1 | t >> 14 & 0xFE, t >> 7 & 255, 1 | t << 1 & 0xFE])


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit = payload[at : at + UNIT]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + unit
        key = k % TABLES_EVERY == 0
        if key:
            for packet in (ASSOCIATION, MAP):
                out.append(packet[:3] + bytes([0x10 | tables & 15]) + packet[4:])
            tables += 1
        # the first packet of a random-access unit has an adaptation field with the clock
        clock = k * TICKS % 2**33
        field = bytes([0x50, clock >> 25, clock >> 17 & 255, clock >> 9 & 255, clock >> 1 & 255, (clock & 1) << 7 | 0x7E, 0]) if key else b""
        room = PACKET - 4 - (len(field) + 1 if key else 0)
        if len(pes) < room:
            field = (field or b"\0").ljust(PACKET - 5 - len(pes), b"\xff") if len(pes) < PACKET - 5 else b""
            room = len(pes)
            control = 0x30
        else:
            control = 0x30 if key else 0x10
        head = bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, control | counter & 15])
        out.append(head + (bytes([len(field)]) + field if control == 0x30 else b"") + pes[:room])
        counter += 1
        rest = pes[room:]
        full = len(rest) // (PACKET - 4)
        if full:  # all full packets of the unit at once
            block = np.empty((full, PACKET), np.uint8)
            block[:, 0], block[:, 1], block[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 255
            block[:, 3] = 0x10 | (np.arange(counter, counter + full) & 15)
            block[:, 4:] = np.frombuffer(rest, np.uint8, full * (PACKET - 4)).reshape(full, -1)
            out.append(block.tobytes())
            counter += full
        tail = rest[full * (PACKET - 4) :]
        if tail:
            stuffing = PACKET - 5 - len(tail)
            field = b"" if stuffing == 0 else b"\0".ljust(stuffing, b"\xff")
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | counter & 15, len(field)]) + field + tail)
            counter += 1
    return b"".join(out)


def _read_section(packet: bytes, table: int) -> bytes:
    start = 5 + packet[4]
    length = (packet[start + 1] & 15) << 8 | packet[start + 2]
    section = packet[start : start + 3 + length]
    if section[0] != table or section_crc(section) != 0:
        raise ValueError("a program table is damaged")
    return section[8:-4]


def demux(stream: bytes) -> tuple[bytes, list[int], list[int]]:
    """Payload, timestamps of its units, and byte offsets of random-access points."""
    if len(stream) % PACKET:
        raise ValueError("the stream is not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if len(packets) == 0 or (packets[:, 0] != SYNC).any() or (packets[:, 1] & 0x80).any():
        raise ValueError("a packet lost its sync byte or is marked as damaged")
    pids = (packets[:, 1].astype(np.int64) & 31) << 8 | packets[:, 2]
    counters = packets[:, 3] & 15
    for pid in set(pids.tolist()):
        own = counters[pids == pid].astype(np.int64)
        if ((np.diff(own) - 1) % 16).any():
            raise ValueError(f"packets of PID {pid} are missing")
    seen: dict[bytes, bytes] = {}  # equal tables are parsed once

    def table(i: int, kind: int) -> bytes:
        raw = stream[i * PACKET + 4 : (i + 1) * PACKET]
        if raw not in seen:
            seen[raw] = _read_section(stream[i * PACKET : (i + 1) * PACKET], kind)
        return seen[raw]

    map_pid = data_pid = None
    for i in np.flatnonzero(pids == 0):
        body = table(int(i), 0)
        map_pid = (body[2] & 31) << 8 | body[3]
    if map_pid is None:
        raise ValueError("there is no program association table")
    for i in np.flatnonzero(pids == map_pid):
        body = table(int(i), 2)
        at = 4 + ((body[2] & 15) << 8 | body[3])
        if body[at] != STREAM_TYPE:
            raise ValueError("the program has another kind of stream")
        data_pid = (body[at + 1] & 31) << 8 | body[at + 2]
    if data_pid is None:
        raise ValueError("there is no program map table")
    own = np.flatnonzero(pids == data_pid)
    data = packets[own]
    adapted = (data[:, 3] & 0x20) != 0
    skip = np.where(adapted, 1 + data[:, 4].astype(np.int64), 0)
    if (skip > PACKET - 4).any():
        raise ValueError("an adaptation field is too long")
    body = np.arange(PACKET)[None, :] >= (4 + skip)[:, None]
    joined = data[body].tobytes()
    sizes = PACKET - 4 - skip
    offsets = np.cumsum(sizes) - sizes
    random_access = adapted & (data[:, 4] > 0) & ((data[:, 5] & 0x40) != 0)
    payload, stamps, points, written = [], [], [], 0
    starts = np.flatnonzero(data[:, 1] & 0x40)
    if not len(starts) or starts[0] != 0:
        raise ValueError("the stream does not begin with a unit")
    ends = np.append(offsets[starts[1:]], len(joined))
    for s, end in zip(starts.tolist(), ends.tolist()):
        at = int(offsets[s])
        if joined[at : at + 4] != b"\0\0\1" + bytes([STREAM_ID]):
            raise ValueError("an elementary packet has no start code")
        if int.from_bytes(joined[at + 4 : at + 6], "big") != end - at - 6:
            raise ValueError("an elementary packet has another length than it says")
        p = joined[at + 9 : at + 14]
        stamps.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        if random_access[s]:
            points.append(written)
        unit = joined[at + 9 + joined[at + 8] : end]
        payload.append(unit)
        written += len(unit)
    return b"".join(payload), stamps, points


def stored(text: str | None) -> tuple[bytes, int]:
    """The stream that stores a text, and the text's bytes."""
    payload, n_bytes = padded(text)
    return mux(payload), n_bytes


def read_back(stream: bytes) -> tuple:
    """What a stored stream holds: digests of its payload and of itself, its timestamps and random-access points, its feature."""
    back, stamps, points = demux(stream)
    samples = np.frombuffer(back, np.uint8)
    feature = f"units={len(stamps)};mean={samples.mean():.4f};max={int(samples.max())}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), feature, stamps, points


def store(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_bytes`` and ``media``, the stream that stores each row's whole text."""

    def run(texts: list[str | None]) -> list:
        return [list(x) for x in zip(*((n, data) for data, n in map(stored, texts)))] if texts else [[], []]

    return append_columns(docs, "text", keep, [("n_bytes", T.LongType()), ("media", T.BinaryType())], lambda: run)


def read(media: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with what each row's stream in ``media`` gives when it is read: payload digests, ``pts`` (presentation
    timestamps of its units) and ``access_points`` (payload offsets at which reading can begin), features."""
    numbers = T.ArrayType(T.LongType())
    new = [
        ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()),
        ("media_sha256", T.StringType()), ("feature", T.StringType()), ("pts", numbers), ("access_points", numbers),
    ]

    def run(streams: list[bytes]) -> list:
        return [list(x) for x in zip(*map(read_back, streams))] if streams else [[] for _ in new]

    return append_columns(media, "media", keep, new, lambda: run)


def media_columns(docs: DataFrame, keep: list[str], stream: bool = False) -> DataFrame:
    """``keep`` and what every row's stored and reread stream gives (and, if asked, the stream as ``media``)."""
    kept = [*(c for c in keep if c.lower() not in ("n_bytes", "media")), "n_bytes"]
    return read(store(docs, keep), [*kept, "media"] if stream else kept)
