"""Media columns as MPEG transport streams: multiplexing, and reading back with timestamps and random-access points.

A payload is cut into access units. Each is a packetised elementary packet with a presentation timestamp,
carried in 188-byte packets whose continuity counter runs on; every GOP-th unit is a random-access point
and carries a clock reference. A program association and a program map table stand before each such point, so that a reader can begin
there. The reader finds the streams through the first of these tables that are whole (by their CRC), checks the continuity counters, leaves out repeated
packets, reassembles the elementary packets and keeps, per stream, the timestamps and the random-access
points with their byte offsets, so that a reader can seek.

The media are a binary column, stored as a Parquet table in the shared folder by the query.

Defined cases: a null or empty text is a payload of PAD spaces; very long texts are stored whole, in as many units as they need, their
timestamps going on from zero after 2 ** 33; equal texts give equal streams; an empty table gives no rows; a stream
with damage raises no error: lost packets are counted, an elementary packet with a gap is left out, and a
stream without tables has no payload; rows come out as often as they came in; further columns of the input
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import landed, pieces_of

PAD = 192
PACKET = 188
ROOM = PACKET - 4
PMT_PID, STREAM_PID, STREAM_TYPE = 0x1000, 0x0100, 0x06
STREAM_ID = 0xBD
#: Bytes of an access unit, ticks of 1/90,000 s from one to the next, and units from one random-access point to the next.
UNIT, TICKS, GOP = 19_200, 3_600, 12
PTS_WRAP = 1 << 33


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % PAD if raw else PAD)


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    whole = head + body
    return whole + crc32_mpeg(whole).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    packet = b"\x47" + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


@lru_cache(16)
def _tables(counter: int) -> bytes:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    streams = bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + streams)
    return _table_packet(0, pat, counter) + _table_packet(PMT_PID, pmt, counter)


def _pes(unit: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
    return b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + unit


def _adaptation(size: int, pts: int | None) -> bytes:
    """An adaptation field of so many bytes; with pts, of a random-access point with its clock reference."""
    if size < 2:
        return b"\x00" * size
    flags, clock = 0, b""
    if pts is not None:
        flags, clock = 0x50, (pts << 15 | 0x7E00).to_bytes(6, "big")
    return bytes([size - 1, flags]) + clock + b"\xff" * (size - 2 - len(clock))


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with the payload as its only stream."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        pts = k * TICKS % PTS_WRAP
        pes = _pes(payload[at : at + UNIT], pts)
        point = k % GOP == 0
        if point:
            out.append(_tables(k // GOP & 15))
        size = max(8 if point else 0, ROOM - len(pes))
        first = ROOM - size
        head = bytes([0x47, 0x40 | STREAM_PID >> 8, STREAM_PID & 255, (0x30 if size else 0x10) | counter])
        out += [head, _adaptation(size, pts if point else None), pes[:first]]
        counter = counter + 1 & 15
        full = (len(pes) - first) // ROOM
        if full:
            packets = np.empty((full, PACKET), dtype=np.uint8)
            packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, STREAM_PID >> 8, STREAM_PID & 255
            packets[:, 3] = 0x10 | (np.arange(full) + counter & 15)
            packets[:, 4:] = np.frombuffer(pes, np.uint8, full * ROOM, first).reshape(full, ROOM)
            out.append(packets.tobytes())
            counter = counter + full & 15
        if rest := (len(pes) - first) % ROOM:
            out += [bytes([0x47, STREAM_PID >> 8, STREAM_PID & 255, 0x30 | counter]), _adaptation(ROOM - rest, None), pes[-rest:]]
            counter = counter + 1 & 15
    return b"".join(out)


@dataclass
class Stream:
    """What a reader finds of one elementary stream."""

    program: int
    pid: int
    kind: int
    payload: bytes = b""
    timestamps: list[int] = field(default_factory=list)
    #: (timestamp, offset of the packet in the stored bytes) of each random-access point.
    points: list[tuple[int, int]] = field(default_factory=list)
    packets: int = 0
    lost: int = 0
    repeated: int = 0
    left_out: int = 0


@lru_cache(256)
def _body(packet: bytes, table_id: int) -> tuple[int, bytes] | None:
    """Number and body of the section that a packet begins; None if its CRC fails."""
    at = 4 + (1 + packet[4] if packet[3] & 0x20 else 0)
    section = packet[at + 1 + packet[at] :] if at < PACKET else b""
    size = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)
    if size < 12 or len(section) < size or section[0] != table_id or crc32_mpeg(section[:size]):
        return None
    return int.from_bytes(section[3:5], "big"), section[8 : size - 4]


def _first_whole(packets: np.ndarray, rows: np.ndarray, table_id: int) -> tuple[int, bytes] | None:
    return next((own for r in rows if (own := _body(packets[r].tobytes(), table_id))), None)


def _streams(packets: np.ndarray, pid: np.ndarray, begins: np.ndarray) -> list[Stream]:
    """The streams that the tables name."""
    found = []
    programs = _first_whole(packets, np.flatnonzero((pid == 0) & begins), 0)
    for i in range(0, len(programs[1]), 4) if programs else ():
        program, map_pid = (int.from_bytes(programs[1][j : j + 2], "big") for j in (i, i + 2))
        own = _first_whole(packets, np.flatnonzero((pid == map_pid & 0x1FFF) & begins), 2) if program else None
        if own is None or own[0] != program:
            continue
        body = own[1]
        at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
        while at + 5 <= len(body):
            found.append(Stream(program, int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF, body[at]))
            at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    return found


def demux(media: bytes) -> list[Stream]:
    """The elementary streams of a transport stream."""
    packets = np.frombuffer(media, np.uint8, len(media) // PACKET * PACKET).reshape(-1, PACKET)
    index = np.flatnonzero(packets[:, 0] == 0x47)
    packets = packets[index]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    begins = packets[:, 1] & 0x40 != 0
    streams = _streams(packets, pid, begins)
    for s in streams:
        rows = np.flatnonzero((pid == s.pid) & (packets[:, 3] & 0x10 != 0))
        if not len(rows):
            continue
        own = packets[rows]
        step = np.diff(own[:, 3] & 15) & 15
        again = np.r_[False, (step == 0) & (own[1:] == own[:-1]).all(axis=1)]
        s.repeated = int(again.sum())
        own, rows = own[~again], rows[~again]
        step = np.r_[1, np.diff(own[:, 3] & 15) & 15]
        s.packets, s.lost = len(own), int((step - 1 & 15).sum())
        extended = own[:, 3] & 0x20 != 0
        skip = np.minimum(4 + np.where(extended, own[:, 4].astype(np.int32) + 1, 0), PACKET)
        data = own[np.arange(PACKET) >= skip[:, None]].tobytes()
        upto = np.r_[0, np.cumsum(PACKET - skip)]
        starts = np.flatnonzero(own[:, 1] & 0x40 != 0)
        parts = []
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
            pes = data[upto[a] : upto[z]]
            size = int.from_bytes(pes[4:6], "big")
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or (size and len(pes) != size + 6) or (step[a + 1 : z] != 1).any():
                s.left_out += 1
                continue
            if pes[7] & 0x80:
                b = pes[9:14]
                pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
                s.timestamps.append(pts)
                if extended[a] and own[a, 4] and own[a, 5] & 0x40:
                    s.points.append((pts, int(index[rows[a]]) * PACKET))
            parts.append(pes[9 + pes[8] :])
        s.payload = b"".join(parts)
    return streams


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, 1):
            made = [padded(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FACTS = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "timestamps array<long>, random_access array<struct<pts: long, offset: long>>"
)


def facts(media: bytes) -> tuple:
    """The values of FACTS: of the first stream's payload, and of the stored bytes."""
    streams = demux(media)
    s = streams[0] if streams else Stream(0, 0, 0)
    feature = (
        f"programs={len({x.program for x in streams})};pid={s.pid};type={s.kind};packets={s.packets};lost={s.lost};repeated={s.repeated};"
        f"units={len(s.timestamps)};left_out={s.left_out};pts={s.timestamps[0] if s.timestamps else ''}-{s.timestamps[-1] if s.timestamps else ''};"
        f"points={','.join(f'{p}@{o}' for p, o in s.points)}"
    )
    return (
        len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature,
        s.timestamps, [{"pts": p, "offset": o} for p, o in s.points],
    )


def with_facts(media: DataFrame) -> DataFrame:
    """The table's rows without media, with what its transport streams hold."""
    kept = [f for f in media.schema.fields if f.name != "media"]
    names = [f.name for f in kept]
    types = pa.struct([
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
        ("feature", pa.string()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = zip(*(facts(m.as_py() or b"") for m in b.column("media")), strict=True)
            made = [pa.array(c, t.type) for c, t in zip(columns, types, strict=True)] if len(b) else [pa.array([], t.type) for t in types]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, *(t.name for t in types)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return media.mapInArrow(run, f"{schema}, {FACTS}")


def report(docs: DataFrame) -> DataFrame:
    stored = landed(with_media(docs), "media", compression="zstd")
    return with_facts(stored).select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access"
    )
