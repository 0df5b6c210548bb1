"""Media columns as MPEG transport streams.

``encode`` carries a payload losslessly as a private-data elementary stream: program tables, packetised access units
with a time stamp each, a clock reference and a random-access flag at each unit's first packet. ``decode`` parses the
program tables (with their checksums), checks the continuity counters of every stream, reassembles the elementary
packets and returns payload, time stamps and random-access points.

Edge cases: a null or empty text is one padding block. Equal texts give equal streams, whatever their rows. A stream
with a lost packet decodes to what is there: ``cc_errors`` counts the breaks, and units that a break cuts are marked
damaged. Bytes that are no transport stream raise ValueError. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom import runtime

PACKET = 188
BLOCK = 576
PAT_PID, PMT_PID, ES_PID = 0, 0x1000, 0x0101
PRIVATE_DATA = 0x06
PRIVATE_STREAM_1 = 0xBD
UNIT = 50 * BLOCK
TICKS = 3600  # of the 90 kHz clock, between units


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 ^ _CRC[c >> 24 ^ b]) & 0xFFFFFFFF
    return c


def _section(table_id: int, ext: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ext.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    p = np.full(PACKET, 0xFF, np.uint8)
    p[:5] = [0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]
    p[5 : 5 + len(section)] = np.frombuffer(section, np.uint8)
    return p


_TABLES = np.stack([_table_packet(PAT_PID, _PAT), _table_packet(PMT_PID, _PMT)])


def _pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, 1 | pts >> 14 & 0xFE, pts >> 7 & 255, 1 | pts << 1 & 0xFE])


def _pcr_bytes(base: int) -> bytes:
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def encode(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream of a payload; ``unit`` bytes to an access unit."""
    if not 0 < unit <= 65000:
        raise ValueError("a unit must fit a PES packet")
    out, cc = [], 0
    for i, start in enumerate(range(0, len(payload), unit)):
        data, pts = payload[start : start + unit], (i * TICKS) % (1 << 33)
        pes = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + data, np.uint8)
        first = min(len(pes), 176)
        full, rest = divmod(len(pes) - first, 184)
        n = 1 + full + (rest > 0)
        p = np.full((n, PACKET), 0xFF, np.uint8)
        p[:, 0], p[:, 1], p[:, 2] = 0x47, ES_PID >> 8, ES_PID & 255
        p[:, 3] = 0x10 | (cc + np.arange(n)) & 15
        p[0, 1] |= 0x40
        p[0, 3] |= 0x20
        p[0, 4], p[0, 5] = 183 - first, 0x50  # random access, clock reference
        p[0, 6:12] = np.frombuffer(_pcr_bytes(pts), np.uint8)
        p[0, PACKET - first :] = pes[:first]
        p[1 : 1 + full, 4:] = pes[first : first + 184 * full].reshape(full, 184)
        if rest:
            p[-1, 3] |= 0x20
            p[-1, 4] = 183 - rest
            if rest < 183:
                p[-1, 5] = 0
            p[-1, PACKET - rest :] = pes[len(pes) - rest :]
        tables = _TABLES.copy()
        tables[:, 3] |= i & 15
        out += [tables.tobytes(), p.tobytes()]
        cc = (cc + n) & 15
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes
    packets: int
    pts: list[int] = field(default_factory=list)
    unit_bytes: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)  # time stamp, byte offset of its packet
    damaged: list[int] = field(default_factory=list)
    cc_errors: int = 0
    stream_type: int = 0


def _first_section(packets: np.ndarray, starts: np.ndarray, unit_start: np.ndarray, table_id: int) -> bytes:
    at = np.flatnonzero(unit_start)
    if not len(at):
        raise ValueError("a program table is missing")
    data = packets[at[0], starts[at[0]] :].tobytes()
    data = data[1 + data[0] :]
    k = at[0] + 1
    while len(data) < 3 or len(data) < 3 + (int.from_bytes(data[1:3], "big") & 0xFFF):
        if k >= len(packets):
            raise ValueError("a program table is cut short")
        data += packets[k, starts[k] :].tobytes()
        k += 1
    data = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
    if data[0] != table_id or crc32_mpeg(data):
        raise ValueError("a program table is damaged")
    return data


def decode(media: bytes) -> Stream:
    if not media or len(media) % PACKET:
        raise ValueError("not whole transport packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    start, control, cc = (p[:, 1] & 0x40) > 0, p[:, 3] >> 4 & 3, p[:, 3] & 15
    begin = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
    has = (control & 1) > 0

    def own(x: int) -> np.ndarray:
        return np.flatnonzero((pid == x) & has)

    k = own(PAT_PID)
    pat = _first_section(p[k], begin[k], start[k], 0)[8:-4]
    programs = [int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(pat), 4) if pat[i : i + 2] != b"\0\0"]
    if not programs:
        raise ValueError("no program")
    k = own(programs[0])
    pmt = _first_section(p[k], begin[k], start[k], 2)
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    if at + 5 > len(pmt) - 4:
        raise ValueError("no elementary stream")
    kind, es = pmt[at], int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF

    errors = 0
    for x in (PAT_PID, programs[0], es):
        k = own(x)
        errors += int((np.diff(cc[k].astype(np.int32)) % 16 != 1).sum())
    k = own(es)
    out = Stream(b"", len(p), cc_errors=errors, stream_type=kind)
    broken = np.concatenate([[False], np.diff(cc[k].astype(np.int32)) % 16 != 1])
    heads = np.flatnonzero(start[k])
    parts = []
    for u, h in enumerate(heads):
        end = heads[u + 1] if u + 1 < len(heads) else len(k)
        rows, lo = p[k[h:end]], begin[k[h:end]]
        flat = rows[:, 4:].reshape(-1) if (lo[1:-1] == 4).all() else None
        if flat is not None and end - h > 1:  # only the first and last packets have an adaptation field
            pes = np.concatenate([rows[0, lo[0] :], flat[184 : 184 * (end - h - 1)], rows[-1, lo[-1] :]]).tobytes()
        else:
            pes = rows[np.arange(PACKET) >= lo[:, None]].tobytes()
        if pes[:3] != b"\0\0\1":
            raise ValueError("no elementary packet where one should start")
        size, head = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        data = pes[head : 6 + size] if size else pes[head:]
        pts = None
        if pes[7] & 0x80:
            b = pes[9:14]
            pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
        if broken[h + 1 : end].any() or size and len(pes) < 6 + size:
            out.damaged.append(u)
        out.pts.append(pts)
        out.unit_bytes.append(len(data))
        if rows[0, 3] & 0x20 and rows[0, 4] and rows[0, 5] & 0x40:
            out.access_points.append((pts, int(k[h]) * PACKET))
        parts.append(data)
    out.payload = b"".join(parts)
    return out


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Appends bytes 255 up to a positive multiple of ``block``."""
    return data + b"\xff" * (max(block, -(-len(data) // block) * block) - len(data))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(x or "").encode() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def feature(s: Stream) -> str:
    """What the stream says of itself: packets, units, access points, counter errors, time span, and the samples' mean, spread and entropy."""
    counts = np.bincount(np.frombuffer(s.payload, np.uint8), minlength=256)
    share, level = counts / counts.sum(), np.arange(256)
    mean = float(share @ level)
    used = share[share > 0]
    return (f"packets={s.packets};units={len(s.pts)};access_points={len(s.access_points)};cc_errors={s.cc_errors};pts={s.pts[0]}-{s.pts[-1]};"
            f"mean={mean:.4f};std={float(np.sqrt(max(0.0, share @ level**2 - mean**2))):.4f};entropy={float(-(used @ np.log2(used))):.4f}")


DECODED = ("doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
           "feature string, access_points array<struct<pts:bigint,byte_offset:bigint>>")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    points = pa.list_(pa.struct([("pts", pa.int64()), ("byte_offset", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), points]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access_points"]
    for batch in batches:
        rows = []
        for doc_id, n, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            s = decode(media)
            rows.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), [{"pts": a, "byte_offset": b} for a, b in s.access_points]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column of every text."""
    runtime.ship(docs.sparkSession)
    runtime.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_encoded, "doc_id bigint, n_bytes bigint, media binary")


def from_media(media: DataFrame) -> DataFrame:
    """Reads a media column back: digests, features and random-access points."""
    runtime.ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decoded, DECODED)


def op10_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = runtime.materialize(to_media(runtime.table(spark, sf_dir, "documents")), "media")
    return from_media(stored)
