"""Media columns: MPEG transport streams that hold a document's bytes as timed access units."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.common import documents, durable, map_texts, slices, small_batches, texts

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0x0000, 0x1000, 0x0100
PROGRAM = 1
#: Stream type of private PES data, and its stream id.
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
#: Payload bytes of an access unit, its duration on the 90 kHz clock, and access units from one random-access point to the next.
UNIT, TICKS, RANDOM_ACCESS = 8192, 3600, 4


class AccessUnit(NamedTuple):
    """A reassembled elementary packet."""

    pid: int
    pts: int | None
    random_access: bool
    data: bytes


class Stream(NamedTuple):
    """What a transport stream holds: program number to PMT's pid, pid to stream type, access units, faults."""

    programs: dict[int, int]
    streams: dict[int, int]
    units: list[AccessUnit]
    packets: int
    gaps: int
    bad: int


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2 of a section; 0 over a section with its own CRC."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | 5 + len(body) + 4).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


#: Program association and program map sections, as they stand in a packet: pointer, section, stuffing.
PAT = (b"\0" + _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))).ljust(PACKET - 4, b"\xff")
PMT = (b"\0" + _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")).ljust(PACKET - 4, b"\xff")


def _clock(base: int) -> bytes:
    """A program clock reference."""
    return (base << 15 | 0x3F << 9).to_bytes(6, "big")


def _stamp(pts: int) -> bytes:
    """A presentation timestamp of a PES header."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def multiplex(payload: bytes) -> bytes:
    """A transport stream with one program of one private data stream; tables stand before each random-access point."""
    out = []
    counters = dict.fromkeys((PAT_PID, PMT_PID, DATA_PID), 0)

    def put(pid: int, start: bool, adaptation: bytes, body: bytes) -> None:
        n = counters[pid]
        counters[pid] = n + 1 & 15
        out.append(bytes((SYNC, start << 6 | pid >> 8, pid & 255, (0x30 if adaptation else 0x10) | n)) + adaptation + body)

    for k, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at : at + UNIT]
        pts = k * TICKS & 0x1FFFFFFFF
        # unit lengths fit in 16 bits; the header after it: marker bits, flags, length, timestamp
        pes = b"\0\0\1" + bytes([PRIVATE_STREAM]) + (8 + len(data)).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + data
        adaptation, begin = b"", 0
        if k % RANDOM_ACCESS == 0:
            put(PAT_PID, True, b"", PAT)
            put(PMT_PID, True, b"", PMT)
            adaptation = b"\x07\x50" + _clock(pts)
        while begin < len(pes):
            room = PACKET - 4 - len(adaptation)
            left = len(pes) - begin
            if left < room:  # stuffing goes into the adaptation field
                if not adaptation:
                    adaptation = b"\x00" if room - left == 1 else bytes([room - left - 1, 0]) + b"\xff" * (room - left - 2)
                else:
                    adaptation = bytes([adaptation[0] + room - left]) + adaptation[1:] + b"\xff" * (room - left)
                room = left
            put(DATA_PID, begin == 0, adaptation, pes[begin : begin + room])
            adaptation, begin = b"", begin + room
    return b"".join(out)


def demultiplex(stream: bytes) -> Stream:
    """Parse a transport stream: tables, continuity, elementary packets with timestamps and random-access points.

    Packets without the sync byte, sections with a wrong CRC and elementary packets cut short count as bad and
    are left out; a step of a continuity counter other than one (or a plain repeat) counts as a gap. A table's
    sections may span packets and may follow each other in one; what a gap cuts is bad.
    """
    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    units: list[AccessUnit] = []
    last: dict[int, int] = {}
    open_: dict[int, tuple[list[bytes], bool]] = {}
    partial: dict[int, bytes] = {}
    gaps = bad = 0

    def table(pid: int, section: bytes) -> None:
        nonlocal bad
        if len(section) < 12 or section_crc(section):
            bad += 1
        elif pid == PAT_PID:
            for i in range(8, len(section) - 4, 4):
                if number := int.from_bytes(section[i : i + 2], "big"):
                    programs[number] = int.from_bytes(section[i + 2 : i + 4], "big") & 0x1FFF
        else:
            i = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
            while i < len(section) - 4:
                streams[int.from_bytes(section[i + 1 : i + 3], "big") & 0x1FFF] = section[i]
                i += 5 + (int.from_bytes(section[i + 3 : i + 5], "big") & 0xFFF)

    def complete(pid: int, data: bytes) -> bytes:
        """Read the whole sections at the front of ``data``; return the beginning of one that goes on."""
        while data and data[0] != 0xFF:  # stuffing follows the last section
            size = 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)
            if len(data) < max(size, 3):
                return data
            table(pid, data[:size])
            data = data[size:]
        return b""

    def close(pid: int) -> None:
        nonlocal bad
        parts, random_access = open_.pop(pid)
        pes = b"".join(parts)
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\0\0\1" or len(pes) < 9 or (length and len(pes) < 6 + length):
            bad += 1
            return
        pts = None
        if pes[7] & 0x80:
            p = pes[9:14]
            pts = (p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1
        units.append(AccessUnit(pid, pts, random_access, pes[9 + pes[8] : 6 + length if length else None]))

    count = len(stream) // PACKET
    for at in range(0, count * PACKET, PACKET):
        if stream[at] != SYNC:
            bad += 1
            continue
        b1, b3 = stream[at + 1], stream[at + 3]
        pid, start = (b1 & 0x1F) << 8 | stream[at + 2], b1 & 0x40
        begin, random_access, cut = at + 4, False, False
        if b3 & 0x20:
            size = stream[begin]
            if size:
                random_access, cut = bool(stream[begin + 1] & 0x40), bool(stream[begin + 1] & 0x80)
            begin += 1 + size
        if not b3 & 0x10:
            continue
        counter, was, gap = b3 & 15, last.get(pid), False
        last[pid] = counter
        if was is not None and not cut and counter != was + 1 & 15:
            if counter == was:
                continue  # a repeated packet
            gap = True
            gaps += 1
        end = at + PACKET
        if pid == PAT_PID or pid in programs.values():
            body, before = stream[begin:end], partial.pop(pid, b"")
            if start and gap and before:
                before, bad = b"", bad + 1
            if start:
                pointer = body[0] if body else 0
                if before and complete(pid, before + body[1 : 1 + pointer]):
                    bad += 1  # the section before ended too early
                partial[pid] = complete(pid, body[1 + pointer :])
            elif before and not gap:
                partial[pid] = complete(pid, before + body)
            elif before:
                bad += 1
        elif pid in streams:
            if start:
                if pid in open_:
                    close(pid)
                open_[pid] = ([stream[begin:end]], random_access)
            elif pid in open_:
                open_[pid][0].append(stream[begin:end])
    for pid in list(open_):
        close(pid)
    bad += sum(1 for rest in partial.values() if rest)
    return Stream(programs, streams, units, count, gaps, bad)


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text (null: empty), and its bytes with zeros up to a positive multiple of 64."""
    data = (text or "").encode()
    return len(data), data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each document's bytes, padded, as a transport stream."""

    def make() -> Callable[[list], dict]:
        def work(batch: list) -> dict:
            both = [padded(t) for t in batch]
            return {"n_bytes": [n for n, _ in both], "media": pa.array([multiplex(p) for _, p in both], pa.binary())}

        return work

    return map_texts(texts(docs), make, "doc_id long, n_bytes long, media binary")


def access_units(media: DataFrame) -> DataFrame:
    """(doc_id, pid, unit, pts, random_access, data) of a media table, one row for each elementary packet."""
    schema = pa.schema([("doc_id", pa.int64()), ("pid", pa.int64()), ("unit", pa.int64()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                for doc, stream in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    units = demultiplex(stream.as_py() or b"").units
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "pid": u.pid, "unit": i, "pts": u.pts, "random_access": u.random_access, "data": u.data} for i, u in enumerate(units)], schema)

    return small_batches(media).select("doc_id", "media").mapInArrow(run, "doc_id long, pid long, unit long, pts long, random_access boolean, data binary")


def feature(stream: Stream) -> str:
    """A stream's structure in words: tables, packets, units, timestamps, random-access points and faults."""
    times = [u.pts for u in stream.units if u.pts is not None]
    points = sum(u.random_access for u in stream.units)
    pids = ",".join(f"{p}:{t}" for p, t in sorted(stream.streams.items()))
    return f"programs={len(stream.programs)};streams={pids};packets={stream.packets};units={len(stream.units)};pts={min(times, default='')}-{max(times, default='')};random_access={points};gaps={stream.gaps};bad={stream.bad}"


def read_back(media: DataFrame) -> DataFrame:
    """Sizes and digests of what the streams of a media table hold, and their features, one row for each of its rows."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "media"):
                out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                for cell in part.column(2):
                    stored = cell.as_py() or b""
                    stream = demultiplex(stored)
                    read = b"".join(u.data for u in stream.units)
                    row = (len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stream))
                    for k, v in zip(out, row, strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n_bytes": part.column(1)} | out)

    return small_batches(media).select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def media_digests(docs: DataFrame) -> DataFrame:
    """One row a document: sizes and digests of what its stored stream holds, and the stream's feature.

    The media column is written as a table of the shared folder (which is left there) and everything but
    n_bytes is computed from the column read again. Null text counts as empty (64 zero bytes); equal texts have
    equal streams; texts of any length are held whole; repeated rows and null doc_id stay; an empty table gives
    no rows; other columns are ignored.
    """
    return read_back(durable(media_table(docs), "media"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored transport stream, and what can be read back from it."""
    return media_digests(documents(spark, sf_dir))
