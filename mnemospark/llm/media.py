"""Texts as MPEG transport streams, written and read back.

Each payload is cut into access units; a unit becomes one packetised elementary stream (PES) packet of private stream 1 with a
presentation time stamp, and is cut into 188-byte transport packets. Every eighth unit is a
random-access point with a program clock reference. Program association and program map tables, with their
CRC, stand at the start. Reading parses the tables, checks the continuity counters of each
stream, puts the PES packets together, and lists time stamps and random-access points.

The reader takes any legal stream: null packets, packets sent twice, announced discontinuities, tables over several
packets, network entries, several elementary streams, PES packets without a time stamp or of open length, and a start within a
unit. What is damaged is reported as faults beside what could be read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Payloads are padded with spaces to a positive multiple of this.
UNIT = 192
#: Bytes of an access unit; ticks of 90 kHz between units; units between random-access points.
ACCESS_BYTES, TICKS, ACCESS_EVERY = 16 * UNIT, 3600, 8
# Fixed values of the transport stream format.
SYNC, PACKET, PAT_PID, PMT_PID, STREAM_PID, NULL_PID = 0x47, 188, 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
#: Streams whose PES packets have no optional header (map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 type E, directory).
BARE_STREAMS = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
PADDING_STREAM = 0xBE


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ byte]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHB", SYNC, 0x4000 | pid, 0x10) + b"\0" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(
    PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_DATA, 0xE000 | STREAM_PID, 0xF000))
)


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload, whose length is a positive multiple of UNIT."""
    out, counter = [_TABLES], 0
    for unit, at in enumerate(range(0, len(payload), ACCESS_BYTES)):
        body, pts = payload[at : at + ACCESS_BYTES], (unit * TICKS) & 0x1FFFFFFFF
        pes = b"\0\0\1" + struct.pack(">BHBBB", PRIVATE_STREAM, len(body) + 8, 0x84, 0x80, 5) + _stamp(pts) + body
        field = b"\x07\x50" + struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00) if unit % ACCESS_EVERY == 0 else b""
        start, done = 0x4000, 0
        while done < len(pes):
            room = PACKET - 4 - len(field)
            part = pes[done : done + room]
            if len(part) < room:  # stuffing goes into the adaptation field
                short = room - len(part)
                if field:
                    field = bytes([field[0] + short]) + field[1:] + b"\xff" * short
                else:
                    field = bytes([short - 1]) + (b"\0" + b"\xff" * (short - 2) if short > 1 else b"")
            out += (struct.pack(">BHB", SYNC, start | STREAM_PID, (0x30 if field else 0x10) | counter), field, part)
            counter, start, field, done = counter + 1 & 15, 0, b"", done + room
    return b"".join(out)


class Stream(NamedTuple):
    #: the bytes of all units, in the order in which they begin
    payload: bytes
    packets: int
    #: of each unit; None where it has none
    stamps: list[int | None]
    #: (number of the packet, time stamp) of the random-access points
    access: list[tuple[int, int | None]]
    #: (number of the packet, what is wrong)
    faults: list[tuple[int, str]]


class _Sections:
    """Puts the sections of one table PID together; each complete one goes to ``done``."""

    def __init__(self, done):
        self.done, self.held = done, None

    def take(self, number: int, begins: bool, body: bytes) -> None:
        if begins and body:
            pointer = body[0]
            if self.held is not None:
                self._grow(number, body[1 : 1 + pointer])
            self.held = b""
            self._grow(number, body[1 + pointer :])
        elif self.held is not None:
            self._grow(number, body)

    def _grow(self, number: int, more: bytes) -> None:
        held = self.held + more
        while len(held) >= 3 and held[0] != 0xFF:  # 0xFF: stuffing up to the end of the packet
            size = 3 + (struct.unpack_from(">H", held, 1)[0] & 0xFFF)
            if len(held) < size:
                break
            self.done(number, held[:size])
            held = held[size:]
        self.held = b"" if held[:1] == b"\xff" else held


class _Reader:
    def __init__(self):
        self.faults: list[tuple[int, str]] = []
        self.tables = {PAT_PID: _Sections(self.programs)}
        self.streams: set[int] = set()
        self.last: dict[int, tuple[int, bytes, bool]] = {}  # counter, packet, and whether it came twice
        self.units: list[tuple[int, bool, list[bytes]]] = []  # first packet, random access, parts
        self.open: dict[int, list[bytes] | None] = {}
        self.waiting: dict[int, list[tuple[int, bool, bool, int, bytes]]] = {}  # payloads of PIDs that no table has named so far

    def _named(self, pid: int) -> None:
        """Takes what came before the table that names its PID."""
        for held in self.waiting.pop(pid, ()):
            self._take(pid, *held)

    def unmapped(self) -> list[tuple[int, str]]:
        """A fault for each PID with payload that no table has named. PIDs below 32 are kept for tables."""
        return [(held[0][0], "unmapped") for pid, held in self.waiting.items() if pid >= 0x20]

    def _checked(self, number: int, section: bytes, table_id: int) -> bool:
        if section[0] != table_id or len(section) < 12:
            return False
        if section_crc(section):
            self.faults.append((number, "table"))
            return False
        return bool(section[5] & 1)  # else it applies later

    def programs(self, number: int, section: bytes) -> None:
        if self._checked(number, section, 0):
            for at in range(8, len(section) - 7, 4):
                program, pid = struct.unpack_from(">HH", section, at)
                # 0 names the network's PID, whose tables are passed over.
                self.tables.setdefault(pid & 0x1FFF, _Sections(self.parts if program else lambda *_: None))
                self._named(pid & 0x1FFF)

    def parts(self, number: int, section: bytes) -> None:
        if self._checked(number, section, 2):
            at = 12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF)
            while at + 5 <= len(section) - 4:
                pid = struct.unpack_from(">H", section, at + 1)[0] & 0x1FFF
                self.streams.add(pid)
                self._named(pid)
                at += 5 + (struct.unpack_from(">H", section, at + 3)[0] & 0xFFF)

    def packet(self, number: int, packet: bytes) -> None:
        _, head, flags = struct.unpack_from(">BHB", packet)
        pid, begins, body, marked, jump = head & 0x1FFF, bool(head & 0x4000), 4, False, False
        if pid == NULL_PID:
            return
        if head & 0x8000:
            self.faults.append((number, "error"))
            return
        if flags & 0x20:
            size = packet[4]
            if size > PACKET - 5:
                self.faults.append((number, "field"))
                return
            if size:
                jump, marked = bool(packet[5] & 0x80), bool(packet[5] & 0x40)
            body += 1 + size
        if not flags & 0x10:
            return
        if pid in self.last and not jump:
            counter, before, twice = self.last[pid]
            if flags & 15 == counter and not twice and (packet == before or self._same(packet, before)):
                self.last[pid] = counter, before, True
                return
            if flags & 15 != counter + 1 & 15:
                self.faults.append((number, "continuity"))
        self.last[pid] = flags & 15, packet, False
        self._take(pid, number, begins, marked, flags, packet[body:])

    def _take(self, pid: int, number: int, begins: bool, marked: bool, flags: int, body: bytes) -> None:
        if pid in self.tables:
            self.tables[pid].take(number, begins, body)
        elif pid in self.streams:
            if flags & 0xC0:
                self.faults.append((number, "scrambled"))
            elif begins:
                self.open[pid] = [body]
                self.units.append((number, marked, self.open[pid]))
            elif self.open.get(pid) is not None:
                self.open[pid].append(body)
            else:
                self.open[pid] = None  # the stream begins within a unit
        else:
            self.waiting.setdefault(pid, []).append((number, begins, marked, flags, body))

    @staticmethod
    def _same(packet: bytes, before: bytes) -> bool:
        """Whether one packet repeats the other but for the six bytes of its clock reference."""
        return bool(packet[3] & 0x20 and packet[4] >= 7 and packet[5] & 0x10) and packet[:6] == before[:6] and packet[12:] == before[12:]

    def unit(self, number: int, pes: bytes) -> tuple[bytes, int | None] | None:
        """Bytes and time stamp of a PES packet; None for padding and for what is no PES packet."""
        if len(pes) < 6 or pes[:3] != b"\0\0\1":
            self.faults.append((number, "unit"))
            return None
        kind, size = pes[3], struct.unpack_from(">H", pes, 4)[0]
        if size and len(pes) != 6 + size:
            self.faults.append((number, "length"))
            pes = pes[: 6 + size]
        if kind in BARE_STREAMS:
            return None if kind == PADDING_STREAM else (pes[6:], None)
        if len(pes) < 9 or pes[6] >> 6 != 2 or len(pes) < 9 + pes[8]:
            self.faults.append((number, "unit"))
            return None
        stamp = None
        if pes[7] & 0x80 and pes[8] >= 5:
            a, b, c = struct.unpack_from(">BHH", pes, 9)
            stamp = (a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1
        return pes[9 + pes[8] :], stamp


def demux(ts: bytes) -> Stream:
    """Reads a stream. Damage is listed in ``faults``: lost sync bytes (sync), a cut last packet (cut), marked errors (error), impossible
    adaptation fields (field), tables of a wrong checksum (table), gaps (continuity), scrambled packets (scrambled), units that
    are no PES packets (unit) or not of their length (length), payload of PIDs that no table names, wherever it lies (unmapped). What comes before
    the tables that name it is read once they are there."""
    reader, at, number = _Reader(), 0, 0
    while at + PACKET <= len(ts):
        if ts[at] != SYNC:
            reader.faults.append((number, "sync"))
            at += 1
            while at + PACKET <= len(ts) and not (ts[at] == SYNC and (at + PACKET == len(ts) or ts[at + PACKET] == SYNC)):
                at += 1
            continue
        reader.packet(number, ts[at : at + PACKET])
        at, number = at + PACKET, number + 1
    if at < len(ts):
        reader.faults.append((number, "cut"))
    payload, stamps, access = [], [], []
    reader.faults += reader.unmapped()
    for first, marked, parts in sorted(reader.units, key=lambda u: u[0]):
        found = reader.unit(first, b"".join(parts))
        if found:
            payload.append(found[0])
            stamps.append(found[1])
            if marked:
                access.append((first, found[1]))
    return Stream(b"".join(payload), number, stamps, access, sorted(reader.faults))


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (0 if text else UNIT))


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the stream (``media``, binary) of each text.

    A null text is empty; an empty one becomes one unit of spaces. A text of any length is one stream. Ids play no
    part in a stream, so equal texts have equal streams. Repeated rows stay. Other columns are ignored.
    """
    common.small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in common.slices(batch):
                data = raw.tobytes()
                texts = [data[at[k] : at[k + 1]] for k in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text")).mapInArrow(common.lean(task), "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """What the streams hold: digests of payload and stream, ``feature`` with packets, units, last time stamp and
    random-access points (packet:time stamp), and ``faults`` (packet:what), empty for a sound stream.

    A null stream is an empty one: no packets, and an empty payload. Other columns are ignored.
    """
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, faults string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ts = ts.as_buffer().to_pybytes() if ts.is_valid else b""
                s = demux(ts)
                points = ",".join(f"{p}:{t}" for p, t in s.access)
                feature = f"packets={s.packets};units={len(s.stamps)};last={s.stamps[-1] if s.stamps else None};access={points}"
                rows.append((doc_id, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-16:]), len(ts), hashlib.sha256(ts).hexdigest(), feature, ",".join(f"{p}:{w}" for p, w in s.faults)))
            if rows:
                types = [x.split() for x in fields.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64() if t == "long" else pa.string()) for x, (_, t) in zip(zip(*rows), types)], names=[n for n, _ in types])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(common.lean(task), fields)
