"""The reader of transport streams against streams from a writer of the tests' own."""

import pytest

from mnemospark.llm import media


def crc(data):
    """Bit by bit, without a table."""
    c = 0xFFFFFFFF
    for byte in data:
        for k in range(7, -1, -1):
            top = c >> 31 ^ byte >> k & 1
            c = (c << 1) & 0xFFFFFFFF
            if top:
                c ^= 0x04C11DB7
    return c


def section(table_id, body, number=1, current=1):
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF]) + number.to_bytes(2, "big") + bytes([0xC0 | current, 0, 0]) + body
    return head + crc(head).to_bytes(4, "big")


def pat(programs):
    return section(0, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in programs))


def pmt(streams, info=b""):
    return section(2, b"\xe1\x00" + (0xF000 | len(info)).to_bytes(2, "big") + info + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(more)).to_bytes(2, "big") + more for kind, pid, more in streams))


def packet(pid, counter, body=b"", start=False, field=None, scrambled=0, error=False):
    """One packet; a short body is filled up by the adaptation field."""
    if field is None and len(body) < 184:
        field = b""
    if field is not None:
        room = 183 - len(body)
        field = (field or (b"\0" if room else b"")).ljust(room, b"\xff")
        assert len(field) == room
        field = bytes([room]) + field
    control = (0x10 if body else 0) | (0x20 if field is not None else 0)
    return bytes([0x47, error << 7 | start << 6 | pid >> 8, pid & 0xFF, scrambled << 6 | control | counter & 15]) + (field or b"") + body


def pes(data, pts=None, open_end=False, stream=0xC0):
    stamp = b"" if pts is None else bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, pts >> 14 & 254 | 1, pts >> 7 & 255, pts << 1 & 254 | 1])
    rest = bytes([0x80, 0 if pts is None else 0x80, len(stamp)]) + stamp + data
    return b"\0\0\1" + bytes([stream]) + (0 if open_end else len(rest)).to_bytes(2, "big") + rest


def tables(streams=((6, 0x101, b""),)):
    return [packet(0, 0, b"\0" + pat([(1, 0x30)]), True), packet(0x30, 0, b"\0" + pmt(streams), True)]


def cut(pid, unit, counter=0):
    parts = [unit[k : k + 184] for k in range(0, len(unit), 184)]
    return [packet(pid, counter + k, p, k == 0) for k, p in enumerate(parts)]


DATA = bytes(range(256)) * 3


def read(packets):
    return media.demux(b"".join(packets))


def test_null_and_repeated_packets():
    body = cut(0x101, pes(DATA, 900))
    null = packet(0x1FFF, 5, b"\xff" * 184)
    s = read([*tables(), null, null, body[0], body[0], null, *body[1:], body[-1]])
    assert (s.payload, s.stamps, s.faults) == (DATA, [900], [])
    thrice = read([*tables(), body[0], body[0], body[0], *body[1:]])
    assert [w for _, w in thrice.faults] == ["continuity", "length"] or "continuity" in [w for _, w in thrice.faults]


def test_a_repeat_may_have_another_clock():
    clock = lambda k: b"\x50" + bytes([0, 0, 0, k, 0x7E, 0])
    unit = pes(DATA[:100], 1)
    s = read([*tables(), packet(0x101, 3, unit, True, clock(1)), packet(0x101, 3, unit, True, clock(2))])
    assert s.payload == DATA[:100] and s.faults == [] and s.access == [(2, 1)]


def test_announced_discontinuity_and_gap():
    one, two = pes(DATA[:50], 1), pes(DATA[50:90], 2)
    told = read([*tables(), packet(0x101, 3, one, True), packet(0x101, 9, two, True, b"\x80")])
    assert told.payload == DATA[:90] and told.faults == []
    gap = read([*tables(), packet(0x101, 3, one, True), packet(0x101, 9, two, True)])
    assert gap.payload == DATA[:90] and gap.faults == [(3, "continuity")]
    # Packets without payload do not count.
    bare = read([*tables(), packet(0x101, 3, one, True), packet(0x101, 3, b"", False, b"\0"), packet(0x101, 4, two, True)])
    assert bare.payload == DATA[:90] and bare.faults == []


def test_tables_over_several_packets_with_a_network_entry_and_descriptors():
    streams = [(6, 0x200 + k, bytes([5, 4]) + b"abcd") for k in range(40)]
    long = b"\0" + pmt(streams, b"\x09\x02xx")
    assert len(long) > 2 * 184
    first = packet(0, 0, b"\0" + pat([(0, 0x10), (7, 0x30), (8, 0x31)]), True)
    other = packet(0x31, 0, b"\0" + pmt([(27, 0x301, b"")]), True)
    s = read([first, *cut(0x30, long), other, *cut(0x227, pes(b"late", 5)), *cut(0x301, pes(b"video"))])
    assert s.payload == b"latevideo" and s.stamps == [5, None] and s.faults == []


def test_two_sections_in_one_packet_and_pointer():
    a, b = pmt([(6, 0x101, b"")]), pmt([(6, 0x102, b"")])
    whole = a + b
    start = packet(0x30, 0, b"\0" + whole[:30], True, b"\0")
    rest = packet(0x30, 1, bytes([len(whole) - 30]) + whole[30:] + pmt([(6, 0x103, b"")]), True)
    s = read([packet(0, 0, b"\0" + pat([(1, 0x30)]), True), start, rest, *[packet(0x101 + k, 0, pes(b"%d" % k), True) for k in range(3)]])
    assert s.payload == b"012" and s.faults == []


def test_units_without_stamp_or_length_and_padding():
    units = [*cut(0x101, pes(DATA, open_end=True)), packet(0x101, 5, pes(b"z" * 10, stream=0xBE)[:9], True), packet(0x101, 6, pes(b"end", 77), True)]
    s = read([*tables(), *units])
    assert s.payload.startswith(DATA) and s.payload.endswith(b"end") and s.stamps == [None, 77]


def test_start_within_a_unit():
    body = cut(0x101, pes(DATA, 900))
    s = read([*tables(), *body[2:], *cut(0x101, pes(b"next", 901), len(body))])
    assert s.payload == b"next" and s.stamps == [901] and s.faults == []


@pytest.mark.parametrize("made, fault", [
    (lambda: [*tables(), packet(0x101, 0, pes(b"a"), True, error=True)], "error"),
    (lambda: [*tables(), packet(0x101, 0, pes(b"a"), True, scrambled=2)], "scrambled"),
    (lambda: [*tables(), packet(0x101, 0, b"nope, no unit", True)], "unit"),
    (lambda: [*tables(), packet(0x101, 0, pes(b"abcdef")[:-2], True)], "length"),
    (lambda: [packet(0, 0, b"\0" + pat([(1, 0x30)])[:-1] + b"x", True)], "table"),
])
def test_faults_are_reported(made, fault):
    assert [w for _, w in read(made()).faults] == [fault]


def test_sync_is_found_again():
    body = cut(0x101, pes(DATA, 900))
    s = media.demux(b"".join([*tables()]) + b"junk" + b"".join(body))
    assert s.payload == DATA and s.faults == [(2, "sync")]
    assert media.demux(b"") == media.Stream(b"", 0, [], [], [])


def test_a_table_for_later_is_passed_over():
    late = section(0, b"\0\1\xe0\x31", current=0)
    s = read([packet(0, 0, b"\0" + late, True), *[packet(p, c + 1, b"\0" + t, True) for p, c, t in ((0, 0, pat([(1, 0x30)])), (0x30, 0, pmt([(6, 0x101, b"")])))], packet(0x101, 0, pes(b"x"), True)])
    assert s.payload == b"x"


def test_tables_may_come_late():
    body, more = cut(0x101, pes(DATA, 900)), cut(0x102, pes(b"other", 901))
    program, parts = tables([(6, 0x101, b""), (6, 0x102, b"")])
    for order in ([*body, *more, program, parts], [body[0], parts, *body[1:], program, *more], [program, *body[:3], *more, parts, *body[3:]]):
        s = read(order)
        assert (s.payload, s.stamps, s.faults) == (DATA + b"other", [900, 901], [])


def test_a_written_stream_with_its_tables_moved_back():
    text = bytes(range(32, 127)) * 96
    whole = media.mux(text)
    parts = [whole[k : k + 188] for k in range(0, len(whole), 188)]
    moved = media.demux(b"".join(parts[2:12] + parts[:2] + parts[12:]))
    straight = media.demux(whole)
    assert (moved.payload, moved.stamps, moved.faults) == (straight.payload, straight.stamps, []) and text in moved.payload


def test_payload_that_no_table_names_is_a_fault():
    s = read([*tables(), packet(0x101, 0, pes(b"x"), True), packet(0x150, 0, pes(b"lost"), True), packet(0x150, 1, b"more" * 46), packet(0x11, 0, b"service table", True)])
    assert s.payload == b"x" and s.faults == [(3, "unmapped")]
    only = read(cut(0x101, pes(DATA, 900)))
    assert only.payload == b"" and only.faults == [(0, "unmapped")]


def test_the_network_pid_is_no_loss():
    first = packet(0, 0, b"\0" + pat([(0, 0x40), (1, 0x30)]), True)
    s = read([first, packet(0x30, 0, b"\0" + pmt([(6, 0x101, b"")]), True), packet(0x40, 0, b"\0" + section(0x40, b"abcd"), True), packet(0x101, 0, pes(b"x"), True)])
    assert s.payload == b"x" and s.faults == []
