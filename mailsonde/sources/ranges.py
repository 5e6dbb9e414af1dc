"""Captures of any size by byte ranges: each record belongs to the range that its header begins in.

A range finds its first record itself: it looks before its beginning for a place from which plausible headers follow each
other over more bytes than any record can have, so a capture inside a packet's payload does not look like one. Every range then checks where the next
one will begin against the end of its own records; starting from the file's header, all agree or the scan fails. It
never gives other packets than a scan of the whole file would: what a range cannot know (interfaces or sections that
begin after the first packet, packets without a time of their own, damage) is an error that names the way out, split=0.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .capture import LARGEST, MAGIC, SECTION, Capture, CaptureError, link_payload

CHUNK, SPLIT = 1 << 20, 128 << 20
#: What a file without a snapshot length may hold in one record.
ANY_LENGTH = 262_144
#: Seconds that a capture lasts at most where ranges look for records: a packet's own length fields may mimic a header, but no time.
YEAR = 366 * 86_400
BLOCK_ROOM = 4096  # options and fields of a block beside its packet


def opened(uri: str):
    """pyarrow's file system and the path in it."""
    from pyarrow import fs

    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Bytes:
    """A file by offset, read in pieces."""

    def __init__(self, file, size: int):
        self.file, self.size, self.start, self.held = file, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes from a place on; fewer only at the end of the file."""
        if place < self.start or place + n > self.start + len(self.held):
            self.file.seek(place)
            self.start, self.held = place, self.file.read(max(n, CHUNK))
        return self.held[place - self.start : place - self.start + n]


class Head(NamedTuple):
    """What a range has to know of its file's beginning."""

    format: str
    order: str
    ticks: int  # of classic files
    link: int
    snaplen: int
    first: int  # where the first record or block after the head lies
    interfaces: tuple[tuple[int, int, int], ...] = ()  # (link, snaplen, ticks)
    since: int = 0  # seconds of the first record of a classic file

    @property
    def longest(self) -> int:
        """Bytes that no record exceeds."""
        most = max((s or ANY_LENGTH for _, s, _ in self.interfaces), default=0) if self.format == "pcapng" else self.snaplen or ANY_LENGTH
        return max(most, 65_535) + (BLOCK_ROOM if self.format == "pcapng" else 16)


def head_of(data: Bytes) -> Head:
    """The head; of newer files the section and all blocks before the first packet."""
    magic = data.at(0, 4)
    if magic in MAGIC:
        order, ticks = MAGIC[magic]
        if len(raw := data.at(4, 20)) < 20:
            raise CaptureError("the file header is cut short")
        *_, snaplen, link = struct.unpack(order + "HHiIII", raw)
        since = data.at(24, 4)
        return Head("pcap", order, ticks, link & 0xFFFF, snaplen, 24, since=struct.unpack(order + "I", since)[0] if len(since) == 4 else 0)
    if magic != SECTION:
        raise CaptureError(f"not a capture: {magic.hex() or 'empty'}")
    order, place, interfaces = (">" if data.at(8, 4) == b"\x1a\x2b\x3c\x4d" else "<"), 0, []
    while len(raw := data.at(place, 8)) == 8:
        kind, size = struct.unpack(order + "II", raw)
        if size < 12 or size > LARGEST or (place and raw[:4] == SECTION) or kind in (2, 3, 6):
            break
        if kind == 1:
            body = data.at(place + 8, size - 12)
            link, _, snap = struct.unpack(order + "HHI", body[:8])
            interfaces.append((link, snap, Capture._resolution(order, body[8:])))
        place += size
    return Head("pcapng", order, 0, interfaces[0][0] if interfaces else -1, interfaces[0][1] if interfaces else 0, place, tuple(interfaces))


def step(data: Bytes, head: Head, place: int) -> int | None:
    """Where the record after the one at `place` begins; the file's size if it is the last or cut short; None if there is no record."""
    if head.format == "pcap":
        raw = data.at(place, 16)
        if len(raw) < 16:
            return data.size
        sec, frac, cap, wire = struct.unpack(head.order + "IIII", raw)
        if abs(sec - head.since) > YEAR or frac >= head.ticks or cap > head.longest - 16 or cap > wire or wire > LARGEST:
            return None
        return min(data.size, place + 16 + cap)
    raw = data.at(place, 8)
    if len(raw) < 8:
        return data.size
    kind, size = struct.unpack(head.order + "II", raw)
    if size < 12 or size % 4 or size > max(head.longest, CHUNK) or kind == 0:
        return None
    if place + size > data.size:
        return data.size
    return place + size if data.at(place + size - 4, 4) == raw[4:8] else None


def plausible(data: Bytes, head: Head, start: int, stop: int) -> list[int]:
    """Places in [start, stop) at which a record or block may begin, by its own fields alone; all of them are looked at in one pass."""
    raw = np.frombuffer(data.at(start, stop - start + 16), np.uint8).astype(np.uint32)
    n = max(0, min(stop - start, len(raw) - 15))
    order = range(4) if head.order == "<" else range(3, -1, -1)
    number = lambda at: sum(raw[at + i : at + i + n] << np.uint32(8 * k) for i, k in enumerate(order))
    if head.format == "pcap":
        sec, frac, cap, wire = number(0).astype(np.int64), number(4), number(8), number(12)
        good = (abs(sec - head.since) <= YEAR) & (frac < head.ticks) & (cap <= head.longest - 16) & (cap <= wire) & (wire <= LARGEST)
    else:  # blocks are padded to words
        kind, size = number(0), number(4)
        good = (size >= 12) & (size % 4 == 0) & (size <= max(head.longest, CHUNK)) & (kind != 0) & ((start + np.arange(n)) % 4 == 0)
    return (start + np.flatnonzero(good)).tolist()


def first_record(data: Bytes, head: Head, place: int) -> int:
    """The first record or block that begins at `place` or later; the file's size if there is none.

    The search begins two longest records before and follows what may be records from there up to `place`, so it never
    judges by what is left of the file after it. Of several ways through the bytes the one of most records counts: false
    headers that long false lengths tie together take few steps, the true ones many.
    """
    if place <= head.first:
        return head.first
    base = place - 2 * head.longest
    best, found, ends = 0, data.size, {}
    for at in plausible(data, head, base, base + head.longest) if base > head.first else [head.first]:
        to: int | None = at
        way = []
        while to is not None and to < place and to not in ends:
            way.append(to)
            to = step(data, head, to)
        steps, end = ends.get(to, (0, to))
        for k, x in enumerate(reversed(way), 1):
            ends[x] = steps + k, end
        if way and end is not None and ends[at][0] > best:
            best, found = ends[at][0], end
    return found


def records(data: Bytes, head: Head, start: int, stop: int, whole: bool) -> Iterator[tuple[int, float, int, int, bytes]]:
    """(offset, ts, wirelen, link, frame) of the records from `start` that begin before `stop`.

    Of a file that is one range everything is read up to its first damage; elsewhere what ranges could disagree on raises.
    """
    place = start
    for place, kind, found in _classic(data, head, start, stop) if head.format == "pcap" else _blocks(data, head, start, stop, whole):
        if kind == "damage":
            if whole:
                return
            raise CaptureError(f"{found} at {place}: read this file with split=0")
        if kind == "packet":
            yield place, *found
    if not whole and place < data.size and (told := first_record(data, head, stop)) != place:
        raise CaptureError(f"ranges disagree at {stop}: {place} and {told}; read this file with split=0")


def _classic(data: Bytes, head: Head, place: int, stop: int) -> Iterator[tuple]:
    while place < min(stop, data.size):
        raw = data.at(place, 16)
        if len(raw) < 16:
            break
        sec, frac, cap, wire = struct.unpack(head.order + "IIII", raw)
        if cap > LARGEST:
            yield place, "damage", "no record"
            return
        frame = data.at(place + 16, cap)
        if len(frame) < cap:
            break
        yield place, "packet", (sec + frac / head.ticks, wire, head.link, frame)
        place += 16 + cap
    else:
        yield place, "end", None
        return
    yield data.size, "end", None


def _blocks(data: Bytes, head: Head, place: int, stop: int, whole: bool) -> Iterator[tuple]:
    order, interfaces, latest = head.order, list(head.interfaces), 0.0
    while place < min(stop, data.size):
        raw = data.at(place, 12)
        if len(raw) < 12:
            place = data.size
            break
        if raw[:4] == SECTION and whole:
            order, interfaces = (">" if raw[8:] == b"\x1a\x2b\x3c\x4d" else "<"), []
        kind, size = struct.unpack(order + "II", raw[:8])
        if size < 12 or size > LARGEST:
            yield place, "damage", "no block"
            return
        if not whole and (raw[:4] == SECTION or kind in (1, 3)):
            yield place, "damage", "a section, an interface or a packet without a time"
            return
        body = data.at(place + 8, size - 12)
        if place + size > data.size:
            place = data.size
            break
        if kind == 1 and len(body) >= 8:
            link, _, snap = struct.unpack(order + "HHI", body[:8])
            interfaces.append((link, snap, Capture._resolution(order, body[8:])))
        elif kind == 6 and len(body) >= 20 and interfaces:
            number, hi, lo, cap, wire = struct.unpack(order + "IIIII", body[:20])
            link, _, ticks = interfaces[min(number, len(interfaces) - 1)]
            ts = (hi << 32 | lo) / ticks
            latest = max(latest, ts)
            yield place, "packet", (ts, wire, link, body[20 : 20 + cap])
        elif kind == 3 and len(body) >= 4 and interfaces:
            (wire,) = struct.unpack(order + "I", body[:4])
            link, snap, _ = interfaces[0]
            yield place, "packet", (latest, wire, link, body[4 : 4 + min(wire, snap or wire)])
        place += size
    yield place, "end", None


def mail_packet(packet: bytes, ports: frozenset[int]) -> bool:
    """Whether a packet (from its network header) has one of the ports at either end, or is a fragment, whose ports may lie elsewhere."""
    if len(packet) < 20:
        return False
    if packet[0] >> 4 == 4:
        at, kind = (packet[0] & 15) * 4, packet[9]
        if int.from_bytes(packet[6:8], "big") & 0x3FFF:
            return True
    elif packet[0] >> 4 == 6 and len(packet) >= 40:
        at, kind = 40, packet[6]
        while kind in (0, 43, 60) and at + 8 <= len(packet):
            kind, at = packet[at], at + 8 + packet[at + 1] * 8
        if kind == 44:
            return True
    else:
        return False
    return kind in (6, 17) and len(packet) >= at + 4 and (int.from_bytes(packet[at : at + 2], "big") in ports or int.from_bytes(packet[at + 2 : at + 4], "big") in ports)


def packets_of_range(uri: str, start: int, stop: int, size: int, budget: float, ports: frozenset[int] | None) -> Iterator[tuple]:
    """(index, ts, caplen, wirelen, vlan, payload) of a range; index is the record's offset, which orders a capture's packets.

    The corruption budget holds for each range of 20 packets or more.
    """
    fs, path = opened(uri)
    whole = start == 0 and stop >= size
    with fs.open_input_file(path) as file:
        data = Bytes(file, size)
        head = head_of(data)
        total = bad = 0
        for place, ts, wire, link, frame in records(data, head, first_record(data, head, start), stop, whole):
            total += 1
            found = link_payload(link, frame)
            if found is None:
                bad += 1
            elif ports is None or mail_packet(found[1], ports):
                yield place, ts, len(frame), wire, *found
        if total >= 20 and bad > budget * total:
            raise CaptureError(f"{bad} of {total} packets are malformed")
