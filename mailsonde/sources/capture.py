"""Packet captures: classic and next-generation files, link layers, corruption budget, metadata.

`read_packets` takes files through Spark's own binary reader, so any store that Spark reads will do, a file a row;
`CaptureSource` reads byte ranges of files of any size on file systems that pyarrow opens, with filters in the scan.
"""

from __future__ import annotations

import hashlib
import io
import operator
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import CAPTURES, PACKETS

#: Magic numbers (byte order, ticks a second), link types, EtherTypes of tags.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\x3c\x4d": (">", 10**9), b"\x4d\x3c\xb2\xa1": ("<", 10**9)}
SECTION = b"\x0a\x0d\x0d\x0a"
NULL, ETHERNET, RAW_OLD, WIFI, COOKED, RADIOTAP, RAW, COOKED2 = 0, 1, 101, 105, 113, 127, 228, 276
TAGS = (0x8100, 0x88A8, 0x9100, 0x9200)
FULL_SNAPLEN, LARGEST = 262_144, 1 << 24


class CaptureError(ValueError):
    pass


def link_payload(link: int, frame: bytes) -> tuple[int | None, bytes] | None:
    """(outer VLAN, bytes from the network header); None where the frame is too short. Unknown links keep all bytes."""
    n = len(frame)
    if link in (RAW, RAW_OLD):
        return None, frame
    if link == NULL:
        return (None, frame[4:]) if n >= 4 else None
    if link == RADIOTAP:
        if n < 4:
            return None
        return link_payload(WIFI, frame[int.from_bytes(frame[2:4], "little") :])
    if link == WIFI:
        if n < 24:
            return None
        head = 24 + (6 if frame[1] & 3 == 3 else 0) + (2 if frame[0] & 0x80 else 0) + 8  # address 4, QoS, LLC/SNAP
        return (None, frame[head:]) if n >= head else None
    if link == COOKED:
        at = 14
    elif link == COOKED2:
        return (None, frame[20:]) if n >= 20 else None
    elif link == ETHERNET:
        at = 12
    else:
        return None, frame
    vlan = None
    while n >= at + 2:
        kind, at = int.from_bytes(frame[at : at + 2], "big"), at + 2
        if kind not in TAGS:
            return vlan, frame[at:]
        if n < at + 2:
            return None
        vlan = int.from_bytes(frame[at : at + 2], "big") & 0xFFF if vlan is None else vlan
        at += 2
    return None


class Capture:
    """One pass over a capture stream. Iterate for (index, ts, caplen, wirelen, vlan, payload); the rest is known afterwards.

    A record that is cut short or longer than any frame ends the scan with a warning. More than `budget` of malformed
    packets fail the file once there are 20 of them all.
    """

    def __init__(self, stream, budget: float = 0.05):
        self.stream, self.budget, self.hash = stream, budget, hashlib.sha256()
        self.total = self.malformed = self.bytes = 0
        self.link, self.snaplen, self.warnings = -1, 0, []
        head = self._take(4)
        if head == SECTION:
            self.format = "pcapng"
        elif head in MAGIC:
            self.format, (self.order, self.ticks) = "pcap", MAGIC[head]
        else:
            raise CaptureError(f"not a capture: {head.hex() or 'empty'}")

    def _take(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.hash.update(data)
        self.bytes += len(data)
        return data

    def __iter__(self) -> Iterator[tuple]:
        for ts, wire, data in self._classic() if self.format == "pcap" else self._blocks():
            self.total += 1
            found = link_payload(self.link, data)
            self.malformed += found is None
            if self.total >= 20 and self.malformed > self.budget * self.total:
                raise CaptureError(f"{self.malformed} of {self.total} packets are malformed")
            if found is not None:
                yield self.total - 1, ts, len(data), wire, *found

    def _classic(self) -> Iterator[tuple[float, int, bytes]]:
        head = self._take(20)
        if len(head) < 20:
            raise CaptureError("the file header is cut short")
        _, _, _, _, self.snaplen, link = struct.unpack(self.order + "HHiIII", head)
        self.link = link & 0xFFFF
        self._snap()
        while head := self._take(16):
            if len(head) < 16:
                self.warnings.append("truncated record header")
                return
            sec, frac, cap, wire = struct.unpack(self.order + "IIII", head)
            if cap > LARGEST:
                self.warnings.append("oversize record")
                return
            data = self._take(cap)
            if len(data) < cap:
                self.warnings.append("truncated record")
                return
            yield sec + frac / self.ticks, wire, data

    def _snap(self) -> None:
        if 0 < self.snaplen < FULL_SNAPLEN:
            self.warnings.append(f"snaplen {self.snaplen} may cut payloads")

    def _blocks(self) -> Iterator[tuple[float, int, bytes]]:
        order, links, latest, pending = "<", [], 0.0, SECTION
        while kind := pending or self._take(4):
            pending = b""
            size = self._take(4)
            if len(kind) < 4 or len(size) < 4:
                self.warnings.append("truncated block")
                return
            if kind == SECTION:
                magic = self._take(4)
                order, links = (">" if magic == b"\x1a\x2b\x3c\x4d" else "<"), []
                rest = struct.unpack(order + "I", size)[0] - 12
            else:
                rest = struct.unpack(order + "I", size)[0] - 8
            if not 4 <= rest <= LARGEST:
                self.warnings.append("oversize block")
                return
            body = self._take(rest)
            if len(body) < rest:
                self.warnings.append("truncated block")
                return
            number, body = struct.unpack(order + "I", kind)[0], body[:-4]
            if number == 1 and len(body) >= 8:
                link, _, snap = struct.unpack(order + "HHI", body[:8])
                links.append((link, snap, self._resolution(order, body[8:])))
                self.snaplen = snap
                self._snap()
            elif number == 6 and len(body) >= 20 and links:
                at, hi, lo, cap, wire = struct.unpack(order + "IIIII", body[:20])
                self.link, _, ticks = links[min(at, len(links) - 1)]
                ts = (hi << 32 | lo) / ticks
                latest = max(latest, ts)
                yield ts, wire, body[20 : 20 + cap]
            elif number == 3 and len(body) >= 4 and links:
                (wire,) = struct.unpack(order + "I", body[:4])
                self.link, snap, _ = links[0]
                yield latest, wire, body[4 : 4 + min(wire, snap or wire)]  # simple packets have no time: the latest so far

    @staticmethod
    def _resolution(order: str, options: bytes) -> int:
        at = 0
        while at + 4 <= len(options):
            code, size = struct.unpack(order + "HH", options[at : at + 4])
            if code == 9 and size >= 1:
                r = options[at + 4]
                return 2 ** (r & 0x7F) if r & 0x80 else 10**r
            if code == 0:
                break
            at += 4 + size + -size % 4
        return 10**6

    def metadata(self, capture_id: str) -> tuple:
        return capture_id, self.hash.hexdigest(), self.format, self.link, self.snaplen, self.total, self.malformed, self.bytes, self.warnings


def _names(ddl: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in ddl.split(",")]


def _batches(capture_id: str, capture: Capture, size: int = 4096) -> Iterator[pa.RecordBatch]:
    kinds, rows = (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _names(PACKETS))

    for row in capture:
        rows.append((capture_id, *row))
        if len(rows) == size:
            yield made()
            rows.clear()
    if rows:
        yield made()


def read_packets(spark: SparkSession, path: str, budget: float = 0.05) -> DataFrame:
    """Packets of all captures under path. A file is one row of the binary reader: below 2 GB each."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _batches(name, Capture(io.BytesIO(data.as_buffer()), budget))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, PACKETS)


def capture_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a capture: digest, format, counts, warnings."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = Capture(io.BytesIO(data.as_buffer()), 1.0)
                for _ in c:
                    pass
                rows.append(c.metadata(name))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.string()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["capture_id", "sha256", "format", "link_type", "snaplen", "packets", "malformed", "bytes", "warnings"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, CAPTURES)


def new_captures(captures: DataFrame, known: DataFrame) -> DataFrame:
    """Captures whose content is not known yet, one of each content."""
    return captures.dropDuplicates(["sha256"]).join(known.select("sha256"), "sha256", "left_anti")


def expired(spark: SparkSession, path: str, now, hours: int = 72) -> DataFrame:
    """Files older than the retention period at `now`; deleting them is left to the caller."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("modificationTime").cast("double")
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length").where(age > hours * 3600)


class _Range(InputPartition):
    def __init__(self, uri: str, start: int, stop: int, size: int):
        self.uri, self.start, self.stop, self.size = uri, start, stop, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        from .ranges import SPLIT

        self.paths, self.budget, self.split = options["path"].split(","), float(options.get("budget", "0.05")), int(options.get("split", SPLIT))
        self.ports = frozenset(map(int, options["ports"].split(","))) if options.get("ports") else None
        self.tests: list = []

    def partitions(self):
        from pyarrow import fs

        from .ranges import opened

        out = []
        for p in self.paths:
            root, base = opened(p)
            info = root.get_file_info(base)
            files = [info] if info.type == fs.FileType.File else root.get_file_info(fs.FileSelector(base, recursive=True))
            scheme = p[: len(p) - len(base)] if p.endswith(base) else ""
            for f in files:
                uri = scheme + f.path
                if f.type == fs.FileType.File and all(uri in values for _, name, values in self.tests if name == "capture_id"):
                    step = self.split if self.split > 0 else max(1, f.size)
                    # A file that must be read whole because its head says so fails in its tasks, not here: the driver opens none.
                    out += [_Range(uri, a, min(a + step, f.size), f.size) for a in range(0, max(1, f.size), step)]
        return out

    def read(self, part: _Range):
        from .ranges import opened, packets_of_range

        if part.start == 0 and part.stop >= part.size and self.split <= 0:
            root, path = opened(part.uri)
            with root.open_input_stream(path) as f:
                found = Capture(f, self.budget)
                rows = (r for r in found if self.ports is None or _mail(r[-1], self.ports))
                yield from _batches(part.uri, filter(self.kept, rows))
        else:
            yield from _batches(part.uri, filter(self.kept, packets_of_range(part.uri, part.start, part.stop, part.size, self.budget, self.ports)))

    def kept(self, row: tuple) -> bool:
        return all(_COMPARE[kind](row[_MEASURES[name]], value) for kind, name, value in self.tests if name != "capture_id")


class _Pushing(_Reader):
    def pushFilters(self, filters):
        """Comparisons of ts, caplen and wirelen with a number, and of capture_id with names, are made in the scan; the others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = type(f).__name__
            if name in _MEASURES and kind in _COMPARE and isinstance(f.value, (int, float)):
                self.tests.append((kind, name, f.value))
            elif name in (*_MEASURES, "capture_id", "index") and kind == "IsNotNull":
                pass  # these never are null
            elif name == "capture_id" and kind in ("EqualTo", "In"):
                self.tests.append((kind, name, (f.value,) if kind == "EqualTo" else tuple(f.value)))
            else:
                yield f


#: Columns that the scan itself compares, by their place in a row, and how.
_MEASURES = {"ts": 1, "caplen": 2, "wirelen": 3}
_COMPARE = {"EqualTo": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le}


def _mail(packet: bytes, ports: frozenset[int]) -> bool:
    from .ranges import mail_packet

    return mail_packet(packet, ports)


class CaptureSource(DataSource):
    """spark.dataSource.register(CaptureSource); spark.read.format("capture").load(path)

    Files are read by ranges of `split` bytes (sources.ranges), on any file system that pyarrow opens; split=0 reads each
    file in one task, whatever it holds. `ports` ("25,587") keeps packets with one of them at either end, and fragments.
    With pushdown=true (and spark.sql.python.filterPushdown.enabled, without which Spark refuses it) comparisons of times
    and lengths and names of captures are made in the scan, and files of other names are not opened. index orders a capture's packets: a record's offset, or with split=0 its
    number.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> _Reader:
        return (_Pushing if self.options.get("pushdown", "").lower() == "true" else _Reader)(self.options)
