"""Packets to sessions: network and transport headers, fragments, reassembly.

Headers are parsed in Arrow batches and only mail ports go on. Flows are shuffled by their order-free key and each is
rebuilt by one call, its packets in order of their number, never of their clock. Sessions' buffers are bounded; `segments` can
cut what a segment holds beyond `keep` bytes, sessions() does not.
A flow's own silence ends a session: a rule that does not depend on other flows, partitioning or row order. With
compat=True the capture's clock decides instead, the latest time of any packet so far: a prefix maximum over packets.
"""

from __future__ import annotations

import heapq
import ipaddress
import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REASSEMBLED

MAIL_PORTS = (25, 110, 143, 465, 587, 993, 995, 2525)
FIN, SYN, RST, ACK = 1, 2, 4, 16
IDLE, GAP_WAIT, FRAGMENT_WAIT = 300.0, 30.0, 60.0
BUFFER, OUT_OF_ORDER, HANDSHAKE = 8 << 20, 2 << 20, 64 << 10
HALF = 1 << 31
DATAGRAMS = "capture_id string, index long, ts double, vlan int, src string, dst string, proto int, ident long, offset int, more boolean, body binary"
CLOCK_SPAN = 1 << 20
#: Rows that are read, or sent on, together.
TOGETHER = 500
SEGMENTS = "capture_id string, index long, ts double, vlan int, src string, sport int, dst string, dport int, seq long, flags int, body binary"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    cols = [x.strip().split(" ") for x in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), cols, strict=True)], [n for n, _ in cols])


def datagrams(packets: DataFrame, protocols: tuple[int, ...] = (6,)) -> DataFrame:
    """IPv4 and IPv6 packets that carry TCP (or other protocols, by number), with their fragment fields; anything shorter than its headers is left out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cap, index, ts, vlan, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(p) >= 20 and p[0] >> 4 == 4:
                    head, size = (p[0] & 15) * 4, int.from_bytes(p[2:4], "big")
                    if head < 20 or size < head or p[9] not in protocols:
                        continue
                    frag = int.from_bytes(p[6:8], "big")
                    rows.append((cap, index, ts, vlan, str(ipaddress.IPv4Address(p[12:16])), str(ipaddress.IPv4Address(p[16:20])), p[9], int.from_bytes(p[4:6], "big"), (frag & 0x1FFF) * 8, bool(frag & 0x2000), p[head : min(size, len(p))]))
                elif len(p) >= 40 and p[0] >> 4 == 6:
                    kind, at, end = p[6], 40, min(len(p), 40 + int.from_bytes(p[4:6], "big"))
                    ident, offset, more = 0, 0, False
                    while kind in (0, 43, 44, 60) and at + 8 <= end:
                        if kind == 44:
                            field, ident = int.from_bytes(p[at + 2 : at + 4], "big"), int.from_bytes(p[at + 4 : at + 8], "big")
                            offset, more = field & 0xFFF8, bool(field & 1)
                        kind, at = p[at], at + (8 if kind == 44 else 8 + p[at + 1] * 8)
                    if kind in protocols:
                        rows.append((cap, index, ts, vlan, str(ipaddress.IPv6Address(p[8:24])), str(ipaddress.IPv6Address(p[24:40])), kind, ident, offset, more, p[at:end]))
            if rows:
                yield _batch(rows, DATAGRAMS)

    return packets.select("capture_id", "index", "ts", F.col("vlan_id"), "payload").mapInArrow(parse, DATAGRAMS)


def defragmented(d: DataFrame) -> DataFrame:
    """Whole datagrams. Only fragments are shuffled; a datagram with a hole, or spread over more than a minute, is lost."""
    whole = d.where("offset = 0 and not more")
    parts = d.where("offset > 0 or more")

    def join(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["index"])
        out, held, start = [], {}, None
        for r in rows:
            if start is None or r["ts"] - start > FRAGMENT_WAIT:
                held, start = {}, r["ts"]
            held[r["offset"]] = r  # of one offset the last counts
            body, last = b"", None
            for o in sorted(held):
                if o > len(body):
                    break
                body, last = body[:o] + held[o]["body"], held[o]
            if last is not None and not last["more"] and last["offset"] == max(held):
                out.append({**r, "offset": 0, "more": False, "body": body})
                held, start = {}, None
        return pa.Table.from_pylist(out, schema=table.schema)

    return whole.unionByName(parts.groupBy("capture_id", "src", "dst", "ident", "proto").applyInArrow(join, DATAGRAMS))


def udp_payloads(packets: DataFrame) -> DataFrame:
    """(capture_id, index, ts, src, sport, dst, dport, payload) of UDP datagrams, fragments put together; what is shorter than its header is left out."""
    d = defragmented(datagrams(packets, (17,)))
    number = lambda at: F.conv(F.hex(F.substring("body", at, 2)), 16, 10).cast("int")
    return d.where(F.length("body") >= 8).select("capture_id", "index", "ts", "src", number(1).alias("sport"), "dst", number(3).alias("dport"), F.substring("body", 9, 65_535).alias("payload"))


def segments(d: DataFrame, ports=MAIL_PORTS, keep: int | None = None) -> DataFrame:
    """TCP segments with a mail port at either end; keep cuts each segment's bytes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cap, index, ts, vlan, src, dst, p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(p) < 20:
                    continue
                sport, dport, seq = struct.unpack(">HHI", p[:8])
                head = (p[12] >> 4) * 4
                if head >= 20 and (ports is None or sport in ports or dport in ports):
                    rows.append((cap, index, ts, vlan, src, sport, dst, dport, seq, p[13], p[head:][:keep]))
            if rows:
                yield _batch(rows, SEGMENTS)

    return d.select("capture_id", "index", "ts", "vlan", "src", "dst", "body").mapInArrow(parse, SEGMENTS)


def with_clock(segs: DataFrame, span: int = CLOCK_SPAN) -> DataFrame:
    """segs with the capture's clock: `clock` is the latest time among its rows up to this one, `before` that up to the one before.

    A prefix maximum in spans of packet numbers: one maximum a span is carried on, and only a span's own rows are put in
    order in one task, whatever the capture's length. The first row's `before` is null. Rows of one number tie: each sees
    the other's time or not. Null times count for nothing.
    """
    span_of = F.floor(F.col("index") / F.lit(span))
    tops = segs.groupBy("capture_id", span_of.alias("__span")).agg(F.max("ts").alias("__top"))
    before = Window.partitionBy("__capture").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(F.col("capture_id").alias("__capture"), F.col("__span").alias("__at"), "__top").withColumn("__carried", F.max("__top").over(before)).drop("__top")
    rows = segs.withColumn("__span", span_of)
    rows = rows.join(carried, F.col("capture_id").eqNullSafe(F.col("__capture")) & F.col("__span").eqNullSafe(F.col("__at")), "left")
    own = Window.partitionBy("capture_id", "__span").orderBy("index")
    upto, earlier = (F.max("ts").over(own.rowsBetween(Window.unboundedPreceding, n)) for n in (0, -1))
    out = rows.withColumns({"clock": F.greatest(upto, "__carried"), "before": F.greatest(earlier, "__carried")})
    return out.select(*segs.columns, "clock", "before")


class Half:
    """One direction: bytes in order, segments that wait, and what was odd."""

    def __init__(self):
        self.isn = None
        self.next = 0  # offset of the next byte from the first one
        self.lost = 0  # bytes skipped so far
        self.out, self.waiting, self.held = bytearray(), [], 0
        self.bytes = self.packets = self.retrans = self.overlaps = 0
        self.gaps, self.findings, self.fin, self.cut, self.stalled = [], [], False, False, None

    def take(self, seq: int, flags: int, body: bytes, ts: float, limit: int) -> list[bytes]:
        """Bytes that became readable."""
        self.packets += 1
        self.bytes += len(body)
        if flags & SYN:
            self.isn = (seq + 1) & 0xFFFFFFFF if self.isn is None else self.isn
            seq = (seq + 1) & 0xFFFFFFFF
        if self.isn is None:
            self.isn = seq
        if flags & FIN:
            self.fin = True
        if not body:
            return []
        # The number of the byte, unwrapped around what is expected next.
        base = (self.isn + self.next) & 0xFFFFFFFF
        at = self.next + ((seq - base + HALF) & 0xFFFFFFFF) - HALF
        new = []
        if at > self.next:
            heapq.heappush(self.waiting, (at, len(self.waiting), body))
            self.held += len(body)
            self.stalled = ts if self.stalled is None else self.stalled
            if self.held > OUT_OF_ORDER:
                new += self.skip(limit, "too many bytes wait for a missing segment")
        else:
            new += self._add(at, body, limit) + self._drain(limit)
        return new

    def _add(self, at: int, body: bytes, limit: int) -> list[bytes]:
        if at < self.next:
            old = min(len(body), self.next - at)
            if at + len(body) <= self.next:
                self.retrans += 1
            else:
                self.overlaps += 1
            place = at - self.lost  # skipped bytes are not in the buffer
            if place >= 0 and place + old <= len(self.out) and self.out[place : place + old] != body[:old]:
                self.findings.append(("ANOMALY_TCP_OVERLAP", "HIGH", "segments that overlap hold different bytes; the first are kept", body[:32].hex()))
            body = body[old:]
        if not body:
            return []
        self.next += len(body)
        room = limit - len(self.out)
        if len(body) > room:
            self.cut, body = True, body[: max(0, room)]
        self.out += body
        return [body] if body else []

    def _drain(self, limit: int) -> list[bytes]:
        new = []
        while self.waiting and self.waiting[0][0] <= self.next:
            at, _, body = heapq.heappop(self.waiting)
            self.held -= len(body)
            new += self._add(at, body, limit)
        self.stalled = self.stalled if self.waiting else None
        return new

    def skip(self, limit: int, why: str) -> list[bytes]:
        """Go on after the missing bytes."""
        if not self.waiting:
            return []
        gap = self.waiting[0][0] - self.next
        self.gaps.append((self.next, gap))
        self.findings.append(("REASSEMBLY_FORCED_GAP", "MEDIUM", why, f"{gap} bytes at {self.next}"))
        self.next += gap
        self.lost += gap
        self.stalled = None
        return self._drain(limit)


class Flow:
    def __init__(self, row: dict, ports, limit: int):
        self.limit, self.halves, self.chunks = limit, (Half(), Half()), []
        here, there = (row["src"], row["sport"]), (row["dst"], row["dport"])
        syn = row["flags"] & (SYN | ACK)
        self.inferred = not row["flags"] & SYN
        if syn == SYN:
            client = here
        elif syn == SYN | ACK:
            client = there
        elif (here[1] in ports) != (there[1] in ports):
            client = there if here[1] in ports else here
        else:
            client = here if there[1] <= here[1] else there
        self.client, self.server = client, there if client == here else here
        self.vlan, self.first, self.last, self.closed = row["vlan"], row["ts"], row["ts"], False
        self.clock = row.get("clock", row["ts"])

    def take(self, r: dict) -> None:
        """The next packet; rows with a clock (with_clock) wait for missing segments by that, others by their own times."""
        side = 0 if (r["src"], r["sport"]) == self.client else 1
        now = r.get("clock", r["ts"])
        self._wait(r["ts"], r["before"] if "clock" in r else r["ts"])
        self.last, self.clock = max(self.last, r["ts"]), now
        self._read(side, r["ts"], self.halves[side].take(r["seq"], r["flags"], r["body"], now, self.limit))
        if "clock" in r:
            self._wait(r["ts"], now)
        self.closed = bool(r["flags"] & RST) or all(h.fin and not h.waiting for h in self.halves)

    def _wait(self, ts: float, now: float | None) -> None:
        for i, h in enumerate(self.halves):
            if h.stalled is not None and now is not None and now - h.stalled >= GAP_WAIT:
                self._read(i, ts, h.skip(self.limit, "a missing segment did not come in time"))

    def _read(self, side: int, ts: float, parts: list[bytes]) -> None:
        self.chunks += [{"dir": ("c2s", "s2c")[side], "ts": ts, "data": bytes(p)} for p in parts]

    def row(self) -> dict:
        for i, h in enumerate(self.halves):
            while h.waiting:
                self._read(i, self.last, h.skip(self.limit, "the capture ends with a segment missing"))
        c, s = self.halves
        cut, gaps = c.cut or s.cut, c.gaps + s.gaps
        return {
            "client_ip": self.client[0], "client_port": self.client[1], "server_ip": self.server[0], "server_port": self.server[1], "vlan_id": self.vlan, "first_seen": self.first, "last_seen": self.last,
            "c2s_bytes": c.bytes, "s2c_bytes": s.bytes, "c2s_packets": c.packets, "s2c_packets": s.packets, "c2s_payload": bytes(c.out), "s2c_payload": bytes(s.out), "chunks": self.chunks,
            "quality": {"retrans_count": c.retrans + s.retrans, "overlap_count": c.overlaps + s.overlaps, "gaps": [{"offset": o, "len": n} for o, n in gaps], "complete": not gaps and not cut and (c.fin or s.fin), "buffer_truncated": cut, "direction_inferred": self.inferred},
            "findings": [dict(zip(("rule_id", "severity", "description", "evidence"), f, strict=True)) for h in self.halves for f in h.findings],
        }


def rebuild(rows: list[dict], ports=MAIL_PORTS, limit: int = BUFFER) -> list[dict]:
    """Sessions of one flow key, from its segments; those with a clock end by what it showed before a packet came."""
    out, flow = [], None
    for r in sorted(rows, key=lambda r: r["index"]):
        silent = flow and (r["before"] - flow.clock if "clock" in r else r["ts"] - flow.last)
        if flow and (silent >= IDLE or (flow.closed and (r["flags"] & SYN or r["body"]))):
            out.append(flow.row())
            flow = None
        flow = flow or Flow(r, ports, limit)
        flow.take(r)
    if flow:
        out.append(flow.row())
    return out


def reassembled(segs: DataFrame, ports=MAIL_PORTS, limit: int = BUFFER, compat: bool = False) -> DataFrame:
    """Sessions with capture_id and the columns of REASSEMBLED.

    compat: silence (300 s) and missing segments (30 s) are measured on the clock of the capture's packets among segs, so
    a session whose flow falls silent goes on if no other packet shows that time has passed.
    """
    segs = with_clock(segs) if compat else segs
    schema = f"capture_id string, {REASSEMBLED}"
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    keyed = segs.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        slices = (b.slice(at, TOGETHER) for b in batches for at in range(0, b.num_rows, TOGETHER))
        for key, rows in groupby((r for b in slices for r in b.to_pylist()), lambda r: (r["capture_id"], r.pop("lo"), r.pop("hi"), r["vlan"])):
            for s in rebuild(list(rows), ports, limit):
                found.append({"capture_id": key[0], **s})
                size += len(s["c2s_payload"]) + len(s["s2c_payload"])
            if len(found) >= TOGETHER or size >= HANDSHAKE * 16:
                yield pa.RecordBatch.from_pylist(found, schema=arrow)
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    key = ("capture_id", "lo", "hi", "vlan")  # put in order, a flow's rows follow each other: many flows are a batch, one is held at a time
    return keyed.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def sessions(packets: DataFrame, ports=MAIL_PORTS, handshake_only: bool = False, compat: bool = False) -> DataFrame:
    """The whole way; handshake_only keeps the first 64 KiB of each direction. compat: see reassembled(); the clock then counts every TCP packet."""
    limit = HANDSHAKE if handshake_only else BUFFER
    if not compat:
        return reassembled(segments(defragmented(datagrams(packets)), ports), ports, limit)
    every = with_clock(segments(defragmented(datagrams(packets)), None))
    return reassembled(every.where(F.col("sport").isin(*ports) | F.col("dport").isin(*ports)), ports, limit)
