"""Byte ranges of captures against one pass over the whole file."""

import io
import random
import struct

import pytest
from pyspark.sql import functions as F

import wire as W
from mailsonde.sources import ranges
from mailsonde.sources.capture import Capture, CaptureError, CaptureSource


def block(kind, body, order="<"):
    body += b"\0" * (-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def noise(r, n):
    return bytes(r.getrandbits(8) for _ in range(n))


def frames(r, n, most=900):
    out, t = [], W.T0
    for i in range(n):
        t += r.choice([0.0, 0.001, 1.5, -0.2])
        port = r.choice([25, 587, 80, 5353])
        out.append((t, W.ethernet(W.tcp(W.CLIENT, 40000 + i % 50, W.SERVER, port, i, 24, noise(r, r.randint(0, most))), r.choice([(), (), (7,)]))))
    return out


def wholly(data):
    return [(round(ts, 6), cap, wire, vlan, payload) for _, ts, cap, wire, vlan, payload in Capture(io.BytesIO(data), 1.0)]


def by_ranges(path, size, split):
    out = []
    for a in range(0, size, split):
        out += [(round(ts, 6), cap, wire, vlan, payload) for _, ts, cap, wire, vlan, payload in ranges.packets_of_range(str(path), a, min(a + split, size), size, 1.0, None)]
    return out


def inside(r, data):
    """Packets whose payloads carry another capture, cut into segments as mail would carry it."""
    return [(W.T0 + i, W.ethernet(W.tcp(W.CLIENT, 40000, W.SERVER, 25, i, 24, data[at : at + 700]))) for i, at in enumerate(range(0, len(data), 700))]


def captures():
    r = random.Random(11)
    some = frames(r, 120)
    carried = W.pcap(frames(r, 400, 40), snaplen=65535)
    yield "empty", W.pcap([])
    for order in "<>":
        for nano in (False, True):
            yield f"classic{order}{nano}", W.pcap(some, order=order, nano=nano, snaplen=65535)
    yield "any snaplen", W.pcap(some, snaplen=0)
    yield "blocks", W.pcapng(some)
    yield "carried", W.pcap(inside(r, carried), snaplen=65535)
    yield "carried blocks", W.pcapng(inside(r, W.pcapng(frames(r, 300, 30))))
    yield "zeros", W.pcap([(W.T0, W.ethernet(W.tcp(W.CLIENT, 1, W.SERVER, 25, i, 24, b"\0" * r.randint(0, 4000)))) for i in range(60)], snaplen=65535)
    zeros = [(W.T0 + i, W.tcp("10.0.0.1", 40000, "10.0.0.2", 25, i, 24, r.choice([b"text ", b"\0\0\0\1", b"\0"]) * r.randint(0, 300))) for i in range(2500)]
    # The lengths in these packets' own headers read as a record's, eleven bytes on, and lead from one packet to the next.
    yield "like headers", W.pcap([(W.T0 + i, W.tcp("10.0.0.1", 40000, "10.0.0.2", 25, i, 24, b"x" * 97, ident=0)) for i in range(9000)], link=101)
    yield "long records allowed", W.pcap(zeros, link=101)
    yield "long blocks allowed", W.pcapng(zeros, link=101)
    yield "cut", W.pcap(some)[:-7]
    yield "cut head", W.pcap(some)[: -len(some[-1][1]) - 3]


@pytest.mark.parametrize(("name", "data"), list(captures()), ids=[n for n, _ in captures()])
def test_every_split_gives_the_same_packets(tmp_path, name, data):
    (path := tmp_path / "a.cap").write_bytes(data)
    want = wholly(data)
    for split in (1, 100, 1013, 4096, 30_000, len(data), 10 * len(data)) if len(data) < 5000 else (509, 4096, 30_000, len(data), 10 * len(data)) if len(data) < 1_000_000 else (97_001, 400_000):
        assert by_ranges(path, len(data), split) == want, split


def test_what_ranges_cannot_know_fails(tmp_path):
    r = random.Random(3)
    us = lambda t: (round(t * 1e6) >> 32, round(t * 1e6) & 0xFFFFFFFF)
    packets = [block(6, struct.pack("<IIIII", 0, *us(t), len(f), len(f)) + f) for t, f in frames(r, 60)]
    head = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    late = head + b"".join(packets[:30]) + block(1, struct.pack("<HHI", 101, 0, 65535)) + b"".join(packets[30:])
    section = head + b"".join(packets[:30]) + head + b"".join(packets[30:])
    simple = head + b"".join(packets[:30]) + block(3, struct.pack("<I", 40) + W.ethernet(W.tcp(W.CLIENT, 1, W.SERVER, 25, 1, 24))[:40]) + b"".join(packets[30:])
    broken = bytearray(W.pcap(frames(r, 60), snaplen=65535))
    at = 24
    for _ in range(30):
        at += 16 + struct.unpack_from("<I", broken, at + 8)[0]
    broken[at + 8 : at + 12] = b"\xff" * 4
    for data in (late, section, simple, bytes(broken)):
        (path := tmp_path / "x.cap").write_bytes(data)
        with pytest.raises(CaptureError, match="split=0"):
            by_ranges(path, len(data), 4000)
        assert by_ranges(path, len(data), len(data)) == wholly(data)
    (path := tmp_path / "y.cap").write_bytes(b"no capture at all")
    with pytest.raises(CaptureError):
        by_ranges(path, 17, 5)


def test_source_splits_prunes_and_filters(spark, tmp_path):
    r = random.Random(5)
    data, other = W.pcap(frames(r, 300), snaplen=65535), W.pcapng(frames(r, 50))
    (tmp_path / "a.pcap").write_bytes(data)
    (tmp_path / "b.pcapng").write_bytes(other)
    spark.dataSource.register(CaptureSource)
    load = lambda **o: spark.read.format("capture").options(**{k: str(v) for k, v in o.items()}).load(str(tmp_path))
    split = load(split=5000)
    assert split.rdd.getNumPartitions() == -(-len(data) // 5000) + -(-len(other) // 5000)
    key = lambda df: sorted((x["capture_id"], x["ts"], bytes(x["payload"])) for x in df.collect())
    want = key(load(split=0))
    assert len(want) == 350 and key(split) == want == key(load())
    by_order = [bytes(x["payload"]) for x in split.where(F.col("capture_id").endswith("a.pcap")).orderBy("index").collect()]
    assert by_order == [x[-1] for x in wholly(data)]
    few = load(split=5000, ports="25,587")
    assert key(few) == [x for x in want if struct.unpack(">H", x[2][22:24])[0] in (25, 587)] and 0 < few.count() < 350
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        name = next(x[0] for x in want if x[0].endswith("a.pcap"))
        late = load(split=5000, pushdown="true").where((F.col("ts") >= W.T0 + 60) & (F.col("ts") < W.T0 + 120) & (F.col("capture_id") == name) & (F.col("caplen") > 100))
        plan = late._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0], plan
        assert late.rdd.getNumPartitions() == -(-len(data) // 5000)
        long = key(load(split=0).where("caplen > 100"))
        assert key(late) == [x for x in want if x[0] == name and W.T0 + 60 <= x[1] < W.T0 + 120 and x in long]
        odd = load(split=5000, pushdown="true").where((F.col("ts") > W.T0 + 60) & (F.col("vlan_id") == 7))
        assert key(odd) == sorted((y["capture_id"], y["ts"], bytes(y["payload"])) for y in load(split=0).collect() if y["ts"] > W.T0 + 60 and y["vlan_id"] == 7)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
