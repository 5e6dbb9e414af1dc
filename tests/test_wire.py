import hashlib
import io
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import wire as W
from mailsonde.operators import decode, detectors, flow
from mailsonde.sources.capture import Capture, CaptureError, CaptureSource, capture_metadata, link_payload, new_captures, read_packets

IP = b"\x45" + b"\0" * 19


def save(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


@pytest.mark.parametrize("data", [b"", b"\xa1\xb2", b"abcdefgh", W.pcap([])[:20]])
def test_what_is_no_capture_fails(data):
    with pytest.raises(CaptureError):
        list(Capture(io.BytesIO(data)))


@pytest.mark.parametrize(
    ("link", "frame", "vlan"),
    [(1, W.ethernet(IP), None), (1, W.ethernet(IP, (7, 9)), 7), (113, b"\0" * 14 + b"\x08\x00" + IP, None), (276, b"\x08\x00" + b"\0" * 18 + IP, None), (101, IP, None), (228, IP, None), (0, b"\2\0\0\0" + IP, None), (999, IP, None)],
)
def test_link_layers(link, frame, vlan):
    assert link_payload(link, frame) == (vlan, IP)


@pytest.mark.parametrize("data", [W.pcap([(1.25, W.ethernet(IP))], order=o, nano=n) for o in "<>" for n in (False, True)] + [W.pcapng([(1.25, W.ethernet(IP))])])
def test_formats_agree(data):
    assert [(x[0], round(x[1], 6), x[5]) for x in Capture(io.BytesIO(data))] == [(0, 1.25, IP)]


def test_truncation_and_corruption_budget():
    whole = W.pcap([(1.0, W.ethernet(IP)), (2.0, W.ethernet(IP))])
    c = Capture(io.BytesIO(whole[:-3]))
    assert len(list(c)) == 1 and c.warnings == ["truncated record"]
    bad = [(1.0, b"x")] * 2 + [(1.0, W.ethernet(IP))] * 18
    with pytest.raises(CaptureError):
        list(Capture(io.BytesIO(W.pcap(bad))))
    assert len(list(Capture(io.BytesIO(W.pcap([(1.0, b"x")] + [(1.0, W.ethernet(IP))] * 29))))) == 29


def segs(parts, isn=1000, syn=True):
    base = {"capture_id": "c", "vlan": None, "src": W.CLIENT, "sport": 40000, "dst": W.SERVER, "dport": 25, "ts": 1.0}
    rows = [{**base, "index": 0, "seq": isn, "flags": 2, "body": b""}] if syn else []
    return rows + [{**base, "index": i + 1, "seq": (isn + syn + at) & 0xFFFFFFFF, "flags": 24, "body": body} for i, (at, body) in enumerate(parts)]


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(1, 400), st.integers(0, 2**32 - 1), st.randoms(use_true_random=False))
def test_any_order_gives_the_payload(payload, size, isn, rnd):
    parts = [(i, payload[i : i + size]) for i in range(0, len(payload), size)]
    parts += rnd.sample(parts, len(parts) // 3)
    rnd.shuffle(parts)
    (s,) = flow.rebuild(segs(parts, isn))
    assert s["c2s_payload"] == payload and not s["quality"]["gaps"] and b"".join(c["data"] for c in s["chunks"]) == payload


def test_overlaps_keep_the_first_bytes():
    (s,) = flow.rebuild(segs([(0, b"AAAA"), (2, b"BBBB")]))
    assert s["c2s_payload"] == b"AAAABB" and s["findings"][0]["rule_id"] == "ANOMALY_TCP_OVERLAP"
    (s,) = flow.rebuild(segs([(0, b"AAAA"), (2, b"AABB")]))
    assert s["c2s_payload"] == b"AAAABB" and not s["findings"] and s["quality"]["overlap_count"] == 1


def test_gaps_idle_and_directions():
    (s,) = flow.rebuild(segs([(0, b"A"), (10, b"Z")]))
    assert s["c2s_payload"] == b"AZ" and s["quality"]["gaps"] == [{"offset": 1, "len": 9}] and s["findings"][0]["rule_id"] == "REASSEMBLY_FORCED_GAP"
    rows = segs([(0, b"A"), (1, b"B")])
    rows[-1]["ts"] = 302.0
    assert [x["c2s_payload"] for x in flow.rebuild(rows)] == [b"A", b"B"]
    (s,) = flow.rebuild(segs([(0, b"A")], syn=False))
    assert s["client_ip"] == W.CLIENT and s["quality"]["direction_inferred"]
    (s,) = flow.rebuild(segs([(0, b"A" * 10)]), limit=4)
    assert s["c2s_payload"] == b"AAAA" and s["quality"]["buffer_truncated"]


def test_capture_to_detections(spark, tmp_path):
    ok = [("s", b"220 mx.example.org ESMTP\r\n"), ("c", b"EHLO me.example.net\r\n"), ("s", b"250-mx.example.org\r\n250 STARTTLS\r\n"), ("c", b"STARTTLS\r\n"), ("s", b"220 go\r\n")]
    clean = [*ok, ("c", W.client_hello()), ("s", W.server_hello()), ("c", W.record(20, b"\1") + W.record(22, b"x" * 40)), ("s", W.record(20, b"\1") + W.record(22, b"x" * 40)), ("c", W.record(23, b"data"))]
    strip = [*ok, ("c", b"MAIL FROM:<a@b.org>\r\n")]
    refused = [*ok[:4], ("s", b"454 no\r\n"), ("c", b"AUTH PLAIN AGEAYg==\r\n")]
    bare = [("s", b"220 mx.example.org ESMTP\r\n"), ("c", b"EHLO me.example.net\r\n"), ("s", b"250 SIZE\r\n")]
    frames = [f for i, turns in enumerate((clean, strip, refused, bare)) for f in W.dialogue(turns, client_port=40000 + i, t0=W.T0 + 10 * i)]
    path = save(tmp_path, "a.pcap", W.pcap(frames))
    s = decode.decoded(flow.sessions(read_packets(spark, path)))
    policies = spark.createDataFrame([("Me.Example.net.", "enforce")], "domain string, mode string")
    rows = {r["client_port"]: r for r in detectors.detect(s, policies=policies, salt="x").collect()}
    assert [rows[p]["fsm"]["state"] for p in range(40000, 40004)] == ["S4_ENCRYPTED", "S_STRIP_DETECTED", "S_REFUSED", "S1B_CAPS_ADV"]
    rules = {p: [d["rule_id"] for d in r["detections"]] for p, r in rows.items()}
    assert rules[40000] == []
    assert rules[40001] == ["D4_POST220_PLAINTEXT", "D9_MTA_STS_VIOLATION"]
    assert rules[40002] == ["D3_EXPLICIT_REFUSAL", "D5_CLEARTEXT_CREDENTIALS", "D9_MTA_STS_VIOLATION"]
    assert rules[40003] == ["D1_CAPABILITY_STRIP", "D9_MTA_STS_VIOLATION"]
    r = rows[40000]
    assert r["cls"]["protocol"] == "SMTP" and r["protocol_version"] == "TLS 1.2" and r["tls"]["handshake_completed"] and r["secure_renegotiation"] and r["extended_master_secret"] and not r["encrypt_then_mac"]
    assert r["ja3"] == hashlib.md5(b"771,4865-49199,0-10-11-13-16-23-43,29-23,0").hexdigest()
    assert r["ja4"].startswith("t13d0207sp_") and r["tls"]["client_hello"]["server_name"] == "mail.example.org"
    assert abs(r["fsm"]["upgrade_latency_ms"] - 500) < 1e-6
    spark.dataSource.register(CaptureSource)
    assert spark.read.format("capture").load(path).count() == len(frames)
    meta = capture_metadata(spark, path)
    assert meta.first()["packets"] == len(frames) and meta.first()["sha256"] == hashlib.sha256(W.pcap(frames)).hexdigest()
    assert new_captures(meta, meta).isEmpty()


def test_fragments(spark):
    whole = W.tcp(W.CLIENT, 40000, W.SERVER, 25, 1, 24, b"x" * 64)
    body = whole[20:]

    def part(at, data, more):
        h = bytearray(whole[:20])
        h[2:4], h[6:8] = (20 + len(data)).to_bytes(2, "big"), ((at // 8) | (0x2000 if more else 0)).to_bytes(2, "big")
        return bytes(h) + data

    rows = [("c", i, 1.0, 1, 1, None, p) for i, p in enumerate((part(40, body[40:], False), part(0, body[:24], True), part(24, body[24:40], True)))]
    from mailsonde.schemas import PACKETS

    p = spark.createDataFrame(rows, PACKETS)
    assert bytes(flow.sessions(p).first()["c2s_payload"]) == b"x" * 64
    assert flow.sessions(p.where("index <> 2")).isEmpty()


def test_tls_oddities():
    assert decode.handshake(b"", b"")["client_hello"] is None
    sentinel = W.server_hello(random=b"s" * 24 + b"DOWNGRD\x01")
    assert decode.handshake(W.client_hello(), sentinel)["server_hello"]["downgrade_sentinel"]
    hello = W.client_hello()
    body = hello[5:]
    cut = W.record(22, body[:50]) + W.record(22, body[50:])
    assert decode.handshake(cut, b"")["client_hello"] == decode.handshake(hello, b"")["client_hello"]
    assert decode.handshake(W.record(21, b"\2\x28"), b"")["alerts"] == [] and decode.handshake(hello + W.record(21, b"\2\x28"), b"")["alerts"] == [{"level": "fatal", "description": "handshake_failure"}]
    for i in range(len(hello)):
        decode.handshake(hello[:i] + bytes([hello[i] ^ 255]) + hello[i + 1 :], hello[:i])


def test_imap_tags_and_classes(spark):
    chunks = [{"dir": d, "ts": float(i), "data": b} for i, (d, b) in enumerate([("s2c", b"* OK hi\r\n"), ("c2s", b"a1 STARTTLS\r\n"), ("s2c", b"a2 OK\r\n")])]
    f = decode.follow(chunks, "IMAP", "EXPLICIT")
    assert f["state"] == "S2_ACCEPTED" and f["findings"][0]["rule_id"] == "IMAP_TAG_MISMATCH"
    df = spark.createDataFrame([(25, b"220 x", b"", None), (9999, b"+OK x", b"", None), (993, b"\x16\x03\x01", b"", None), (9999, b"", b"", "imap"), (9999, b"", b"", None), (143, b"", b"", None)], "p int, s binary, c binary, a string")
    got = [tuple(r.c)[:3] for r in df.select(decode.classify(F.col("p"), F.col("s"), F.col("c"), F.col("a")).alias("c")).collect()]
    assert got == [("SMTP", "EXPLICIT", "content"), ("POP3", "EXPLICIT", "content"), ("IMAP", "IMPLICIT", "content"), ("IMAP", "IMPLICIT", "alpn"), ("UNKNOWN", "UNKNOWN", "port"), ("IMAP", "EXPLICIT", "port")]


HELLO, ANSWER, ENDED, DATA = W.client_hello(), W.server_hello(), W.record(20, b"\1") + W.record(22, b"x" * 40), W.record(23, b"data")
TURNS = {
    "SMTP": [("s2c", b"220 mx ESMTP\r\n"), ("c2s", b"EHLO me.example\r\n"), ("s2c", b"250-mx\r\n250-SIZE\r\n250 STARTTLS\r\n"), ("c2s", b"STARTTLS\r\n"), ("s2c", b"220 go\r\n"), ("c2s", HELLO), ("s2c", ANSWER + ENDED), ("c2s", ENDED + DATA), ("s2c", DATA)],
    "POP3": [("s2c", b"+OK hi\r\n"), ("c2s", b"STLS\r\n"), ("s2c", b"-ERR no\r\n"), ("c2s", b"USER a\r\nPASS b\r\n")],
    "IMAP": [("s2c", b"* OK hi\r\n* CAPABILITY IMAP4rev1 STARTTLS\r\n"), ("c2s", b"a1 STARTTLS\r\n"), ("s2c", b"a1 OK\r\n"), ("c2s", HELLO), ("s2c", ANSWER), ("c2s", DATA)],
    "PLAIN": [("s2c", b"220 mx\r\n"), ("c2s", b"EHLO me\r\n"), ("s2c", b"250-mx\r\n250 STARTTLS\r\n"), ("c2s", b"STARTTLS\r\n"), ("s2c", b"220 go\r\n"), ("c2s", b"\x16 not a record\r\nMAIL FROM:<a@b.org>\r\n")],
}


def told(turns, protocol):
    out = decode.follow([{"dir": d, "ts": 1.0, "data": b} for d, b in turns], "SMTP" if protocol == "PLAIN" else protocol, "EXPLICIT")
    steps = [(t["from_state"], t["to_state"], t["stream_offset"]) for t in out["transitions"]]
    return steps, {k: v for k, v in out.items() if k != "transitions"}


@pytest.mark.parametrize("protocol", TURNS)
def test_dialogues_do_not_depend_on_segments(protocol):
    whole = told(TURNS[protocol], protocol)
    assert whole[1]["state"] == {"SMTP": "S4_ENCRYPTED", "IMAP": "S4_ENCRYPTED", "POP3": "S_REFUSED", "PLAIN": "S_STRIP_DETECTED"}[protocol]
    for size in range(1, 12):
        assert told([(d, b[i : i + size]) for d, b in TURNS[protocol] for i in range(0, len(b), size)], protocol) == whole, size
    for k, (d, b) in enumerate(TURNS[protocol]):
        for cut in range(1, len(b)):
            assert told([*TURNS[protocol][:k], (d, b[:cut]), (d, b[cut:]), *TURNS[protocol][k + 1 :]], protocol) == whole, (k, cut)


def test_replies_and_records_in_one_segment():
    merged = [("s2c", b"220 mx\r\n"), ("c2s", b"EHLO me\r\n"), ("s2c", b"250 STARTTLS\r\n"), ("c2s", b"STARTTLS\r\n"), ("s2c", b"220 go\r\n"), ("c2s", HELLO + ENDED + DATA)]
    steps, out = told(merged, "SMTP")
    assert out["state"] == "S4_ENCRYPTED" and steps[-1][2] == sum(len(b) for d, b in merged if d == "c2s") - len(DATA)
    gap = [*merged[:-1], ("c2s", HELLO[:40]), ("c2s", b"?" * 500), ("c2s", DATA)]  # a record with a hole: in step again at the next one
    assert told(gap, "SMTP")[1]["state"] == "S4_ENCRYPTED"
    long = [("s2c", b"220 " + b"x" * 200_000), ("s2c", b"\r\n"), ("c2s", b"EHLO me\r\n")]
    assert told(long, "SMTP")[1]["state"] == "S1_GREETING"


def test_what_servers_tell_of_key_exchange_and_tickets():
    def told(*messages, extra=b""):
        return decode.handshake(W.client_hello(), W.server_hello() + b"".join(W.record(22, W.message(k, b)) for k, b in messages) + extra)

    prime = b"\xff" * 96
    dh = W.v(2, prime) + W.v(2, b"\2") + W.v(2, b"\1" * 96) + b"\4\1" + W.v(2, b"s")
    curve = b"\3\0\x1d" + W.v(1, b"k" * 32) + b"\4\1" + W.v(2, b"s")
    assert (told((12, dh))["dh_key_bits"], told((12, dh))["curve"]) == (768, None)
    assert (told((12, curve))["dh_key_bits"], told((12, curve))["curve"]) == (None, 29)
    big = W.v(2, b"\xff" * 0x300) + W.v(2, b"\2") + W.v(2, b"\1" * 0x300)  # its length begins like a named curve
    assert told((12, big))["dh_key_bits"] == 0x1800
    for cut in range(len(dh)):
        told((12, dh[:cut]))
    assert told()["dh_key_bits"] is None and told()["ticket_lifetime"] is None and told()["stapled_ocsp"] is None
    assert told((4, (700_000).to_bytes(4, "big") + W.v(2, b"t")), (4, b"\0\0\0\1" + W.v(2, b"t")))["ticket_lifetime"] == 700_000
    assert told((22, b"\1" + W.v(3, b"answer")))["stapled_ocsp"] == b"answer" and told((22, b"\2" + W.v(3, b"x")))["stapled_ocsp"] is None
    share = W.ext(43, b"\3\4") + W.ext(51, b"\0\x17" + W.v(2, b"p" * 65))
    hello = W.record(22, W.message(2, b"\3\3" + b"s" * 32 + W.v(1, b"") + b"\x13\1\0" + W.v(2, share)))
    assert decode.handshake(b"", hello)["server_hello"]["key_share_group"] == 23 and decode.handshake(b"", W.server_hello())["server_hello"]["key_share_group"] is None


def test_udp_and_quic(spark):
    from mailsonde.schemas import PACKETS

    def udp(sport, dport, body, more=b""):
        seg = struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body
        return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(seg), 7, 0, 64, 17, 0, W.ip4(W.CLIENT), W.ip4(W.SERVER)) + seg + more

    bodies = [(25, b"\xc3abc"), (25, b"\x43abc"), (443, b"\xc3abc"), (587, b""), (25, b"\x80"), (25, b"\xff" * 40)]
    rows = [("c", i, float(-i), 1, 1, None, udp(5000, port, body)) for i, (port, body) in enumerate(bodies)]
    rows += [("c", 50, 1.0, 1, 1, None, udp(5000, 25, b"")[:24]), ("c", 51, 1.0, 1, 1, None, W.tcp(W.CLIENT, 1, W.SERVER, 25, 1, 24, b"\xc3"))]
    p = spark.createDataFrame(rows, PACKETS)
    got = flow.udp_payloads(p).orderBy("index").collect()
    assert [(r["dport"], bytes(r["payload"])) for r in got] == bodies
    (found,) = detectors.quic_findings(flow.udp_payloads(p)).collect()
    assert (found["server_ip"], found["server_port"], found["packets"], found["first_seen"], found["finding"]["evidence"]) == (W.SERVER, 25, 3, -5.0, "port 25, first byte 0xff")
    assert detectors.quic_findings(flow.udp_payloads(p.limit(0))).count() == 0 and flow.sessions(p).count() == 1


@pytest.mark.parametrize("together", [1, 3, 500])
def test_flows_across_batches(spark, monkeypatch, together):
    """Flows that begin and end anywhere in a batch, or fill several, are rebuilt as each alone is; many of them are one batch's work."""
    monkeypatch.setattr(flow, "TOGETHER", together)
    rows = []
    for c in range(12):
        for r in segs([(0, b"ab" * c), (2 * c, b"x"), (2 * c + 1, b"yz")]):
            back = {**r, "src": W.SERVER, "sport": 25, "dst": W.CLIENT, "dport": 40000 + c // 3, "seq": r["seq"] + 7}
            rows += [{**r, "capture_id": f"c{c % 3}", "sport": 40000 + c // 3, "vlan": None if c % 2 else 7}, {**back, "capture_id": f"c{c % 3}", "vlan": None if c % 2 else 7}]
    rows = [{**r, "index": i, "ts": float(i)} for i, r in enumerate(rows)]
    df = spark.createDataFrame([tuple(r[x.split()[0]] for x in flow.SEGMENTS.split(", ")) for r in rows], flow.SEGMENTS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = flow.reassembled(df.repartition(3))
        got = sorted((r["capture_id"], str(r["vlan_id"]), r["client_port"], bytes(r["c2s_payload"]), bytes(r["s2c_payload"]), r["first_seen"], r["last_seen"]) for r in out.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for key in {(r["capture_id"], max(r["sport"], r["dport"]), r["vlan"]) for r in rows}:
        for s in flow.rebuild([r for r in rows if (r["capture_id"], max(r["sport"], r["dport"]), r["vlan"]) == key]):
            want.append((key[0], str(s["vlan_id"]), s["client_port"], s["c2s_payload"], s["s2c_payload"], s["first_seen"], s["last_seen"]))
    assert got == sorted(want) and len(got) == 12 and "FlatMapGroups" not in out._jdf.queryExecution().toString()
