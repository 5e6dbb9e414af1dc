"""Orders cut into spans: sessions by silence, trailing counts and the capture's clock against loops over all rows."""

import random

import pytest

import wire as W
from mailsonde.operators import flow, relational


def times(r, n):
    t, out = 0.0, []
    for i in range(n):
        t += r.choice([0, 0, 1, 5, 50, 400, 90_000])
        out.append((r.choice(["a", "a", "a", "b", None]), i, float(t)))
    return out


def test_idle_sessions_against_a_loop(spark):
    rows = times(random.Random(1), 400)
    df = spark.createDataFrame(rows, "k string, i int, t double").repartition(4)
    for span in (10.0, 1000.0, 1e9):
        got = {x["i"]: x["session_no"] for x in relational.idle_sessions(df, ["k"], "t", "i", 300.0, span).collect()}
        for key in ("a", "b", None):
            n, last = 0, None
            for _, i, t in sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1])):
                n += last is None or t - last >= 300
                last = t
                assert got[i] == n, (span, key, i)


def test_trailing_count_against_all_pairs(spark):
    rows = [(k, i, int(t)) for k, i, t in times(random.Random(2), 300)] + [("a", 900, None), ("a", 901, None)]
    df = spark.createDataFrame(rows, "k string, i int, t long").repartition(4)
    got = {x["i"]: x["n"] for x in relational.trailing_count(df, ["k"], "t", 60).collect()}
    for k, i, t in rows:
        want = sum(a == k and (b is None and t is None or b is not None and t is not None and t - 60 <= b <= t) for a, _, b in rows)
        assert got[i] == want


def traffic(r, n):
    """Segments of several flows of two captures: silences, holes that are filled late or never, clocks that run back."""
    rows, t, seq = [], W.T0, {}
    for i in range(n):
        t += r.choice([0.01, 0.5, 3, 12, 40, 160, -1, -20])
        port = 40000 + r.randrange(4)
        side = r.random() < 0.8
        key = (port, side)
        body = bytes(r.randrange(97, 123) for _ in range(r.randint(1, 6)))
        at = seq.get(key, 1000)
        seq[key] = at + len(body) + (r.choice([0, 0, 0, 0, 4]))
        a, b = ((W.CLIENT, port), (W.SERVER, 25)) if side else ((W.SERVER, 25), (W.CLIENT, port))
        rows.append({"capture_id": r.choice("xxy"), "index": i, "ts": t, "vlan": None, "src": a[0], "sport": a[1], "dst": b[0], "dport": b[1], "seq": at, "flags": 24, "body": body})
    return rows


def sequentially(rows):
    """One pass over a capture in order, all flows at once, with one clock; timers are looked at after every packet."""
    out, flows, clock = [], {}, None
    for r in sorted(rows, key=lambda r: r["index"]):
        key = tuple(sorted([(r["src"], r["sport"]), (r["dst"], r["dport"])]))
        now = r["ts"] if clock is None else max(clock, r["ts"])
        f = flows.get(key)
        if f and f.closed and (r["flags"] & flow.SYN or r["body"]):
            out.append(flows.pop(key).row())
            f = None
        f = flows.setdefault(key, f or flow.Flow(r, flow.MAIL_PORTS, flow.BUFFER))
        f.last, f.seen = max(f.last, r["ts"]), now
        side = 0 if (r["src"], r["sport"]) == f.client else 1
        f._read(side, r["ts"], f.halves[side].take(r["seq"], r["flags"], r["body"], now, f.limit))
        f.closed = bool(r["flags"] & flow.RST) or all(h.fin and not h.waiting for h in f.halves)
        clock = now
        for k, g in list(flows.items()):
            for i, h in enumerate(g.halves):
                if h.stalled is not None and clock - h.stalled >= flow.GAP_WAIT:
                    g._read(i, clock, h.skip(g.limit, "a missing segment did not come in time"))
            if clock - g.seen >= flow.IDLE:
                out.append(flows.pop(k).row())
    return out + [f.row() for f in flows.values()]


def told(s):
    return s["client_ip"], s["client_port"], s["first_seen"], s["last_seen"], bytes(s["c2s_payload"]), bytes(s["s2c_payload"]), [(g["offset"], g["len"]) for g in s["quality"]["gaps"]], s["c2s_packets"], s["s2c_packets"]


@pytest.mark.parametrize("seed", range(3))
def test_the_captures_clock_against_one_pass(spark, seed):
    rows = traffic(random.Random(seed), 250)
    want = sorted(told(s) for c in "xy" for s in sequentially([r for r in rows if r["capture_id"] == c]))
    df = spark.createDataFrame([tuple(r[k.split(" ")[0]] for k in flow.SEGMENTS.split(", ")) for r in rows], flow.SEGMENTS)
    shuffled = df.repartition(7)
    assert sorted(told(s) for s in flow.reassembled(shuffled, compat=True).collect()) == want
    for span in (1, 16, 1000):
        seen, clock = flow.with_clock(shuffled, span).orderBy("index").collect(), {}
        for x in seen:
            c = clock.get(x["capture_id"])
            assert x["before"] == c
            clock[x["capture_id"]] = x["ts"] if c is None else max(c, x["ts"])
            assert x["clock"] == clock[x["capture_id"]]
    assert want != sorted(told(s) for s in flow.reassembled(shuffled).collect())  # own silence alone splits otherwise


def test_a_silent_capture_keeps_a_session_open(spark):
    base = {"capture_id": "c", "vlan": None, "src": W.CLIENT, "sport": 40000, "dst": W.SERVER, "dport": 25, "flags": 24}
    alone = [{**base, "index": 0, "ts": 1.0, "seq": 1, "body": b"a"}, {**base, "index": 2, "ts": 900.0, "seq": 2, "body": b"b"}]
    other = {**base, "index": 1, "ts": 600.0, "seq": 1, "body": b"z", "sport": 50000}
    make = lambda rows: spark.createDataFrame([tuple(r[k.split(" ")[0]] for k in flow.SEGMENTS.split(", ")) for r in rows], flow.SEGMENTS)
    payloads = lambda df: sorted(bytes(s["c2s_payload"]) for s in df.collect())
    assert payloads(flow.reassembled(make(alone))) == [b"a", b"b"]
    assert payloads(flow.reassembled(make(alone), compat=True)) == [b"ab"]
    assert payloads(flow.reassembled(make([*alone, other]), compat=True)) == [b"a", b"b", b"z"]
