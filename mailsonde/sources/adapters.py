"""Adapters that present ordinary tables as captures, so that byte-level operators run on them too."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PACKETS as PACKETS_DDL

SEGMENT, STEP, EPOCH = 97, 0.001, 1_700_000_000.0
PACKETS = pa.schema([("capture_id", pa.string()), ("index", pa.int64()), ("ts", pa.float64()), ("caplen", pa.int32()), ("wirelen", pa.int32()), ("vlan_id", pa.int32()), ("payload", pa.binary())])


def _packet(src: bytes, sport: int, dst: bytes, dport: int, seq: int, flags: int, body: bytes) -> bytes:
    segment = struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 0x50, flags, 65535, 0, 0) + body
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(segment), 0, 0, 64, 6, 0, src, dst) + segment


def packets_from_conversations(conversations: DataFrame) -> DataFrame:
    """Packets of one SMTP-port session a conversation: users' turns go to the server, all others to the client.

    Every second pair of a turn's segments arrives in the wrong order and every fifth segment twice. The client's
    address spells the conversation's id; sequence numbers wrap on the way for every third conversation.
    """

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["turn"])
        conv = rows[0]["conv_id"]
        ends = {"c": (struct.pack(">I", 0x0A000000 | conv & 0xFFFFFF), 40_000), "s": (b"\xac\x10\x00\x19", 25)}
        seq = {"c": 0xFFFFFF00 if conv % 3 == 0 else 1000, "s": 5000}
        out: list[bytes] = []

        def send(side: str, at: int, flags: int, body: bytes = b"") -> None:
            other = "s" if side == "c" else "c"
            out.append(_packet(*ends[side], *ends[other], at, flags, body))

        for side, flags in (("c", 2), ("s", 18)):
            send(side, seq[side], flags)
            seq[side] += 1
        for r in rows:
            side, data = "c" if r["role"] == "user" else "s", (r["text"] or "").encode()
            parts = [(seq[side] + i, data[i : i + SEGMENT]) for i in range(0, len(data), SEGMENT)]
            seq[side] += len(data)
            for i in range(0, len(parts) - 1, 4):
                parts[i], parts[i + 1] = parts[i + 1], parts[i]
            for i, (at, body) in enumerate(parts):
                for _ in range(1 + (i % 5 == 4)):
                    send(side, at, 24, body)
        for side in "cs":
            send(side, seq[side], 17)
        n, name = len(out), f"conversation-{conv}"
        sizes = [len(p) for p in out]
        return pa.table([[name] * n, list(range(n)), [EPOCH + STEP * i for i in range(n)], sizes, sizes, pa.nulls(n, pa.int32()), out], schema=PACKETS)

    return conversations.select("conv_id", "turn", "role", F.col("text")).groupBy("conv_id").applyInArrow(build, PACKETS_DDL)


def _sized(n: int, body: bytes) -> bytes:
    return len(body).to_bytes(n, "big") + body


def _record(kind: int, body: bytes, version: int = 0x0303) -> bytes:
    return struct.pack(">BH", kind, version) + _sized(2, body)


def _hello(kind: int, body: bytes, extensions: list[tuple[int, bytes]]) -> bytes:
    exts = b"".join(k.to_bytes(2, "big") + _sized(2, x) for k, x in extensions)
    return _record(22, bytes([kind]) + _sized(3, b"\x03\x03" + body + _sized(2, exts)))


def client_hello(ciphers: list[int], host: bytes) -> bytes:
    numbers = lambda *xs: b"".join(x.to_bytes(2, "big") for x in xs)
    exts = [(0, _sized(2, b"\0" + _sized(2, host))), (10, _sized(2, numbers(29, 23))), (11, _sized(1, b"\0")), (13, _sized(2, numbers(0x0403, 0x0804))), (23, b""), (43, _sized(1, numbers(0x0304, 0x0303)))]
    return _hello(1, b"r" * 32 + _sized(1, b"") + _sized(2, numbers(*ciphers)) + _sized(1, b"\0"), exts)


def server_hello(cipher: int, random: bytes, selected: int | None) -> bytes:
    exts = [(65281, b"\0")] + ([(43, selected.to_bytes(2, "big"))] if selected else [])
    return _hello(2, random + _sized(1, b"") + cipher.to_bytes(2, "big") + b"\0", exts)


def mail_turns(n: int) -> tuple[int, list[tuple[str, bytes]]]:
    """(server's port, (side, bytes) in order) of the n-th dialogue, of eight kinds: what it offers and asks, and what becomes of it."""
    kind, cipher = n % 8, 0xC000 + n % 500
    greeting, asks = [("s", b"220 mx.example.org ESMTP\r\n"), ("c", b"EHLO me.example.net\r\n")], [("c", b"STARTTLS\r\n")]
    offers, accepts = [("s", b"250-mx.example.org\r\n250 STARTTLS\r\n")], [("s", b"220 go\r\n")]
    hello, done = client_hello([0x1301, cipher], b"mail.example.org"), _record(20, b"\1") + _record(22, b"x" * 40)
    shake = lambda random=b"s" * 32, selected=None: [("c", hello), ("s", server_hello(cipher, random, selected)), ("c", done), ("s", done), ("c", _record(23, b"data"))]
    ready = greeting + offers + asks + accepts
    turns = (
        ready + shake(), ready + [("c", b"MAIL FROM:<a@b.org>\r\n")], greeting + offers + asks + [("s", b"454 no\r\n"), ("c", b"AUTH PLAIN AGEAYg==\r\n")], greeting + [("s", b"250 SIZE\r\n")],
        ready + shake(b"s" * 24 + b"DOWNGRD\1"), greeting + offers + asks, [("c", hello)], shake(selected=0x0304),
    )[kind]
    return {6: 465, 7: 993}.get(kind, 25), turns


def packets_of_dialogues(ids: DataFrame, name: str, turns_of=mail_turns) -> DataFrame:
    """Packets of one mail dialogue for each number in the column `name`, which gives its kind, its cipher and the client's address."""

    def build(batches):
        for b in batches:
            for n in b.column(0).to_pylist():
                port, turns = turns_of(n)
                ends = {"c": (struct.pack(">I", 0x0A000000 | n & 0xFFFFFF), 40_000), "s": (b"\xac\x10\x00\x19", port)}
                seq, out = {"c": 1000, "s": 5000}, []
                for side, flags, data in [("c", 2, b""), ("s", 18, b""), *[(s, 24, x) for s, x in turns], ("c", 17, b""), ("s", 17, b"")]:
                    out.append(_packet(*ends[side], *ends["s" if side == "c" else "c"], seq[side], flags, data))
                    seq[side] += len(data) + bool(flags & 3)
                sizes = [len(p) for p in out]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([[f"dialogue-{n}"] * len(out), range(len(out)), [EPOCH + 0.25 * i for i in range(len(out))], sizes, sizes, [None] * len(out), out], PACKETS.types, strict=True)], PACKETS.names)

    return ids.select(F.col(name).cast("long")).mapInArrow(build, PACKETS_DDL)


#: Bits of the primes that parameter_turns() gives out, by turns.
PRIMES = (512, 1016, 1024, 2048, 4096)


def parameter_turns(n: int) -> tuple[int, list[tuple[str, bytes]]]:
    """(port, turns) of an implicit session whose numbers follow from n: the prime of its key exchange, its ticket's lifetime, whether early data was offered."""
    bits, cipher = PRIMES[n % len(PRIMES)], 0xC000 + n % 500
    hello = client_hello([cipher], b"mail.example.org")
    if n % 3 == 0:  # an empty early data extension, at the end
        body = hello[9:]
        at = 2 + 32 + 1 + 2 + 2 + 2
        exts = body[at + 2 :] + b"\x00\x2a\x00\x00"
        hello = _record(22, b"\1" + _sized(3, body[:at] + _sized(2, exts)))
    prime = ((1 << bits) - 1).to_bytes(bits // 8, "big")
    exchange = _sized(2, prime) + _sized(2, b"\2") + _sized(2, prime[1:]) + b"\4\1" + _sized(2, b"signature")
    ticket = (100_000 * (n % 12)).to_bytes(4, "big") + _sized(2, b"ticket")
    done = _record(20, b"\1") + _record(22, b"x" * 40)
    answer = server_hello(cipher, b"s" * 32, None) + _record(22, b"\x0c" + _sized(3, exchange)) + _record(22, b"\4" + _sized(3, ticket))
    return 465, [("c", hello), ("s", answer), ("c", done), ("s", done), ("c", _record(23, b"data"))]


def packets_of_handshakes(rows: DataFrame) -> DataFrame:
    """Packets of one upgraded mail session a row of (id, at, certificates): it begins at `at` and its server shows these certificates.

    The client's address spells the id. Null certificates: the server shows none.
    """

    def build(batches):
        for b in batches:
            for n, at, ders in zip(*(c.to_pylist() for c in b.columns), strict=True):
                _, turns = mail_turns(0)
                shown = b"".join(_sized(3, d) for d in ders or [])
                place = next(i for i, (side, data) in enumerate(turns) if side == "s" and data[:1] == b"\x16") + 1
                turns = [*turns[:place], *([("s", _record(22, b"\x0b" + _sized(3, _sized(3, shown))))] if ders else []), *turns[place:]]
                ends = {"c": (struct.pack(">I", 0x0A000000 | n & 0xFFFFFF), 40_000), "s": (b"\xac\x10\x00\x19", 25)}
                seq, out = {"c": 1000, "s": 5000}, []
                for side, flags, data in [("c", 2, b""), ("s", 18, b""), *[(s, 24, x) for s, x in turns], ("c", 17, b""), ("s", 17, b"")]:
                    for part in range(0, max(1, len(data)), 1400):
                        out.append(_packet(*ends[side], *ends["s" if side == "c" else "c"], seq[side], flags, data[part : part + 1400]))
                        seq[side] += len(data[part : part + 1400]) + bool(flags & 3)
                sizes = [len(p) for p in out]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([[f"handshake-{n}"] * len(out), range(len(out)), [at + 0.25 * i for i in range(len(out))], sizes, sizes, [None] * len(out), out], PACKETS.types, strict=True)], PACKETS.names)

    return rows.select(F.col("id").cast("long"), F.col("at").cast("double"), "certificates").mapInArrow(build, PACKETS_DDL)
