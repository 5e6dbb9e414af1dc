"""Builders of captures, byte by byte."""

import struct

T0 = 1_700_000_000.0
CLIENT, SERVER = "192.168.1.100", "10.0.0.25"


def ip4(text):
    return bytes(map(int, text.split(".")))


def tcp(src, sport, dst, dport, seq, flags, body=b"", ident=1):
    seg = struct.pack(">HHIIBBHHH", sport, dport, seq & 0xFFFFFFFF, 0, 5 << 4, flags, 65535, 0, 0) + body
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(seg), ident, 0, 64, 6, 0, ip4(src), ip4(dst)) + seg


def ethernet(packet, tags=()):
    return b"\0" * 12 + b"".join(struct.pack(">HH", 0x8100, t) for t in tags) + b"\x08\x00" + packet


def pcap(frames, link=1, order="<", nano=False, snaplen=262144):
    head = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, snaplen, link)
    ticks = 10**9 if nano else 10**6
    return head + b"".join(struct.pack(order + "IIII", int(t), round((t - int(t)) * ticks), len(f), len(f)) + f for t, f in frames)


def pcapng(frames, link=1):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", link, 0, 262144))
    for t, f in frames:
        us = round(t * 1e6)
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def dialogue(turns, port=25, client_port=40000, t0=T0):
    """Frames of a session from turns of (side, bytes)."""
    seq, ends = {"c": 100_000, "s": 200_000}, {"c": (CLIENT, client_port), "s": (SERVER, port)}
    frames, t = [], t0

    def send(side, flags, body=b""):
        nonlocal t
        (a, ap), (b, bp) = ends[side], ends["s" if side == "c" else "c"]
        frames.append((t, ethernet(tcp(a, ap, b, bp, seq[side], flags, body))))
        seq[side] += len(body) + bool(flags & 3)
        t += 0.25

    send("c", 2)
    send("s", 18)
    for side, body in turns:
        send(side, 24, body)
    send("c", 17)
    send("s", 17)
    return frames


def record(kind, body, version=0x0303):
    return struct.pack(">BHH", kind, version, len(body)) + body


def message(kind, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def ext(kind, body):
    return struct.pack(">HH", kind, len(body)) + body


def v(n, body):
    return len(body).to_bytes(n, "big") + body


def client_hello(ciphers=(0x0A0A, 0x1301, 0xC02F), groups=(0x2A2A, 29, 23), versions=(0x0304, 0x0303), host=b"mail.example.org", alpn=(b"smtp",)):
    n16 = lambda xs: b"".join(x.to_bytes(2, "big") for x in xs)
    exts = ext(0x1A1A, b"") + ext(0, v(2, b"\0" + v(2, host))) + ext(10, v(2, n16(groups))) + ext(11, v(1, b"\0")) + ext(13, v(2, n16((0x0403, 0x0804)))) + ext(16, v(2, b"".join(v(1, a) for a in alpn))) + ext(23, b"") + ext(43, v(1, n16(versions)))
    body = b"\x03\x03" + b"r" * 32 + v(1, b"") + v(2, n16(ciphers)) + v(1, b"\0") + v(2, exts)
    return record(22, message(1, body), 0x0301)


def server_hello(cipher=0xC02F, random=b"s" * 32, selected=None):
    exts = ext(65281, b"\0") + (ext(43, selected.to_bytes(2, "big")) if selected else b"")
    return record(22, message(2, b"\x03\x03" + random + v(1, b"") + cipher.to_bytes(2, "big") + b"\0" + v(2, exts)))
