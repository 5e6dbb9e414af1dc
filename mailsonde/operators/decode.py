"""Protocol decoding of sessions: classification, STARTTLS dialogue, TLS handshakes, certificates' fields.

Classification and detectors are Column expressions; the dialogue and the byte formats are read in Arrow-backed pandas
functions, one call a batch, from the time-ordered chunks that reassembly keeps, so requests and replies interleave as
they did on the wire.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import FSM, TLS

#: What a port suggests, ALPN names of mail protocols, alert codes.
PORTS = {25: ("SMTP", "EXPLICIT"), 587: ("SMTP", "EXPLICIT"), 2525: ("SMTP", "EXPLICIT"), 465: ("SMTP", "IMPLICIT"), 110: ("POP3", "EXPLICIT"), 995: ("POP3", "IMPLICIT"), 143: ("IMAP", "EXPLICIT"), 993: ("IMAP", "IMPLICIT")}
STANDARD_PORTS, FEATURE_PORTS = (25, 110, 143, 465, 587, 993, 995, 2525), (25, 110, 143, 465, 587, 993, 995)
ALPN = {"smtp": "SMTP", "imap": "IMAP", "pop3": "POP3"}
ALERTS = {
    0: "close_notify", 10: "unexpected_message", 20: "bad_record_mac", 21: "decryption_failed", 22: "record_overflow", 30: "decompression_failure", 40: "handshake_failure", 42: "bad_certificate", 43: "unsupported_certificate",
    44: "certificate_revoked", 45: "certificate_expired", 46: "certificate_unknown", 47: "illegal_parameter", 48: "unknown_ca", 49: "access_denied", 50: "decode_error", 51: "decrypt_error", 70: "protocol_version", 71: "insufficient_security",
    80: "internal_error", 86: "inappropriate_fallback", 90: "user_canceled", 100: "no_renegotiation", 109: "missing_extension", 110: "unsupported_extension", 112: "unrecognized_name", 113: "bad_certificate_status_response",
    114: "unknown_psk_identity", 115: "certificate_required", 116: "no_application_protocol",
}
#: The last eight bytes of a server's random number that tell of a downgrade, and that of a retry request (RFC 8446).
SENTINELS = (b"DOWNGRD\x01", b"DOWNGRD\x00")
RETRY = bytes.fromhex("cf21ad74e59a6111be1d8c021e65b891c2a211167abb8c5e079e09e2c8a8339c")


def classify(port: Column, first_s2c: Column, first_c2s: Column, alpn: Column | None = None, overrides: dict | None = None) -> Column:
    """struct(protocol, mode, detected_by, port_is_standard): ALPN, then content, then overrides, then the port."""
    hints = {**PORTS, **(overrides or {})}
    proto, mode = S.lookup({k: v[0] for k, v in hints.items()}, port), S.lookup({k: v[1] for k, v in hints.items()}, port)
    name = S.lookup(ALPN, F.lower(F.trim(F.lit(None).cast("string") if alpn is None else alpn)))
    text, other = (F.decode(F.substring(F.coalesce(c, F.lit(b"")), 1, 64), "ISO-8859-1") for c in (first_s2c, first_c2s))
    tls = text.rlike(r"^\x16\x03[\x00-\x04]") | ((text == "") & other.rlike(r"^\x16\x03[\x00-\x04]"))
    said = F.when(text.rlike("^220[ -]"), "SMTP").when(text.rlike(r"^\+OK"), "POP3").when(text.rlike(r"^\* OK"), "IMAP")
    unknown = F.lit("UNKNOWN")
    by = F.when(name.isNotNull(), "alpn").when(tls | said.isNotNull(), "content").when(port.isin(*(overrides or {0: 0})), "override").otherwise("port")
    return F.struct(
        F.coalesce(name, F.when(tls, F.coalesce(proto, unknown)), said, proto, unknown).alias("protocol"),
        F.when(name.isNotNull() | tls, "IMPLICIT").when(said.isNotNull(), "EXPLICIT").otherwise(F.coalesce(mode, unknown)).alias("mode"),
        by.alias("detected_by"), port.isin(*STANDARD_PORTS).alias("port_is_standard"),
    )


def quic_on_mail_port(port: Column, payload: Column) -> Column:
    first = F.conv(F.hex(F.substring(payload, 1, 1)), 16, 10).cast("int")
    return port.isin(*STANDARD_PORTS) & (first.bitwiseAND(F.lit(0x80)) != 0)


# -- the dialogue

GREETING = re.compile(rb"220[ -]|\+OK|\* OK")
UPGRADE = {"SMTP": re.compile(rb"STARTTLS\s*$", re.I), "POP3": re.compile(rb"STLS\s*$", re.I), "IMAP": re.compile(rb"(\S+)\s+STARTTLS\s*$", re.I)}
ACCEPT = {"SMTP": re.compile(rb"220[ -]"), "POP3": re.compile(rb"\+OK"), "IMAP": re.compile(rb"(\S+)\s+OK", re.I)}
REJECT = {"SMTP": re.compile(rb"[45]\d\d"), "POP3": re.compile(rb"-ERR"), "IMAP": re.compile(rb"(\S+)\s+(?:NO|BAD)", re.I)}
HELO = re.compile(rb"(?:EHLO|HELO)\s+(\S+)", re.I)
SECRETS = re.compile(rb"(?:AUTH\s+(?P<mech>PLAIN|LOGIN|CRAM-MD5|EXTERNAL)|USER\s+\S+|PASS\s+\S+|\S+\s+LOGIN\s+\S+\s+\S+)", re.I)
HANDSHAKE_RECORD, DATA_RECORD = re.compile(rb"\x16\x03[\x00-\x04]"), re.compile(rb"\x17\x03[\x00-\x04]")
ANY_RECORD = re.compile(rb"[\x14-\x18]\x03[\x00-\x04]")
HANDSHAKE_KIND, HANDSHAKE_HEAD = 0x16, b"\x16\x03"
#: States in which a handshake record begins the encrypted part.
UPGRADABLE = ("S2_ACCEPTED", "S0_TCP_EST", "S1_GREETING")
LONGEST_LINE = 65_536


def any_of(rules: dict[str, re.Pattern], protocol: str, line: bytes) -> re.Match | None:
    """The protocol's own rule, or any for a protocol that is not known."""
    if protocol in rules:
        return rules[protocol].match(line)
    return next((m for r in rules.values() if (m := r.match(line))), None)


class Dialogue:
    """States from S0_TCP_EST on; every change is kept with its time, place and evidence."""

    def __init__(self, protocol: str, mode: str):
        self.protocol, self.state = protocol, "S3_TLS_HS" if mode == "IMPLICIT" else "S0_TCP_EST"
        self.banner = self.ehlo = self.latency = self.asked = self.tag = None
        self.caps, self.mechs, self.secrets, self.steps, self.findings = [], [], False, [], []
        self.buffers, self.offsets, self.unread = {"c2s": b"", "s2c": b""}, {"c2s": 0, "s2c": 0}, {"c2s": 0, "s2c": 0}

    def move(self, state: str, ts: float, at: int, data: bytes) -> None:
        head = data[:64]
        shown = "".join(chr(b) if 32 <= b <= 126 else "." for b in head)
        self.steps.append({"from_state": self.state, "to_state": state, "ts": ts, "stream_offset": at, "evidence": f"{head.hex()} | {shown}"})
        self.state = state

    def feed(self, side: str, ts: float, data: bytes) -> None:
        """Bytes of one direction in order. Lines and records are found in the stream, so it does not matter how it was cut into segments."""
        buf, at, start = self.buffers[side] + data, 0, self.offsets[side]
        while at < len(buf) and self.state != "S4_ENCRYPTED":
            if self.state == "S3_TLS_HS":
                after = self.record(side, ts, buf, at, start + at)
            elif self.state in UPGRADABLE and buf[at] == HANDSHAKE_KIND and (len(buf) - at < 3 and HANDSHAKE_HEAD.startswith(buf[at:][:2]) or HANDSHAKE_RECORD.match(buf, at)):
                if len(buf) - at < 3:
                    break  # the rest of the record's head comes with the next segment
                self.latency = None if self.asked is None else (ts - self.asked) * 1000
                self.move("S3_TLS_HS", ts, start + at, buf[at : at + 64])
                continue
            else:
                after = self.line(side, ts, buf, at, start + at)
            if after == at:
                break
            at = after
        if self.state == "S4_ENCRYPTED":
            at = len(buf)
        self.buffers[side], self.offsets[side] = buf[at:], start + at

    def line(self, side: str, ts: float, buf: bytes, at: int, place: int) -> int:
        """Read the line at `at`; where the next one begins, or `at` if it has not ended yet."""
        end = buf.find(b"\n", at, at + LONGEST_LINE)
        if end < 0:
            if len(buf) - at <= LONGEST_LINE:
                return at
            end, after = at + LONGEST_LINE, at + LONGEST_LINE
        else:
            after = end + 1
        if text := buf[at:end].strip():
            (self.client if side == "c2s" else self.server)(text, ts, place)
        return after

    def record(self, side: str, ts: float, buf: bytes, at: int, place: int) -> int:
        """Go on by one record, or by the part of it that is there; application data ends the handshake."""
        if not self.unread[side]:
            if len(buf) - at < 3:
                return at
            if DATA_RECORD.match(buf, at):
                self.move("S4_ENCRYPTED", ts, place, buf[at : at + 64])
                return len(buf)
            if len(buf) - at < 5:
                return at
            if not ANY_RECORD.match(buf, at):  # out of step, after a gap: the next thing that looks like a record
                m = ANY_RECORD.search(buf, at + 1)
                return m.start() if m else len(buf) - 2
            self.unread[side] = 5 + int.from_bytes(buf[at + 3 : at + 5], "big")
        step = min(self.unread[side], len(buf) - at)
        self.unread[side] -= step
        return at + step

    def client(self, line: bytes, ts: float, at: int) -> None:
        if m := SECRETS.match(line):
            self.secrets = True
            if (mech := (m["mech"] or b"").decode().upper()) and mech not in self.mechs:
                self.mechs.append(mech)
        if self.state in ("S1_GREETING", "S1B_CAPS_ADV"):
            if m := HELO.match(line):
                self.ehlo = m[1].decode("latin-1")
            if m := any_of(UPGRADE, self.protocol, line):
                self.asked, self.tag = ts, m[1] if m.re.groups else None
                self.move("S2_CMD", ts, at, line)
        elif self.state == "S2_ACCEPTED":
            self.move("S_STRIP_DETECTED", ts, at, line)

    def server(self, line: bytes, ts: float, at: int) -> None:
        if self.state == "S0_TCP_EST" and GREETING.match(line):
            self.banner = line.decode("latin-1")
            self.move("S1_GREETING", ts, at, line)
        elif self.state in ("S1_GREETING", "S1B_CAPS_ADV"):
            if found := self.offers(line.decode("latin-1")):
                self.caps += [c for c in dict.fromkeys(found) if c not in self.caps]
                if self.state == "S1_GREETING":
                    self.move("S1B_CAPS_ADV", ts, at, line)
        elif self.state == "S2_CMD":
            if m := any_of(ACCEPT, self.protocol, line):
                if m.re.groups and self.tag and m[1] != self.tag:
                    self.findings.append({"rule_id": "IMAP_TAG_MISMATCH", "severity": "MEDIUM", "description": "the reply has another tag than the command", "evidence": f"{self.tag!r} {m[1]!r}"})
                self.move("S2_ACCEPTED", ts, at, line)
            elif any_of(REJECT, self.protocol, line):
                self.move("S_REFUSED", ts, at, line)

    def offers(self, line: str) -> list[str]:
        if self.protocol == "SMTP":
            return [line[4:].strip()] if line[:4] in ("250-", "250 ") and line[4:].strip() else []
        if self.protocol == "POP3":
            return [] if line.startswith(("+OK", ".")) else [line]
        return line.split() if self.protocol == "IMAP" and "CAPABILITY" in line.upper() else []

    def result(self) -> dict:
        return {
            "state": self.state, "server_banner": self.banner, "ehlo_domain": self.ehlo, "advertised_capabilities": self.caps, "auth_mechanisms_used": self.mechs,
            "credentials_in_cleartext": self.secrets, "upgrade_latency_ms": self.latency, "transitions": self.steps, "findings": self.findings,
        }


def follow(chunks, protocol: str | None = "SMTP", mode: str | None = "EXPLICIT") -> dict:
    d = Dialogue(protocol or "", mode or "")
    for c in chunks if chunks is not None else ():
        if c["data"]:
            d.feed(c["dir"], c["ts"], bytes(c["data"]))
    return d.result()


def dialogue(chunks, protocol, mode) -> Column:
    """The dialogue's outcome (FSM) from time-ordered chunks."""

    @F.pandas_udf(FSM)
    def run(c: pd.Series, p: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([follow(*x) for x in zip(c, p, m, strict=True)], columns=list(Dialogue("", "").result()))

    return run(chunks, protocol, mode)


# -- TLS


def handshakes(stream: bytes) -> tuple[list[tuple[int, bytes]], list[dict], bool]:
    """(messages, alerts, whether encrypted records follow) of one direction, from its first handshake record on."""
    m = re.search(rb"\x16\x03[\x00-\x04]", stream)
    at, body, alerts, sealed, messages = (m.start() if m else len(stream)), b"", [], False, []
    while at + 5 <= len(stream):
        kind, _, size = struct.unpack(">BHH", stream[at : at + 5])
        if size > 18_432 or not 20 <= kind <= 24:
            break
        part = stream[at + 5 : at + 5 + size]
        at += 5 + size
        if kind == 20:
            sealed = True
        elif kind == 21 and not sealed and len(part) == 2:
            alerts.append({"level": {1: "warning", 2: "fatal"}.get(part[0], str(part[0])), "description": ALERTS.get(part[1], f"unknown_alert_{part[1]}")})
        elif kind == 22 and not sealed:
            body += part
    while len(body) >= 4:
        size = int.from_bytes(body[1:4], "big")
        if len(body) < 4 + size:
            break
        messages.append((body[0], body[4 : 4 + size]))
        body = body[4 + size :]
    return messages, alerts, sealed


class Reader:
    """Fields one after another; what lies beyond the end is an IndexError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise IndexError
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def vector(self, n: int) -> bytes:
        return self.take(self.number(n))

    @property
    def more(self) -> bool:
        return self.at < len(self.data)


def numbers(data: bytes, width: int = 2) -> list[int]:
    return [int.from_bytes(data[i : i + width], "big") for i in range(0, len(data) - width + 1, width)]


def extensions(r: Reader) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    try:
        x = Reader(r.vector(2))
        while x.more:
            kind = x.number(2)
            out.setdefault(kind, x.vector(2))
    except IndexError:
        pass
    return out


def inner(data: bytes | None, n: int) -> bytes:
    """The vector that fills an extension; cut ones give what is there."""
    return data[n : n + int.from_bytes(data[:n], "big")] if data else b""


def names(data: bytes) -> list[str]:
    r, out = Reader(data), []
    try:
        while r.more:
            out.append(r.vector(1).decode("ascii", "replace"))
    except IndexError:
        pass
    return out


def client_hello(data: bytes) -> dict | None:
    r = Reader(data)
    try:
        version, random = r.number(2), r.take(32)
        r.vector(1)
        ciphers, compression = numbers(r.vector(2)), list(r.vector(1))
    except IndexError:
        return None
    x = extensions(r)
    host = None
    if 0 in x:
        try:
            s = Reader(inner(x[0], 2))
            while s.more and host is None:
                kind, value = s.number(1), s.vector(2)
                host = value.decode("latin-1") if kind == 0 else None
        except IndexError:
            host = None
    return {
        "legacy_version": version, "random": random, "cipher_suites": ciphers, "compression_methods": compression, "ext_order": list(x), "supported_versions": numbers(inner(x.get(43), 1)), "supported_groups": numbers(inner(x.get(10), 2)),
        "ec_point_formats": list(inner(x.get(11), 1)), "signature_algorithms": numbers(inner(x.get(13), 2)), "alpn_protocols": names(inner(x.get(16), 2)), "server_name": host,
    }


def server_hello(data: bytes) -> dict | None:
    r = Reader(data)
    try:
        version, random = r.number(2), r.take(32)
        r.vector(1)
        cipher, compression = r.number(2), r.number(1)
    except IndexError:
        return None
    x = extensions(r)
    selected = int.from_bytes(x[43][:2], "big") if len(x.get(43, b"")) >= 2 else version
    alpn = names(inner(x.get(16), 2))
    return {
        "legacy_version": version, "selected_version": selected, "random": random, "selected_cipher": cipher, "selected_compression": compression, "ext_order": list(x),
        "selected_alpn": alpn[0] if alpn else None, "downgrade_sentinel": random[24:] in SENTINELS, "hello_retry": random == RETRY, "key_share_group": int.from_bytes(x[51][:2], "big") if len(x.get(51, b"")) >= 2 else None,
    }


def certificate_list(data: bytes) -> list[bytes]:
    r, out = Reader(data), []
    try:
        x = Reader(r.vector(3))
        while x.more:
            out.append(x.vector(3))
    except IndexError:
        pass
    return out


def stapled_answer(data: bytes) -> bytes | None:
    """The OCSP answer in a certificate status message (kind 1)."""
    return inner(data[1:], 3) or None if data[:1] == b"\1" else None


def key_exchange(data: bytes) -> tuple[int | None, int | None]:
    """(bits of the prime, number of the curve) of a server's key exchange message; one of them, or neither.

    Three vectors that follow each other in full are a prime, a generator and a public value; else kind 3 names a curve.
    """
    r = Reader(data)
    try:
        prime = r.vector(2)
        r.vector(2)
        r.vector(2)
        return int.from_bytes(prime, "big").bit_length(), None
    except IndexError:
        return None, int.from_bytes(data[1:3], "big") if data[:1] == b"\3" and len(data) >= 4 + data[3] else None


def handshake(c2s: bytes | None, s2c: bytes | None) -> dict:
    mine, alerts, sealed = handshakes(c2s or b"")
    theirs, more, sealed2 = handshakes(s2c or b"")
    hello = next((h for k, b in mine if k == 1 and (h := client_hello(b))), None)
    answers = [h for k, b in theirs if k == 2 and (h := server_hello(b))]
    answer = next((h for h in answers if not h["hello_retry"]), answers[0] if answers else None)
    certs = next((certificate_list(b) for k, b in theirs if k == 11), [])
    bits, curve = next((key_exchange(b) for k, b in theirs if k == 12), (None, None))
    lifetimes = [int.from_bytes(b[:4], "big") for k, b in theirs if k == 4 and len(b) >= 4]
    modern = bool(answer) and answer["selected_version"] == 0x0304
    # Finished is encrypted: both sides changing to encrypted records tells that the handshake ended.
    more_told = {"ticket_lifetime": max(lifetimes, default=None), "dh_key_bits": bits, "curve": curve}
    return {"client_hello": hello, "server_hello": answer, "certificates": certs, "alerts": alerts + more, "handshake_completed": sealed and sealed2, "certificates_observable": bool(certs) and not modern, "stapled_ocsp": next((stapled_answer(b) for k, b in theirs if k == 22), None), **more_told}


def tls(c2s, s2c) -> Column:
    """The handshake (TLS) from both directions' bytes."""

    @F.pandas_udf(TLS)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([handshake(*x) for x in zip(a, b, strict=True)], columns=list(handshake(b"", b"")))

    return run(c2s, s2c)


def fingerprints(t: str = "tls") -> dict[str, Column]:
    """ja3, ja3s, ja4, ja4s from the decoded hellos; null where there is none."""
    c, s = (lambda f: F.col(f"{t}.client_hello.{f}")), (lambda f: F.col(f"{t}.server_hello.{f}"))
    has = lambda k, x: F.when(F.col(f"{t}.{k}").isNotNull(), x)
    return {
        "ja3": has("client_hello", S.ja3(c("legacy_version"), c("cipher_suites"), c("ext_order"), c("supported_groups"), c("ec_point_formats"))),
        "ja3s": has("server_hello", S.ja3s(s("legacy_version"), s("selected_cipher"), s("ext_order"))),
        "ja4": has("client_hello", S.ja4(c("legacy_version"), c("supported_versions"), c("cipher_suites"), c("ext_order"), c("signature_algorithms"), c("alpn_protocols"), c("server_name"))),
        "ja4s": has("server_hello", S.ja4s(s("selected_version"), s("selected_cipher"), s("ext_order"), s("selected_alpn"))),
    }


def protocol_version(t: str = "tls") -> Column:
    """The server's choice, else the client's offer, else NONE; numbers without a name are shown in hex."""
    v = F.coalesce(F.col(f"{t}.server_hello.selected_version"), F.col(f"{t}.client_hello.legacy_version"))
    return F.when(v.isNull(), "NONE").otherwise(F.coalesce(S.lookup(S.VERSION_NAMES, v), F.format_string("0x%04X", v)))


def hygiene(t: str = "tls") -> dict[str, Column]:
    c, s, suites = (F.coalesce(F.col(f"{t}.{x}"), F.array().cast("array<int>")) for x in ("client_hello.ext_order", "server_hello.ext_order", "client_hello.cipher_suites"))
    either = lambda n: F.array_contains(c, n) | F.array_contains(s, n)
    return {"encrypt_then_mac": either(22), "extended_master_secret": either(23), "secure_renegotiation": either(65281) | F.array_contains(suites, 0x00FF)}


def decoded(sessions: DataFrame) -> DataFrame:
    """Reassembled sessions with classification, dialogue, handshake, fingerprints, version and hygiene."""
    out = sessions.withColumn("cls", classify(F.col("server_port"), F.col("s2c_payload"), F.col("c2s_payload")))
    out = out.withColumn("fsm", dialogue("chunks", "cls.protocol", "cls.mode")).withColumn("tls", tls("c2s_payload", "s2c_payload"))
    return out.withColumns({**fingerprints(), **hygiene(), "protocol_version": protocol_version()})
