"""Scalar functions as Column expressions: sequence arithmetic, fingerprints, strengths, bands, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOD32 = 4294967295
#: TLS version numbers and their short tags.
VERSION_TAGS = {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3", 0x0002: "s2"}
VERSION_NAMES = {0x0304: "TLS 1.3", 0x0303: "TLS 1.2", 0x0302: "TLS 1.1", 0x0301: "TLS 1.0", 0x0300: "SSL 3.0", 0x0002: "SSL 2.0"}


def lookup(mapping: dict, key: Column, default=None) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def bound(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body reads it."""
    return F.transform(F.array(value), body)[0]


# -- sequence numbers modulo 2**32


def seq_diff(a: Column, b: Column) -> Column:
    """Signed distance from b to a, in (-2**31, 2**31]."""
    d = (a - b).bitwiseAND(F.lit(MOD32))
    return F.when(d > MOD32 // 2 + 1, d - (MOD32 + 1)).otherwise(d)


def seq_lt(a: Column, b: Column) -> Column:
    return (a - b).bitwiseAND(F.lit(MOD32)) > MOD32 // 2


def seq_gt(a: Column, b: Column) -> Column:
    return seq_lt(b, a)


def seq_lte(a: Column, b: Column) -> Column:
    return (a == b) | seq_lt(a, b)


def seq_gte(a: Column, b: Column) -> Column:
    return (a == b) | seq_lt(b, a)


def flow_key(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, vlan: Column | None = None) -> Column:
    """Endpoints in an order that does not depend on direction, with the VLAN."""
    a, b = F.struct(src_ip.alias("ip"), src_port.alias("port")), F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.struct(lo["ip"].alias("a_ip"), lo["port"].alias("a_port"), hi["ip"].alias("b_ip"), hi["port"].alias("b_port"), (F.lit(None).cast("int") if vlan is None else vlan).alias("vlan"))


# -- TLS fingerprints


def is_grease(v: Column) -> Column:
    return (v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(v, 8) == v.bitwiseAND(F.lit(0xFF)))


def strip_grease(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<int>")), lambda v: ~is_grease(v))


def _dashed(values: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<int>")), lambda v: v.cast("string")), "-")


def ja3_text(version: Column, ciphers: Column, extensions: Column, groups: Column, formats: Column) -> Column:
    parts = [F.coalesce(version.cast("string"), F.lit("")), _dashed(strip_grease(ciphers)), _dashed(strip_grease(extensions)), _dashed(strip_grease(groups)), _dashed(formats)]
    return F.concat_ws(",", *parts)


def ja3(*parts: Column) -> Column:
    return F.md5(ja3_text(*parts))


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    chosen = F.when(F.coalesce(cipher, F.lit(0)) == 0, "").otherwise(cipher.cast("string"))
    return F.md5(F.concat_ws(",", F.coalesce(version.cast("string"), F.lit("")), chosen, _dashed(strip_grease(extensions))))


def _hex4(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v), 4, "0"))


def _hash12(text: Column) -> Column:
    return F.when(text == "", "000000000000").otherwise(F.substring(F.sha2(text, 256), 1, 12))


def alpn_tag(protocols: Column) -> Column:
    first = F.get(protocols, F.lit(0))
    return F.when(first.isNull() | (first == ""), "00").otherwise(F.concat(F.substring(first, 1, 1), F.substring(first, -1, 1)))


def best_version(legacy: Column, offered: Column) -> Column:
    return F.coalesce(F.array_max(strip_grease(offered)), legacy)


def ja4(legacy: Column, offered: Column, ciphers: Column, extensions: Column, sigalgs: Column, alpn: Column, sni: Column, transport: str = "t") -> Column:
    """Sorted ciphers and extensions (server name and ALPN apart), signature algorithms as sent."""
    cs, xs = strip_grease(ciphers), strip_grease(extensions)
    two = lambda a: F.lpad(F.least(F.size(a), F.lit(99)).cast("string"), 2, "0")
    head = F.concat(F.lit(transport), lookup(VERSION_TAGS, best_version(legacy, offered), "00"), F.when(F.coalesce(sni, F.lit("")) != "", "d").otherwise("i"), two(cs), two(xs), alpn_tag(alpn))
    names = F.array_join(F.array_sort(F.transform(cs, _hex4)), ",")
    kept = F.array_join(F.array_sort(F.transform(F.filter(xs, lambda v: ~v.isin(0, 16)), _hex4)), ",")
    algs = F.array_join(F.transform(strip_grease(sigalgs), _hex4), ",")
    return F.concat_ws("_", head, _hash12(names), _hash12(F.when(algs == "", kept).otherwise(F.concat_ws("_", kept, algs))))


def ja4s(version: Column, cipher: Column, extensions: Column, alpn: Column, transport: str = "t") -> Column:
    xs = strip_grease(extensions)
    head = F.concat(F.lit(transport), lookup(VERSION_TAGS, version, "00"), F.lpad(F.least(F.size(xs), F.lit(99)).cast("string"), 2, "0"), alpn_tag(F.array(alpn)))
    return F.concat_ws("_", head, _hex4(F.coalesce(cipher, F.lit(0))), _hash12(F.array_join(F.transform(xs, _hex4), ",")))


def fingerprint_document(a: Column, b: Column, c: Column, d: Column) -> Column:
    tag = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}_"), x))
    text = F.concat_ws(" ", tag("ja3", a), tag("ja3s", b), tag("ja4", c), tag("ja4s", d))
    return F.when(text == "", "no_fingerprint").otherwise(text)


def extension_bitmap(extensions: Column, tracked: list[int]) -> Column:
    """Bit i is set where the i-th tracked extension is present."""
    return sum((F.when(F.array_contains(extensions, t), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tracked)), F.lit(0))


def order_hash(extensions: Column) -> Column:
    """crc32 of the extensions as big-endian pairs of bytes, scaled to [0, 1]."""
    return F.crc32(F.unhex(F.array_join(F.transform(extensions, _hex4), ""))) / F.lit(float(MOD32))


def hash16(text: Column) -> Column:
    return F.crc32(F.encode(text, "UTF-8")).bitwiseAND(F.lit(0xFFFF))


# -- strengths in bits


def factoring_strength(bits: Column) -> Column:
    """Security of RSA and finite-field keys: named sizes, else the number field sieve's estimate, snapped down to a tier."""
    n = bits.cast("double") * F.lit(0.6931471805599453)
    sieve = (F.lit(1.923) * F.pow(n, F.lit(1 / 3)) * F.pow(F.log(n), F.lit(2 / 3)) - F.lit(4.69)) / F.lit(0.6931471805599453)
    snapped = F.coalesce(*[F.when(sieve >= s, s) for s in (256, 192, 128, 112, 80)], F.greatest(F.lit(0), F.floor(sieve)))
    named = F.when(bits <= 512, 56).when(bits < 1024, 64).when(bits >= 15360, 256)
    for size, strength in ((1024, 80), (2048, 112), (3072, 128), (4096, 128), (7680, 192)):
        named = named.when(bits == size, strength)
    return F.when(bits.isNull() | (bits <= 0), 0).otherwise(F.coalesce(named, snapped)).cast("int")


def curve_strength(bits: Column) -> Column:
    tiers = F.coalesce(*[F.when(bits >= b, s) for b, s in ((512, 256), (384, 192), (256, 128), (224, 112), (160, 80))], F.floor(bits / 2))
    return F.when(bits.isNull() | (bits <= 0), 0).otherwise(tiers).cast("int")


def hash_strength(name: Column) -> Column:
    """Collision resistance; the first match counts, unknown names count 80."""
    n = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[-_]", "")
    rules = (("MD[245]", 0), ("SHA1", 80), ("SHA224|512224", 112), ("SHA256|512256|SHA3256", 128), ("SHA384|SHA3384", 192), ("SHA512|SHA3512", 256))
    return F.coalesce(*[F.when(n.rlike(r), s) for r, s in rules], F.lit(80)).cast("int")


def strength_tier(bits: Column) -> Column:
    return F.when(bits >= 112, "approved").when(bits >= 80, "legacy").otherwise("prohibited")


def band(score: Column) -> Column:
    return F.coalesce(*[F.when(score <= top, name) for top, name in ((19, "SECURE"), (39, "ACCEPTABLE"), (59, "WEAK"), (79, "HIGH_RISK"))], F.lit("CRITICAL"))


# -- text


def char_entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits; empty and null: 0."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def nonempty(*names: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in names])


def evidence(data: Column, n: int = 64) -> Column:
    """Hex and printable text of the first n bytes."""
    head = F.substring(data, 1, n)
    return F.concat_ws(" | ", F.lower(F.hex(head)), F.regexp_replace(F.decode(head, "ISO-8859-1"), "[^ -~]", "."))


def is_ipv4(text: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return F.regexp_replace(text, r"^\[|\]$", "").rlike(rf"^{octet}(\.{octet}){{3}}$")


def ipv4_text(data: Column) -> Column:
    return F.concat_ws(".", *[F.conv(F.hex(F.substring(data, i, 1)), 16, 10) for i in range(1, 5)])


def domain(text: Column) -> Column:
    """Lower case, trimmed, without final dots."""
    return F.regexp_replace(F.lower(F.trim(text)), r"\.+$", "")


def wildcard_match(pattern: Column, host: Column) -> Column:
    """Whole leftmost label only, three labels or more, equal label counts; otherwise equality."""
    p, h = F.split(domain(pattern), r"\."), F.split(domain(host), r"\.")
    tail = lambda x: F.array_join(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(1))), ".")
    wild = (F.get(p, F.lit(0)) == "*") & (F.size(p) >= 3) & (F.size(p) == F.size(h)) & (tail(p) == tail(h)) & (F.get(h, F.lit(0)) != "")
    plain = ~domain(pattern).contains("*") & (domain(pattern) == domain(host))
    return F.coalesce(~is_ipv4(host) & (plain | wild), F.lit(False))


def common_name(subject: Column) -> Column:
    return F.nullif(F.regexp_extract(subject, r"CN=([^,]+)", 1), F.lit(""))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
CREDENTIAL = r"(?i)\b(AUTH PLAIN|AUTH LOGIN|PASS|USER)[ \t]+[^\s]+"


def redact_emails(text: Column, salt: str) -> Column:
    """Local parts become salted hashes, domains stay. Longer addresses go first, so none is rewritten inside another."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    hashed = lambda e: F.concat(F.substring(F.sha2(F.concat(F.lit(salt), F.lower(e)), 256), 1, 16), F.lit("@"), F.substring_index(e, "@", -1))
    return F.aggregate(found, text, lambda t, e: F.replace(t, e, hashed(e)))


def redact(text: Column, salt: str) -> Column:
    return F.regexp_replace(redact_emails(text, salt), CREDENTIAL, "$1 [REDACTED]")


def secret_hash(secret: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.encode(F.lit(salt), "UTF-8"), secret.cast("binary")), 256)
