"""Risk scoring: 51 rules as data, their conditions as Column expressions, one projection per session.

Input columns are those of a session's cryptographic parameters, with the joined cipher and the leaf certificate as
structs; null structs are unknown. No UDF, no shuffle: the score is a function of the row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import with_suites
from ..functions.scalars import band, curve_strength, factoring_strength, hash_strength, strip_grease


class Rule(NamedTuple):
    rule_id: str
    component: str
    penalty: int
    veto: bool = False


P, C, K, X, H, G = "protocol_version", "cipher_hash", "key_exchange", "certificate", "session_hygiene", "strength_gate"
#: Penalties, and which are floors of the score.
RULES = (
    Rule("PROTO-NO-TLS-AUTH", P, 100, True), Rule("PROTO-NO-TLS-PLAIN", P, 100), Rule("PROTO-SSL2", P, 100, True), Rule("PROTO-SSL3", P, 100, True),
    Rule("PROTO-TLS10", P, 80), Rule("PROTO-TLS11", P, 60), Rule("PROTO-TLS12-LEGACY", P, 10), Rule("PROTO-UNKNOWN", P, 70),
    Rule("CIPHER-NULL", C, 100, True), Rule("CIPHER-EXPORT", C, 100, True), Rule("CIPHER-ANON", C, 100, True), Rule("CIPHER-RC4", C, 95), Rule("CIPHER-DES", C, 95),
    Rule("CIPHER-3DES", C, 70), Rule("CIPHER-CBC-LEGACY", C, 25), Rule("HASH-MD5", C, 90), Rule("HASH-SHA1-MAC", C, 60), Rule("HASH-SHA1-CERT", C, 85), Rule("CIPHER-CBC-NO-ETM", C, 30),
    Rule("KEX-STATIC-RSA", K, 75), Rule("KEX-STATIC-DH", K, 75), Rule("KEX-DHE-LOGJAM", K, 100, True), Rule("KEX-DHE-WEAK", K, 55), Rule("KEX-DHE-2048", K, 5),
    Rule("KEX-ECDHE-WEAK-CURVE", K, 70), Rule("KEX-ECDHE-UNKNOWN-CURVE", K, 35),
    Rule("CERT-COMPROMISED-KEY", X, 100, True), Rule("CERT-EXPIRED", X, 70), Rule("CERT-NOT-YET-VALID", X, 70), Rule("CERT-SELF-SIGNED", X, 65), Rule("CERT-UNTRUSTED-CHAIN", X, 75),
    Rule("CERT-HOSTNAME-MISMATCH", X, 80), Rule("CERT-RSA-512", X, 100, True), Rule("CERT-RSA-1024", X, 85), Rule("CERT-ECDSA-WEAK", X, 90), Rule("CERT-SIG-MD5", X, 100, True),
    Rule("CERT-SIG-SHA1", X, 85), Rule("CERT-REVOKED", X, 100, True), Rule("CERT-REVOCATION-UNKNOWN", X, 10), Rule("CERT-LIFETIME-825", X, 35), Rule("CERT-LIFETIME-398", X, 20),
    Rule("CERT-CA-NO-BC", X, 50), Rule("CERT-NO-SAN", X, 25), Rule("CERT-NO-SCT", X, 8),
    Rule("HYGIENE-INSECURE-RENEG", H, 60), Rule("HYGIENE-NO-EMS", H, 25), Rule("HYGIENE-COMPRESSION-CRIME", H, 80), Rule("HYGIENE-LONG-TICKET", H, 20),
    Rule("HYGIENE-0RTT-SUBMISSION", H, 30), Rule("HYGIENE-INCOMPLETE-HANDSHAKE", H, 15), Rule("NIST-MIN-STRENGTH", G, 90, True),
)
#: Component weights; without an observable certificate the others share its fifth.
WEIGHTS = {P: "0.25", C: "0.25", K: "0.20", X: "0.20", H: "0.10"}
NO_CERT_WEIGHTS = {P: "0.3125", C: "0.3125", K: "0.25", X: "0", H: "0.125"}
GOOD_CURVES = ("x25519", "x448", "secp256r1", "secp384r1", "secp521r1", "prime256v1", "p-256", "p-384", "p-521")

CIPHER = "struct<name:string,enc:string,enc_bits:int,mac:string,hash:string,kex:string,aead:boolean,anon:boolean,export:boolean,null_enc:boolean,pfs:boolean>"
CERT = (
    "struct<public_key_algorithm:string,public_key_bits:int,signature_hash:string,lifetime_days:int,is_self_signed:boolean,is_ca:boolean,path_length_known:boolean,"
    "san_count:int,sct_count:int>"
)
CHAIN = "struct<is_valid:boolean,anchor_source:string,ocsp_status:string,crl_status:string,errors:array<string>>"
PARAMS = (
    "id long, protocol_version string, dst_port int, has_auth boolean, cleartext_credentials_observed boolean, handshake_completed boolean, cert_analysis_possible boolean, "
    "encrypt_then_mac boolean, extended_master_secret boolean, secure_renegotiation boolean, compression_method int, ticket_lifetime_seconds int, zero_rtt_used boolean, "
    f"kex_algorithm string, named_group string, dh_key_bits int, ec_bits int, cipher {CIPHER}, cert {CERT}, chain {CHAIN}, host_status string, known_compromised_spki boolean"
)


#: Named groups and the bits of their curves, by registered number.
GROUPS = {19: ("secp192r1", 192), 21: ("secp224r1", 224), 23: ("secp256r1", 256), 24: ("secp384r1", 384), 25: ("secp521r1", 521), 29: ("x25519", 256), 30: ("x448", 448)}


def parameters(decoded: DataFrame, suites: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Decoded sessions with the columns of PARAMS beside their own, ready for score(): from captures to scores.

    suites: (id, name). A leaf `cert` (certificates.with_leaf) and a `host_status` are used where decoded has them;
    chains: (fingerprint_sha256, chain) of validated chains, joined by the leaf; without it a `chain` that decoded has
    (chains.validated, revocation.with_revocation) is used, each session's own. The group is the server's key
    share or named curve, else the client's first that is not reserved, the key exchange the chosen suite's. What is not observed is null and matches no rule of its own.
    id is a hash of the flow and its start.
    """
    has = set(decoded.columns)
    out = with_suites(decoded, suites)
    server = F.col("tls.server_hello")
    cipher = F.when(server.isNotNull(), F.try_element_at("__suites", F.col("tls.server_hello.selected_cipher")))
    offered = F.get(strip_grease(F.coalesce("tls.client_hello.supported_groups", F.array().cast("array<int>"))), F.lit(0))
    group = F.coalesce("tls.server_hello.key_share_group", "tls.curve", offered)
    groups = F.create_map(*[x for k, (name, bits) in GROUPS.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(bits).alias("bits")))])
    named = F.when(group.isNotNull(), F.try_element_at(groups, group))
    null = lambda kind: F.lit(None).cast(kind)
    out = out.withColumn("cipher", cipher).withColumn("__leaf", F.col("cert.fingerprint_sha256") if "cert" in has else null("string")).withColumns({
        "id": F.xxhash64("capture_id", "client_ip", "client_port", "server_ip", "server_port", "first_seen"), "dst_port": F.col("server_port"), "has_auth": F.size("fsm.auth_mechanisms_used") > 0,
        "cleartext_credentials_observed": F.col("fsm.credentials_in_cleartext"), "handshake_completed": F.col("tls.handshake_completed"), "cert_analysis_possible": F.col("tls.certificates_observable"), "compression_method": F.col("tls.server_hello.selected_compression").cast("int"),
        "ticket_lifetime_seconds": F.when(F.col("tls.ticket_lifetime").isNotNull(), F.least("tls.ticket_lifetime", F.lit(2**31 - 1))).cast("int"), "zero_rtt_used": F.array_contains("tls.client_hello.ext_order", 42), "kex_algorithm": F.col("cipher.kex"), "named_group": F.when(F.col("cipher.kex") == "ECDHE", F.coalesce(named["name"], F.lit("unknown"))), "dh_key_bits": F.col("tls.dh_key_bits"),
        "ec_bits": F.when(F.col("cipher.kex") == "ECDHE", named["bits"]), "cert": F.struct(*[F.col(f"cert.{x.split(':')[0]}").alias(x.split(":")[0]) for x in CERT[7:-1].split(",")]) if "cert" in has else null(CERT),
        "host_status": F.col("host_status") if "host_status" in has else null("string"), "known_compromised_spki": F.col("known_compromised_spki") if "known_compromised_spki" in has else F.lit(False),
    })
    if "cert" in has:
        out = out.withColumn("cert", F.when(F.col("cert.public_key_algorithm").isNotNull(), F.col("cert")))
    if chains is None:
        names = [x.split(":")[0] for x in CHAIN[7:-1].split(",")]
        told = {f.name for f in decoded.schema["chain"].dataType.fields} if "chain" in has else set()
        own = F.struct(*[(F.col(f"chain.{n}") if n in told else F.lit("UNKNOWN")).alias(n) for n in names]).cast(CHAIN)
        return out.withColumn("chain", own if told else null(CHAIN)).drop("__suites", "__leaf")
    known = chains.select(F.col("fingerprint_sha256").alias("__leaf"), "chain").dropDuplicates(["__leaf"])
    return out.join(known, "__leaf", "left").drop("__suites", "__leaf")


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def conditions(compat: bool = False) -> dict[str, Column]:
    """When each rule applies. compat: as the model was first specified, where null key sizes count as 1024 and 256 bits,
    any SHA-2 MAC counts as SHA-1, and "EC" keys are no ECDSA keys; otherwise unknown sizes match no size rule."""
    col = F.col
    text = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    proto, kex, group = text(col("protocol_version")), text(col("kex_algorithm")), F.lower(F.trim(F.coalesce("named_group", F.lit(""))))
    has = lambda *names: yes(F.lit(False) if not names else _any([proto.contains(n) for n in names]))
    plain = proto.isin("NONE", "PLAINTEXT", "")
    auth = yes(col("has_auth")) | yes(col("cleartext_credentials_observed"))
    ssl2, ssl3, t10, t11, t12, t13 = (has(*n) for n in (("SSL 2", "SSLV2"), ("SSL 3", "SSLV3"), ("TLS 1.0", "TLSV1.0"), ("TLS 1.1", "TLSV1.1"), ("TLS 1.2", "TLSV1.2"), ("TLS 1.3", "TLSV1.3")))
    out: dict[str, Column] = {}
    before = plain
    out["PROTO-NO-TLS-AUTH"], out["PROTO-NO-TLS-PLAIN"] = plain & auth, plain & ~auth
    weak12 = col("cipher").isNotNull() & (~yes(col("cipher.aead")) | ~yes(col("cipher.pfs")))
    for rule, is_it, extra in (("PROTO-SSL2", ssl2, None), ("PROTO-SSL3", ssl3, None), ("PROTO-TLS10", t10, None), ("PROTO-TLS11", t11, None), ("PROTO-TLS12-LEGACY", t12, weak12), (None, t13, None)):
        if rule:
            out[rule] = ~before & is_it & (F.lit(True) if extra is None else extra)
        before = before | is_it
    out["PROTO-UNKNOWN"] = ~before

    known = col("cipher").isNotNull()
    name, enc, mac, hsh, ckex = (text(col(f"cipher.{f}")) for f in ("name", "enc", "mac", "hash", "kex"))
    three = enc.contains("3DES") | enc.contains("EDE")
    out["CIPHER-NULL"] = known & (yes(col("cipher.null_enc")) | enc.contains("NULL") | name.contains("NULL"))
    out["CIPHER-EXPORT"] = known & (yes(col("cipher.export")) | name.contains("EXP"))
    out["CIPHER-ANON"] = known & (yes(col("cipher.anon")) | name.contains("ANON") | ckex.contains("ANON"))
    out["CIPHER-RC4"] = known & (enc.contains("RC4") | name.contains("RC4"))
    out["CIPHER-DES"] = known & enc.contains("DES") & ~three & ~enc.contains("TRIPLE")
    out["CIPHER-3DES"] = known & (three | name.contains("3DES"))
    out["CIPHER-CBC-LEGACY"] = known & (name.contains("IDEA") | name.contains("SEED") | name.contains("CAMELLIA"))
    out["HASH-MD5"] = known & (mac.contains("MD5") | hsh.contains("MD5"))
    sha1 = (mac.contains("SHA") | hsh.contains("SHA1")) if compat else (mac.rlike("SHA-?1?$") | hsh.rlike("^SHA-?1?$"))
    out["HASH-SHA1-MAC"] = known & ~yes(col("cipher.aead")) & sha1
    out["HASH-SHA1-CERT"] = F.lit(False)  # covered by CERT-SIG-SHA1
    out["CIPHER-CBC-NO-ETM"] = known & enc.contains("CBC") & ~yes(col("cipher.aead")) & ~yes(col("encrypt_then_mac"))

    dh, ec = (F.coalesce("dh_key_bits", F.lit(1024)), F.coalesce("ec_bits", F.lit(256))) if compat else (col("dh_key_bits"), col("ec_bits"))
    out["KEX-STATIC-RSA"], out["KEX-STATIC-DH"] = kex == "RSA", kex.isin("DH", "STATIC_DH")
    out["KEX-DHE-LOGJAM"] = (kex == "DHE") & yes(dh < 1024)
    out["KEX-DHE-WEAK"] = (kex == "DHE") & yes((dh >= 1024) & (dh < 2048))
    out["KEX-DHE-2048"] = (kex == "DHE") & yes(dh >= 2048)
    weak_curve = group.isin("secp192r1", "secp224r1") | yes(ec < 256)
    out["KEX-ECDHE-WEAK-CURVE"] = (kex == "ECDHE") & weak_curve
    out["KEX-ECDHE-UNKNOWN-CURVE"] = (kex == "ECDHE") & ~weak_curve & ~(group.isin(*GOOD_CURVES) | yes(ec >= 256)) & group.isin("unknown", "unrecognized", "")

    seen = yes(col("cert_analysis_possible")) & col("cert").isNotNull()
    err = lambda *codes: yes(F.exists("chain.errors", lambda e: e.isin(*codes)))
    alg, bits, sig = text(col("cert.public_key_algorithm")), col("cert.public_key_bits"), F.regexp_replace(text(col("cert.signature_hash")), "-", "")
    ecdsa = alg == "ECDSA" if compat else alg.isin("ECDSA", "EC")
    own = yes(col("cert.is_self_signed")) | yes(col("chain.anchor_source") == "self_signed")
    revoked = yes(col("chain.ocsp_status") == "REVOKED") | yes(col("chain.crl_status") == "REVOKED") | err("CERT_REVOKED", "OCSP_REVOKED", "CRL_REVOKED")
    out["CERT-COMPROMISED-KEY"] = seen & yes(col("known_compromised_spki"))
    out["CERT-EXPIRED"] = seen & err("CERT_EXPIRED")
    out["CERT-NOT-YET-VALID"] = seen & ~err("CERT_EXPIRED") & err("CERT_NOT_YET_VALID")
    out["CERT-SELF-SIGNED"] = seen & own
    out["CERT-UNTRUSTED-CHAIN"] = seen & ~own & yes(~col("chain.is_valid")) & err("UNTRUSTED_ROOT")
    out["CERT-HOSTNAME-MISMATCH"] = seen & yes(col("host_status") == "MISMATCH")
    out["CERT-RSA-512"] = seen & (alg == "RSA") & yes(bits < 1024)
    out["CERT-RSA-1024"] = seen & (alg == "RSA") & yes((bits >= 1024) & (bits < 2048))
    out["CERT-ECDSA-WEAK"] = seen & ecdsa & yes(bits < 224)
    out["CERT-SIG-MD5"] = seen & sig.contains("MD5")
    out["CERT-SIG-SHA1"] = seen & ~sig.contains("MD5") & (sig.contains("SHA1") | err("WEAK_HASH_ALGO"))
    out["CERT-REVOKED"] = seen & revoked
    out["CERT-REVOCATION-UNKNOWN"] = seen & ~revoked & yes((col("chain.ocsp_status") == "UNKNOWN") & (col("chain.crl_status") == "UNKNOWN") & col("chain.is_valid"))
    out["CERT-LIFETIME-825"] = seen & yes(col("cert.lifetime_days") > 825)
    out["CERT-LIFETIME-398"] = seen & yes((col("cert.lifetime_days") > 398) & (col("cert.lifetime_days") <= 825))
    out["CERT-CA-NO-BC"] = seen & yes(col("cert.is_ca")) & ~yes(col("cert.path_length_known")) & err("INVALID_CA_CERT")
    out["CERT-NO-SAN"] = seen & (F.coalesce("cert.san_count", F.lit(0)) == 0)
    out["CERT-NO-SCT"] = seen & yes(col("cert.sct_count") == 0)

    out["HYGIENE-INSECURE-RENEG"] = ~yes(col("secure_renegotiation")) & ~has("TLS 1.3") & ~plain
    out["HYGIENE-NO-EMS"] = ~yes(col("extended_master_secret")) & t12
    out["HYGIENE-COMPRESSION-CRIME"] = F.coalesce("compression_method", F.lit(0)) != 0
    out["HYGIENE-LONG-TICKET"] = yes(col("ticket_lifetime_seconds") > 604800)
    out["HYGIENE-0RTT-SUBMISSION"] = yes(col("zero_rtt_used")) & col("dst_port").isin(465, 587)
    out["HYGIENE-INCOMPLETE-HANDSHAKE"] = ~yes(col("handshake_completed")) & ~plain

    sym = F.when(known, F.coalesce("cipher.enc_bits", F.lit(0))).when(plain, 0).otherwise(128)
    dh_strength = factoring_strength(dh) if compat else F.when(dh.isNotNull(), factoring_strength(dh)).otherwise(128)
    ec_strength = curve_strength(ec) if compat else F.when(ec.isNotNull(), curve_strength(ec)).otherwise(128)
    kex_bits = (
        F.when(kex == "RSA", F.when(alg == "RSA", factoring_strength(bits)).otherwise(80)).when(kex == "DHE", dh_strength).when(kex == "ECDHE", ec_strength).when(plain, 0).otherwise(128)
    )
    auth_bits = F.when(known & yes(col("cipher.anon")), 0).when(col("cert").isNotNull(), F.when(alg == "RSA", factoring_strength(bits)).when(ecdsa, curve_strength(bits)).otherwise(112)).when(plain, 0).otherwise(128)
    hash_bits = hash_strength(F.when(known, F.coalesce("cipher.hash", F.lit(""))).otherwise("SHA256"))
    out["NIST-MIN-STRENGTH"] = ~plain & (F.least(sym, kex_bits, auth_bits, hash_bits) < 112)
    return out


def _any(cs: list[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def total(components: dict[str, Column], weights_known: Column, omega: Column, floor: Column) -> Column:
    """min(100, max(floor, omega * sum of weight * component)), in exact decimals, halves to even."""
    w = lambda k: F.when(weights_known, F.lit(WEIGHTS[k]).cast("decimal(5,4)")).otherwise(F.lit(NO_CERT_WEIGHTS[k]).cast("decimal(5,4)"))
    parts = [w(k) * c.cast("decimal(3,0)") for k, c in components.items()]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw + p
    rounded = F.bround(omega.cast("decimal(3,2)") * raw.cast("decimal(12,6)"), 0).cast("int")
    return F.least(F.lit(100), F.greatest(F.coalesce(floor, F.lit(0)), rounded))


def omega(credentials: Column, port: Column) -> Column:
    return F.when(yes(credentials), F.lit("1.25")).when(port.isin(465, 587), F.lit("1.15")).otherwise(F.lit("1.00")).cast("decimal(3,2)")


def score(params: DataFrame, compat: bool = False) -> DataFrame:
    """params with risk_score, band, context_multiplier, components (map), provenance and vetoes (sorted arrays), weight_redistributed."""
    applies = conditions(compat)
    hits = F.array_compact(F.array(*[F.when(applies[r.rule_id], F.struct(F.lit(r.component).alias("component"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.penalty).alias("penalty"), F.lit(r.veto).alias("veto"))) for r in RULES]))
    out = params.withColumn("__hits", hits)
    part = lambda k: F.least(F.lit(100), F.aggregate(F.filter("__hits", lambda h: h["component"] == k), F.lit(0), lambda a, h: a + h["penalty"]))
    out = out.withColumn("components", F.create_map(*[x for k in WEIGHTS for x in (F.lit(k), part(k))]))
    out = out.withColumn("vetoes", F.array_sort(F.transform(F.filter("__hits", lambda h: h["veto"]), lambda h: F.struct(h["rule_id"].alias("rule_id"), h["penalty"].alias("floor")))))
    seen = yes(F.col("cert_analysis_possible")) & F.col("cert").isNotNull()
    factor = omega(F.col("cleartext_credentials_observed"), F.col("dst_port"))
    result = total({k: F.col("components")[k] for k in WEIGHTS}, seen, factor, F.array_max(F.transform("vetoes", lambda v: v["floor"])))
    out = out.withColumn("context_multiplier", factor).withColumn("weight_redistributed", ~seen).withColumn("risk_score", result).withColumn("band", band(result))
    provenance = F.array_sort(F.transform("__hits", lambda h: F.struct(h["component"].alias("component"), h["rule_id"].alias("rule_id"), h["penalty"].alias("penalty"))))
    return out.withColumn("provenance", provenance).drop("__hits")
