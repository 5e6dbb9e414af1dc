"""Per-session detectors over decoded sessions: D1 to D9 and hostname checks, as Column expressions and joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.names import canonical_address, canonical_hosts, canonical_name
from .decode import SENTINELS, quic_on_mail_port

EXPLICIT_PORTS = (25, 587, 2525, 110, 143)


def offers_upgrade(caps: Column) -> Column:
    return F.coalesce(F.exists(caps, lambda c: F.upper(c).contains("STARTTLS") | F.upper(c).contains("STLS")), F.lit(False))


def upgrade_endpoints(decoded: DataFrame) -> DataFrame:
    """Endpoints that offered the upgrade at least once in this corpus."""
    return decoded.where(offers_upgrade(F.col("fsm.advertised_capabilities"))).select("server_ip", "server_port").distinct()


def found(rule: str, severity: str, when: Column, evidence: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.coalesce(evidence.cast("string"), F.lit("")).alias("evidence")))


def credential_line(payload: Column, salt: str) -> Column:
    """The first line that gives credentials away: its command and a salted hash of the secret."""
    lines = F.split(F.decode(F.coalesce(payload, F.lit(b"")), "ISO-8859-1"), r"\r?\n")
    rules = {r"(?i)^\s*AUTH\s+(?:PLAIN|LOGIN)\s+(\S+)": "SASL", r"(?i)^\s*PASS\s+(\S+)": "POP3_PASS", r"(?i)^\s*USER\s+(\S+)": "POP3_USER", r"(?i)^\s*\S+\s+LOGIN\s+\S+\s+(\S+)": "IMAP_LOGIN"}
    first = F.get(F.filter(lines, lambda x: x.rlike("|".join(f"(?:{r})" for r in rules))), F.lit(0))
    parts = [F.when(first.rlike(r), F.concat(F.lit(f"{name} "), F.substring(S.secret_hash(F.regexp_extract(first, r, 1), salt), 1, 16))) for r, name in rules.items()]
    return F.coalesce(*parts)


def detect(decoded: DataFrame, known: DataFrame | None = None, baselines: DataFrame | None = None, policies: DataFrame | None = None, salt: str = "", distance: int = 8) -> DataFrame:
    """decoded with detections: array of (rule_id, severity, evidence) in the order D1 to D9.

    known: endpoints (server_ip, server_port); by default those of this corpus. baselines: (server_ip, server_port,
    baseline). policies: (domain, mode). Dimensions are joined left; the planner broadcasts what is small.
    """
    known = upgrade_endpoints(decoded) if known is None else known
    out = decoded.join(known.withColumn("__known", F.lit(True)), ["server_ip", "server_port"], "left")
    out = out.join(baselines, ["server_ip", "server_port"], "left") if baselines is not None else out.withColumn("baseline", F.lit(None).cast("string"))
    if policies is not None:
        p = policies.select(S.domain(F.col("domain")).alias("__domain"), F.lower("mode").alias("__mode")).dropDuplicates(["__domain"])
        out = out.join(p, S.domain(F.col("fsm.ehlo_domain")) == F.col("__domain"), "left").drop("__domain")
    else:
        out = out.withColumn("__mode", F.lit(None).cast("string"))
    steps, state, banner = F.col("fsm.transitions"), F.col("fsm.state"), F.col("fsm.server_banner")
    asked = F.get(F.filter(steps, lambda t: t["to_state"] == "S2_CMD"), F.lit(0))
    answered = F.exists(steps, lambda t: t["to_state"].isin("S2_ACCEPTED", "S_REFUSED", "S3_TLS_HS") & (t["ts"] > asked["ts"]))
    step = lambda s: F.get(F.filter(steps, lambda t: t["to_state"] == s), F.lit(0))["evidence"]
    random, versions = F.col("tls.server_hello.random"), F.col("tls.client_hello.supported_versions")
    sentinel = F.substring(random, 25, 8).isin(*[F.lit(s) for s in SENTINELS])
    lower = F.array_contains(versions, 0x0304) & (F.col("tls.server_hello.selected_version") <= 0x0302)
    secret = credential_line(F.col("c2s_payload"), salt)
    apart = F.levenshtein("baseline", banner)
    rules = F.array(
        found("D1_CAPABILITY_STRIP", "CRITICAL", F.col("server_port").isin(*EXPLICIT_PORTS) & banner.isNotNull() & ~offers_upgrade(F.col("fsm.advertised_capabilities")) & F.col("__known"), F.array_join("fsm.advertised_capabilities", "|")),
        found("D2_SILENT_FAILURE", "CRITICAL", asked.isNotNull() & ~answered, asked["evidence"]),
        found("D3_EXPLICIT_REFUSAL", "HIGH", F.exists(steps, lambda t: t["to_state"] == "S_REFUSED"), step("S_REFUSED")),
        found("D4_POST220_PLAINTEXT", "CRITICAL", state == "S_STRIP_DETECTED", step("S_STRIP_DETECTED")),
        found("D5_CLEARTEXT_CREDENTIALS", "CRITICAL", secret.isNotNull(), secret),
        found("D6_TLS_DOWNGRADE", "CRITICAL", sentinel | lower, F.lower(F.hex(F.substring(random, 25, 8)))),
        found("D7_HANDSHAKE_BLACKHOLE", "HIGH", (state == "S3_TLS_HS") & F.col("tls.server_hello").isNull() & (F.length("c2s_payload") > 0) & (F.length("s2c_payload") == 0), F.length("c2s_payload")),
        found("D8_BANNER_MUTATION", "MEDIUM", apart > distance, F.concat_ws(" -> ", "baseline", banner)),
        found("D9_MTA_STS_VIOLATION", "CRITICAL", (state != "S4_ENCRYPTED") & (state != "S3_TLS_HS") & (F.col("__mode") == "enforce"), F.col("fsm.ehlo_domain")),
    )
    return out.withColumn("detections", F.array_compact(rules)).drop("__known", "__mode", "baseline")


def quic_findings(datagrams: DataFrame) -> DataFrame:
    """One finding a capture, server and mail port that long-header QUIC packets went to, of flow.udp_payloads(): these sessions are out of reach.

    (capture_id, server_ip, server_port, finding, packets, first_seen); evidence shows the first packet's first byte.
    Null and empty payloads are no QUIC.
    """
    seen = datagrams.where(F.coalesce(quic_on_mail_port(F.col("dport"), F.col("payload")), F.lit(False)))
    g = seen.groupBy("capture_id", F.col("dst").alias("server_ip"), F.col("dport").alias("server_port")).agg(F.count("*").alias("packets"), F.min("ts").alias("first_seen"), F.min_by(F.hex(F.substring("payload", 1, 1)), F.struct("ts", "index")).alias("b"))
    finding = F.struct(F.lit("UNSUPPORTED_TRANSPORT_QUIC").alias("rule_id"), F.lit("INFO").alias("severity"), F.lit("QUIC on a mail port: only TCP is read").alias("description"), F.concat(F.lit("port "), F.col("server_port").cast("string"), F.lit(", first byte 0x"), F.lower("b")).alias("evidence"))
    return g.select("capture_id", "server_ip", "server_port", finding.alias("finding"), "packets", "first_seen")


def hostname(sans: Column, ip_sans: Column, subject: Column, sni: Column, alpn_host: Column, ehlo: Column, reverse: Column) -> Column:
    """struct(status, method, reference, matched, cn_only): the first reference that is there is checked, and only that."""
    refs = {"sni": sni, "alpn": alpn_host, "ehlo": ehlo, "reverse_dns": reverse}
    ref = S.nonempty(*[F.trim(c) for c in refs.values()])
    method = F.coalesce(*[F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), name) for name, c in refs.items()], F.lit("none"))
    is_ip = S.is_ipv4(ref) | ref.contains(":")
    matched = F.when(is_ip, F.get(F.filter(ip_sans, lambda x: F.trim(x) == ref), F.lit(0))).otherwise(F.get(F.filter(sans, lambda x: S.wildcard_match(x, ref)), F.lit(0)))
    cn = S.common_name(subject)
    cn_only = F.coalesce(ref.isNotNull() & ~is_ip & matched.isNull() & S.wildcard_match(F.trim(cn), ref), F.lit(False))
    status = F.when(ref.isNull(), "INDETERMINATE").when(matched.isNotNull() | cn_only, "MATCH").otherwise("MISMATCH")
    return F.struct(status.alias("status"), method.alias("method"), ref.alias("reference"), matched.alias("matched"), cn_only.alias("cn_only"))


def canonical_references(df: DataFrame, names: list[str], lists: list[str]) -> DataFrame:
    """df with host names and addresses of these columns, and of these arrays of them, in canonical form, for hostname().

    Coded, mapped and differently written names then compare equal. Nulls stay, as does what is neither name nor address.
    """
    tell = lambda v: canonical_address(v) or canonical_name(v) or v

    @F.pandas_udf("string")
    def lines(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None else "\n".join(map(tell, t.split("\n"))))

    out = df.withColumns({n: canonical_hosts(F.col(n)) for n in names})
    for n in lists:  # one text a list: separators that no name holds
        joined = F.array_join(n, "\n", "")
        out = out.withColumn(n, F.when(F.col(n).isNull() | (F.size(n) == 0), F.col(n)).otherwise(F.split(lines(joined), "\n")))
    return out


def dane_data(selector: Column, matching: Column, cert: Column, spki: Column) -> Column:
    """What a matching TLSA record holds, in hex: selector 0 is the certificate, 1 its key; matching 0 whole, 1 SHA-256, 2 SHA-512; null for others."""
    source = F.when(selector == 0, cert).when(selector == 1, spki)
    return F.when(matching == 0, F.lower(F.hex(source))).when(matching == 1, F.sha2(source, 256)).when(matching == 2, F.sha2(source, 512))


def dane_match(usage_selector: Column, matching: Column, data: Column, cert: Column, spki: Column) -> Column:
    """Whether a TLSA record is of this certificate or key, see dane_data(). data in hex."""
    return F.coalesce(dane_data(usage_selector, matching, cert, spki) == F.lower(data), F.lit(False))


def dane(sessions: DataFrame, records: DataFrame, host: str, port: str, cert: str, spki: str, transport: str = "tcp") -> DataFrame:
    """sessions with dane: struct(n_records, n_matching) of the TLSA records for their host, port and transport.

    records: (domain, port, protocol, selector, matching, data). They are counted before the join, all of a name and equal
    ones of a name, and what a session's certificate and key come to is looked up among the latter by an equi-join: each
    session stays one row, and none is held against a name's records one by one. Without records both counts are 0. Names
    compare trimmed and in any case.
    """
    clean = lambda c: F.lower(F.trim(F.col(c)))
    r = records.where(F.lower("protocol") == transport).select(clean("domain").alias("__host"), F.col("port").alias("__port"), "selector", "matching", F.lower("data").alias("__data"))
    there = (clean(host) == F.col("__host")) & (F.col(port) == F.col("__port"))
    out = sessions.join(r.groupBy("__host", "__port").agg(F.count("*").alias("__all")), there, "left").drop("__host", "__port")
    kinds = sorted(r.where(F.col("selector").isin(0, 1) & F.col("matching").isin(0, 1, 2)).select("selector", "matching").distinct().collect())  # six at most
    good = []
    for selector, matching in kinds:
        n = f"__{selector}_{matching}"
        alike = r.where((F.col("selector") == selector) & (F.col("matching") == matching)).groupBy("__host", "__port", "__data").agg(F.count("*").alias(n))
        have = dane_data(F.lit(selector), F.lit(matching), F.col(cert), F.col(spki))
        out = out.join(alike, there & (have == F.col("__data")), "left").drop("__host", "__port", "__data")
        good.append(n)
    total = lambda ns: sum((F.coalesce(n, F.lit(0)) for n in ns), F.lit(0)).cast("int")
    return out.withColumn("dane", F.struct(total(["__all"]).alias("n_records"), total(good).alias("n_matching"))).drop("__all", *good)
