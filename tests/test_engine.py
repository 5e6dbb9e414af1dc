import os

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mailsonde.functions import scalars as S
from mailsonde.operators import anomaly, corpus, governance, overview, profile, search
from mailsonde.plans import queries, rules
from mailsonde.sources import dims, sinks
from mailsonde.sources.tables import sessions_from_events, table
from mailsonde.streaming import sessions as streaming

SF = "/root/testdata/sf0.001"
SESSION = "id long, client_ip string, server_ip string, server_port int, protocol string, first_seen double, starttls_state string, ja3 string, sni string, server_banner string"


def rows(spark, times=(), **over):
    base = {"client_ip": "10.0.0.1", "server_ip": "10.0.0.2", "server_port": 587, "protocol": "SMTP", "starttls_state": "S4_ENCRYPTED", "ja3": None, "sni": None, "server_banner": None}
    pick = lambda v, i: v[i % len(v)] if isinstance(v, list) else v
    return spark.createDataFrame([(i, *[pick({**base, **over}[k], i) if k != "first_seen" else float(t) for k in ("client_ip", "server_ip", "server_port", "protocol", "first_seen", "starttls_state", "ja3", "sni", "server_banner")]) for i, t in enumerate(times)], SESSION)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def shown(v):
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in queries.SQL:
        assert got
        return
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([shown(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
    assert sorted([shown(r[c]) for c in sorted(names)] for r in got) == want


@pytest.mark.parametrize(
    ("times", "n"),
    [([60 * i for i in range(8)], 1), ([300 * i + (i * 7 % 11) - 5 for i in range(8)], 1), ([0, 10, 400, 410, 3000, 9000, 9001, 20000], 0), ([0, 60, 120, 180], 0), ([1000] * 8, 0)],
)
def test_beacons(spark, times, n):
    got = corpus.beacon_groups(rows(spark, times)).collect()
    assert len(got) == n and all(g["primary_id"] == 0 for g in got)


@pytest.mark.parametrize(
    ("times", "kind", "score"),
    [([60 * i for i in range(10)], "BEACON_CANDIDATE", 100), ([2, 37, 8, 91, 4, 52], "SUSPICIOUS_TIMING", 40), ([0, 60], "INSUFFICIENT_DATA", 0), ([0, 0, 10, 20, 30, 40], "BEACON_CANDIDATE", 90), ([5] * 6, "NORMAL", 20), ([100 * i for i in range(6)], "BEACON_CANDIDATE", 100)],
)
def test_timing_classes(spark, times, kind, score):
    (g,) = corpus.temporal_groups(rows(spark, times)).collect()
    assert (g["class"], g["score"]) == (kind, score)


def test_timing_of_odd_times(spark):
    df = rows(spark, [0, 10, 20, 30, 40, float("nan")]).unionByName(rows(spark, [50]).withColumn("first_seen", F.lit(None).cast("double")))
    (g,) = corpus.temporal_groups(df).collect()
    assert g["n_events"] == 5 and g["mean_gap"] == 10.0 and corpus.temporal_groups(rows(spark)).count() == 0


def test_corpus_detectors_positive_and_near_miss(spark):
    both = rows(spark, range(4), starttls_state=["S4_ENCRYPTED", "S_NO_STARTTLS"])
    assert [r["absent_ids"] for r in corpus.capability_asymmetry(both).collect()] == [[1, 3]]
    assert corpus.capability_asymmetry(rows(spark, range(4))).isEmpty() and corpus.capability_asymmetry(rows(spark, range(2), starttls_state=["S4_ENCRYPTED", "S_NO_STARTTLS"], server_port=[25, 26])).isEmpty()
    b = corpus.banner_mutations(rows(spark, range(5), server_banner=["220 postfix ready", "220 exim 4.94 hello", None, "220 postfix ready", ""])).collect()
    assert len(b) == 1 and (b[0]["id_a"], b[0]["id_b"]) == (0, 1)
    assert corpus.banner_mutations(rows(spark, range(2), server_banner=["220 a1", "220 a2"])).isEmpty()
    rare = corpus.rare_values(rows(spark, range(12), ja3=["a"] * 11 + ["b"])).collect()
    assert [(r["ja3"], r["n"], round(r["rarity_pct"], 3)) for r in rare] == [("b", 1, 8.333)]
    assert corpus.rare_values(rows(spark, range(9), ja3=["a"] * 8 + ["b"])).isEmpty() and corpus.rare_values(rows(spark, range(12))).isEmpty()
    found = corpus.corpus_findings(rows(spark, [60 * i for i in range(12)], ja3=["a"] * 11 + ["b"], starttls_state=["S4_ENCRYPTED"] * 11 + ["S_NO_STARTTLS"], server_banner=["x" * 10] * 11 + ["y" * 10])).collect()
    assert sorted(f["rule_id"] for f in found) == ["CB1_BEACONING_PERIODIC_SESSIONS", "CB4_JA3_SINGLETON_FINGERPRINT", "D1_CORPUS_CAPABILITY_STRIP", "D8_BANNER_MUTATION", "TEMPORAL_BEACON_CANDIDATE"]
    assert len({f["finding_id"] for f in found}) == 5


CLEAN = {
    "id": 1, "protocol_version": "TLS 1.3", "dst_port": 25, "has_auth": False, "cleartext_credentials_observed": False, "handshake_completed": True, "cert_analysis_possible": False, "encrypt_then_mac": True, "extended_master_secret": True,
    "secure_renegotiation": True, "compression_method": 0, "ticket_lifetime_seconds": None, "zero_rtt_used": False, "kex_algorithm": "ECDHE", "named_group": "x25519", "dh_key_bits": None, "ec_bits": 256, "cipher": None, "cert": None, "chain": None,
    "host_status": None, "known_compromised_spki": False,
}
SUITE = dict(name="TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256", enc="AES_128_GCM", enc_bits=128, mac="AEAD", hash="SHA256", kex="ECDHE", aead=True, anon=False, export=False, null_enc=False, pfs=True)
LEAF = dict(public_key_algorithm="RSA", public_key_bits=2048, signature_hash="SHA256", lifetime_days=90, is_self_signed=False, is_ca=False, path_length_known=True, san_count=1, sct_count=2)
CHAIN = dict(is_valid=True, anchor_source="public", ocsp_status="GOOD", crl_status="GOOD", errors=[])


def scored(spark, *changes, compat=False):
    data = [{**CLEAN, **c, "id": i} for i, c in enumerate(changes)]
    df = spark.createDataFrame(data, rules.PARAMS)
    return [r for r in rules.score(df, compat).orderBy("id").collect()]


def ids(r):
    return {p["rule_id"] for p in r["provenance"]}


def test_every_rule_fires_alone_or_is_named(spark):
    cert = {"cert_analysis_possible": True, "chain": CHAIN}
    leaf = lambda **k: {**cert, "cert": {**LEAF, **k}}
    suite = lambda **k: {"cipher": {**SUITE, **k}}
    chain = lambda **k: {**cert, "cert": LEAF, "chain": {**CHAIN, **k}}
    cases = {
        "PROTO-NO-TLS-AUTH": {"protocol_version": "NONE", "has_auth": True}, "PROTO-NO-TLS-PLAIN": {"protocol_version": "plaintext "}, "PROTO-SSL2": {"protocol_version": "SSL 2.0"}, "PROTO-SSL3": {"protocol_version": "SSLv3"},
        "PROTO-TLS10": {"protocol_version": "TLS 1.0"}, "PROTO-TLS11": {"protocol_version": "TLSv1.1"}, "PROTO-TLS12-LEGACY": {"protocol_version": "TLS 1.2", **suite(pfs=False)}, "PROTO-UNKNOWN": {"protocol_version": "0x7F00"},
        "CIPHER-NULL": suite(null_enc=True), "CIPHER-EXPORT": suite(export=True), "CIPHER-ANON": suite(kex="DH_anon"), "CIPHER-RC4": suite(enc="RC4_128"), "CIPHER-DES": suite(enc="DES_CBC", enc_bits=112), "CIPHER-3DES": suite(enc="3DES_EDE_CBC", enc_bits=112),
        "CIPHER-CBC-LEGACY": suite(name="TLS_RSA_WITH_SEED_X"), "HASH-MD5": suite(mac="HMAC-MD5"), "HASH-SHA1-MAC": suite(mac="HMAC-SHA1", aead=False), "CIPHER-CBC-NO-ETM": {**suite(enc="AES_128_CBC", aead=False), "encrypt_then_mac": False},
        "KEX-STATIC-RSA": {"kex_algorithm": "rsa"}, "KEX-STATIC-DH": {"kex_algorithm": "DH"}, "KEX-DHE-LOGJAM": {"kex_algorithm": "DHE", "dh_key_bits": 512}, "KEX-DHE-WEAK": {"kex_algorithm": "DHE", "dh_key_bits": 1024}, "KEX-DHE-2048": {"kex_algorithm": "DHE", "dh_key_bits": 4096},
        "KEX-ECDHE-WEAK-CURVE": {"named_group": "secp224r1"}, "KEX-ECDHE-UNKNOWN-CURVE": {"named_group": None, "ec_bits": None},
        "CERT-COMPROMISED-KEY": {**leaf(), "known_compromised_spki": True}, "CERT-EXPIRED": chain(errors=["CERT_EXPIRED", "CERT_NOT_YET_VALID"]), "CERT-NOT-YET-VALID": chain(errors=["CERT_NOT_YET_VALID"]), "CERT-SELF-SIGNED": leaf(is_self_signed=True),
        "CERT-UNTRUSTED-CHAIN": chain(is_valid=False, errors=["UNTRUSTED_ROOT"]), "CERT-HOSTNAME-MISMATCH": {**leaf(), "host_status": "MISMATCH"}, "CERT-RSA-512": leaf(public_key_bits=512), "CERT-RSA-1024": leaf(public_key_bits=1024), "CERT-ECDSA-WEAK": leaf(public_key_algorithm="EC", public_key_bits=192),
        "CERT-SIG-MD5": leaf(signature_hash="MD5"), "CERT-SIG-SHA1": leaf(signature_hash="SHA-1"), "CERT-REVOKED": chain(crl_status="REVOKED"), "CERT-REVOCATION-UNKNOWN": chain(ocsp_status="UNKNOWN", crl_status="UNKNOWN"), "CERT-LIFETIME-825": leaf(lifetime_days=900),
        "CERT-LIFETIME-398": leaf(lifetime_days=400), "CERT-CA-NO-BC": {**chain(errors=["INVALID_CA_CERT"]), "cert": {**LEAF, "is_ca": True, "path_length_known": False}}, "CERT-NO-SAN": leaf(san_count=0), "CERT-NO-SCT": leaf(sct_count=0),
        "HYGIENE-INSECURE-RENEG": {"protocol_version": "TLS 1.2", "secure_renegotiation": False}, "HYGIENE-NO-EMS": {"protocol_version": "TLS 1.2", "extended_master_secret": False}, "HYGIENE-COMPRESSION-CRIME": {"compression_method": 1},
        "HYGIENE-LONG-TICKET": {"ticket_lifetime_seconds": 700_000}, "HYGIENE-0RTT-SUBMISSION": {"zero_rtt_used": True, "dst_port": 587}, "HYGIENE-INCOMPLETE-HANDSHAKE": {"handshake_completed": False}, "NIST-MIN-STRENGTH": suite(enc_bits=56),
    }
    assert {r.rule_id for r in rules.RULES} == set(rules.conditions()) == {*cases, "HASH-SHA1-CERT"} and len(rules.RULES) == 51
    got = scored(spark, {}, *cases.values())
    assert (got[0]["risk_score"], got[0]["band"], ids(got[0])) == (0, "SECURE", set())
    for (rule, _), r in zip(cases.items(), got[1:], strict=True):
        assert rule in ids(r) and ids(r) - {rule} <= {"NIST-MIN-STRENGTH"}, (rule, ids(r))
        floor = max((x.penalty for x in rules.RULES if x.veto and x.rule_id in ids(r)), default=0)
        assert floor <= r["risk_score"] <= 100 and r["risk_score"] > 0 or rule in ("PROTO-TLS12-LEGACY", "KEX-DHE-2048", "CERT-NO-SCT", "CERT-REVOCATION-UNKNOWN")


def test_score_by_hand_and_compat(spark):
    a, b, c = scored(spark, {"protocol_version": "TLS 1.0", "dst_port": 465}, {"protocol_version": "NONE", "cleartext_credentials_observed": True}, {"protocol_version": "TLS 1.2", "cert_analysis_possible": True, "cert": {**LEAF, "san_count": 0}, "extended_master_secret": False})
    assert (a["risk_score"], float(a["context_multiplier"]), a["weight_redistributed"]) == (29, 1.15, True)  # 1.15 * 0.3125 * 80 = 28.75
    assert (b["risk_score"], b["band"]) == (100, "CRITICAL")
    assert c["risk_score"] == 8 and not c["weight_redistributed"]  # 0.20 * 25 + 0.10 * 25 = 7.5, half to even
    dhe = {"kex_algorithm": "DHE"}
    assert "KEX-DHE-WEAK" not in ids(scored(spark, dhe)[0]) and {"KEX-DHE-WEAK", "NIST-MIN-STRENGTH"} <= ids(scored(spark, dhe, compat=True)[0])


def test_strengths(spark):
    df = spark.createDataFrame([(0,), (512,), (1023,), (1024,), (2048,), (3072,), (4096,), (7680,), (15360,), (256,), (384,), (521,), (159,)], "b int")
    got = df.select(S.factoring_strength(F.col("b")).alias("f"), S.curve_strength(F.col("b")).alias("c")).collect()
    assert [r["f"] for r in got[:9]] == [0, 56, 64, 80, 112, 128, 128, 192, 256] and [r["c"] for r in got[9:]] == [128, 192, 256, 79]
    names = spark.createDataFrame([("MD5",), ("sha-1",), ("SHA_256",), ("SHA384",), ("SHA512",), (None,)], "h string")
    assert [r[0] for r in names.select(S.hash_strength(F.col("h"))).collect()] == [0, 80, 128, 192, 256, 80]


@pytest.mark.parametrize(
    ("pattern", "host", "ok"),
    [("*.example.com", "a.example.com", True), ("*.example.com", "a.b.example.com", False), ("*.example.com", "example.com", False), ("*.com", "example.com", False), ("A.Example.com.", "a.example.COM", True), ("a*.example.com", "ab.example.com", False), ("1.2.3.4", "1.2.3.4", False), (None, "x", False)],
)
def test_wildcards(spark, pattern, host, ok):
    df = spark.createDataFrame([(pattern, host)], "p string, h string")
    assert df.select(S.wildcard_match(F.col("p"), F.col("h"))).first()[0] is ok


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(0, 2**31 - 1))
def test_sequence_order_wraps(spark, a, d):
    b = (a + d) % 2**32
    r = spark.range(1).select(S.seq_diff(F.lit(b), F.lit(a)).alias("d"), S.seq_lte(F.lit(a), F.lit(b)).alias("le"), S.seq_gt(F.lit(b), F.lit(a)).alias("gt")).first()
    assert r["d"] == d and r["le"] and r["gt"] == (d > 0)


def test_redaction_and_scrubbing(spark):
    df = spark.createDataFrame([("mail a.b@x.org and aa.b@x.org PASS secret", ["c@d.net"], {"k": "e@f.io"}, (1, "AUTH PLAIN AAAA"))], "s string, a array<string>, m map<string,string>, t struct<n:int,u:string>")
    r = governance.scrubbed(df, "pepper").first()
    assert "a.b@" not in r["s"] and r["s"].count("@x.org") == 2 and r["s"].endswith("PASS [REDACTED]") and r["a"][0].endswith("@d.net") and "c@" not in r["a"][0] and r["m"]["k"].endswith("@f.io") and r["t"]["u"] == "AUTH PLAIN [REDACTED]"
    assert governance.scrubbed(df, "pepper", keep_for="court order").first()["s"].startswith("mail a.b@")


def test_custody(spark):
    captures = spark.createDataFrame([("b",), ("a",)], "sha256 string")
    bounds = spark.createDataFrame([(1.0, 2.0)], "evidence_from double, evidence_to double")
    m = governance.custody_manifest(captures, bounds, analyst="x", model_sha256="y", rules_version="1")
    assert governance.valid_manifest(m) and not governance.valid_manifest({**m, "analyst": "z"})
    with pytest.raises(ValueError, match="model_sha256"):
        governance.custody_manifest(captures, bounds, analyst="x", rules_version="1")


def test_pages_agree_and_do_not_overlap(spark):
    s = sessions_from_events(table(spark, SF, "events"))
    whole = [r["id"] for r in search.ordered(s).collect()]
    seen, after = [], None
    while page := search.keyset_page(s, 300, after).collect():
        seen += [r["id"] for r in page]
        after = search.cursor(page[-1]["risk_score"], page[-1]["id"])
    assert seen == whole and [r["id"] for r in search.offset_page(s, 10, 20).collect()] == whole[20:30]
    assert search.findings_of(corpus.corpus_findings(s, 0.6), s.limit(5)).count() >= 0 and search.timeline(corpus.corpus_findings(s, 0.6), s).count() <= 12


def test_exports(spark, tmp_path):
    s = sessions_from_events(table(spark, SF, "events"))
    for name in ("one", "two", "one"):
        sinks.write_partition(s, f"{tmp_path}/t", name)
    assert sinks.read_partition(spark, f"{tmp_path}/t", "one").count() == s.count() and spark.read.parquet(f"{tmp_path}/t").count() == 2 * s.count()
    sinks.write_csv(s, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == s.count()
    sinks.write_json(s, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == s.count()
    stix = sinks.stix_objects(s).collect()
    assert len({x["id"] for x in stix}) == len(stix) and all(x["id"] in x["object"] for x in stix)
    assert sinks.misp_attributes(s).where("type = 'ip-src'").count() == s.select("client_ip").distinct().count()
    page = sinks.html_report(s, corpus.corpus_findings(s, 0.6))
    assert page.startswith("<!DOCTYPE html>") and "CRITICAL" in page


def test_dimensions(spark, tmp_path):
    names = ["TLS_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384", "TLS_AES_128_GCM_SHA256", "TLS_RSA_EXPORT_WITH_RC4_40_MD5", "TLS_DH_anon_WITH_AES_128_CBC_SHA", "TLS_RSA_WITH_NULL_SHA256", None]
    got = [r["c"] for r in spark.createDataFrame([(n,) for n in names], "n string").select(dims.cipher_facts(F.col("n")).alias("c")).collect()]
    assert [(c["enc"], c["enc_bits"], c["hash"], c["kex"], c["aead"], c["pfs"]) for c in got[:3]] == [("3DES_EDE_CBC", 112, "SHA1", "RSA", False, False), ("AES_256_GCM", 256, "SHA384", "ECDHE", True, True), ("AES_128_GCM", 128, "SHA256", "ECDHE", True, True)]
    assert got[3]["export"] and got[3]["hash"] == "MD5" and got[4]["anon"] and got[5]["null_enc"] and got[6] is None
    for i, text in enumerate(['[{"domain": "A.org.", "mode": "Enforce"}]', '{"a.org": {"mode": "enforce"}}', '{"a.org": "enforce"}']):
        (tmp_path / f"{i}.json").write_text(text)
        assert [tuple(r) for r in dims.read_policies(spark, f"{tmp_path}/{i}.json").collect()] == [("a.org", "enforce")]


def test_isolation_forest_finds_what_is_far(spark):
    import numpy as np

    g = np.random.default_rng(0)
    data = [(i, v.tolist()) for i, v in enumerate(g.standard_normal((400, 4)))] + [(1000, [9.0] * 4), (1001, None)]
    got = {r["id"]: r for r in anomaly.anomaly_scores(spark.createDataFrame(data, "id long, v array<double>"), "id", "v").collect()}
    assert got[1000]["is_anomaly"] and got[1000]["anomaly_score"] == max(r["anomaly_score"] or 0 for r in got.values()) and got[1001]["anomaly_score"] is None
    assert anomaly.anomaly_scores(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0


def test_thresholds_and_checks(spark):
    df = spark.createDataFrame([(0.95, 1), (0.85, 1), (0.4, 0), (0.75, 0), (0.2, 1)], "s double, y int")
    grid = profile.threshold_grid(df, "s", "y")
    assert profile.best_threshold(grid, 0.6).first()["threshold"] == 0.8
    assert profile.score_summary(df.select(F.lit(3.0).alias("s")), "s").first()["mean"] == 0.0
    assert overview.takeaways(sessions_from_events(table(spark, SF, "events"))).count() >= 2


def test_streams_agree_with_batches(spark, tmp_path):
    s = sessions_from_events(table(spark, SF, "events")).select("id", "client_ip", "server_ip", "first_seen", "risk_score")
    s.repartition(1).sortWithinPartitions("first_seen").write.parquet(f"{tmp_path}/in")
    read = lambda: streaming.with_time(spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in"))

    def run(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("out").collect()

    got = run(streaming.trend(read(), "1 day"), "complete")
    assert sum(r["n"] for r in got) == s.count()
    timing = {(r["client_ip"], r["server_ip"]): r for r in run(streaming.running_timing(read(), ["client_ip", "server_ip"]), "update")}
    batch = corpus.temporal_groups(s.withColumn("server_port", F.lit(1)).withColumn("protocol", F.lit("x"))).collect()
    for r in batch:
        t = timing[r["client_ip"], r["server_ip"]]
        assert t["n_events"] == r["n_events"] and (r["cv"] is None or abs(t["cv"] - r["cv"]) < 1e-6)
    assert len(run(streaming.once(read(), ["client_ip"]), "append")) == s.select("client_ip").distinct().count()
    windows = run(streaming.idle_windows(read(), ["client_ip"], "6 hours"), "complete")
    assert sum(r["n_events"] for r in windows) == s.count()
