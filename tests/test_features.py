import hashlib

from pyspark.sql import functions as F

import wire as W
from mailsonde.functions import features
from mailsonde.operators import certificates, decode, flow
from mailsonde.sources.capture import read_packets


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def seq(*xs):
    return der(0x30, b"".join(xs))


def oid(text):
    a, b, *rest = map(int, text.split("."))
    out = bytes([40 * a + b])
    for n in rest:
        part = [n & 0x7F]
        while n := n >> 7:
            part.append(n & 0x7F | 0x80)
        out += bytes(reversed(part))
    return der(6, out)


def certificate(subject=b"mx.example.org", issuer=b"CA", bits=2048, sig="1.2.840.113549.1.1.11", sans=(b"mx.example.org", b"*.example.org"), ca=None):
    name = lambda cn: seq(der(0x31, seq(oid("2.5.4.3"), der(12, cn))))
    key = seq(seq(oid("1.2.840.113549.1.1.1"), der(5, b"")), der(3, b"\0" + seq(der(2, b"\0" + (1 << bits - 1).to_bytes(bits // 8, "big")), der(2, b"\1\0\1"))))
    ext = lambda k, v: seq(oid(k), der(4, v))
    exts = ext("2.5.29.17", seq(*[der(0x82, s) for s in sans], der(0x87, bytes([10, 0, 0, 25])))) + ext("2.5.29.19", ca if ca is not None else seq())
    body = seq(der(0xA0, der(2, b"\2")), der(2, b"\x12\x34"), seq(oid(sig)), name(issuer), seq(der(23, b"240101000000Z"), der(24, b"20250101000000Z")), name(subject), key, der(0xA3, seq(exts)))
    return seq(body, seq(oid(sig)), der(3, b"\0sig"))


def test_certificate_fields():
    c = certificates.parsed(certificate())
    assert (c["parse_mode"], c["subject_dn"], c["issuer_dn"], c["public_key_algorithm"], c["public_key_bits"], c["signature_hash"], c["lifetime_days"]) == ("STRICT", "CN=mx.example.org", "CN=CA", "RSA", 2048, "SHA256", 366)
    assert c["san_dns"] == ["mx.example.org", "*.example.org"] and c["san_ip"] == ["10.0.0.25"] and c["san_count"] == 3 and not c["is_self_signed"] and c["serial_number"] == "1234"
    assert certificates.parsed(certificate(subject=b"CA", ca=seq(der(1, b"\xff"), der(2, b"\0"))))["is_self_signed"]
    whole = certificate()
    for i in range(len(whole)):
        certificates.parsed(whole[:i])
        certificates.parsed(whole[:i] + bytes([whole[i] ^ 0x55]) + whole[i + 1 :])
    assert certificates.parsed(b"junk")["parse_mode"] == "CORRUPT" and certificates.parsed(None)["parse_mode"] is None


def test_features_of_a_session(spark, tmp_path):
    leaf = certificate()
    cert = W.record(22, W.message(11, W.v(3, W.v(3, leaf))))
    turns = [("s", b"220 mx ESMTP\r\n"), ("c", b"EHLO me\r\n"), ("s", b"250 STARTTLS\r\n"), ("c", b"STARTTLS\r\n"), ("s", b"220 go\r\n"), ("c", W.client_hello()), ("s", W.server_hello() + cert)]
    (tmp_path / "a.pcap").write_bytes(W.pcap(W.dialogue(turns) + W.dialogue(turns[:3], client_port=40001)))
    ident = ["capture_id", "client_port"]
    s = certificates.with_leaf(decode.decoded(flow.sessions(read_packets(spark, str(tmp_path / "a.pcap")))), ident).withColumn("risk_score", F.lit(12))
    suites = spark.createDataFrame([("0x1301", "TLS_AES_128_GCM_SHA256"), ("0xC02F", "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256")], "id string, name string")
    f = features.features(s, suites)
    r, plain = f.orderBy("key_client_port").collect()
    assert (r["ciph_n_offered"], r["ciph_n_grease"], r["ciph_top1_id"], r["ciph_mean_strength"], r["ciph_pct_aead"], r["ciph_list_entropy"]) == (2, 1, 0x1301, 128, 1, 0)
    assert (r["ext_count"], r["ext_has_sni"], r["ext_sni_label_count"], r["crypto_selected_cipher"], r["crypto_pubkey_bits"], r["crypto_san_count"], r["crypto_risk_score"]) == (7, 1, 3, 0xC02F, 2048, 3, 12)
    assert r["beh_starttls_state"] == 5 and r["beh_port_is_standard_mail"] == 1 and abs(r["meta_iat_mean"] - 0.25) < 1e-3 and abs(sum(x * x for x in r["fp_hash"]) - 1) < 1e-9
    assert plain["ciph_n_offered"] == 0 and plain["ciph_mean_strength"] is None and plain["crypto_pubkey_bits"] is None and plain["fp_document"] == "no_fingerprint"
    filled = features.imputed(f, ["crypto_pubkey_bits", "ciph_mean_strength"]).collect()
    assert all(x["crypto_pubkey_bits"] == 2048 and x["ciph_mean_strength"] == 128 for x in filled)
    scored = features.normal_scores(spark.range(101).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("c")), ["x", "c"]).orderBy("x").collect()
    assert abs(scored[50]["x"]) < 1e-9 and scored[0]["x"] < -5 and scored[100]["x"] > 5 and scored[7]["c"] == 0
    chain = certificates.certificates(s, ident).collect()
    assert [x["cert"]["fingerprint_sha256"] for x in chain] == [hashlib.sha256(leaf).hexdigest()]


def test_hashed_documents_reads_whole_texts(spark, tmp_path):
    from mailsonde.plans.queries import hashed_documents

    rows = [(1, "one two"), (2, "One, TWO! " * 5000), (3, None), (4, ""), (5, "one " * 5000 + "two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["fp_hash"] for r in hashed_documents(spark, str(tmp_path)).collect()}
    assert got[1] == got[2] != got[5] and got[3] == got[4] == ",".join(["0.0"] * 32)


def test_captured_sessions_take_their_leaf_and_its_chain_into_the_score(spark):
    from mailsonde.plans import rules
    from mailsonde.sources.adapters import packets_of_dialogues

    suites = spark.createDataFrame([("0xC000", "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256")], "id string, name string")
    decoded = decode.decoded(flow.sessions(packets_of_dialogues(spark.range(2).select(F.col("id").alias("doc_id")), "doc_id")))
    leaf = "named_struct('fingerprint_sha256', 'f', 'public_key_algorithm', 'RSA', 'public_key_bits', 1024, 'signature_hash', 'SHA1', 'lifetime_days', 900, 'is_self_signed', false, 'is_ca', false, 'path_length_known', false, 'san_count', 0, 'sct_count', 0)"
    decoded = decoded.withColumn("cert", F.expr(leaf)).withColumn("tls", F.col("tls").withField("certificates_observable", F.lit(True)))
    chains = spark.sql(f"SELECT 'f' AS fingerprint_sha256, CAST(named_struct('is_valid', false, 'anchor_source', null, 'ocsp_status', 'UNKNOWN', 'crl_status', 'REVOKED', 'errors', array('CERT_EXPIRED', 'UNTRUSTED_ROOT')) AS {rules.CHAIN}) AS chain")
    got = {r["capture_id"]: r for r in rules.score(rules.parameters(decoded, suites, chains.unionByName(chains))).collect()}
    assert len(got) == 2 and got["dialogue-0"]["risk_score"] == 100
    fired = {x["rule_id"] for x in got["dialogue-0"]["provenance"] if x["component"] == "certificate"}
    assert fired == {"CERT-EXPIRED", "CERT-UNTRUSTED-CHAIN", "CERT-REVOKED", "CERT-RSA-1024", "CERT-SIG-SHA1", "CERT-LIFETIME-825", "CERT-NO-SAN", "CERT-NO-SCT"}
    alone = {r["capture_id"]: r for r in rules.score(rules.parameters(decoded, suites)).collect()}
    assert "CERT-EXPIRED" not in {x["rule_id"] for x in alone["dialogue-0"]["provenance"]}


def test_tlsa_records_count_per_name_port_and_transport(spark):
    from mailsonde.operators import detectors

    key = hashlib.sha512(b"k").hexdigest()
    records = spark.createDataFrame([("MX.org ", 25, "tcp", 1, 2, key.upper()), ("mx.org", 25, "tcp", 1, 2, "00"), ("mx.org", 25, "tcp", 7, 1, key), ("mx.org", 25, "udp", 1, 2, key), ("mx.org", 587, "tcp", 1, 0, "6b")], "domain string, port int, protocol string, selector int, matching int, data string")
    s = spark.createDataFrame([(1, " mx.ORG", 25), (2, "mx.org", 587), (3, "other.org", 25), (4, None, 25)], "id int, host string, port int").withColumns({"c": F.lit(b"c"), "k": F.lit(b"k")})
    got = {r["id"]: tuple(r["dane"]) for r in detectors.dane(s, records, "host", "port", "c", "k").collect()}
    assert got == {1: (3, 1), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_tlsa_records_are_not_met_one_by_one(spark):
    """A name's many records are counted before the join: all kinds, doubled ones, nulls, sessions that are equal, columns with the records' names."""
    from mailsonde.operators import detectors

    digests = {0: lambda b: b.hex(), 1: lambda b: hashlib.sha256(b).hexdigest(), 2: lambda b: hashlib.sha512(b).hexdigest()}
    certs = [b"c%d" % (i % 40) for i in range(200)] + [None]
    spkis = [b"k%d" % (i % 30) for i in range(200)] + [b"k1"]
    records = [(f"h{i % 2}", 25, "TCP", i % 3, i // 3 % 4, None if i % 11 == 0 else (digests.get(i // 3 % 4, digests[0]))([b"c%d", b"k%d"][i % 2] % (i % 50)).upper()) for i in range(400)] * 2
    r = spark.createDataFrame(records, "domain string, port int, protocol string, selector int, matching int, data string")
    s = spark.createDataFrame([(f"h{i % 3}", 25, c, k, "own") for i, (c, k) in enumerate(zip(certs, spkis, strict=True))] * 2, "host string, at int, c binary, k binary, selector string")
    out = detectors.dane(s, r, "host", "at", "c", "k")
    assert out.columns == [*s.columns, "dane"] and "collect_list" not in out._jdf.queryExecution().toString()

    def want(host, c, k):
        mine = [x for x in records if x[0] == host]
        source = {0: c, 1: k}
        return len(mine), sum(x[3] in source and x[4] in digests and source[x[3]] is not None and x[5] is not None and digests[x[4]](source[x[3]]) == x[5].lower() for x in mine)

    b = lambda x: None if x is None else bytes(x)
    got = [(tuple(x["dane"]), want(x["host"], b(x["c"]), b(x["k"]))) for x in out.collect()]
    assert len(got) == 2 * len(certs) and all(a == w for a, w in got) and len({a for a, _ in got}) > 3
