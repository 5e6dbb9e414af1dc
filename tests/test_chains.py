"""Signatures, certificate chains, revocation and interval joins against plain searches and the JVM's own signatures."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mailsonde.functions import signatures
from mailsonde.operators import chains, relational, revocation
from mailsonde.plans import chain_queries, rules
from mailsonde.plans import made_certs as M
from mailsonde.sources.trust import read_certificates

DAY = 86_400.0
T0 = 1_700_000_000.0


@pytest.mark.parametrize("bits", signatures.CURVES)
def test_curves(bits):
    c = signatures.CURVES[bits]
    assert signatures.multiples(c, [(c.n, (c.x, c.y))]) is None and signatures.multiples(c, [(1, (c.x, c.y))]) == c.x
    assert signatures.multiples(c, [(5, (c.x, c.y)), (c.n - 5, (c.x, c.y))]) is None


def jvm_pair(spark, kind, size):
    g = spark._jvm.java.security.KeyPairGenerator.getInstance(kind)
    g.initialize(size)
    return g.generateKeyPair()


@pytest.mark.parametrize(("kind", "size", "algorithm"), [("RSA", 2048, "SHA256withRSA"), ("RSA", 1024, "SHA1withRSA"), ("RSA", 1024, "MD5withRSA"), ("RSA", 2048, "SHA512withRSA"), ("RSA", 2048, "RSASSA-PSS"), ("EC", 256, "SHA256withECDSA"), ("EC", 384, "SHA384withECDSA"), ("EC", 521, "SHA512withECDSA"), ("EC", 256, "SHA512withECDSA")])
def test_signatures_of_the_jvm(spark, kind, size, algorithm):
    pair, message = jvm_pair(spark, kind, size), b"signed part"
    j = spark._jvm
    s = j.java.security.Signature.getInstance(algorithm)
    if algorithm == "RSASSA-PSS":
        s.setParameter(j.java.security.spec.PSSParameterSpec("SHA-256", "MGF1", j.java.security.spec.MGF1ParameterSpec.SHA256, 32, 1))
    s.initSign(pair.getPrivate())
    s.update(bytearray(message))
    raw = bytes(b & 255 for b in s.sign())
    kind_of = j.java.lang.Class.forName("java.security.spec.X509EncodedKeySpec")
    key = bytes(b & 255 for b in j.java.security.KeyFactory.getInstance(kind).getKeySpec(pair.getPublic(), kind_of).getEncoded())
    sha256 = "2.16.840.1.101.3.4.2.1"
    oids = {
        "SHA256withRSA": "1.2.840.113549.1.1.11", "SHA1withRSA": "1.2.840.113549.1.1.5", "MD5withRSA": "1.2.840.113549.1.1.4", "SHA512withRSA": "1.2.840.113549.1.1.13", "RSASSA-PSS": chains.PSS, "SHA256withECDSA": "1.2.840.10045.4.3.2",
        "SHA384withECDSA": "1.2.840.10045.4.3.3", "SHA512withECDSA": "1.2.840.10045.4.3.4",
    }
    more = M.seq(M.der(0xA0, M.seq(M.oid(sha256))), M.der(0xA2, M.integer(32))) if algorithm == "RSASSA-PSS" else b""
    alg = M.oid(oids[algorithm]) + more
    content = M._content(key)
    assert chains.checked(message, alg, raw, content) == "good"
    assert chains.checked(message + b"x", alg, raw, content) == "bad"
    assert chains.checked(message, alg, raw[:-1] + bytes([raw[-1] ^ 1]), content) == "bad"
    assert chains.checked(message, alg, raw[:5], content) == "bad"
    assert chains.checked(message, M.oid("1.3.101.112"), raw, content) in ("bad", "unsupported")


def sha(d):
    return hashlib.sha256(d).hexdigest()


class World:
    """A certificate authority of several branches, by name."""

    def __init__(self):
        self.certs = {}

    def add(self, label, subject, issuer, before=-100, after=1000, **how):
        self.certs[label] = M.certificate(subject, issuer, len(self.certs) + 1, T0 + before * DAY, T0 + after * DAY, **how)
        return self.certs[label]


def brute(presented, store, at, depth=chains.DEPTH):
    """(is_valid, first error or None, path) by plain recursion, with the rules of chain_paths and verdict."""
    facts = {d: chains.node(d) for d in [*presented, *store]}
    own = lambda n: n["subject_key"] == n["issuer_key"] and (n["authority_id"] is None or n["key_id"] is None or n["authority_id"] == n["key_id"])
    roots = {d for d, s in store.items() if s != "intermediate"}
    found = []

    def walk(path):
        tip = path[-1]
        if tip in roots:
            found.append(path)
            return
        if len(path) == depth or own(facts[tip]):
            return
        for up in {*presented, *store}:
            if up not in path and facts[up]["readable"] and facts[up]["subject_key"] == facts[tip]["issuer_key"]:
                a, k = facts[tip]["authority_id"], facts[up]["key_id"]
                if a is None or k is None or a == k:
                    walk([*path, up])

    def fault(path):
        for i in reversed(range(len(path))):
            n = facts[path[i]]
            below = sum(not own(facts[u]) for u in path[1:i])
            if i == len(path) - 1:
                if n["path_length"] is not None and n["path_length"] < below:
                    return i, "PATH_VALIDATION_ERROR"
                continue
            if n["signature_hash"] in chains.WEAK:
                return i, "WEAK_HASH_ALGO"
            if chains.issued(path[i], path[i + 1]) != "good":
                return i, "PATH_VALIDATION_ERROR"
            if at < n["not_before"]:
                return i, "CERT_NOT_YET_VALID"
            if at > n["not_after"]:
                return i, "CERT_EXPIRED"
            if i and not (n["is_ca"] and n["may_sign"]):
                return i, "INVALID_CA_CERT"
            if i and n["path_length"] is not None and n["path_length"] < below:
                return i, "PATH_VALIDATION_ERROR"
        return None

    if not presented:
        return False, ["EMPTY_CHAIN"], []
    leaf = facts[presented[0]]
    if not leaf["readable"]:
        return False, ["INVALID_CERTIFICATE"], []
    walk([presented[0]])
    faults = [(fault(p), p) for p in found]
    best = min(((f is not None, f[0] if f else -1, len(p), [sha(d) for d in p], f and f[1]) for f, p in faults), key=lambda x: x[:4], default=None)
    errors = ["CERT_NOT_YET_VALID"] if at < leaf["not_before"] else ["CERT_EXPIRED"] if at > leaf["not_after"] else []
    code = best[4] if best else "SELF_SIGNED_CERT" if own(leaf) else "UNTRUSTED_ROOT"
    if code and code not in errors:
        errors.append(code)
    return bool(best) and not errors, errors, best[3] if best and not best[0] else []


@pytest.fixture(scope="module")
def world():
    w = World()
    w.add("root", "Root", "Root", ca=True)
    w.add("old", "Old Root", "Old Root", before=-5000, after=-1, ca=True)
    w.add("stranger", "Stranger", "Stranger", ca=True)
    w.add("mid", "Mid", "Root", ca=True, path_length=1)
    w.add("mid-cross", "Mid", "Old Root", ca=True)
    w.add("sub", "Sub", "Mid", ca=True, path_length=0)
    w.add("deep", "Deep", "Sub", ca=True)
    w.add("not-ca", "NotCA", "Root", ca=False)
    w.add("no-sign", "NoSign", "Root", ca=True, usage=0x80)
    w.add("weak", "Weak", "Root", ca=True, digest_name="SHA1")
    w.add("expired", "Expired", "Root", after=-2, ca=True)
    w.add("future", "Future", "Root", before=20, ca=True)
    w.add("loop-a", "LoopA", "LoopB", ca=True)
    w.add("loop-b", "LoopB", "LoopA", ca=True)
    w.add("proxy", "Corp Inspection Proxy", "Root", ca=True)
    w.add("same", "Mid", "Root", owner="Other Mid", ca=True)  # the name of another key
    for label, issuer in (("a", "Mid"), ("b", "Sub"), ("c", "Deep"), ("d", "NotCA"), ("e", "NoSign"), ("f", "Weak"), ("g", "Expired"), ("h", "Future"), ("i", "LoopA"), ("j", "Corp Inspection Proxy"), ("k", "Stranger"), ("l", "Root"), ("m", "Nobody")):
        w.add(f"leaf-{label}", f"{label}.example.org", issuer, ca=False)
    w.add("leaf-late", "late.example.org", "Mid", after=-3)
    w.add("leaf-soon", "soon.example.org", "Mid", before=3)
    w.add("leaf-forged", "forged.example.org", "Mid", signer="Somebody else", ids=False)
    w.add("leaf-self", "self.example.org", "self.example.org")
    w.add("leaf-md5", "md5.example.org", "Mid", digest_name="MD5")
    w.certs["junk"] = b"\x30\x03junk"
    return w.certs


CASES = [
    [], ["junk"], ["leaf-a", "mid"], ["leaf-a"], ["leaf-a", "mid-cross"], ["leaf-a", "same", "mid"], ["leaf-b", "sub", "mid"], ["leaf-b", "sub"], ["leaf-c", "deep", "sub", "mid"], ["leaf-d", "not-ca"], ["leaf-e", "no-sign"], ["leaf-f", "weak"],
    ["leaf-g", "expired"], ["leaf-h", "future"], ["leaf-i", "loop-a", "loop-b"], ["leaf-j", "proxy"], ["leaf-k", "stranger"], ["leaf-l"], ["leaf-m"], ["leaf-late", "mid"], ["leaf-soon", "mid"], ["leaf-forged", "mid"], ["leaf-self"], ["leaf-md5", "mid"],
    ["leaf-a", "junk", "mid", "mid"], ["root"], ["leaf-a", "mid"], ["mid", "leaf-a"],
]


def test_chains_against_plain_search(spark, world):
    store = {world["root"]: "bundle", world["old"]: "enterprise", world["sub"]: "intermediate"}
    moments = [T0, T0 - 4 * DAY, T0 + 10 * DAY, T0 + 2000 * DAY]
    rows = [(i, [world[x] for x in case], t) for i, case in enumerate(CASES) for t in moments] + [(99, None, T0), (2, [world["leaf-a"], world["mid"]], None)]
    s = spark.createDataFrame([(i, ds and [bytearray(d) for d in ds], t, "x", "y") for i, ds, t in rows], "id int, certs array<binary>, first_seen double, leaf string, chain string").repartition(4)
    kept = spark.createDataFrame([(bytearray(d), k) for d, k in store.items()] + [(None, "bundle"), (bytearray(b"junk"), "bundle")], "der binary, source string")
    out = chains.validated(s, kept, certificates="certs", expected=("corp",)).collect()
    assert len(out) == len(rows)
    codes = defaultdict(set)
    for r in out:
        if r["first_seen"] is None:
            assert r["chain"]["is_valid"]  # no time, no dates
            continue
        want = brute([bytes(d) for d in r["certs"] or []], store, r["first_seen"])
        got = r["chain"]
        assert (got["is_valid"], got["errors"], got["path"]) == want, (CASES[r["id"]] if r["id"] < 99 else None, r["first_seen"] - T0)
        for e in got["errors"]:
            codes[e].add(r["id"])
        if got["path"]:
            assert got["anchor_source"] == store[next(d for d in store if sha(d) == got["path"][-1])] and got["anchor_dn"] in ("CN=Root", "CN=Old Root") and got["chain_length"] == len(got["path"])
        assert got["interception"] == (None if not got["path"] or r["id"] != CASES.index(["leaf-j", "proxy"]) else "MITM_INTERCEPTION")
    assert {"EMPTY_CHAIN", "INVALID_CERTIFICATE", "CERT_EXPIRED", "CERT_NOT_YET_VALID", "SELF_SIGNED_CERT", "UNTRUSTED_ROOT", "WEAK_HASH_ALGO", "INVALID_CA_CERT", "PATH_VALIDATION_ERROR"} == set(codes)
    by = chains.validated(s.where(F.col("id") == CASES.index(["leaf-j", "proxy"])), kept, certificates="certs", expected=("root",)).where(F.col("first_seen") == T0).first()
    assert by["chain"]["interception"] == "AUTHORIZED_INTERCEPTION_PROXY"
    assert chains.validated(s.limit(0), kept, certificates="certs").count() == 0
    assert {r["chain"]["anchor_source"] for r in chains.validated(s.where("size(certs) > 0"), kept.limit(0), certificates="certs").collect()} == {"untrusted", "self_signed"}


def test_trust_stores_from_files(spark, world, tmp_path):
    import base64

    pem = lambda d: b"-----BEGIN CERTIFICATE-----\n" + base64.encodebytes(d) + b"-----END CERTIFICATE-----\n"
    (tmp_path / "bundle.pem").write_bytes(b"# comment\n" + pem(world["root"]) + b"text\n" + pem(world["old"]).replace(b"\n", b"\r\n"))
    (tmp_path / "one.der").write_bytes(world["mid"])
    got = read_certificates(spark, str(tmp_path), "bundle").collect()
    assert {bytes(r["der"]) for r in got} == {world["root"], world["old"], world["mid"]} and len({r["file_sha256"] for r in got}) == 2


def test_interval_join_against_all_pairs(spark):
    r = random.Random(5)
    spans = []
    for i in range(300):
        a = r.uniform(-1e7, 1e7)
        spans.append((r.choice("ab"), i, a, None if i % 9 == 0 else a + r.choice([0, 1, 3600, 7e4, 1e6, 3e7, 1e9, 1e12, -5]) * r.random()))
    spans += [(None, 900, 0.0, 1.0), ("a", 901, None, 5.0), ("a", 902, 0.0, 3600.0), ("a", 902, 0.0, 3600.0)]
    points = [(r.choice(["a", "b", "c"]), i, r.choice([x for _, _, s, e in spans if s is not None for x in (s, e) if x is not None]) if i % 2 else r.uniform(-1e7, 1e7)) for i in range(300)] + [("a", 700, None), (None, 701, 0.5), ("a", 702, 3600.0), ("a", 702, 3600.0)]
    got = relational.interval_join(spark.createDataFrame(points, "k string, p int, at double"), spark.createDataFrame(spans, "k string, i int, s double, e double"), ["k"], "at", "s", "e")
    assert sorted((x["p"], x["i"]) for x in got.collect()) == sorted((p, i) for k, p, t in points for q, i, s, e in spans if k == q and k and t is not None and s is not None and s <= t and (e is None or t <= e))
    assert "__level" not in got.columns


def test_revocation(spark, tmp_path):
    url, other = "http://crl.example.org/a.crl", "http://crl.example.org/b.crl"
    ca = M.certificate("CA", "CA", 1, T0 - 900 * DAY, T0 + 900 * DAY, ca=True)
    leaf = lambda serial, u=url: M.certificate(f"l{serial}.example.org", "CA", serial, T0 - 900 * DAY, T0 + 900 * DAY, crl_url=u)
    files = {
        (url, 1): M.revocation_list("CA", T0, T0 + 10 * DAY, [(5, T0 - DAY)]), (url, 2): M.revocation_list("CA", T0 + 5 * DAY, T0 + 20 * DAY, [(6, T0 + 4 * DAY), (300, T0)]), (url, 3): M.revocation_list("CA", T0 + 50 * DAY, None, []),
        (other, 1): M.revocation_list("CA", T0, T0 + DAY, [(7, T0)]), (other, 2): b"no list",
    }
    for (u, i), data in files.items():
        (tmp_path / f"{sha(u.encode())}.{i}.crl").write_bytes(data)
    lists, entries = revocation.read_lists(spark, str(tmp_path))
    assert lists.count() == 4 and entries.count() == 4
    asks = [(s, u, t) for s, u in ((5, url), (6, url), (300, url), (7, other), (8, None)) for t in (-1, 0, 3, 7, 15, 30, 60)]

    def want(serial, u, t):
        held = {(url, 1): (0, 10, {5}), (url, 2): (5, 20, {6, 300}), (url, 3): (50, 1e9, set()), (other, 1): (0, 1, {7})}
        force = [(a, ids) for (v, _), (a, b, ids) in held.items() if v == u and a <= t <= b]
        return "UNKNOWN" if not force else "REVOKED" if serial in max(force, key=lambda x: x[0])[1] else "GOOD"

    s = spark.createDataFrame([(i, [bytearray(leaf(n, u)), bytearray(ca)], None, T0 + t * DAY) for i, (n, u, t) in enumerate(asks)], "id int, certs array<binary>, staple binary, first_seen double")
    store = spark.createDataFrame([(bytearray(ca), "bundle")], "der binary, source string")
    out = revocation.with_revocation(chains.validated(s, store, certificates="certs"), lists, entries, "certs", "staple")
    for r in out.collect():
        status = want(*asks[r["id"]])
        assert (r["chain"]["crl_status"], r["chain"]["ocsp_status"]) == (status, "UNKNOWN"), asks[r["id"]]
        assert r["chain"]["is_valid"] == (status != "REVOKED") and r["chain"]["errors"] == (["CRL_REVOKED"] if status == "REVOKED" else []) and r["chain"]["findings"] == (["CERT_CRL_REVOKED"] if status == "REVOKED" else [])

    delegate = M.certificate("Responder", "CA", 90, T0 - 900 * DAY, T0 + 900 * DAY, ocsp_signing=True)
    plain = M.certificate("Responder", "CA", 91, T0 - 900 * DAY, T0 + 900 * DAY)
    answer = lambda *a, **k: M.ocsp_answer("CA", 5, *a, **k)
    cases = [
        (answer("GOOD", T0, T0 + DAY), "GOOD", None), (answer("REVOKED", T0, None), "REVOKED", "CERT_OCSP_REVOKED"), (answer("GOOD", T0 - 9 * DAY, T0 - DAY), "EXPIRED", "OCSP_STALE"), (answer("GOOD", T0 + DAY, None), "EXPIRED", "OCSP_STALE"),
        (answer("GOOD", T0, None, signer="Mallory"), "UNAUTHORIZED", "OCSP_UNAUTHORIZED_RESPONDER"), (answer("GOOD", T0, None, signer="Responder", certs=(delegate,)), "GOOD", None), (answer("GOOD", T0, None, signer="Responder", certs=(plain,)), "UNAUTHORIZED", "OCSP_UNAUTHORIZED_RESPONDER"),
        (answer("GOOD", T0, None, good=False), "UNKNOWN", "CERT_CRL_REVOKED"), (b"junk", "UNKNOWN", "OCSP_MALFORMED"), (M.ocsp_answer("CA", 6, "REVOKED", T0, None), "UNKNOWN", "CERT_CRL_REVOKED"), (None, "UNKNOWN", "CERT_CRL_REVOKED"),
    ]
    s = spark.createDataFrame([(i, [bytearray(leaf(5)), bytearray(ca)], a and bytearray(a), T0 + 60) for i, (a, _, _) in enumerate(cases)], s.schema)
    for r in revocation.with_revocation(chains.validated(s, store, certificates="certs"), lists, entries, "certs", "staple").collect():
        _, status, finding = cases[r["id"]]
        crl = "REVOKED" if status == "UNKNOWN" else "UNKNOWN"
        assert (r["chain"]["ocsp_status"], r["chain"]["crl_status"], r["chain"]["findings"]) == (status, crl, [finding] if finding else []), r["id"]


def test_power_by_primes():
    for owner in ("customers", "NATION 3"):
        n, d = M.key(owner)
        assert all(M.power(owner, x) == pow(x, d, n) for x in (0, 1, n - 1, M.primes(owner)[0], M.primes(owner)[1] * 5, 2**500 + 12345))


def test_chains_are_made_by_many_tasks_and_once(spark, tmp_path):
    """A table in one file is not one task's work, customers without a chain or of an unknown nation stay, and packets are made once."""
    spark.createDataFrame([(i, f"r{i}") for i in range(5)], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(i, f"n{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, 99 if i == 30 else i % 25) for i in range(60)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    shown, _ = chain_queries.hierarchy(spark, str(tmp_path))
    assert len(shown.inputFiles()) >= 4 and not any("customer.parquet" in x for x in shown.inputFiles())
    assert {r[0]: r[1] for r in shown.select("c_custkey", F.size("certificates")).collect()} == {i: None if i % 29 == 0 or i == 30 else 1 if i % 17 == 3 else 2 for i in range(60)}
    out = chain_queries.captured_chains(spark, str(tmp_path))
    assert out.count() == 60 and "MapInArrow" not in out._jdf.queryExecution().toString()


def test_a_chain_of_many_sessions_is_carried_once(spark, tmp_path):
    """Sessions of certificate_chains name their chain, they don't hold its certificates; verdicts are those of sessions that do."""
    spark.createDataFrame([(i, f"r{i}") for i in range(5)], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(i, f"n{i}", i % 5) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(i, i % 25) for i in range(60)], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.range(300).selectExpr("id as o_orderkey", "id % 62 as o_custkey", "timestamp_seconds(694224000 + id * 86400 * 8) as o_orderdate")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    out = chain_queries.certificate_chains(spark, str(tmp_path))
    assert "certificates#" not in out._jdf.queryExecution().optimizedPlan().toString()
    shown, store = chain_queries.hierarchy(spark, str(tmp_path))
    s = orders.join(shown, F.col("o_custkey") == F.col("c_custkey")).withColumn("first_seen", F.col("o_orderdate").cast("double"))
    want = chains.validated(s, store, "certificates").select("o_orderkey", "chain.is_valid", "chain.chain_length", "chain.anchor_dn", "chain.anchor_source", F.array_join("chain.errors", ","), "chain.interception")
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and len(got) == sum(i % 62 < 60 for i in range(300)) and len({x[5] for x in got}) > 4
