"""Certificate chains: bounded path search over the graph of certificates, and verdicts as of the time of capture.

Distinct chains are the unit of work: a path is searched once for each, over edges from a certificate to those that may
have issued it, and each edge's signature is checked once. A path's verdict depends on the time only through its
certificates' dates, so sessions get theirs by one equi-join with their chain's paths and a Column expression.

An issuer is a certificate of the same chain, or of the stores, whose subject is the issuer's name and whose key
identifier, where both tell one, is the same: cross-signed branches give several paths, a certificate comes once in a
path, so loops end. A path ends at the first trusted certificate; like path validators do, that one is taken as it is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import signatures
from ..sources.trust import settled
from .certificates import CURVES, HASHES, KEYS, name, oid, moment, values

#: Most certificates of a path.
DEPTH = 8
INTERMEDIATE = "intermediate"
NODE = (
    "struct<readable:boolean,subject:string,issuer:string,subject_key:string,issuer_key:string,key_id:string,authority_id:string,serial:string,not_before:double,not_after:double,"
    "signature_hash:string,has_constraints:boolean,is_ca:boolean,path_length:int,may_sign:boolean,crl_urls:array<string>,ocsp_signing:boolean>"
)
#: Signature algorithms that are no digest with RSA or ECDSA, extensions, purposes; digests that count as weak.
PSS = "1.2.840.113549.1.1.10"
KEY_ID, KEY_USAGE, CONSTRAINTS, CRL_POINTS, AUTHORITY_ID, PURPOSES = "2.5.29.14", "2.5.29.15", "2.5.29.19", "2.5.29.31", "2.5.29.35", "2.5.29.37"
OCSP_SIGNING = "1.3.6.1.5.5.7.3.9"
WEAK = ("MD5", "SHA1")
#: What an interception proxy's certificate is named after.
PROXY_MARKERS = ("proxy", "inspection", "interception", "bluecoat", "zscaler", "fortinet", "palo alto", "mitm")
RESULT = "struct<is_valid:boolean,chain_length:int,anchor_dn:string,anchor_fingerprint:string,anchor_source:string,errors:array<string>,path:array<string>,interception:string>"


def node(der: bytes | None) -> dict:
    """What path search needs of a certificate (NODE); unreadable ones have readable = False and nulls."""
    import hashlib

    out = dict.fromkeys(x.split(":")[0] for x in NODE[7:-1].split(","))
    out |= {"readable": False, "crl_urls": []}
    if der is None:
        return out
    try:
        fields = values(values(values(der)[0][1])[0][1])
        fields = fields[1:] if fields[0][0] == 0xA0 else fields
        serial, algorithm, issuer, validity, subject, _ = fields[:6]
        before, after = (moment(t, v).timestamp() for t, v, _ in values(validity[1])[:2])
        sig = values(algorithm[1])
        known = {
            "subject": name(subject[1]), "issuer": name(issuer[1]), "subject_key": hashlib.sha256(subject[2]).hexdigest(), "issuer_key": hashlib.sha256(issuer[2]).hexdigest(), "serial": serial[1].hex().lstrip("0") or "0",
            "not_before": before, "not_after": after, "signature_hash": pss_digest(sig[1][1])[0] if oid(sig[0][1]) == PSS and len(sig) > 1 else HASHES.get(oid(sig[0][1]), "UNKNOWN"),
            "has_constraints": False, "is_ca": False, "may_sign": True, "ocsp_signing": False, "crl_urls": [],
        }
        for tag, content, _ in fields[6:]:
            if tag == 0xA3:
                for _, e, _ in values(values(content)[0][1]):
                    parts = values(e)
                    _extension(known, oid(parts[0][1]), values(parts[-1][1])[0])
        out |= known | {"readable": True}
    except (ValueError, IndexError, UnicodeDecodeError, OverflowError):
        pass
    return out


def _extension(out: dict, key: str, value: tuple[int, bytes, bytes]) -> None:
    tag, content, _ = value
    if key == KEY_ID:
        out["key_id"] = content.hex()
    elif key == AUTHORITY_ID:
        out["authority_id"] = next((v.hex() for t, v, _ in values(content) if t == 0x80), None)
    elif key == KEY_USAGE:
        out["may_sign"] = len(content) > 1 and bool(content[1] & 0x04)
    elif key == CONSTRAINTS:
        out["has_constraints"] = True
        for t, v, _ in values(content):
            if t == 1:
                out["is_ca"] = v != b"\0"
            elif t == 2:
                out["path_length"] = min(int.from_bytes(v, "big"), 2**31 - 1)
    elif key == CRL_POINTS:
        for _, point, _ in values(content):
            for t, names, _ in values(point):
                if t == 0xA0:
                    out["crl_urls"] += [v.decode("latin-1") for k, full, _ in values(names) if k == 0xA0 for u, v, _ in values(full) if u == 0x86]
    elif key == PURPOSES:
        out["ocsp_signing"] = any(oid(v) == OCSP_SIGNING for _, v, _ in values(content))


def pss_digest(parameters: bytes) -> tuple[str, int]:
    """(digest, salt length) of PSS parameters; SHA-1 and 20 where they are left out."""
    found, salt = "SHA1", 20
    for tag, content, _ in values(parameters):
        if tag == 0xA0:
            found = signatures.DIGEST_OIDS.get(oid(values(values(content)[0][1])[0][1]), "UNKNOWN")
        elif tag == 0xA2:
            salt = int.from_bytes(values(content)[0][1], "big")
    return found, salt


def checked(signed: bytes, algorithm: bytes, signature: bytes, key: bytes) -> str:
    """Whether a signature (content of its bit string) over `signed` is by the key of a SubjectPublicKeyInfo's content."""
    try:
        parts, (kind, bits) = values(algorithm), values(key)[:2]
        sig, kinds, raw = oid(parts[0][1]), values(kind[1]), bits[1][1:]
        owner = KEYS.get(oid(kinds[0][1]))
        if owner == "RSA":
            n, e = (int.from_bytes(x[1], "big") for x in values(values(raw)[0][1])[:2])
            if sig == PSS:
                digest, salt = pss_digest(parts[1][1] if len(parts) > 1 else b"")
                return signatures.rsa_pss(n, e, signature, digest, salt, signed)
            return signatures.rsa_pkcs1(n, e, signature, HASHES.get(sig, "?"), signed) if sig.startswith("1.2.840.113549.1.1.") else signatures.BAD
        if owner == "EC" and len(kinds) > 1:
            curve = CURVES.get(oid(kinds[1][1]), 0) if kinds[1][0] == 6 else 0
            if not sig.startswith("1.2.840.10045.4.") or raw[0] != 4:
                return signatures.UNSUPPORTED if raw[0] != 4 else signatures.BAD
            half = (len(raw) - 1) // 2
            r, s = (int.from_bytes(x[1], "big") for x in values(values(signature)[0][1])[:2])
            return signatures.ecdsa(curve, (int.from_bytes(raw[1 : 1 + half], "big"), int.from_bytes(raw[1 + half :], "big")), r, s, HASHES.get(sig, "?"), signed)
        return signatures.UNSUPPORTED
    except (ValueError, IndexError, OverflowError):
        return signatures.BAD


def issued(child: bytes, issuer: bytes) -> str:
    """good, bad or unsupported: the child's signature by the issuer's key."""
    try:
        signed, algorithm, signature = values(values(child)[0][1])[:3]
        fields = values(values(values(issuer)[0][1])[0][1])
        key = fields[6 if fields[0][0] == 0xA0 else 5]
    except (ValueError, IndexError):
        return signatures.BAD
    return checked(signed[2], algorithm[1], signature[1][1:], key[1])


def nodes(ders: DataFrame) -> DataFrame:
    """(fp, der, node) of the distinct certificates among ders (der), each read once; null ones are left out."""

    @F.pandas_udf(NODE)
    def read(der: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([node(bytes(x)) for x in der], columns=list(node(None)))

    one = ders.where("der is not null").select(F.sha2("der", 256).alias("fp"), "der").dropDuplicates(["fp"])
    return one.select("fp", "der", read("der").alias("node"))


def chain_id(ders: Column) -> Column:
    """The name of a presented chain: a hash of its certificates' hashes, in order; null and empty chains have none."""
    return F.when(F.size(ders) > 0, F.sha2(F.array_join(F.transform(ders, lambda x: F.sha2(x, 256)), ","), 256))


def _links(child: DataFrame, issuer: DataFrame, on: list) -> DataFrame:
    """child joined with those that may have issued it; the issuer's columns are called up_fp and up."""
    up = issuer.withColumnsRenamed({"fp": "up_fp", "node": "up"})
    same = (F.col("node.issuer_key") == F.col("up.subject_key")) & (F.col("fp") != F.col("up_fp"))
    ids = F.col("node.authority_id").isNull() | F.col("up.key_id").isNull() | (F.col("node.authority_id") == F.col("up.key_id"))
    return child.join(up, on, "inner").where(same & ids) if on else child.join(up, same & ids)


def self_issued(n: Column) -> Column:
    """Named and, where it tells, keyed as its own issuer."""
    return (n["subject_key"] == n["issuer_key"]) & (n["authority_id"].isNull() | n["key_id"].isNull() | (n["authority_id"] == n["key_id"]))


def chain_paths(chains: DataFrame, store: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(chain_id, leaf, paths) of distinct chains.

    chains: (chain_id, certificates: array of DER, leaf first). store: (der, source); INTERMEDIATE ones help to build
    paths, all others are trusted. leaf is the first certificate's node with its fingerprint. paths has every path to a
    trusted certificate as (source, certs), certs from the leaf up as (fp, node, sig), sig being the verdict on its
    signature by the next (null at the end). Repeated chains count once, null certificates are left out, a chain that
    is null or empty has no row. A chain's own certificates are matched within the chain only, so a subject that a
    million chains share joins no two of them. Levels of the search are written, since each is read twice.
    """
    seen = chains.where("chain_id is not null").select("chain_id", "certificates").dropDuplicates(["chain_id"])
    each = settled(seen.select("chain_id", F.posexplode("certificates").alias("pos", "der")).where("der is not null").withColumn("fp", F.sha2("der", 256)), "presented")
    known = settled(nodes(each.select("der").unionByName(store.select("der"))), "certificates")
    facts = known.select("fp", "node")
    sources = store.where("der is not null").select(F.sha2("der", 256).alias("fp"), "source").groupBy("fp").agg(F.min(F.when(F.col("source") != INTERMEDIATE, F.col("source"))).alias("root"))
    held = settled(sources.join(facts, "fp"), "store")
    presented = settled(each.select("chain_id", "pos", "fp").join(facts, "fp"), "nodes")
    leaf = presented.withColumn("r", F.struct("pos", "fp", "node")).groupBy("chain_id").agg(F.min_by(F.struct("fp", "node"), "pos").alias("leaf"))
    roots = held.where("root is not null").select("fp", F.col("root").alias("source"))

    # One step: a certificate and what may have issued it, in its own chain or in the store; signatures once an edge.
    own = presented.select("chain_id", "fp", "node").dropDuplicates(["chain_id", "fp"])
    in_chain = _links(own, own, ["chain_id"]).select("chain_id", "fp", "up_fp")
    store_links = _links(facts, held.select("fp", "node"), []).select("fp", "up_fp")
    ends = known.select("fp", "der")
    pairs = in_chain.select("fp", "up_fp").unionByName(store_links).distinct().join(ends, "fp").join(ends.withColumnsRenamed({"fp": "up_fp", "der": "up_der"}), "up_fp")

    @F.pandas_udf("string")
    def verdict(child: pd.Series, issuer: pd.Series) -> pd.Series:
        return pd.Series([issued(bytes(a), bytes(b)) for a, b in zip(child, issuer, strict=True)], dtype=object)

    edges = settled(pairs.select("fp", "up_fp", verdict("der", "up_der").alias("sig")), "signatures")
    chain_edges = settled(in_chain.join(edges, ["fp", "up_fp"]), "chain-edges")
    store_edges = settled(store_links.join(edges, ["fp", "up_fp"]), "store-edges")

    tip = F.col("leaf.fp")
    front = settled(leaf.select("chain_id", tip.alias("fp"), F.array(tip).alias("path"), F.array().cast("array<string>").alias("sigs"), F.coalesce(self_issued(F.col("leaf.node")), F.lit(True)).alias("ends")), "front")
    stops = facts.select("fp", F.coalesce(self_issued(F.col("node")), F.lit(True)).alias("ends"))
    ended = []
    for level in range(depth):
        ended.append(front.join(roots, "fp").select("chain_id", "source", "path", "sigs"))
        open_ = front.join(roots.select("fp"), "fp", "left_anti").where("not ends")
        if level == depth - 1 or open_.isEmpty():
            break
        up = open_.join(chain_edges, ["chain_id", "fp"]).select("chain_id", "path", "sigs", "up_fp", "sig").unionByName(open_.join(store_edges, "fp").select("chain_id", "path", "sigs", "up_fp", "sig"))
        up = up.where(~F.array_contains("path", F.col("up_fp"))).distinct()
        up = up.select("chain_id", F.col("up_fp").alias("fp"), F.concat("path", F.array("up_fp")).alias("path"), F.concat("sigs", F.array("sig")).alias("sigs"))
        front = settled(up.join(stops, "fp"), "front")
    found = ended[0]
    for x in ended[1:]:
        found = found.unionByName(x)
    # Nodes of a path's certificates, put back in order.
    step = found.withColumn("p", F.sha2(F.array_join("path", ","), 256)).select("chain_id", "source", "p", "sigs", F.posexplode("path").alias("i", "fp"))
    certs = step.join(facts, "fp").groupBy("chain_id", "source", "p").agg(F.array_sort(F.collect_list(F.struct("i", "fp", "node", F.get("sigs", F.col("i")).alias("sig")))).alias("certs"))
    paths = certs.groupBy("chain_id").agg(F.collect_list(F.struct("source", F.transform("certs", lambda c: F.struct(c["fp"].alias("fp"), c["node"].alias("node"), c["sig"].alias("sig"))).alias("certs"))).alias("paths"))
    return leaf.join(paths, "chain_id", "left")


def path_error(certs: Column, at: Column) -> Column:
    """struct(place, code) of the first thing wrong with a path at a time, from below the anchor down to the leaf; null if nothing is."""
    n = F.size(certs)

    def wrong(c: Column, i: Column) -> Column:
        x = c["node"]
        below = F.size(F.filter(F.slice(certs, F.lit(2), F.greatest(i - 1, F.lit(0))), lambda u: ~self_issued(u["node"])))  # between it and the leaf
        return (
            F.when(x["signature_hash"].isin(*WEAK), "WEAK_HASH_ALGO").when(c["sig"] == signatures.UNSUPPORTED, "VALIDATION_ERROR").when(c["sig"] == signatures.BAD, "PATH_VALIDATION_ERROR")
            .when(at < x["not_before"], "CERT_NOT_YET_VALID").when(at > x["not_after"], "CERT_EXPIRED").when((i > 0) & ~(x["is_ca"] & x["may_sign"]), "INVALID_CA_CERT").when((i > 0) & (x["path_length"] < below), "PATH_VALIDATION_ERROR")
        )

    tested = F.slice(certs, F.lit(1), F.greatest(n - 1, F.lit(0)))
    fault = lambda code, i: F.when(code.isNotNull(), F.struct(i.cast("int").alias("place"), code.alias("code")))
    found = F.transform(tested, lambda c, i: S.bound(wrong(c, i), lambda code: fault(code, i)))
    top = F.element_at(certs, -1)["node"]
    over = F.size(F.filter(F.slice(certs, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda u: ~self_issued(u["node"])))
    own = fault(F.when(top["path_length"] < over, "PATH_VALIDATION_ERROR"), n - 1)
    return F.coalesce(own, F.get(F.array_compact(F.reverse(found)), F.lit(0)))


def verdict(leaf: Column, paths: Column, at: Column, presented: Column, expected: tuple[str, ...] = ()) -> Column:
    """RESULT of a chain at a time (seconds since 1970).

    A path without faults counts before any other, then one whose fault is nearer to the leaf, then a shorter one, then by
    fingerprints. A leaf outside its dates is
    an error of its own. Without a path the chain is SELF_SIGNED_CERT or UNTRUSTED_ROOT. Proxy markers in the names of a
    faultless path tell of interception: AUTHORIZED_INTERCEPTION_PROXY if `expected` holds the anchor's fingerprint or a
    part of its name, else MITM_INTERCEPTION. A null time leaves dates untested.
    """
    x = leaf["node"]
    count, lone = F.coalesce(presented, F.lit(0)), self_issued(x)
    dates = F.when(at < x["not_before"], "CERT_NOT_YET_VALID").when(at > x["not_after"], "CERT_EXPIRED")
    said = lambda c: F.lower(F.concat_ws(" ", c["node"]["subject"], c["node"]["issuer"])).rlike("|".join(PROXY_MARKERS))

    def ranked(p: Column) -> Column:
        return S.bound(path_error(p["certs"], at), lambda e: F.struct(e.isNotNull().alias("bad"), e["place"].alias("place"), F.size(p["certs"]).alias("n"), F.transform(p["certs"], lambda c: c["fp"]).alias("fps"), e["code"].alias("error"), p["source"].alias("source"), F.element_at(p["certs"], -1)["node"]["subject"].alias("anchor"), F.exists(p["certs"], said).alias("proxy")))

    def told(best: Column) -> Column:
        has = best.isNotNull() & ~best["bad"]
        outcome = F.when(best.isNotNull(), best["error"]).when(lone, "SELF_SIGNED_CERT").otherwise("UNTRUSTED_ROOT")
        errors = F.when(count == 0, F.array(F.lit("EMPTY_CHAIN"))).when(~x["readable"], F.array(F.lit("INVALID_CERTIFICATE"))).otherwise(F.array_distinct(F.array_compact(F.array(dates, outcome))))
        allowed = F.lit(False)
        for e in expected:
            allowed = allowed | (F.element_at(best["fps"], -1) == e) | F.contains(F.lower(best["anchor"]), F.lit(e.lower()))
        return F.struct(
            (has & (F.size(errors) == 0)).alias("is_valid"), F.when(has, best["n"]).otherwise(count).cast("int").alias("chain_length"), F.when(has, best["anchor"]).alias("anchor_dn"), F.when(has, F.element_at(best["fps"], -1)).alias("anchor_fingerprint"),
            F.when(has, best["source"]).when(F.array_contains(errors, "SELF_SIGNED_CERT"), "self_signed").otherwise("untrusted").alias("anchor_source"), errors.alias("errors"), F.when(has, best["fps"]).otherwise(F.array().cast("array<string>")).alias("path"),
            F.when(has & best["proxy"], F.when(F.coalesce(allowed, F.lit(False)), "AUTHORIZED_INTERCEPTION_PROXY").otherwise("MITM_INTERCEPTION")).alias("interception"),
        ).cast(RESULT)

    return S.bound(F.array_min(F.transform(paths, ranked)), told)


def validated(sessions: DataFrame, store: DataFrame, certificates: str = "tls.certificates", at: str = "first_seen", expected: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """sessions with chain_id, leaf (fp, node) and chain (RESULT): each chain as of the session's own time.

    Every session stays; one without certificates has the error EMPTY_CHAIN. The join is by chain_id against one row a
    distinct chain, which adaptive execution may broadcast or split where one chain is most sessions'. Columns named
    chain_id, leaf or chain are replaced.
    """
    ders = F.col(certificates)
    mine = sessions.drop("chain_id", "leaf", "chain").withColumn("chain_id", chain_id(ders))
    paths = chain_paths(mine.select("chain_id", ders.alias("certificates")), store, depth)
    return judged(mine.withColumn("__shown", F.size(ders)), paths, "__shown", at, expected).drop("__shown")


def judged(sessions: DataFrame, paths: DataFrame, shown: str, at: str = "first_seen", expected: tuple[str, ...] = ()) -> DataFrame:
    """sessions, which name their chain (chain_id, null for none) and how many certificates it has (column `shown`), with leaf and chain.

    paths: what chain_paths() tells of these chains. Sessions need not hold their certificates, so a chain that many show
    is carried once. Columns named leaf or chain are replaced.
    """
    out = sessions.drop("leaf", "chain").join(settled(paths, "paths").withColumnRenamed("paths", "__paths"), "chain_id", "left")
    size = F.when(F.col("chain_id").isNotNull(), F.col(shown)).otherwise(0)
    return out.withColumn("chain", verdict(F.col("leaf"), F.col("__paths"), F.col(at), size, expected)).drop("__paths")
