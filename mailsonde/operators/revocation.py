"""Revocation as of a moment: lists and stapled answers, each judged by its own period.

A list counts from its date until the date of its next one. Sessions meet the lists of their leaf's addresses in an
interval join; of those in force the newest of each address decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures
from ..sources.trust import settled
from . import chains
from .certificates import KEYS, moment, oid, values
from .relational import interval_join

LISTS = "list_id string, url_sha256 string, issuer_key string, this_update double, next_update double, entries long"
ENTRIES = "list_id string, serial string, revoked_at double"
_BOTH = "list_id string, url_sha256 string, issuer_key string, this_update double, next_update double, entries long, serial string, revoked_at double"
STAPLED = "struct<readable:boolean,successful:boolean,status:string,this_update:double,next_update:double,authorised:boolean>"
#: Entries of one record batch of the reader.
BATCH = 10_000


def _values(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, content) of the values that follow each other, one at a time: a list may hold millions."""
    at = 0
    while at < len(data):
        size, head = data[at + 1], 2
        if size & 0x80:
            head += size & 0x7F
            size = int.from_bytes(data[at + 2 : at + head], "big")
        if at + head + size > len(data):
            raise ValueError("a value is cut short")
        yield data[at], data[at + head : at + head + size]
        at += head + size


def hex_serial(data: bytes) -> str:
    return data.hex().lstrip("0") or "0"


def revocation_list(der: bytes) -> tuple[str, float, float | None, bytes]:
    """(issuer's key, this update, next update, entries as DER content) of a list; ValueError or IndexError if it is none."""
    fields = values(values(values(der)[0][1])[0][1])
    fields = fields[1:] if fields[0][0] == 2 else fields
    _, issuer, this = fields[:3]
    rest = fields[3:]
    following = moment(*rest.pop(0)[:2]).timestamp() if rest and rest[0][0] in (23, 24) else None
    body = rest[0][1] if rest and rest[0][0] == 0x30 else b""
    return hashlib.sha256(issuer[2]).hexdigest(), moment(*this[:2]).timestamp(), following, body


def read_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lists, entries) of the files under path: LISTS and ENTRIES.

    A file is named after the SHA-256 of the address it came from; list_id is its content's hash, so copies of one list
    under one address are one. Files that are no list give no rows. Serial numbers are hex without leading zeros.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.float64())
        names = [x.split(" ")[0] for x in _BOTH.split(", ")]
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                der = data.as_py()
                try:
                    issuer, this, following, body = revocation_list(der)
                    ident, n, rows = hashlib.sha256(der).hexdigest(), 0, []
                    for _, entry in _values(body):
                        serial, when = list(_values(entry))[:2]
                        rows.append((ident, None, None, None, None, None, hex_serial(serial[1]), moment(*when).timestamp()))
                        n += 1
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                    rows.append((ident, file.rsplit("/", 1)[-1].split(".")[0].lower(), issuer, this, following, n, None, None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                except (ValueError, IndexError, OverflowError, UnicodeDecodeError):
                    continue  # entries without a list match nothing

    both = settled(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(scan, _BOTH), "revocation-lists")
    lists = both.where("serial is null").select(*[x.split(" ")[0] for x in LISTS.split(", ")]).dropDuplicates(["list_id", "url_sha256"])
    return lists, both.where("serial is not null").select("list_id", "serial", "revoked_at").dropDuplicates(["list_id", "serial"])


def listed(asked: DataFrame, lists: DataFrame, entries: DataFrame) -> DataFrame:
    """(fp, at, crl_status, revoked_at) of (fp, serial, crl_urls, at): a certificate's state at a time.

    REVOKED if the newest list in force of any of its addresses holds its serial number, GOOD if one is in force and none
    does, UNKNOWN without one. A list is in force from its date to its next one's, both included; without a next date for
    ever. Of lists of one date the one whose entries hold the serial number counts. Null times are UNKNOWN, repeated
    questions are answered once.
    """
    one = asked.select("fp", "serial", "crl_urls", "at").where("fp is not null and at is not null").dropDuplicates(["fp", "at"])
    points = one.select("fp", "serial", "at", F.explode("crl_urls").alias("url")).select("fp", "serial", "at", F.sha2("url", 256).alias("url_sha256")).distinct()
    spans = lists.select("url_sha256", "list_id", F.col("this_update").alias("from"), F.col("next_update").alias("until"))
    met = interval_join(points, spans, ["url_sha256"], "at", "from", "until")
    found = met.join(entries, ["list_id", "serial"], "left")
    newest = found.groupBy("fp", "at", "url_sha256").agg(F.max(F.struct("from", F.col("revoked_at").isNotNull().alias("hit"), "revoked_at")).alias("m"))
    state = newest.groupBy("fp", "at").agg(F.max("m.hit").alias("hit"), F.min(F.when(F.col("m.hit"), F.col("m.revoked_at"))).alias("revoked_at"))
    out = one.select("fp", "at").join(state, ["fp", "at"], "left")
    return out.select("fp", "at", F.when(F.col("hit"), "REVOKED").when(~F.col("hit"), "GOOD").otherwise("UNKNOWN").alias("crl_status"), "revoked_at")


def stapled(response: bytes | None, leaf: bytes | None, issuer: bytes | None) -> dict:
    """What a stapled answer says of the leaf (STAPLED).

    authorised: the signature is by the leaf's issuer, or by a certificate in the answer that the issuer signed for this
    purpose. An answer about another serial number tells nothing of the leaf: its status is UNKNOWN.
    """
    out = {"readable": False, "successful": False, "status": None, "this_update": None, "next_update": None, "authorised": False}
    try:
        parts = values(values(response)[0][1])
        out["successful"] = parts[0][1] == b"\0"
        if not out["successful"]:
            return out | {"readable": True}
        basic = values(values(values(values(parts[1][1])[0][1])[1][1])[0][1])
        signed, algorithm, signature = basic[:3]
        data = [x for x in values(signed[1]) if x[0] != 0xA0]
        serial = chains.node(leaf)["serial"]
        answers = [values(x[1]) for x in values(data[2][1])]
        mine = next((a for a in answers if hex_serial(values(a[0][1])[3][1]) == serial), answers[0])
        same = hex_serial(values(mine[0][1])[3][1]) == serial
        out |= {"readable": True, "status": {0x80: "GOOD", 0xA1: "REVOKED"}.get(mine[1][0], "UNKNOWN") if same else "UNKNOWN", "this_update": moment(*mine[2][:2]).timestamp()}
        if len(mine) > 3 and mine[3][0] == 0xA0:
            out["next_update"] = moment(*values(mine[3][1])[0][:2]).timestamp()
        signers = [] if issuer is None else [issuer]
        for _, content, _ in basic[3:4]:
            signers += [c for _, _, c in values(values(content)[0][1]) if issuer is not None and chains.node(c)["ocsp_signing"] and chains.issued(c, issuer) == signatures.GOOD]
        for s in signers:
            fields = values(values(values(s)[0][1])[0][1])
            key = fields[6 if fields[0][0] == 0xA0 else 5][1]
            out["authorised"] |= oid(values(values(key)[0][1])[0][1]) in KEYS and chains.checked(signed[2], algorithm[1], signature[1][1:], key) == signatures.GOOD
    except (ValueError, IndexError, OverflowError, UnicodeDecodeError, TypeError):
        pass
    return out


def stapled_status(answer: Column, at: Column) -> Column:
    """GOOD, REVOKED, UNAUTHORIZED, EXPIRED or UNKNOWN: a stapled answer as of a time."""
    stale = (at < answer["this_update"]) | (at > answer["next_update"])
    return F.when(answer.isNull() | ~answer["readable"] | ~answer["successful"], "UNKNOWN").when(F.coalesce(stale, F.lit(False)), "EXPIRED").when(~answer["authorised"], "UNAUTHORIZED").otherwise(F.coalesce(answer["status"], F.lit("UNKNOWN")))


def with_revocation(sessions: DataFrame, lists: DataFrame, entries: DataFrame, certificates: str = "tls.certificates", staple: str | None = "tls.stapled_ocsp", at: str = "first_seen") -> DataFrame:
    """Validated sessions (chains.validated) whose chain also has ocsp_status, crl_status, revoked_at and findings.

    A stapled answer that is definite or faulty keeps lists from being asked, as long as its status is not UNKNOWN.
    Revoked leaves lose is_valid and get OCSP_REVOKED or CRL_REVOKED among their errors. Each distinct answer is read
    once, each leaf and time looked up once; every session stays.
    """
    if staple:

        @F.pandas_udf(STAPLED)
        def read(response: pd.Series, leaf: pd.Series, issuer: pd.Series) -> pd.DataFrame:
            raw = lambda x: None if x is None else bytes(x)
            return pd.DataFrame([stapled(*map(raw, x)) for x in zip(response, leaf, issuer, strict=True)], columns=list(stapled(None, None, None)))

        ders = F.col(certificates)
        s = sessions.withColumn("__answer", F.when(F.col(staple).isNotNull() & (F.size(ders) > 0), F.sha2(F.concat(F.sha2(staple, 256), F.lit(","), F.col("chain_id")).cast("binary"), 256)))
        each = s.where("__answer is not null").select("__answer", F.col(staple).alias("response"), F.get(ders, F.lit(0)).alias("leaf"), F.get(ders, F.lit(1)).alias("issuer")).dropDuplicates(["__answer"])
        s = s.join(each.select("__answer", read("response", "leaf", "issuer").alias("__stapled")), "__answer", "left")
    else:
        s = sessions.withColumn("__answer", F.lit(None).cast("string")).withColumn("__stapled", F.lit(None).cast(STAPLED))
    s = s.withColumn("__ocsp", stapled_status(F.col("__stapled"), F.col(at)))
    asked = s.where("__ocsp = 'UNKNOWN'").select(F.col("leaf.fp").alias("fp"), F.col("leaf.node.serial").alias("serial"), F.col("leaf.node.crl_urls").alias("crl_urls"), F.col(at).alias("at"))
    state = listed(asked, lists, entries).withColumnsRenamed({"fp": "__fp", "at": "__at", "crl_status": "__crl", "revoked_at": "__revoked"})
    s = s.join(state, (F.col("leaf.fp") == F.col("__fp")) & (F.col(at) == F.col("__at")) & (F.col("__ocsp") == "UNKNOWN"), "left").withColumn("__crl", F.coalesce("__crl", F.lit("UNKNOWN")))
    code = F.when(F.col("__ocsp") == "REVOKED", "OCSP_REVOKED").when(F.col("__crl") == "REVOKED", "CRL_REVOKED")
    finding = (
        F.when(F.col("__stapled").isNotNull() & ~F.col("__stapled.readable"), "OCSP_MALFORMED").when(F.col("__ocsp") == "EXPIRED", "OCSP_STALE").when(F.col("__ocsp") == "UNAUTHORIZED", "OCSP_UNAUTHORIZED_RESPONDER")
        .when(F.col("__ocsp") == "REVOKED", "CERT_OCSP_REVOKED").when(F.col("__crl") == "REVOKED", "CERT_CRL_REVOKED")
    )
    more = {"is_valid": F.col("chain.is_valid") & code.isNull(), "errors": F.concat("chain.errors", F.array_compact(F.array(code))), "ocsp_status": F.col("__ocsp"), "crl_status": F.col("__crl"), "revoked_at": F.col("__revoked"), "findings": F.array_compact(F.array(F.col("chain.interception"), finding))}
    chain = F.col("chain")
    for k, v in more.items():
        chain = chain.withField(k, v)
    return s.withColumn("chain", chain).drop("__answer", "__stapled", "__ocsp", "__fp", "__at", "__crl", "__revoked")
