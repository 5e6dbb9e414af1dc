"""Small dimensions: cipher suites from their registered names, port overrides, transport policies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import domain


def cipher_facts(name: Column) -> Column:
    """What a registered suite name says: TLS_<kex>_WITH_<cipher>_<hash>, or TLS_<cipher>_<hash> for TLS 1.3.

    All fields come from the name by rule; a null or unknown name gives a null struct.
    """
    n = F.upper(name)
    modern = ~n.contains("_WITH_")
    front = F.when(modern, F.lit("TLS13")).otherwise(F.regexp_replace(F.substring_index(n, "_WITH_", 1), "^(TLS|SSL)_", ""))
    back = F.when(modern, F.regexp_replace(n, "^TLS_", "")).otherwise(F.substring_index(n, "_WITH_", -1))
    last = F.regexp_extract(back, r"_([A-Z0-9]+)$", 1)
    aead = modern | back.rlike("GCM|CCM|POLY1305")
    hsh = F.when(last == "SHA", "SHA1").when(last.rlike("^(SHA256|SHA384|SHA512|MD5)$"), last).otherwise("SHA256")
    enc = F.when(aead & ~last.rlike("^SHA"), back).otherwise(F.regexp_replace(back, r"_[A-Z0-9]+$", ""))
    bits = (
        F.when(back.startswith("NULL"), 0).when(back.rlike("RC4_40|DES40|RC2_CBC_40"), 40).when(back.rlike("3DES|EDE"), 112).when(back.startswith("DES"), 56)
        .when(back.contains("CHACHA20") | back.contains("256_"), 256).otherwise(128)
    )
    kex = F.when(modern, "ECDHE").when(front.startswith("ECDHE"), "ECDHE").when(front.startswith("DHE"), "DHE").when(front.startswith("DH_ANON"), "DH_ANON").when(front.startswith("ECDH_"), "ECDH").when(front.startswith("DH_"), "DH").otherwise(F.substring_index(front, "_", 1))
    return F.when(n.startswith("TLS_") | n.startswith("SSL_"), F.struct(
        name.alias("name"), enc.alias("enc"), bits.cast("int").alias("enc_bits"), F.when(aead, "AEAD").otherwise(F.concat(F.lit("HMAC-"), hsh)).alias("mac"), hsh.alias("hash"), kex.alias("kex"), aead.alias("aead"),
        front.contains("ANON").alias("anon"), front.contains("EXPORT").alias("export"), back.startswith("NULL").alias("null_enc"), kex.isin("ECDHE", "DHE").alias("pfs"),
    ))


def with_cipher(sessions: DataFrame, suites: DataFrame, ident: str = "cipher_id") -> DataFrame:
    """sessions with the struct of their suite, from suites (id, name); ids compare in any case, unknown ones get null."""
    s = suites.select(F.lower("id").alias("__id"), cipher_facts(F.col("name")).alias("cipher"))
    return sessions.join(s, F.lower(F.col(ident)) == F.col("__id"), "left").drop("__id")


def read_suites(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) from a JSON object of suites by id."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<id:string,name:string>>")).alias("k", "v"))
    return raw.select("v.id", "v.name")


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """(domain, mode) from one configuration file: a list of objects, an object of objects, or an object of modes."""
    found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    if isinstance(found, dict):
        found = [{"domain": k, **(v if isinstance(v, dict) else {"mode": v})} for k, v in found.items()]
    rows = spark.createDataFrame([(r["domain"], r["mode"]) for r in found], "domain string, mode string")
    return rows.select(domain(F.col("domain")).alias("domain"), F.lower("mode").alias("mode"))
