"""Feature columns of a decoded session: cipher, extension, parameter, metadata and behaviour profiles, hashed fingerprints.

What is not known is null, never a plausible constant: certificates that cannot be observed, names hidden by encrypted
hellos, timing of fewer than two chunks.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import quantiles
from ..sources.dims import cipher_facts
from . import scalars as S

#: Extensions of the presence bitmap, by number; dialogue states in order; ports that count as standard.
BITMAP = (0, 5, 10, 11, 13, 15, 16, 17, 18, 21, 22, 23, 27, 28, 35, 41, 42, 43, 44, 45, 49, 50, 51, 65281)
STATES = ("S0_TCP_EST", "S1_GREETING", "S1B_CAPS_ADV", "S2_CMD", "S2_ACCEPTED", "S3_TLS_HS", "S4_ENCRYPTED", "S_REFUSED", "S_STRIP_DETECTED")
PORTS = (25, 110, 143, 465, 587, 993, 995)
HASHED = 32


def with_suites(sessions: DataFrame, suites: DataFrame) -> DataFrame:
    """sessions with __suites: facts by number, in one row that goes to every task (the registry has some hundred rows)."""
    number = F.conv(F.regexp_replace(F.lower("id"), "^0x", ""), 16, 10).cast("int")
    facts = suites.select(number.alias("k"), cipher_facts(F.col("name")).alias("v")).dropDuplicates(["k"])
    one = facts.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__suites"))
    return sessions.join(F.broadcast(one), F.lit(True))


def families_entropy(facts: Column) -> Column:
    """Entropy of the cipher families among offered suites, in bits."""
    enc = lambda f: F.upper(F.coalesce(f["enc"], F.lit("")))
    family = lambda f: F.when(f.isNull(), "UNKNOWN").when(enc(f).contains("GCM"), "AES-GCM").when(enc(f).contains("CHACHA"), "CHACHA20").when(enc(f).contains("CBC"), "AES-CBC").when(enc(f).contains("DES"), "3DES").when(enc(f).contains("RC4"), "RC4").when(enc(f).contains("NULL"), "NULL").otherwise("OTHER")
    names = F.transform(facts, family)
    shares = F.transform(F.array_distinct(names), lambda x: F.size(F.filter(names, lambda y: y == x)) / F.size(names))
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def moments(values: Column) -> dict[str, Column]:
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n)
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return {"mean": mean, "std": F.when(n > 0, F.sqrt(var)), "min": F.array_min(values), "max": F.array_max(values)}


def hashed(document: Column, size: int = HASHED) -> Column:
    """Token counts in `size` buckets, scaled to length 1. Tokens are lower-cased words of two characters or more; null and empty texts give zeros.

    A text is split and hashed once, whatever its length, then counted once a bucket.
    """
    words = F.filter(F.split(F.lower(F.coalesce(document, F.lit(""))), r"\W+"), lambda t: F.length(t) >= 2)
    at = F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(size)))
    counts = S.bound(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double")))

    def scaled(c: Column) -> Column:
        norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        return S.bound(norm, lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return S.bound(counts, scaled)


def features(sessions: DataFrame, suites: DataFrame) -> DataFrame:
    """(id, one DOUBLE column a feature, fp_document, fp_hash) of decoded sessions.

    Columns of sources and scores are used where sessions have them: n_sessions, n_sni, is_beacon, risk_score, cert.
    """
    s = with_suites(sessions, suites)
    has = set(sessions.columns)
    opt = lambda name, kind="double": F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)
    c = lambda f: F.col(f"tls.client_hello.{f}")
    a = lambda f: F.col(f"tls.server_hello.{f}")
    d = lambda x: x.cast("double")
    offered, exts = S.strip_grease(c("cipher_suites")), S.strip_grease(c("ext_order"))
    s = s.withColumn("__offered", offered).withColumn("__facts", F.transform("__offered", lambda x: F.try_element_at("__suites", x))).withColumn("__exts", exts)
    n, facts = F.size("__offered"), F.col("__facts")
    bits = F.transform(facts, lambda f: F.coalesce(f["enc_bits"], F.lit(128)).cast("double"))
    any_of = lambda p: d(F.exists(facts, lambda f: F.coalesce(p(f), F.lit(False))))
    share = lambda p: F.when(n > 0, F.size(F.filter(facts, lambda f: F.coalesce(p(f), F.lit(False)))) / n).otherwise(0.0)
    out: dict[str, Column] = {"ciph_n_offered": d(n), "ciph_n_grease": d(F.coalesce(F.size(c("cipher_suites")), F.lit(0)) - n)}
    for i in range(5):
        out[f"ciph_top{i + 1}_id"] = d(F.coalesce(F.get("__offered", F.lit(i)), F.lit(0)))
    out |= {
        "ciph_mean_strength": moments(bits)["mean"], "ciph_min_strength": F.array_min(bits), "ciph_offers_3des": any_of(lambda f: f["enc"].contains("3DES")), "ciph_offers_rc4": any_of(lambda f: f["enc"].contains("RC4")), "ciph_offers_null": any_of(lambda f: f["null_enc"]),
        "ciph_pct_aead": share(lambda f: f["aead"]), "ciph_pct_pfs": share(lambda f: f["pfs"]), "ciph_list_entropy": families_entropy(facts),
    }
    ech, sni = F.array_contains("__exts", 0xFE0D), F.nullif(c("server_name"), F.lit(""))
    first = F.get(c("alpn_protocols"), F.lit(0))
    clear = lambda x: F.when(~ech, x)
    out |= {
        "ext_bitmap_24": d(S.extension_bitmap(F.col("__exts"), list(BITMAP))), "ext_count": d(F.size("__exts")), "ext_order_hash": S.order_hash(F.col("__exts")), "ext_has_sni": clear(d(sni.isNotNull())), "ext_sni_is_ip": clear(d(F.coalesce(S.is_ipv4(sni), F.lit(False)))),
        "ext_sni_entropy": clear(S.char_entropy(sni)), "ext_sni_label_count": clear(F.when(sni.isNotNull(), d(F.size(F.split(sni, r"\.")))).otherwise(0.0)), "ext_has_alpn": d(first.isNotNull()), "ext_alpn_hash": F.coalesce(d(S.hash16(first)), F.lit(0.0)), "ext_has_padding": d(F.array_contains("__exts", 21)),
    }
    cert = F.col("cert") if "cert" in has else F.lit(None).cast("struct<public_key_bits:int,signature_hash:string,lifetime_days:int,is_self_signed:boolean,san_count:int>")
    seen = lambda x: F.when(F.col("tls.certificates_observable"), x)
    out |= {
        "crypto_selected_version": d(a("selected_version")), "crypto_selected_cipher": d(a("selected_cipher")), "crypto_kex_group": d(F.get(S.strip_grease(c("supported_groups")), F.lit(0))), "crypto_pubkey_bits": seen(d(cert["public_key_bits"])), "crypto_sig_alg": seen(d(S.hash16(cert["signature_hash"]))),
        "crypto_cert_chain_len": seen(d(F.size("tls.certificates"))), "crypto_cert_lifetime_days": seen(d(cert["lifetime_days"])), "crypto_is_self_signed": seen(d(cert["is_self_signed"])), "crypto_san_count": seen(d(cert["san_count"])), "crypto_risk_score": opt("risk_score"),
    }
    times = F.transform("chunks", lambda x: x["ts"])
    gaps = F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda y, x: y - x)
    sizes = F.transform("chunks", lambda x: F.length(x["data"]).cast("double"))
    out |= {"meta_total_hs_bytes": d(F.col("c2s_bytes") + F.col("s2c_bytes")), "meta_n_hs_packets": d(F.col("c2s_packets") + F.col("s2c_packets"))}
    out |= {f"meta_pkt_size_{k}": v for k, v in moments(sizes).items()} | {f"meta_iat_{k}": v for k, v in moments(gaps).items()}
    state = F.array_position(F.array(*map(F.lit, STATES)), F.col("fsm.state"))
    out |= {
        "meta_hs_duration_ms": d(F.col("fsm.upgrade_latency_ms")), "meta_tcp_retrans_count": d(F.col("quality.retrans_count")), "meta_tcp_overlap_count": d(F.col("quality.overlap_count")),
        "beh_starttls_state": F.when(state > 0, d(state - 1)), "beh_sessions_from_src": opt("n_sessions"), "beh_distinct_sni_per_src": opt("n_sni"), "beh_dst_port": d(F.col("server_port")), "beh_port_is_standard_mail": d(F.col("server_port").isin(*PORTS)),
        "beh_bytes_up_down_ratio": F.col("c2s_bytes") / F.greatest(F.col("s2c_bytes"), F.lit(1)), "beh_session_duration_s": F.col("last_seen") - F.col("first_seen"), "beh_is_periodic": opt("is_beacon"),
    }
    document = S.fingerprint_document(*[F.col(k) if k in has else F.lit(None).cast("string") for k in ("ja3", "ja3s", "ja4", "ja4s")])
    keys = [k for k in ("id", "capture_id", "client_ip", "client_port", "server_ip", "first_seen") if k in has]
    return s.select(*[F.col(k).alias(f"key_{k}") for k in keys], *[v.alias(k) for k, v in out.items()], document.alias("fp_document"), hashed(document).alias("fp_hash"))


def imputed(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls become the feature's median over all rows (exact, selected by refined ranges; a feature without values stays null)."""
    medians = {n: v for n, (v,) in quantiles(df, names, [0.5]).items()}
    return df.select(*[F.coalesce(F.col(c), F.lit(medians[c]).cast("double")).alias(c) if c in names else F.col(c) for c in df.columns])


def normal_scores(df: DataFrame, names: list[str], quantile_count: int = 100) -> DataFrame:
    """Each feature mapped by its own quantiles to the normal distribution; ends are held at +-5.2, constants give 0."""
    probs = [i / (quantile_count - 1) for i in range(quantile_count)]
    row = {n: None if v[0] is None else v for n, v in quantiles(df, names, probs).items()}  # names x quantiles numbers
    grids = {n: np.array(row[n], float) if row[n] else None for n in names}
    inverse = np.vectorize(NormalDist().inv_cdf, otypes=[float])

    def mapped(name: str):
        grid = grids[name]

        @F.pandas_udf("double")
        def run(x: pd.Series) -> pd.Series:
            if grid is None or grid[0] == grid[-1]:
                return x * 0.0
            # Ties: the middle of the run of equal quantiles.
            up = np.interp(x, grid, probs)
            down = 1 - np.interp(-x, -grid[::-1], probs)
            return pd.Series(inverse(np.clip((up + down) / 2, 1e-7, 1 - 1e-7))).where(x.notna())

        return run(F.col(name))

    return df.select(*[mapped(c).alias(c) if c in names else F.col(c) for c in df.columns])
