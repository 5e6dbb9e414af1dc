"""Overview aggregates: histograms, health, trends, key figures, compliance, custody bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import band

BANDS = ("SECURE", "ACCEPTABLE", "WEAK", "HIGH_RISK", "CRITICAL")
ENCRYPTED = ("S4_ENCRYPTED", "S3_TLS_HS")
STRIPPED = ("S_STRIP_DETECTED",)


def _is(states) -> Column:
    return F.col("starttls_state").isin(*states)


def _dimension(df: DataFrame, name: str, values) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} string")


def zero_filled(counts: DataFrame, name: str, values) -> DataFrame:
    """One row a value of the dimension; absent ones count 0."""
    numbers = [c for c in counts.columns if c != name]
    return F.broadcast(_dimension(counts, name, values)).join(counts, name, "left").select(name, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def band_histogram(sessions: DataFrame) -> DataFrame:
    return zero_filled(sessions.groupBy(band(F.col("risk_score")).alias("band")).agg(F.count("*").alias("n")), "band", BANDS)


def overall_risk(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.coalesce(F.max("risk_score"), F.lit(0)).alias("overall")).withColumn("band", band(F.col("overall")))


def kpis(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("n_sessions"), F.max("risk_score").alias("max_risk"), F.avg("risk_score").alias("avg_risk"), F.count_distinct("client_ip").alias("n_clients"), F.count_distinct("server_ip").alias("n_servers"),
        F.sum("bytes").alias("bytes"), F.count_if(_is(ENCRYPTED)).alias("n_encrypted"), F.count_if(_is(STRIPPED)).alias("n_stripped"), F.count_if("is_anomaly").alias("n_anomalies"), F.count_if(F.col("risk_score") >= 80).alias("n_critical"),
    )


def mx_health(sessions: DataFrame, top: int | None = 7) -> DataFrame:
    """Per mail exchanger (server name, else address): encrypted and stripped shares in percent, worst first."""
    mx = F.coalesce(F.nullif("sni", F.lit("")), F.col("server_ip"))
    g = sessions.groupBy(mx.alias("mx")).agg(F.count("*").alias("total"), F.count_if(_is(ENCRYPTED)).alias("encrypted"), F.count_if(_is(STRIPPED)).alias("stripped"))
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col("total"), 2)
    g = g.withColumns({"encrypted_pct": pct("encrypted"), "stripped_pct": pct("stripped")})
    return g.orderBy("encrypted_pct", F.desc("total"), "mx").limit(top) if top else g


def protocol_states(sessions: DataFrame, protocols=("SMTP", "IMAP", "POP3")) -> DataFrame:
    """Protocol by encrypted, stripped and plain; the named protocols are there even without sessions."""
    g = sessions.groupBy("protocol").agg(F.count_if(_is(ENCRYPTED)).alias("encrypted"), F.count_if(_is(STRIPPED)).alias("stripped"), F.count_if(~_is(ENCRYPTED) & ~_is(STRIPPED)).alias("plain"))
    both = g.unionByName(_dimension(g, "protocol", protocols).select("protocol", *[F.lit(0).cast("long").alias(c) for c in ("encrypted", "stripped", "plain")]))
    return both.groupBy("protocol").agg(*[F.sum(c).alias(c) for c in ("encrypted", "stripped", "plain")])


def fingerprint_frequency(sessions: DataFrame, top: int | None = 5) -> DataFrame:
    g = sessions.where(F.coalesce("ja3", F.lit("")) != "").groupBy("ja3").agg(F.count("*").alias("n"), F.min("first_seen").alias("first_seen"), F.max("first_seen").alias("last_seen"))
    return g.orderBy(F.desc("n"), "ja3").limit(top) if top else g


def trend(sessions: DataFrame, buckets: int = 24) -> DataFrame:
    """Buckets of equal width over the period; all are there, and the last takes the latest session as well."""
    bounds = sessions.agg(F.min("first_seen").alias("t0"), F.greatest((F.max("first_seen") - F.min("first_seen")) / buckets, F.lit(1.0)).alias("width"))
    at = F.least(F.floor((F.col("first_seen") - F.col("t0")) / F.col("width")), F.lit(buckets - 1)).cast("int")
    g = sessions.join(F.broadcast(bounds), F.lit(True)).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"), F.avg("risk_score").alias("avg_risk"), F.count_if(F.col("risk_score") >= 80).alias("critical"), F.count_if(_is(STRIPPED)).alias("stripped"))
    every = sessions.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(g, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "avg_risk", "critical", "stripped")])


def period(sessions: DataFrame) -> DataFrame:
    good = F.when(F.col("first_seen") > 0, F.col("first_seen"))
    return sessions.agg(F.min(good).alias("starts"), F.max(good).alias("ends"))


def dominant(sessions: DataFrame, column: str) -> DataFrame:
    return sessions.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1)


def takeaways(sessions: DataFrame) -> DataFrame:
    """Sentences over the key figures; those that do not apply are left out."""
    k = kpis(sessions)
    pct = lambda c: F.round(F.col(c) * 100.0 / F.greatest(F.col("n_sessions"), F.lit(1)), 1)
    says = F.array_compact(F.array(
        F.format_string("%d sessions from %d clients to %d servers", "n_sessions", "n_clients", "n_servers"),
        F.when(F.col("n_encrypted") > 0, F.format_string("%.1f%% of sessions are encrypted", pct("n_encrypted"))),
        F.when(F.col("n_stripped") > 0, F.format_string("%d sessions show a stripped upgrade", "n_stripped")),
        F.when(F.col("n_critical") > 0, F.format_string("%d sessions are critical", "n_critical")),
    ))
    return k.select(F.posexplode(says).alias("position", "sentence"))


def top_remediations(findings: DataFrame, n: int = 5) -> DataFrame:
    g = findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.min(F.struct("finding_id", "title", "severity")).alias("first"))
    return g.orderBy(F.desc("n"), "rule_id").limit(n).select("rule_id", "n", F.col("first.title").alias("title"), F.col("first.severity").alias("severity"))


def compliance(sessions: DataFrame, controls: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per control (applies, fails): counts, the first ten failing ids and PASS, FAIL or NA; one pass over the sessions."""
    rows = []
    for name, (applies, fails) in controls.items():
        rows.append(F.struct(F.lit(name).alias("control"), F.coalesce(applies, F.lit(False)).alias("applies"), F.coalesce(applies & fails, F.lit(False)).alias("fails")))
    each = sessions.select("id", F.explode(F.array(*rows)).alias("c")).select("id", "c.*")
    ranked = each.where("fails").withColumn("r", F.row_number().over(Window.partitionBy("control").orderBy("id"))).where("r <= 10")
    ids = ranked.groupBy("control").agg(F.array_sort(F.collect_list("id")).alias("failing_ids"))
    counts = each.groupBy("control").agg(F.count_if("applies").alias("n_applies"), F.count_if("fails").alias("n_fails"))
    status = F.when(F.col("n_applies") == 0, "NA").when(F.col("n_fails") > 0, "FAIL").otherwise("PASS")
    return counts.join(ids, "control", "left").select("control", "n_applies", "n_fails", F.coalesce("failing_ids", F.array().cast("array<long>")).alias("failing_ids"), status.alias("status"))


#: The six controls' names, in order, and the states in which nothing was encrypted.
CONTROLS = ("NIST-800-52r2-3.1", "NIST-800-52r2-3.3.1", "NIST-800-57-5.6.1", "PCI-DSS-4.2.1", "RFC-8461-MTA-STS", "RFC-7672-DANE")
UNPROTECTED = ("S_PLAINTEXT", "S_REFUSED")


def mail_controls(dane: Column | None = None) -> dict[str, tuple[Column, Column]]:
    """The six controls for compliance(), over scored sessions (components, vetoes, band, starttls_state, protocol).

    Versions, suites, strength of 112 bits, risk (HIGH_RISK and CRITICAL) or stripping, and for SMTP alone a policy that is kept and TLSA records.
    dane: false where a session's records do not match; without it that control never fails.
    """
    smtp, every = F.col("protocol") == "SMTP", F.lit(True)
    part = lambda k: F.coalesce(F.try_element_at("components", F.lit(k)), F.lit(0))
    fails = (
        (every, (part("protocol_version") > 20) | _is(UNPROTECTED)),
        (every, (part("key_exchange") >= 50) | (part("cipher_hash") >= 50)),
        (every, F.exists("vetoes", lambda v: v["rule_id"] == "NIST-MIN-STRENGTH")),
        (every, F.col("band").isin("HIGH_RISK", "CRITICAL") | _is(STRIPPED)),
        (smtp, _is(STRIPPED + UNPROTECTED)),
        (smtp, F.lit(False) if dane is None else ~dane),
    )
    return dict(zip(CONTROLS, fails, strict=True))


def custody_bounds(sessions: DataFrame, duration: str) -> DataFrame:
    return sessions.agg(F.min("first_seen").alias("evidence_from"), F.max(F.col("first_seen") + F.col(duration)).alias("evidence_to"), F.count("*").alias("n_sessions"))
