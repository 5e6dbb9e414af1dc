"""Session search, presets, ordering and pages."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import band

SUMMARY = ("id", "client_ip", "server_ip", "server_port", "protocol", "first_seen", "risk_score", "starttls_state", "ja3", "sni", "is_anomaly")
ORDERS = {"risk_score": "risk_score", "anomaly_score": "anomaly_score", "first_seen": "first_seen"}


def search(sessions: DataFrame, min_risk=None, band_is=None, protocol=None, state=None, anomaly=None, ja3=None, sni=None, server_ip=None) -> DataFrame:
    """All given conditions; plain comparisons, so that they reach the scan."""
    out = sessions
    if min_risk is not None:
        out = out.where(F.col("risk_score") >= min_risk)
    if band_is is not None:
        out = out.where(band(F.col("risk_score")) == band_is)
    for name, value in (("protocol", protocol), ("starttls_state", state), ("is_anomaly", anomaly), ("ja3", ja3), ("server_ip", server_ip)):
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    if sni is not None:
        out = out.where(F.contains(F.lower("sni"), F.lit(sni.lower())))
    return out


def preset(sessions: DataFrame, name: str, beacons: DataFrame | None = None) -> DataFrame:
    if name == "beacon":
        return sessions.join(beacons.select("client_ip", "server_ip").distinct(), ["client_ip", "server_ip"], "left_semi")
    rules = {"critical": F.col("risk_score") >= 80, "stripping": F.col("starttls_state") == "S_STRIP_DETECTED", "anomalies": F.col("is_anomaly")}
    if name == "weak_kex":
        return sessions.where(F.coalesce(F.try_element_at("component_scores", F.lit("key_exchange")), F.lit(0)) > 0)
    return sessions.where(rules[name])


def text_search(sessions: DataFrame, text: str, columns) -> DataFrame:
    """Rows with the text in any of the columns, in any case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False))
    return sessions.where(hit)


def ordered(sessions: DataFrame, by: str = "risk_score", descending: bool = True) -> DataFrame:
    key = F.coalesce(F.col(ORDERS[by]), F.lit(0.0))
    return sessions.orderBy(key.desc() if descending else key.asc(), "id")


def offset_page(sessions: DataFrame, size: int = 50, offset: int = 0, by: str = "risk_score", descending: bool = True) -> DataFrame:
    return ordered(sessions, by, descending).offset(offset).limit(size)


def cursor(value: float, ident) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, ident]).encode()).decode()


def keyset_page(sessions: DataFrame, size: int = 50, after: str | None = None, by: str = "risk_score", descending: bool = True) -> DataFrame:
    """The page after a cursor: a filter and a top-k, whose cost does not grow with how far the page lies."""
    key = F.coalesce(F.col(ORDERS[by]), F.lit(0.0))
    if after:
        value, ident = json.loads(base64.urlsafe_b64decode(after))
        beyond = key < value if descending else key > value
        sessions = sessions.where(beyond | ((key == value) & (F.col("id") > ident)))
    return ordered(sessions, by, descending).limit(size)


def findings_of(findings: DataFrame, sessions: DataFrame, severities=None, text: str | None = None) -> DataFrame:
    """Findings of the sessions that are left, by severity, most severe first."""
    out = findings.join(sessions.select(F.col("id").cast("string").alias("session_id")), "session_id", "left_semi")
    if severities:
        out = out.where(F.col("severity").isin(*severities))
    if text:
        out = text_search(out, text, ("rule_id", "title"))
    weight = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW"))], F.lit(9))
    return out.orderBy(weight, "finding_id")


def timeline(findings: DataFrame, sessions: DataFrame, n_findings: int = 15, n_stripped: int = 8, n: int = 12) -> DataFrame:
    """The newest events: findings at their sessions' times, and stripped sessions."""
    f = findings.orderBy("finding_id").limit(n_findings).join(sessions.select(F.col("id").cast("string").alias("session_id"), "first_seen"), "session_id", "left")
    f = f.select(F.col("first_seen").alias("ts"), F.lit("finding").alias("kind"), F.col("title").alias("what"), "session_id")
    s = sessions.where("starttls_state = 'S_STRIP_DETECTED'").orderBy("first_seen", "id").limit(n_stripped)
    s = s.select(F.col("first_seen").alias("ts"), F.lit("strip").alias("kind"), F.col("server_ip").alias("what"), F.col("id").cast("string").alias("session_id"))
    return f.unionByName(s).orderBy(F.desc_nulls_last("ts"), "session_id", "kind").limit(n)
