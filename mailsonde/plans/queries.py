"""Every operator as a query over the driver's tables, with the SQL that must give the same rows.

Sessions come from the adapter over events; where an operator's own constants would give no rows on these tables, a
looser parameter is passed, as the query says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.features import hashed, imputed
from ..operators import comparison, corpus, decode, detectors, flow, governance, overview, profile, relational, search
from ..operators.feature_model import FeaturePipeline, FeaturePipelineModel
from ..sources import sinks
from ..sources.adapters import packets_from_conversations, packets_of_dialogues
from ..sources.tables import SESSIONS_SQL, epoch, sessions_from_events, table
from ..sources.trust import shared_path
from . import rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BAND_SQL = "CASE WHEN {0} <= 19 THEN 'SECURE' WHEN {0} <= 39 THEN 'ACCEPTABLE' WHEN {0} <= 59 THEN 'WEAK' WHEN {0} <= 79 THEN 'HIGH_RISK' ELSE 'CRITICAL' END"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("@sessions", SESSIONS_SQL)
        return f

    return put


def sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions_from_events(table(spark, d, "events"))


def rounded(df: DataFrame, n: int = 6, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


# -- timing

GAPS_SQL = """gaps AS (SELECT *, first_seen - lag(first_seen) OVER (PARTITION BY client_ip, server_ip, server_port, protocol ORDER BY first_seen, id) AS gap FROM sessions)"""
TEMPORAL_SQL = f"""WITH @sessions, {GAPS_SQL},
g AS (SELECT client_ip, server_ip, server_port, protocol, count(*) AS n_events, count(*) FILTER (gap > 0) AS n_gaps, avg(gap) FILTER (gap > 0) AS mean_gap,
        coalesce(stddev_samp(gap) FILTER (gap > 0), 0) AS dev, max(first_seen) - min(first_seen) AS duration, min(id) AS primary_id FROM gaps GROUP BY ALL),
c AS (SELECT *, CASE WHEN mean_gap > 0 THEN dev / mean_gap END AS cv FROM g),
s AS (SELECT *, CASE WHEN n_events < 5 THEN 0 ELSE 20 + CASE WHEN mean_gap > 0 THEN 20 ELSE 0 END + CASE WHEN cv < 0.8 THEN 50 ELSE 0 END + CASE WHEN duration >= 300 THEN 10 ELSE 0 END END AS score FROM c)
SELECT client_ip, server_ip, server_port, protocol, n_events, n_gaps, round(mean_gap, 3) AS mean_gap, round(cv, 4) AS cv, score,
       CASE WHEN n_events < 5 THEN 'INSUFFICIENT_DATA' WHEN score >= 70 THEN 'BEACON_CANDIDATE' WHEN score >= 40 THEN 'SUSPICIOUS_TIMING' ELSE 'NORMAL' END AS class, primary_id FROM s"""


@query(TEMPORAL_SQL)
def temporal_classify(spark, d):
    """Timing class per (client, server, port, protocol); regular below a coefficient of 0.8 here, 0.15 by default."""
    g = corpus.temporal_groups(sessions(spark, d), max_cv=0.8)
    return g.select("client_ip", "server_ip", "server_port", "protocol", "n_events", "n_gaps", F.round("mean_gap", 3).alias("mean_gap"), F.round("cv", 4).alias("cv"), "score", "class", "primary_id")


@query(f"SELECT count(*) AS n_groups, count(*) FILTER (class = 'BEACON_CANDIDATE') AS beacons, count(*) FILTER (class = 'SUSPICIOUS_TIMING') AS suspicious, count(*) FILTER (class = 'NORMAL') AS normal, count(*) FILTER (class = 'INSUFFICIENT_DATA') AS insufficient FROM ({TEMPORAL_SQL})")
def temporal_summary(spark, d):
    return corpus.temporal_summary(corpus.temporal_groups(sessions(spark, d), max_cv=0.8))


BEACON_SQL = """WITH @sessions, gaps AS (SELECT *, first_seen - lag(first_seen) OVER (PARTITION BY client_ip, server_ip, server_port ORDER BY first_seen, id) AS gap FROM sessions),
g AS (SELECT client_ip, server_ip, server_port, count(*) AS n_sessions, avg(gap) AS mean_gap, stddev_pop(gap) AS dev, min(id) AS primary_id FROM gaps GROUP BY ALL)
SELECT client_ip, server_ip, server_port, n_sessions, round(mean_gap, 3) AS mean_gap, round(dev / mean_gap, 4) AS cov, primary_id FROM g WHERE n_sessions >= 5 AND mean_gap > 0 AND dev / mean_gap < 0.6"""


@query(BEACON_SQL)
def beacon_groups(spark, d):
    """Periodic groups; below 0.60 here, 0.30 by default."""
    g = corpus.beacon_groups(sessions(spark, d), max_cov=0.6)
    return g.select("client_ip", "server_ip", "server_port", "n_sessions", F.round("mean_gap", 3).alias("mean_gap"), F.round("cov", 4).alias("cov"), "primary_id")


@query(f"WITH b AS ({BEACON_SQL}), @sessions SELECT id, client_ip, server_ip FROM sessions s WHERE EXISTS (SELECT 1 FROM b WHERE b.client_ip = s.client_ip AND b.server_ip = s.server_ip)")
def beacon_sessions(spark, d):
    """The beacon preset: a semi-join."""
    s = sessions(spark, d)
    return search.preset(s, "beacon", corpus.beacon_groups(s, max_cov=0.6)).select("id", "client_ip", "server_ip")


@query("WITH @sessions SELECT client_ip, count(*) AS n_sessions, CAST(greatest(1, count(DISTINCT nullif(sni, ''))) AS BIGINT) AS n_sni FROM sessions GROUP BY client_ip")
def source_stats(spark, d):
    return corpus.source_stats(sessions(spark, d))


@query(f"""WITH b AS ({BEACON_SQL}), t AS ({TEMPORAL_SQL}), @sessions,
ss AS (SELECT client_ip, count(*) AS n_sessions, greatest(1, count(DISTINCT nullif(sni, ''))) AS n_sni FROM sessions GROUP BY client_ip)
SELECT s.id, b.client_ip IS NOT NULL AS is_beacon, CAST(coalesce(ss.n_sessions, 1) AS BIGINT) AS n_sessions, CAST(coalesce(ss.n_sni, 1) AS BIGINT) AS n_sni, coalesce(t.class, 'INSUFFICIENT_DATA') AS timing
FROM sessions s LEFT JOIN b USING (client_ip, server_ip, server_port) LEFT JOIN ss USING (client_ip) LEFT JOIN t USING (client_ip, server_ip, server_port, protocol)""")
def enriched_sessions(spark, d):
    s = sessions(spark, d)
    out = corpus.enriched(s, corpus.beacon_groups(s, max_cov=0.6), corpus.source_stats(s), corpus.temporal_groups(s, max_cv=0.8))
    return out.select("id", "is_beacon", F.col("n_sessions").cast("long").alias("n_sessions"), F.col("n_sni").cast("long").alias("n_sni"), "timing")


@query("""WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_clean, count(*) FILTER (o_orderstatus = 'O') AS n_absent, min(o_orderkey) FILTER (o_orderstatus = 'O') AS primary_id,
  list_slice(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'F')), 1, 10) AS c, list_slice(list_sort(list(o_orderkey) FILTER (o_orderstatus = 'O')), 1, 10) AS a FROM orders GROUP BY o_custkey)
SELECT o_custkey, n_clean, n_absent, primary_id, array_to_string(c, ',') AS clean_ids, array_to_string(a, ',') AS absent_ids FROM g WHERE n_clean > 0 AND n_absent > 0""")
def capability_asymmetry(spark, d):
    """Servers with and without the capability: customers with orders of status F and O."""
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    g = corpus.capability_asymmetry(o, ("o_custkey",), F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O")
    return g.withColumns({c: F.array_join(c, ",") for c in ("clean_ids", "absent_ids")})


@query("""WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS id FROM part WHERE p_name <> '' GROUP BY ALL)
SELECT a.p_brand, a.p_name AS banner_a, b.p_name AS banner_b, CAST(levenshtein(a.p_name, b.p_name) AS INTEGER) AS distance, a.id AS id_a, b.id AS id_b
FROM f a JOIN f b ON a.p_brand = b.p_brand AND a.id < b.id WHERE levenshtein(a.p_name, b.p_name) >= 8""")
def banner_mutation(spark, d):
    """Part names within a brand stand for banners of an endpoint."""
    p = table(spark, d, "part").select("p_brand", "p_name", F.col("p_partkey").alias("id"), F.col("p_partkey").alias("first_seen"))
    return corpus.banner_mutations(p, 8, ("p_brand",), "p_name")


@query("SELECT l_orderkey, n, primary_id, round(100.0 * n / n_total, 6) AS rarity_pct FROM (SELECT l_orderkey, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS primary_id FROM lineitem GROUP BY 1), (SELECT count(*) AS n_total FROM lineitem) WHERE n <= 2 AND n_total >= 10")
def rare_fingerprint(spark, d):
    x = table(spark, d, "lineitem").withColumn("id", F.col("l_linenumber").cast("long"))
    return rounded(corpus.rare_values(x, "l_orderkey").drop("n_total"), 6, "rarity_pct")


@query("""WITH @sessions, g AS (SELECT server_ip, server_port, min(id) FILTER (starttls_state = 'S_NO_STARTTLS') AS primary_id, count(*) FILTER (starttls_state = 'S4_ENCRYPTED') AS c, count(*) FILTER (starttls_state = 'S_NO_STARTTLS') AS a FROM sessions GROUP BY ALL)
SELECT 'D1_CORPUS_CAPABILITY_STRIP' AS rule_id, 'CRITICAL' AS severity, CAST(primary_id AS VARCHAR) AS session_id, server_ip || ':' || server_port AS title FROM g WHERE c > 0 AND a > 0
UNION ALL SELECT 'CB1_BEACONING_PERIODIC_SESSIONS', 'HIGH', CAST(primary_id AS VARCHAR), client_ip || ' ' || server_ip || ' ' || server_port FROM (""" + BEACON_SQL.replace("WITH @sessions,", "WITH") + ")")
def finding_union(spark, d):
    """All corpus detectors in one schema; beacons below 0.60 here."""
    f = corpus.corpus_findings(sessions(spark, d), 0.6)
    return f.where("rule_id in ('D1_CORPUS_CAPABILITY_STRIP', 'CB1_BEACONING_PERIODIC_SESSIONS')").select("rule_id", "severity", "session_id", "title")


# -- search


@query("WITH @sessions SELECT id, client_ip, server_ip, server_port, protocol, first_seen, risk_score, starttls_state, ja3, sni, is_anomaly FROM sessions WHERE risk_score >= 60 AND starttls_state = 'S_STRIP_DETECTED' AND contains(lower(sni), 'l')")
def session_search(spark, d):
    return search.search(sessions(spark, d), min_risk=60, state="S_STRIP_DETECTED", sni="L").select(*search.SUMMARY)


@query("WITH @sessions SELECT id, risk_score FROM sessions ORDER BY risk_score DESC, id LIMIT 50 OFFSET 100")
def session_offset_page(spark, d):
    return search.offset_page(sessions(spark, d), 50, 100).select("id", "risk_score")


@query("WITH @sessions SELECT id, risk_score FROM sessions WHERE risk_score < 90 OR (risk_score = 90 AND id > 500) ORDER BY risk_score DESC, id LIMIT 50")
def session_keyset_page(spark, d):
    return search.keyset_page(sessions(spark, d), 50, search.cursor(90, 500)).select("id", "risk_score")


@query("WITH @sessions SELECT id FROM sessions WHERE contains(lower(client_ip), '7') OR contains(lower(ja3), '7') OR contains(lower(sni), '7')")
def session_text_search(spark, d):
    return search.text_search(sessions(spark, d), "7", ("client_ip", "ja3", "sni")).select("id")


@query("WITH @sessions SELECT id FROM sessions WHERE risk_score >= 80")
def session_preset_critical(spark, d):
    return search.preset(sessions(spark, d), "critical").select("id")


# -- overview


@query(f"WITH @sessions, c AS (SELECT {BAND_SQL.format('risk_score')} AS band, count(*) AS n FROM sessions GROUP BY 1) SELECT b.band, coalesce(n, 0) AS n FROM (VALUES ('SECURE'), ('ACCEPTABLE'), ('WEAK'), ('HIGH_RISK'), ('CRITICAL')) b(band) LEFT JOIN c USING (band)")
def risk_band_histogram(spark, d):
    return overview.band_histogram(sessions(spark, d))


@query("""WITH @sessions SELECT count(*) AS n_sessions, max(risk_score) AS max_risk, round(avg(risk_score), 6) AS avg_risk, count(DISTINCT client_ip) AS n_clients, count(DISTINCT server_ip) AS n_servers, CAST(sum(bytes) AS BIGINT) AS bytes,
count(*) FILTER (starttls_state = 'S4_ENCRYPTED') AS n_encrypted, count(*) FILTER (starttls_state = 'S_STRIP_DETECTED') AS n_stripped, count(*) FILTER (is_anomaly) AS n_anomalies, count(*) FILTER (risk_score >= 80) AS n_critical FROM sessions""")
def overview_kpis(spark, d):
    return rounded(overview.kpis(sessions(spark, d)), 6, "avg_risk")


@query(f"WITH @sessions SELECT max(risk_score) AS overall, {BAND_SQL.format('max(risk_score)')} AS band FROM sessions")
def overall_risk(spark, d):
    return overview.overall_risk(sessions(spark, d))


@query("""WITH @sessions, g AS (SELECT coalesce(nullif(sni, ''), server_ip) AS mx, count(*) AS total, count(*) FILTER (starttls_state = 'S4_ENCRYPTED') AS encrypted, count(*) FILTER (starttls_state = 'S_STRIP_DETECTED') AS stripped FROM sessions GROUP BY 1)
SELECT *, round(encrypted * 100.0::DOUBLE / total, 2) AS encrypted_pct, round(stripped * 100.0::DOUBLE / total, 2) AS stripped_pct FROM g""")
def mx_health(spark, d):
    return overview.mx_health(sessions(spark, d), None)


@query("""WITH @sessions, g AS (SELECT protocol, count(*) FILTER (starttls_state = 'S4_ENCRYPTED') AS encrypted, count(*) FILTER (starttls_state = 'S_STRIP_DETECTED') AS stripped, count(*) FILTER (starttls_state = 'S_NO_STARTTLS') AS plain FROM sessions GROUP BY 1)
SELECT * FROM g UNION ALL SELECT p, 0, 0, 0 FROM (VALUES ('SMTP'), ('IMAP'), ('POP3')) v(p) WHERE p NOT IN (SELECT protocol FROM g)""")
def protocol_state_matrix(spark, d):
    return overview.protocol_states(sessions(spark, d))


@query("WITH @sessions SELECT ja3, count(*) AS n, min(first_seen) AS first_seen, max(first_seen) AS last_seen FROM sessions WHERE ja3 <> '' GROUP BY ja3 ORDER BY n DESC, ja3 LIMIT 5")
def fingerprint_topk(spark, d):
    return overview.fingerprint_frequency(sessions(spark, d))


@query("""WITH @sessions, b AS (SELECT min(first_seen) AS t0, greatest((max(first_seen) - min(first_seen)) / 24, 1.0::DOUBLE) AS width FROM sessions),
g AS (SELECT CAST(least(floor((first_seen - t0) / width), 23) AS INTEGER) AS bucket, count(*) AS n, avg(risk_score) AS a, count(*) FILTER (risk_score >= 80) AS critical, count(*) FILTER (starttls_state = 'S_STRIP_DETECTED') AS stripped FROM sessions, b GROUP BY 1)
SELECT CAST(r.bucket AS INTEGER) AS bucket, coalesce(n, 0) AS n, round(coalesce(a, 0), 6) AS avg_risk, coalesce(critical, 0) AS critical, coalesce(stripped, 0) AS stripped FROM range(24) r(bucket) LEFT JOIN g USING (bucket)""")
def time_bucket_trend(spark, d):
    return rounded(overview.trend(sessions(spark, d)), 6, "avg_risk")


@query("WITH @sessions SELECT min(first_seen) AS starts, max(first_seen) AS ends FROM sessions WHERE first_seen > 0")
def capture_period(spark, d):
    return overview.period(sessions(spark, d))


@query("WITH @sessions SELECT sni, count(*) AS count FROM sessions GROUP BY sni ORDER BY count DESC, sni LIMIT 1")
def dominant_mx(spark, d):
    return overview.dominant(sessions(spark, d), "sni")


@query("WITH @sessions SELECT min(first_seen) AS evidence_from, max(first_seen + bytes / 1000) AS evidence_to, count(*) AS n_sessions FROM sessions")
def custody_bounds(spark, d):
    return overview.custody_bounds(sessions(spark, d).withColumn("duration", F.col("bytes") / 1000), "duration")


@query("""WITH c AS (SELECT o_orderkey AS id, o_orderpriority IS NOT NULL AS a1, o_totalprice > 100000 AS f1, o_orderstatus = 'F' AS a2, o_totalprice < 0 AS f2, o_orderstatus = 'X' AS a3, true AS f3 FROM orders),
u AS (SELECT id, 'PRICE' AS control, a1 AS a, a1 AND f1 AS f FROM c UNION ALL SELECT id, 'SIGN', a2, a2 AND f2 FROM c UNION ALL SELECT id, 'NONE', a3, a3 AND f3 FROM c)
SELECT control, count(*) FILTER (a) AS n_applies, count(*) FILTER (f) AS n_fails, coalesce(array_to_string(list_slice(list_sort(list(id) FILTER (f)), 1, 10), ','), '') AS failing_ids,
CASE WHEN count(*) FILTER (a) = 0 THEN 'NA' WHEN count(*) FILTER (f) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM u GROUP BY control""")
def compliance_controls(spark, d):
    o = table(spark, d, "orders").withColumn("id", F.col("o_orderkey"))
    controls = {"PRICE": (F.col("o_orderpriority").isNotNull(), F.col("o_totalprice") > 100000), "SIGN": (F.col("o_orderstatus") == "F", F.col("o_totalprice") < 0), "NONE": (F.col("o_orderstatus") == "X", F.lit(True))}
    return overview.compliance(o, controls).withColumn("failing_ids", F.array_join("failing_ids", ","))


@query("""WITH f AS (SELECT 'R-' || o_orderpriority AS rule_id, o_orderkey FROM orders WHERE o_totalprice > 1000)
SELECT rule_id, count(*) AS n, 'order ' || min(lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS title FROM f GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 5""")
def remediation_top5(spark, d):
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    f = table(spark, d, "orders").where("o_totalprice > 1000").select(F.concat(F.lit("R-"), "o_orderpriority").alias("rule_id"), key.alias("finding_id"), F.concat(F.lit("order "), key).alias("title"), F.lit("LOW").alias("severity"))
    return overview.top_remediations(f).drop("severity")


MAIL_CONTROLS_SQL = """WITH @sessions, c AS (
  SELECT 'NIST-800-52r2-3.1' AS control, id, true AS applies, risk_score % 41 > 20 AS fails FROM sessions
  UNION ALL SELECT 'NIST-800-52r2-3.3.1', id, true, risk_score % 61 >= 50 OR risk_score * 3 % 71 >= 50 FROM sessions
  UNION ALL SELECT 'NIST-800-57-5.6.1', id, true, risk_score % 13 = 0 FROM sessions
  UNION ALL SELECT 'PCI-DSS-4.2.1', id, true, risk_score >= 60 OR starttls_state = 'S_STRIP_DETECTED' FROM sessions
  UNION ALL SELECT 'RFC-8461-MTA-STS', id, id % 2 = 0, id % 2 = 0 AND starttls_state = 'S_STRIP_DETECTED' FROM sessions
  UNION ALL SELECT 'RFC-7672-DANE', id, id % 2 = 0, id % 2 = 0 AND risk_score % 7 = 0 FROM sessions)
SELECT control, count(*) FILTER (applies) AS n_applies, count(*) FILTER (fails) AS n_fails, coalesce(array_to_string(list_sort(list(id) FILTER (fails))[1:10], ','), '') AS failing_ids,
CASE WHEN count(*) FILTER (applies) = 0 THEN 'NA' WHEN count(*) FILTER (fails) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM c GROUP BY control"""


@query(MAIL_CONTROLS_SQL)
def mail_controls(spark, d):
    """The six controls, over sessions whose component scores follow from their risk; every second one is SMTP."""
    risk = F.col("risk_score")
    parts = F.create_map(F.lit("protocol_version"), risk % 41, F.lit("key_exchange"), risk % 61, F.lit("cipher_hash"), risk * 3 % 71)
    vetoes = F.array_compact(F.array(F.when(risk % 13 == 0, F.struct(F.lit("NIST-MIN-STRENGTH").alias("rule_id"), F.lit(90).alias("floor")))))
    s = sessions(spark, d).withColumns({"components": parts, "vetoes": vetoes, "band": S.band(risk), "protocol": F.when(F.col("id") % 2 == 0, "SMTP").otherwise("IMAP")})
    return overview.compliance(s, overview.mail_controls(risk % 7 != 0)).withColumn("failing_ids", F.array_join("failing_ids", ","))


@query("""WITH r AS (SELECT lower(p_brand) AS domain, p_size AS port, sha256(p_name) AS data FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT lower(p_brand), p_size, sha512 FROM (SELECT p_brand, p_size, sha256('other' || p_name) AS sha512 FROM part WHERE p_partkey % 5 = 0))
SELECT p_partkey, CAST(count(r.domain) AS INTEGER) AS n_records, CAST(count(*) FILTER (r.data = sha256(p_name)) AS INTEGER) AS n_matching FROM part LEFT JOIN r ON r.domain = lower(p_brand) AND r.port = p_size GROUP BY p_partkey""")
def dane_lookup(spark, d):
    """TLSA records of a name, port and transport: how many there are, and how many match."""
    p = table(spark, d, "part")
    record = lambda rows, data: rows.select(F.concat(F.lit(" "), "p_brand").alias("domain"), F.col("p_size").alias("port"), F.lit("TCP").alias("protocol"), F.lit(1).alias("selector"), F.lit(1).alias("matching"), F.upper(F.sha2(data, 256)).alias("data"))
    records = record(p.where("p_partkey % 3 = 0"), F.col("p_name")).unionByName(record(p.where("p_partkey % 5 = 0"), F.concat(F.lit("other"), "p_name")))
    s = p.select("p_partkey", "p_brand", "p_size", F.lit(b"").alias("der"), F.col("p_name").cast("binary").alias("spki"))
    return detectors.dane(s, records, "p_brand", "p_size", "der", "spki").select("p_partkey", "dane.n_records", "dane.n_matching")


# -- scoring

PRICE_SQL = "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 2 AS p, CAST(floor(l_discount * 1000) AS BIGINT) % 101 AS c, CAST(floor(l_tax * 1000) AS BIGINT) % 101 AS k, l_linenumber * 10 AS h, l_returnflag = 'R' AS cred, CASE WHEN l_linestatus = 'O' THEN 465 ELSE 25 END AS port, CASE WHEN l_quantity >= 50 THEN 90 END AS veto FROM lineitem"


@query(f"""WITH x AS ({PRICE_SQL}), s AS (SELECT *, CAST(round_even(CASE WHEN cred THEN 1.25 WHEN port = 465 THEN 1.15 ELSE 1.00 END * (0.3125 * least(p, 100) + 0.3125 * c + 0.25 * k + 0.125 * h), 0) AS INTEGER) AS r FROM x),
t AS (SELECT *, least(100, greatest(coalesce(veto, 0), r)) AS risk_score FROM s)
SELECT l_orderkey, l_linenumber, CAST(risk_score AS INTEGER) AS risk_score, {BAND_SQL.format('risk_score')} AS band FROM t""")
def risk_score_decimal(spark, d):
    """The weighted, floored, half-to-even score over line items as components."""
    x = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.least(F.col("l_quantity").cast("long") * 2, F.lit(100)).alias("p"), (F.floor(F.col("l_discount") * 1000) % 101).alias("c"), (F.floor(F.col("l_tax") * 1000) % 101).alias("k"), (F.col("l_linenumber") * 10).alias("h"),
        (F.col("l_returnflag") == "R").alias("cred"), F.when(F.col("l_linestatus") == "O", 465).otherwise(25).alias("port"), F.when(F.col("l_quantity") >= 50, 90).alias("veto"),
    )
    parts = {rules.P: F.col("p"), rules.C: F.col("c"), rules.K: F.col("k"), rules.X: F.lit(0), rules.H: F.col("h")}
    s = rules.total(parts, F.lit(False), rules.omega(F.col("cred"), F.col("port")), F.col("veto"))
    return x.select("l_orderkey", "l_linenumber", s.alias("risk_score"), S.band(s).alias("band"))


@query("""WITH v AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'NONE' WHEN 1 THEN 'TLS 1.0' WHEN 2 THEN 'TLS 1.1' WHEN 3 THEN 'TLS 1.3' ELSE 'SSL 3.0' END AS v, CASE WHEN o_orderstatus = 'F' THEN 465 ELSE 25 END AS port, o_orderstatus = 'O' AS auth FROM orders),
c AS (SELECT *, CASE v WHEN 'NONE' THEN 100 WHEN 'TLS 1.0' THEN 80 WHEN 'TLS 1.1' THEN 60 WHEN 'TLS 1.3' THEN 0 ELSE 100 END AS p, CASE WHEN v = 'SSL 3.0' THEN 100 WHEN v = 'NONE' AND auth THEN 100 ELSE 0 END AS veto FROM v)
SELECT id, CAST(least(100, greatest(veto, round_even(CASE WHEN port = 465 THEN 1.15 ELSE 1.00 END * 0.3125 * p, 0))) AS INTEGER) AS risk_score, p AS protocol_penalty FROM c""")
def score_sessions(spark, d):
    """The whole rule table over parameters made from orders: protocol rules and vetoes show, the rest is clean."""
    o = table(spark, d, "orders")
    version = F.element_at(F.array(*map(F.lit, ("NONE", "TLS 1.0", "TLS 1.1", "TLS 1.3", "SSL 3.0"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    null = lambda t: F.lit(None).cast(t)
    params = o.select(
        F.col("o_orderkey").alias("id"), version.alias("protocol_version"), F.when(F.col("o_orderstatus") == "F", 465).otherwise(25).alias("dst_port"), (F.col("o_orderstatus") == "O").alias("has_auth"), F.lit(False).alias("cleartext_credentials_observed"),
        F.lit(True).alias("handshake_completed"), F.lit(False).alias("cert_analysis_possible"), F.lit(True).alias("encrypt_then_mac"), F.lit(True).alias("extended_master_secret"), F.lit(True).alias("secure_renegotiation"), F.lit(0).alias("compression_method"),
        null("int").alias("ticket_lifetime_seconds"), F.lit(False).alias("zero_rtt_used"), F.lit("ECDHE").alias("kex_algorithm"), F.lit("x25519").alias("named_group"), null("int").alias("dh_key_bits"), F.lit(256).alias("ec_bits"),
        null(rules.CIPHER).alias("cipher"), null(rules.CERT).alias("cert"), null(rules.CHAIN).alias("chain"), null("string").alias("host_status"), F.lit(False).alias("known_compromised_spki"),
    )
    return rules.score(params).select("id", "risk_score", F.col("components")["protocol_version"].alias("protocol_penalty"))


# -- joins, sets, windows


@query("SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def enrich_with_default(spark, d):
    return relational.with_default(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"], {"quality": -1, "toxic": -1})


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def known_endpoint_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unseen_anti(spark, d):
    o, x = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(x, o["o_orderkey"] == x["l_orderkey"], "left_anti").select("o_orderkey")


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def capture_dedup(spark, d):
    return relational.first_of_hash(table(spark, d, "documents"), "text", "doc_id")


@query("SELECT l_orderkey, l_linenumber, coalesce(p_brand, 'UNKNOWN') AS p_brand, coalesce(p_size, 0) AS p_size FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey")
def dim_lookup_unknown(spark, d):
    p = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return relational.with_default(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), p, ["l_partkey"], {"p_brand": "UNKNOWN", "p_size": 0}).drop("l_partkey")


@query("SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem")
def canonical_flow_key(spark, d):
    k = S.flow_key(F.col("l_suppkey"), F.lit(0), F.col("l_partkey"), F.lit(0))
    return table(spark, d, "lineitem").select(k["a_ip"].alias("a"), k["b_ip"].alias("b")).distinct()


@query("WITH x AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 2654435761) & 4294967295 AS a, (l_partkey * 2654435761) & 4294967295 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, ((a - b) & 4294967295) > 2147483647 AS lt, CASE WHEN ((a - b) & 4294967295) > 2147483648 THEN ((a - b) & 4294967295) - 4294967296 ELSE (a - b) & 4294967295 END AS diff FROM x")
def seq_modular_compare(spark, d):
    a, b = ((F.col(c) * 2654435761).bitwiseAND(F.lit(S.MOD32)) for c in ("l_orderkey", "l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.seq_lt(a, b).alias("lt"), S.seq_diff(a, b).alias("diff"))


@query("""WITH g AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS t FROM events), l AS (SELECT *, t - lag(t) OVER w AS gap FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM l)
SELECT user_id, CAST(n AS BIGINT) AS session_no, count(*) AS n_events, min(t) AS starts, max(t) AS ends FROM s GROUP BY ALL""")
def session_windows(spark, d):
    """Idle gaps split a key's rows; six hours here, 300 seconds for flows."""
    e = table(spark, d, "events").select("user_id", "event_id", epoch("ts").alias("t"))
    return relational.idle_sessions(e, ["user_id"], "t", "event_id", 21600.0).groupBy("user_id", "session_no").agg(F.count("*").alias("n_events"), F.min("t").alias("starts"), F.max("t").alias("ends"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS n FROM orders GROUP BY o_custkey")
def latest_verdict(spark, d):
    """The latest row of each key."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"), F.count("*").alias("n"))


@query("SELECT event_id, max(value) OVER w AS clock, max(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def capture_clock(spark, d):
    """The latest time so far in a capture: a type's events in order of their ids, their values as times that run back."""
    x = table(spark, d, "events").select("event_id", F.col("event_type").alias("capture_id"), F.col("event_id").alias("index"), F.col("value").alias("ts"))
    return flow.with_clock(x, 1000).select("event_id", "clock", "before")


@query("SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
def trailing_rate(spark, d):
    """Rows of the trailing period: a day here, 60 seconds for the rate limit."""
    x = table(spark, d, "events").select("event_id", "user_id", F.floor(epoch("ts")).cast("long").alias("s"))
    return relational.trailing_count(x, ["user_id"], "s", 86400).select("event_id", "n")


@query("SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS chain_position, role, turn = min(turn) OVER (PARTITION BY conv_id) AS is_leaf FROM conversations")
def chain_explode(spark, d):
    """Nested chains and their positions: 0 is the leaf."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("chain"))
    return relational.exploded_chain(c, "chain").select("conv_id", F.col("item.turn").alias("chain_position"), F.col("item.role").alias("role"), F.col("is_leaf")).withColumn("chain_position", F.col("chain_position") - F.min("chain_position").over(Window.partitionBy("conv_id")))


@query("SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def split_disjointness(spark, d):
    return relational.shared_keys(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 AND o_orderstatus = 'F'")
def missing_expected(spark, d):
    """Customers without a finished order in 1995."""
    seen = table(spark, d, "orders").where((F.year("o_orderdate") == 1995) & (F.col("o_orderstatus") == "F"))
    return table(spark, d, "customer").select("c_custkey").exceptAll(seen.select(F.col("o_custkey").alias("c_custkey")))


# -- scalar functions


@query("SELECT p_partkey, md5(p_name || ',' || p_size) AS ja3, substr(sha256(p_name), 1, 12) AS part FROM part")
def hash_fingerprint(spark, d):
    return table(spark, d, "part").select("p_partkey", F.md5(F.concat_ws(",", "p_name", F.col("p_size").cast("string"))).alias("ja3"), F.substring(F.sha2("p_name", 256), 1, 12).alias("part"))


@query("SELECT p_partkey, round(entropy(c), 6) AS entropy FROM (SELECT p_partkey, unnest(string_split(p_name, '')) AS c FROM part) GROUP BY p_partkey")
def char_entropy(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(S.char_entropy(F.col("p_name")), 6).alias("entropy"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def email_count(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(S.EMAIL), F.lit(0))).alias("n"))


@query(r"""WITH x AS (SELECT doc_id, text, list_sort(list_transform(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')), lambda e: {'n': -len(e), 'e': e})) AS found FROM documents WHERE contains(text, '@'))
SELECT doc_id, regexp_replace(list_reduce(list_transform(found, lambda v: v.e), lambda t, e: replace(t, e, substr(sha256('salt' || lower(e)), 1, 16) || '@' || string_split(e, '@')[-1]), text), '(?i)\b(AUTH PLAIN|AUTH LOGIN|PASS|USER)[ \t]+[^\s]+', '\1 [REDACTED]', 'g') AS text FROM x""")
def email_redaction(spark, d):
    """Salted hashes of local parts."""
    x = table(spark, d, "documents").where(F.contains(F.col("text"), F.lit("@")))
    return x.select("doc_id", S.redact(F.col("text"), "salt").alias("text"))


@query("""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages),
p AS (SELECT pattern FROM (VALUES ('*.example.org'), ('*.example.net'), ('blog.example.org'), ('*.org')) v(pattern))
SELECT host, pattern, (NOT contains(pattern, '*') AND host = pattern) OR (pattern LIKE '*.%' AND len(string_split(pattern, '.')) >= 3 AND len(string_split(pattern, '.')) = len(string_split(host, '.')) AND substr(pattern, 3) = substr(host, strpos(host, '.') + 1)) AS matches FROM h, p""")
def wildcard_host_match(spark, d):
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1))
    patterns = F.array(*map(F.lit, ("*.example.org", "*.example.net", "blog.example.org", "*.org")))
    h = table(spark, d, "pages").select(host.alias("host")).distinct().withColumn("pattern", F.explode(patterns))
    return h.withColumn("matches", S.wildcard_match(F.col("pattern"), F.col("host")))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, [CAST(l_partkey % 65536 AS INTEGER), 2570, 6682, CAST(l_suppkey % 65536 AS INTEGER), 35466, 4865] AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter(a, lambda x: NOT ((x & 3855) = 2570 AND (x >> 8) = (x & 255))), '-') AS kept FROM v""")
def grease_filter(spark, d):
    a = F.array((F.col("l_partkey") % 65536).cast("int"), F.lit(2570), F.lit(6682), (F.col("l_suppkey") % 65536).cast("int"), F.lit(35466), F.lit(4865))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.transform(S.strip_grease(a), lambda v: v.cast("string")), "-").alias("kept"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 5 = 0 THEN 4 ELSE 0 END AS bitmap FROM part")
def extension_bitmap(spark, d):
    xs = F.array_compact(F.array(*[F.when(F.col("p_size") % n == 0, n) for n in (2, 3, 5)]))
    return table(spark, d, "part").select("p_partkey", S.extension_bitmap(xs, [2, 3, 5]).cast("int").alias("bitmap"))


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, CAST(coalesce(props->>'$.missing', 'none') AS VARCHAR) AS missing FROM events")
def json_evidence(spark, d):
    v = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "string"), F.lit("none")).alias("missing"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS path, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS n_user FROM conversations GROUP BY conv_id")
def state_fold(spark, d):
    """Steps of a dialogue folded in order."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("steps"))
    return g.select("conv_id", F.array_join(F.transform("steps", lambda s: s["role"]), ">").alias("path"), F.aggregate("steps", F.lit(0).cast("long"), lambda n, s: n + F.when(s["role"] == "user", 1).otherwise(0)).alias("n_user"))


# -- profiles


@query("""SELECT f AS feature, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.95), 4) AS p95, round(quantile_cont(v, 0.99), 4) AS p99, round(max(v), 4) AS max, count(DISTINCT v) AS n_unique, count(*) FILTER (v = 0) AS n_zero
FROM (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME f VALUE v) GROUP BY f""")
def feature_profile(spark, d):
    p = profile.feature_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(p, 4, "mean", "std", "min", "median", "p95", "p99", "max").select("feature", "n", "mean", "std", "min", "median", "p95", "p99", "max", "n_unique", "n_zero")


@query("""WITH x AS (SELECT vec_id % 2 AS part, unnest(embedding)::DOUBLE AS v, unnest(range(1, 65)) AS f FROM embeddings), s AS (SELECT f, avg(v) FILTER (part = 0) AS m0, stddev_samp(v) FILTER (part = 0) AS s0, avg(v) FILTER (part = 1) AS m1 FROM x GROUP BY f)
SELECT CAST(f AS INTEGER) AS feature, round(abs(m1 - m0) / (s0 + 1e-6), 4) AS z FROM s""")
def distribution_shift(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("part"), F.posexplode("embedding").alias("p", "v")).select("part", (F.col("p") + 1).alias("feature"), F.col("v").cast("double").alias("v"))
    return rounded(profile.shift(e, "feature", "v", F.col("part") == 0, F.col("part") == 1), 4, "z").select("feature", "z")


@query("""WITH g AS (SELECT DISTINCT coalesce(source, '') AS source, sha256('42|' || coalesce(source, '')) AS h FROM documents), r AS (SELECT source, percent_rank() OVER (ORDER BY h) AS p FROM g)
SELECT source, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'validation' ELSE 'test' END AS split FROM r""")
def group_split(spark, d):
    return profile.group_split(table(spark, d, "documents"), "source")


@query("""WITH x AS (SELECT toxic AS y, least(1.0::DOUBLE, n_chars / 10000.0::DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), t AS (SELECT CAST(i AS DOUBLE) / 10 AS threshold FROM range(1, 10) r(i))
SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn, count(*) FILTER (s < threshold AND y = 0) AS tn FROM x, t GROUP BY threshold""")
def threshold_grid(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("toxic").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("s"))
    return profile.threshold_grid(x, "s", "y").select("threshold", "tp", "fp", "fn", "tn")


@query("""WITH s AS (SELECT vec_id, embedding[1]::DOUBLE AS v FROM embeddings), b AS (SELECT min(v) AS lo, max(v) AS hi FROM s), n AS (SELECT (v - lo) / (hi - lo) AS x FROM s, b)
SELECT count(*) AS n, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(quantile_cont(x, 0.95), 5) AS p95, round(avg(CASE WHEN x >= 0.5 THEN 1.0 ELSE 0.0 END), 5) AS flag_rate FROM n""")
def minmax_scores(spark, d):
    return rounded(profile.score_summary(table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("score")), "score"), 5, "mean", "std", "p95", "flag_rate")


@query("SELECT role, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def split_sizes(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def anomaly_scores(spark, d):
    """An isolation forest over embeddings: trees from bounded samples, scores by broadcast trees."""
    from ..operators.anomaly import anomaly_scores as scored

    return scored(table(spark, d, "embeddings"), "vec_id", "embedding")


# -- byte-level operators, over packets made from conversations


@query("""SELECT conv_id, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'user'), '')) AS c2s_md5, md5(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'user'), '')) AS s2c_md5,
CAST(coalesce(sum(strlen(text)) FILTER (role = 'user'), 0) AS INTEGER) AS c2s_length, CAST(coalesce(sum(strlen(text)) FILTER (role <> 'user'), 0) AS INTEGER) AS s2c_length, true AS complete FROM conversations GROUP BY conv_id""")
def reassemble_flows(spark, d):
    """Headers, disorder, retransmissions and wrapping numbers: the rebuilt payloads are the conversation's texts."""
    s = flow.sessions(packets_from_conversations(table(spark, d, "conversations")))
    conv = F.regexp_extract("capture_id", r"(\d+)$", 1).cast("long")
    return s.select(conv.alias("conv_id"), F.md5("c2s_payload").alias("c2s_md5"), F.md5("s2c_payload").alias("s2c_md5"), F.length("c2s_payload").alias("c2s_length"), F.length("s2c_payload").alias("s2c_length"), F.col("quality.complete").alias("complete"))


@query()
def decode_sessions(spark, d):
    """Classification, dialogue, handshake and detectors over rebuilt flows."""
    s = decode.decoded(flow.sessions(packets_from_conversations(table(spark, d, "conversations"))))
    return detectors.detect(s).select("capture_id", F.col("cls.protocol").alias("protocol"), F.col("fsm.state").alias("state"), "protocol_version", F.array_join(F.transform("detections", lambda x: x["rule_id"]), ",").alias("detections"))


@query("""WITH x AS (SELECT DISTINCT doc_id, doc_id % 8 AS k, 49152 + doc_id % 500 AS cipher FROM documents WHERE doc_id IS NOT NULL), c AS (SELECT *, k IN (0, 4, 6, 7) AS client, k IN (0, 4, 7) AS server FROM x)
SELECT doc_id, CASE k WHEN 7 THEN 'IMAP' ELSE 'SMTP' END AS protocol, CASE WHEN k >= 6 THEN 'IMPLICIT' ELSE 'EXPLICIT' END AS mode,
['S4_ENCRYPTED', 'S_STRIP_DETECTED', 'S_REFUSED', 'S1B_CAPS_ADV', 'S4_ENCRYPTED', 'S2_CMD', 'S3_TLS_HS', 'S4_ENCRYPTED'][k + 1] AS state, CASE WHEN k = 7 THEN 'TLS 1.3' WHEN client THEN 'TLS 1.2' ELSE 'NONE' END AS protocol_version,
CASE WHEN client THEN 'mail.example.org' END AS sni, CASE WHEN server THEN CAST(cipher AS INTEGER) END AS cipher, CASE WHEN client THEN md5('771,4865-' || cipher || ',0-10-11-13-23-43,29-23,0') END AS ja3, CASE WHEN server THEN md5('771,' || cipher || ',65281' || CASE WHEN k = 7 THEN '-43' ELSE '' END) END AS ja3s,
CASE WHEN client THEN 't13d020600_' || substr(sha256('1301,' || printf('%04x', cipher)), 1, 12) || '_' || substr(sha256('000a,000b,000d,0017,002b_0403,0804'), 1, 12) END AS ja4,
CASE WHEN k = 7 THEN 't130200_' || printf('%04x', cipher) || '_' || substr(sha256('ff01,002b'), 1, 12) WHEN server THEN 't120100_' || printf('%04x', cipher) || '_' || substr(sha256('ff01'), 1, 12) END AS ja4s,
client AS extended_master_secret, server AS secure_renegotiation, false AS encrypt_then_mac, CASE WHEN k IN (0, 4) THEN 500.0::DOUBLE END AS upgrade_ms,
['', 'D4_POST220_PLAINTEXT,D9_MTA_STS_VIOLATION', 'D3_EXPLICIT_REFUSAL,D5_CLEARTEXT_CREDENTIALS,D9_MTA_STS_VIOLATION', 'D1_CAPABILITY_STRIP,D9_MTA_STS_VIOLATION', 'D6_TLS_DOWNGRADE', 'D2_SILENT_FAILURE,D9_MTA_STS_VIOLATION', 'D7_HANDSHAKE_BLACKHOLE', ''][k + 1] AS detections FROM c""")
def mail_dialogues(spark, d):
    """Eight kinds of dialogues, TLS records and all, from packets to states, fingerprints and detections."""
    ids = table(spark, d, "documents").where("doc_id is not null").select("doc_id").distinct()
    policies = spark.createDataFrame([("Me.Example.net.", "enforce")], "domain string, mode string")
    x = detectors.detect(decode.decoded(flow.sessions(packets_of_dialogues(ids, "doc_id"))), policies=policies, salt="x")
    return x.select(
        F.regexp_extract("capture_id", r"(\d+)$", 1).cast("long").alias("doc_id"), F.col("cls.protocol").alias("protocol"), F.col("cls.mode").alias("mode"), F.col("fsm.state").alias("state"), "protocol_version", F.col("tls.client_hello.server_name").alias("sni"),
        F.col("tls.server_hello.selected_cipher").alias("cipher"), "ja3", "ja3s", "ja4", "ja4s", "extended_master_secret", "secure_renegotiation", "encrypt_then_mac", F.round("fsm.upgrade_latency_ms", 3).alias("upgrade_ms"), F.array_join(F.transform("detections", lambda v: v["rule_id"]), ",").alias("detections"),
    )


@query("""WITH x AS (SELECT DISTINCT doc_id, doc_id % 8 AS k, doc_id % 500 % 3 = 1 AS weak FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT *, CASE WHEN k IN (1, 3, 5) THEN 31 WHEN k = 2 THEN 100 WHEN k = 6 THEN 11 WHEN weak THEN 90 ELSE 0 END AS risk_score FROM x)
SELECT doc_id, CAST(risk_score AS INTEGER) AS risk_score, CASE WHEN risk_score = 31 THEN 'ACCEPTABLE' WHEN risk_score >= 90 THEN 'CRITICAL' ELSE 'SECURE' END AS band, CASE WHEN k IN (0, 4, 7) THEN CASE doc_id % 500 % 3 WHEN 0 THEN 'ECDHE' WHEN 1 THEN 'RSA' END END AS kex_algorithm,
CASE WHEN k IN (0, 4, 7) AND doc_id % 500 % 3 = 0 THEN 'x25519' END AS named_group,
CASE WHEN k IN (1, 3, 5) THEN 'PROTO-NO-TLS-PLAIN' WHEN k = 2 THEN 'PROTO-NO-TLS-AUTH' WHEN k = 6 THEN 'HYGIENE-INCOMPLETE-HANDSHAKE,HYGIENE-INSECURE-RENEG'
WHEN weak THEN 'CIPHER-3DES,CIPHER-CBC-NO-ETM,HASH-SHA1-MAC,KEX-STATIC-RSA' || CASE WHEN k = 7 THEN '' ELSE ',PROTO-TLS12-LEGACY' END || ',NIST-MIN-STRENGTH' ELSE '' END AS rules FROM r""")
def captured_risk(spark, d):
    """From packets to scores: dialogues as in mail_dialogues, with a strong, a weak or an unknown suite chosen."""
    ids = table(spark, d, "documents").where("doc_id is not null").select("doc_id").distinct()
    name = F.when(F.col("id") % 3 == 0, "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256").when(F.col("id") % 3 == 1, "TLS_RSA_WITH_3DES_EDE_CBC_SHA")
    suites = spark.range(500).where("id % 3 < 2").select(F.hex(F.col("id") + 49152).alias("id"), name.alias("name"))
    x = rules.score(rules.parameters(decode.decoded(flow.sessions(packets_of_dialogues(ids, "doc_id"))), suites))
    return x.select(F.regexp_extract("capture_id", r"(\d+)$", 1).cast("long").alias("doc_id"), "risk_score", "band", "kex_algorithm", "named_group", F.array_join(F.transform("provenance", lambda v: v["rule_id"]), ",").alias("rules"))


FIRST_BYTES = "CASE doc_id % 5 WHEN 0 THEN '220 ' WHEN 1 THEN '+OK ' WHEN 2 THEN '* OK ' ELSE '' END"


@query(f"""WITH x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 25 WHEN 1 THEN 465 WHEN 2 THEN 995 ELSE 9999 END AS port, {FIRST_BYTES} AS pre FROM documents)
SELECT doc_id, CASE pre WHEN '220 ' THEN 'SMTP' WHEN '+OK ' THEN 'POP3' WHEN '* OK ' THEN 'IMAP' ELSE CASE port WHEN 25 THEN 'SMTP' WHEN 465 THEN 'SMTP' WHEN 995 THEN 'POP3' ELSE 'UNKNOWN' END END AS protocol,
CASE WHEN pre <> '' THEN 'EXPLICIT' ELSE CASE port WHEN 25 THEN 'EXPLICIT' WHEN 465 THEN 'IMPLICIT' WHEN 995 THEN 'IMPLICIT' ELSE 'UNKNOWN' END END AS mode, CASE WHEN pre <> '' THEN 'content' ELSE 'port' END AS detected_by, port <> 9999 AS port_is_standard FROM x""")
def classify_first_bytes(spark, d):
    """Greetings as first bytes, on four ports; ids pick them, no text is read."""
    port = F.element_at(F.array(*map(F.lit, (25, 465, 995, 9999))), (F.col("doc_id") % 4 + 1).cast("int"))
    first = F.concat(F.expr(FIRST_BYTES), F.lit("words")).cast("binary")
    x = table(spark, d, "documents").select("doc_id", decode.classify(port, first, F.lit(b"")).alias("c"))
    return x.select("doc_id", "c.*")


TLS_LISTS = "[CAST(l_partkey % 65536 AS INTEGER), 2570, 4865, 49199] AS c, [0, 10, CAST(l_suppkey % 50 + 100 AS INTEGER), 16, 6682] AS x, [29, CAST(l_linenumber AS INTEGER)] AS g"
NO_GREASE = "list_filter({0}, lambda v: NOT ((v & 3855) = 2570 AND (v >> 8) = (v & 255)))"


def tls_lists(spark, d):
    i = lambda c: c.cast("int")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(i(F.col("l_partkey") % 65536), F.lit(2570), F.lit(4865), F.lit(49199)).alias("c"), F.array(F.lit(0), F.lit(10), i(F.col("l_suppkey") % 50 + 100), F.lit(16), F.lit(6682)).alias("x"), F.array(F.lit(29), i(F.col("l_linenumber"))).alias("g")
    )


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, {TLS_LISTS} FROM lineitem)
SELECT l_orderkey, l_linenumber, md5('771,' || array_to_string({NO_GREASE.format('c')}, '-') || ',' || array_to_string({NO_GREASE.format('x')}, '-') || ',' || array_to_string(g, '-') || ',0') AS ja3,
md5('771,' || 49199 || ',' || array_to_string({NO_GREASE.format('x')}, '-')) AS ja3s FROM l""")
def ja3_fingerprints(spark, d):
    formats, v = F.array(F.lit(0)), F.lit(771)
    return tls_lists(spark, d).select("l_orderkey", "l_linenumber", S.ja3(v, F.col("c"), F.col("x"), F.col("g"), formats).alias("ja3"), S.ja3s(v, F.lit(49199), F.col("x")).alias("ja3s"))


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, {TLS_LISTS} FROM lineitem), k AS (SELECT *, {NO_GREASE.format('c')} AS cc, {NO_GREASE.format('x')} AS xx FROM l),
h AS (SELECT *, array_to_string(list_sort(list_transform(cc, lambda v: printf('%04x', v))), ',') AS cn, array_to_string(list_sort(list_transform(list_filter(xx, lambda v: v <> 0 AND v <> 16), lambda v: printf('%04x', v))), ',') AS xn FROM k)
SELECT l_orderkey, l_linenumber, 't13d' || lpad(CAST(len(cc) AS VARCHAR), 2, '0') || lpad(CAST(len(xx) AS VARCHAR), 2, '0') || 'sp_' || substr(sha256(cn), 1, 12) || '_' || substr(sha256(xn || '_0403,0804'), 1, 12) AS ja4 FROM h""")
def ja4_fingerprints(spark, d):
    x = S.ja4(F.lit(771), F.array(F.lit(772), F.lit(771)), F.col("c"), F.col("x"), F.array(F.lit(0x0403), F.lit(0x0804)), F.array(F.lit("smtp")), F.lit("mail.example.org"))
    return tls_lists(spark, d).select("l_orderkey", "l_linenumber", x.alias("ja4"))


@query("""WITH x AS (SELECT p_partkey, p_size * 200 AS b FROM part), n AS (SELECT *, b * 0.6931471805599453::DOUBLE AS n FROM x), s AS (SELECT *, (1.923::DOUBLE * pow(n, 1.0::DOUBLE / 3) * pow(ln(n), 2.0::DOUBLE / 3) - 4.69) / 0.6931471805599453::DOUBLE AS s FROM n)
SELECT p_partkey, CAST(CASE WHEN b <= 512 THEN 56 WHEN b < 1024 THEN 64 WHEN b >= 15360 THEN 256 WHEN s >= 256 THEN 256 WHEN s >= 192 THEN 192 WHEN s >= 128 THEN 128 WHEN s >= 112 THEN 112 WHEN s >= 80 THEN 80 ELSE floor(s) END AS INTEGER) AS factoring,
CAST(CASE WHEN b >= 512 THEN 256 WHEN b >= 384 THEN 192 WHEN b >= 256 THEN 128 WHEN b >= 224 THEN 112 WHEN b >= 160 THEN 80 ELSE b // 2 END AS INTEGER) AS curve FROM s""")
def key_strengths(spark, d):
    b = (F.col("p_size") * 200).cast("int")
    return table(spark, d, "part").select("p_partkey", S.factoring_strength(b).alias("factoring"), S.curve_strength(b).alias("curve"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN false WHEN p_partkey % 5 = 1 THEN p_name = p_brand WHEN p_partkey % 7 = 3 THEN false ELSE true END AS matches FROM part""")
def dane_match(spark, d):
    """Records over a name as certificate and a brand as key: whole, SHA-256 and SHA-512; cut off, of the other one, and of a matching that there is not."""
    k, selector, matching = F.col("p_partkey"), F.col("p_size") % 2, F.when(F.col("p_partkey") % 7 == 3, 3).otherwise(F.col("p_partkey") % 3)
    cert, key = F.col("p_name").cast("binary"), F.col("p_brand").cast("binary")
    source = F.when((selector == 0) == (k % 5 != 1), cert).otherwise(key)
    data = F.when(matching == 0, F.hex(source)).when(matching == 1, F.upper(F.sha2(source, 256))).otherwise(F.sha2(source, 512))
    data = F.when(k % 5 == 0, F.substring(data, 3, 1000)).otherwise(data)
    return table(spark, d, "part").select("p_partkey", detectors.dane_match(selector, matching, data, cert, key).alias("matches"))


@query("""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'INDETERMINATE' WHEN host LIKE '%.example.org' AND len(string_split(host, '.')) = 3 THEN 'MATCH' ELSE 'MISMATCH' END AS status, CASE page_id % 3 WHEN 0 THEN 'sni' WHEN 1 THEN 'ehlo' ELSE 'none' END AS method FROM h""")
def hostname_verification(spark, d):
    host, none = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1)), F.lit(None).cast("string")
    pick = lambda k: F.when(F.col("page_id") % 3 == k, host)
    r = detectors.hostname(F.array(F.lit("*.example.org")), F.array().cast("array<string>"), F.lit("CN=other"), pick(0), none, pick(1), none)
    return table(spark, d, "pages").select("page_id", r.alias("r")).select("page_id", "r.status", "r.method")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '2001:db8::' || printf('%x', CAST(o_orderkey % 65535 + 1 AS INTEGER)) WHEN 1 THEN '10.0.' || (o_orderkey // 256 % 256) || '.' || (o_orderkey % 256) WHEN 2 THEN 'xn--mnchen-' || '3ya.n' || o_orderkey || '.example' ELSE 'not a name ' || o_orderkey END AS host,
CASE WHEN o_orderkey % 4 = 2 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM orders""")
def canonical_references(spark, d):
    """Addresses and names as they come, in upper case, brackets, full-width dots and umlauts, against a certificate's coded names."""
    k = F.col("o_orderkey")
    v6 = F.concat(F.lit("[2001:0DB8:0000:0000:0000:0000:0000:"), F.lpad(F.hex(k % 65535 + 1), 4, "0"), F.lit("]"))
    v4 = F.concat_ws(".", F.lit(" 10.0"), (F.floor(k / 256) % 256).cast("string"), (k % 256).cast("string"))
    name = F.concat(F.lit("MÜNCHEN．N"), k.cast("string"), F.lit(".example."))
    x = table(spark, d, "orders").select("o_orderkey", F.when(k % 4 == 0, v6).when(k % 4 == 1, v4).when(k % 4 == 2, name).otherwise(F.concat(F.lit("not a name "), k.cast("string"))).alias("host"), F.array(F.concat(F.lit("münchen.n"), k.cast("string"), F.lit(".EXAMPLE"))).alias("sans"))
    x = detectors.canonical_references(x, ["host"], ["sans"])
    none = F.lit(None).cast("string")
    return x.select("o_orderkey", "host", detectors.hostname(F.col("sans"), F.array().cast("array<string>"), F.lit("CN=other"), F.col("host"), none, none, none)["status"].alias("status"))


@query("""WITH @sessions, a AS (SELECT 'ip-src' AS type, client_ip AS value, risk_score FROM sessions UNION ALL SELECT 'ip-dst', server_ip, risk_score FROM sessions UNION ALL SELECT 'hostname', sni, risk_score FROM sessions UNION ALL SELECT 'ja3-fingerprint-md5', ja3, risk_score FROM sessions)
SELECT type, value, bool_or(risk_score >= 60) AS to_ids FROM a WHERE value <> '' GROUP BY ALL""")
def misp_attributes(spark, d):
    return sinks.misp_attributes(sessions(spark, d)).select("type", "value", "to_ids")


STIX_ID = "'{0}--' || (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1('@ns|{0}|' || {1}) AS h))".replace("@ns", sinks.STIX_NAMESPACE)


@query(f"""WITH @sessions, k AS (SELECT *, strftime(make_timestamp(CAST(floor(first_seen) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS seen, {STIX_ID.format("ipv4-addr", "client_ip")} AS a, {STIX_ID.format("ipv4-addr", "server_ip")} AS b,
{STIX_ID.format("network-traffic", "id")} AS t, {STIX_ID.format("indicator", "id")} AS i, {STIX_ID.format("relationship", "id")} AS r FROM sessions),
o AS (SELECT a AS id, '{{"type":"ipv4-addr","spec_version":"2.1","id":"' || a || '","value":"' || client_ip || '"}}' AS object FROM k UNION SELECT b, '{{"type":"ipv4-addr","spec_version":"2.1","id":"' || b || '","value":"' || server_ip || '"}}' FROM k
UNION SELECT t, '{{"type":"network-traffic","spec_version":"2.1","id":"' || t || '","src_ref":"' || a || '","dst_ref":"' || b || '","dst_port":' || server_port || ',"protocols":["tcp","' || lower(protocol) || '"]}}' FROM k
UNION SELECT i, '{{"type":"indicator","spec_version":"2.1","id":"' || i || '","created":"' || seen || '","modified":"' || seen || '","valid_from":"' || seen || '","pattern_type":"stix","pattern":"[ipv4-addr:value = ''' || server_ip || ''']"}}' FROM k WHERE risk_score >= 60
UNION SELECT r, '{{"type":"relationship","spec_version":"2.1","id":"' || r || '","created":"' || seen || '","modified":"' || seen || '","relationship_type":"based-on","source_ref":"' || i || '","target_ref":"' || t || '"}}' FROM k WHERE risk_score >= 60)
SELECT id, object FROM o""")
def stix_objects(spark, d):
    return sinks.stix_objects(sessions(spark, d))


@query("""WITH @sessions, k AS (SELECT count(*) AS n, count(DISTINCT client_ip) AS c, count(DISTINCT server_ip) AS s, count(*) FILTER (starttls_state = 'S4_ENCRYPTED') AS e, count(*) FILTER (starttls_state = 'S_STRIP_DETECTED') AS st, count(*) FILTER (risk_score >= 80) AS cr FROM sessions)
SELECT printf('%d sessions from %d clients to %d servers', n, c, s) AS sentence FROM k UNION ALL SELECT printf('%.1f%% of sessions are encrypted', round(e * 100.0::DOUBLE / n, 1)) FROM k WHERE e > 0 UNION ALL SELECT printf('%d sessions show a stripped upgrade', st) FROM k WHERE st > 0
UNION ALL SELECT printf('%d sessions are critical', cr) FROM k WHERE cr > 0""")
def executive_takeaways(spark, d):
    return overview.takeaways(sessions(spark, d)).select("sentence")


@query("""WITH @sessions, f AS (SELECT server_ip || ':' || server_port AS what, CAST(min(id) FILTER (starttls_state = 'S_NO_STARTTLS') AS VARCHAR) AS session_id FROM sessions GROUP BY server_ip, server_port),
t AS (SELECT first_seen AS ts, 'finding' AS kind, what, session_id FROM f JOIN sessions ON CAST(id AS VARCHAR) = session_id UNION ALL SELECT * FROM (SELECT first_seen, 'strip', server_ip, CAST(id AS VARCHAR) FROM sessions WHERE starttls_state = 'S_STRIP_DETECTED' ORDER BY first_seen, id LIMIT 8))
SELECT * FROM t ORDER BY ts DESC NULLS LAST, session_id, kind LIMIT 12""")
def event_timeline(spark, d):
    """The newest of findings (here the asymmetric servers) and stripped sessions."""
    s = sessions(spark, d)
    return search.timeline(corpus.corpus_findings(s, 0.0).where("rule_id = 'D1_CORPUS_CAPABILITY_STRIP'"), s)


@query("""WITH v AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME f VALUE v),
g AS (SELECT f, quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q, quantile_cont(v, 0.5) AS m FROM v GROUP BY f), l AS (SELECT f, list_prepend(m, q) AS q FROM g)
SELECT f AS feature, CAST(i AS INTEGER) AS i, round(q[i + 2], 6) AS q FROM (SELECT f, q, unnest(range(-1, 11)) AS i FROM l)""")
def stored_model(spark, d):
    """A feature pipeline fitted, saved, loaded under its approved digest: the medians (-1) and quantiles that it came back with."""
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), *names)
    told = FeaturePipeline(names, "id", quantiles=11, trees=10).fit(x).save(at := shared_path(spark, "model"))
    grid, _ = FeaturePipelineModel.load(at, approved={told}).tables()
    return spark.createDataFrame([(names[f], i, round(q, 6)) for f, i, q in grid], "feature string, i int, q double")


@query("""WITH f AS (SELECT source, toxic, CAST(floor(CAST('0x' || substr(md5('42|' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 5) AS INTEGER) AS fold FROM labels JOIN documents USING (doc_id) WHERE toxic IN (0, 1)),
c AS (SELECT fold, count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic, count(DISTINCT source) AS n_groups FROM f GROUP BY fold) SELECT fold, n AS n_test, n_toxic, n_groups, (SELECT count(*) FROM f) - n AS n_train FROM c""")
def grouped_folds(spark, d):
    """Folds that keep a source whole: rows, toxic rows and sources of each, and how many rows its model may learn from."""
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").where(F.col("toxic").isin(0, 1))
    x = comparison.with_fold(x.select("source", "toxic"), "source")
    g = x.groupBy("fold").agg(F.count("*").alias("n_test"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_distinct("source").alias("n_groups"))
    return g.join(F.broadcast(x.agg(F.count("*").alias("all"))), F.lit(True)).select("fold", "n_test", "n_toxic", "n_groups", (F.col("all") - F.col("n_test")).alias("n_train"))


@query("SELECT doc_id, coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(quality, 0.5) FROM labels)) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def median_imputation(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return imputed(x.select("doc_id", F.col("quality").cast("double").alias("quality")), ["quality"])


@query()
def hashed_documents(spark, d):
    """Token counts in 32 buckets by Spark's own hash; no other engine has it."""
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(hashed(F.col("text")), lambda x: F.round(x, 6).cast("string")), ",").alias("fp_hash"))


@query("""WITH x AS (SELECT toxic AS y, least(1.0::DOUBLE, n_chars / 10000.0::DOUBLE) AS s FROM labels JOIN documents USING (doc_id)), t AS (SELECT CAST(i AS DOUBLE) / 10 AS threshold FROM range(1, 10) r(i)),
g AS (SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn FROM x, t GROUP BY threshold)
SELECT arg_max(threshold, (tp::DOUBLE / (tp + fp), threshold)) AS threshold FROM g WHERE tp + fp > 0 AND tp::DOUBLE / (tp + fn) >= 0.1""")
def best_threshold(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("toxic").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("s"))
    return profile.best_threshold(profile.threshold_grid(x, "s", "y"), 0.1)


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY quality) AS INTEGER) AS n, quality FROM labels QUALIFY n = 1")
def audit_latest(spark, d):
    """An append log's latest entry per key, here by the key itself."""
    x = governance.latest(table(spark, d, "labels").withColumn("at", -F.col("quality")), "doc_id", "at", "quality")
    return x.select("doc_id", F.lit(1).alias("n"), "quality")
