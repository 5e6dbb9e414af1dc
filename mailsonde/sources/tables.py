"""Tables by name, and the adapter that presents a table of events as sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def epoch(ts: str) -> Column:
    """Seconds since 1970 as double, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})") / F.lit(1e6)


def sessions_from_events(events: DataFrame) -> DataFrame:
    """One session an event: the user is the client, the type the server and protocol, props.k the fingerprint."""
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.when(k % 3 == 0, "S4_ENCRYPTED").when(k % 3 == 1, "S_NO_STARTTLS").otherwise("S_STRIP_DETECTED")
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("client_ip"), F.col("event_type").alias("server_ip"), F.lit(587).alias("server_port"),
        F.upper("event_type").alias("protocol"), epoch("ts").alias("first_seen"), (F.floor(F.abs("value") * 7) % 101).cast("int").alias("risk_score"),
        state.alias("starttls_state"), F.get_json_object("props", "$.k").alias("ja3"), F.concat("event_type", F.lit(".example")).alias("sni"),
        (F.col("value") * 100).cast("long").alias("bytes"), (F.col("value") > 200).alias("is_anomaly"),
    )


#: The same adapter for DuckDB.
SESSIONS_SQL = """sessions AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS client_ip, event_type AS server_ip, 587 AS server_port, upper(event_type) AS protocol,
         epoch_us(ts) / 1e6::DOUBLE AS first_seen, CAST(CAST(floor(abs(value) * 7) AS BIGINT) % 101 AS INTEGER) AS risk_score,
         CASE CAST(props->>'$.k' AS INTEGER) % 3 WHEN 0 THEN 'S4_ENCRYPTED' WHEN 1 THEN 'S_NO_STARTTLS' ELSE 'S_STRIP_DETECTED' END AS starttls_state,
         props->>'$.k' AS ja3, event_type || '.example' AS sni, CAST(trunc(value * 100) AS BIGINT) AS bytes, value > 200 AS is_anomaly
  FROM events)"""
