"""The streaming forms: event time is the packets' and sessions' own clock, state is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import flow
from ..schemas import REASSEMBLED


def with_time(stream: DataFrame, ts: str = "first_seen", delay: str = "5 minutes") -> DataFrame:
    return stream.withColumn("event_time", F.timestamp_seconds(F.col(ts))).withWatermark("event_time", delay)


def idle_windows(stream: DataFrame, keys: list[str], idle: str = "300 seconds") -> DataFrame:
    """Session windows: a key's rows less than `idle` apart."""
    g = stream.groupBy(F.session_window("event_time", idle).alias("w"), *keys).agg(F.count("*").alias("n_events"))
    return g.select(*keys, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n_events")


def trend(stream: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling windows, or sliding ones, with the overview's figures."""
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    g = stream.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg("risk_score").alias("avg_risk"), F.count_if(F.col("risk_score") >= 80).alias("critical"))
    return g.select(F.col("w.start").alias("starts"), "n", "avg_risk", "critical")


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)


BEACON = "n_events long, n_gaps long, mean_gap double, cv double, last_seen double"
_STATE = "n long, gaps long, mean double, m2 double, last double"


def running_timing(stream: DataFrame, keys: list[str], ts: str = "first_seen", forget: float = 86_400.0) -> DataFrame:
    """Timing of each key so far, after each batch; state is five numbers a key, and is dropped after `forget` silent seconds.

    Rows that come late within the watermark count as events, but only steps ahead in time are gaps.
    """
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in (stream.schema[k] for k in keys)), BEACON])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, gaps, mean, m2, last = state.get if state.exists else (0, 0, 0.0, 0.0, float("-inf"))
        for t in sorted(t for b in batches for t in b[ts]):
            n += 1
            if last > float("-inf") and t > last:
                gaps += 1
                d = t - last - mean
                mean += d / gaps
                m2 += d * (t - last - mean)
            last = max(last, t)
        state.update((n, gaps, mean, m2, last))
        state.setTimeoutTimestamp(max(int((last + forget) * 1000), state.getCurrentWatermarkMs() + 1))
        dev = (m2 / (gaps - 1)) ** 0.5 if gaps > 1 else 0.0
        yield pd.DataFrame([[*key, n, gaps, mean if gaps else None, dev / mean if gaps and mean else None, last]], columns=[*keys, *(x.strip().split(" ")[0] for x in BEACON.split(","))])

    return stream.groupBy(*keys).applyInPandasWithState(step, schema, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def flows(segments: DataFrame, ports=flow.MAIL_PORTS, limit: int = flow.HANDSHAKE, idle: float = flow.IDLE) -> DataFrame:
    """Reassembly of a stream of segments (with event_time and a watermark): a flow is given out when it is silent for `idle` seconds.

    Its segments wait in the state store, cut to the handshake's bytes, and are rebuilt by the batch rule, so both give
    the same sessions.
    """
    import pickle

    names = [x.strip().split(" ")[0] for x in flow.SEGMENTS.split(",")]
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    keyed = segments.withColumn("lo", F.least(a, b).cast("string")).withColumn("hi", F.greatest(a, b).cast("string"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{"capture_id": key[0], **s} for s in flow.rebuild(held, ports, limit)])
            return
        size = sum(len(r["body"]) for r in held)
        for batch in batches:
            for r in batch[names].to_dict("records"):
                r["body"] = bytes(r["body"])[: max(0, 2 * limit - size)]
                size += len(r["body"])
                held.append(r)
        state.update((pickle.dumps(held),))
        state.setTimeoutTimestamp(max(int((max(r["ts"] for r in held) + idle) * 1000), state.getCurrentWatermarkMs() + 1))

    return keyed.groupBy("capture_id", "lo", "hi", "vlan").applyInPandasWithState(step, f"capture_id string, {REASSEMBLED}", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
