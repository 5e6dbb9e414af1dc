"""Flows over a stream with timers of their own, and batches that part good rows from bad ones.

Each flow keeps its segments as a list, the bytes that wait for a missing segment as a map, and two event-time timers: one
30 seconds after a segment went missing, one 300 seconds after the last packet. State lives in RocksDB column families, so
a new packet appends to its flow's list and rewrites nothing else; a restart goes on from the checkpoint, timers included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import flow
from ..schemas import REASSEMBLED
from ..sources.capture import MAGIC, SECTION

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GAP = "struct<side:string,offset:long,len:long,at:double>"
TIMED = f"capture_id string, kind string, gap {GAP}, session struct<{', '.join(x.replace(' ', ':', 1) for x in REASSEMBLED.split(', '))}>"
_NAMES = [x.strip().split(" ")[0] for x in flow.SEGMENTS.split(",")]
SIDES = ("c2s", "s2c")


class FlowTimers(StatefulProcessor):
    """Packets of one flow: sessions when it has been silent for `idle` seconds, gaps when a segment is missing for `wait`."""

    def __init__(self, ports, limit: int, idle: float, wait: float):
        self.ports, self.limit, self.idle, self.wait = ports, limit, idle, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.segments = handle.getListState("segments", flow.SEGMENTS)
        self.waiting = handle.getMapState("waiting", "side int, at long", "len long, ts double")
        self.sides = handle.getMapState("sides", "side int", "isn long, next long, due long")
        self.flow = handle.getValueState("flow", "client string, port int, last double, end long, bytes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((r for b in rows for r in b[_NAMES].to_dict("records")), key=lambda r: r["index"])
        held = self.flow.get() if self.flow.exists() else None
        if held is None:
            f = flow.Flow(new[0], self.ports, self.limit)
            held = (*f.client, new[0]["ts"], 0, 0)
        client, last, end, size = tuple(held[:2]), held[2], held[3], held[4]
        kept, out = [], []
        for r in new:
            last = max(last, r["ts"])
            out += self._missed(key, int(r["ts"] * 1000))  # the flow's own packet tells the time before the watermark does
            self._seen(0 if (r["src"], r["sport"]) == client else 1, r)
            r["body"] = bytes(r["body"])[: max(0, 2 * self.limit - size)]
            size += len(r["body"])
            r["vlan"] = None if pd.isna(r["vlan"]) else int(r["vlan"])
            kept.append(tuple(r[n] for n in _NAMES))
        self.segments.appendList(kept)
        if end:
            self.handle.deleteTimer(end)
        end = max(int((last + self.idle) * 1000), timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(end)
        self.flow.update((*client, last, end, size))
        if out:
            yield pd.DataFrame(out, columns=["capture_id", "kind", "gap", "session"])

    def _missed(self, key, now: int) -> list[dict]:
        """The holes whose time is up, each told at the time it was due; what comes after them is read on."""
        out = []
        for side in (0, 1):
            while self.sides.containsKey((side,)):
                isn, following, due = self.sides.getValue((side,))
                starts = sorted(k[1] for k in self.waiting.keys() if k[0] == side)
                if not due or due > now or not starts:
                    break
                out.append({"capture_id": key[0], "kind": "gap", "gap": {"side": SIDES[side], "offset": following, "len": starts[0] - following, "at": due / 1000}, "session": None})
                self._cancel(due)
                following = self._drained(side, starts[0])
                more = any(k[0] == side for k in self.waiting.keys())
                due = due + int(self.wait * 1000) if more else 0
                if due:
                    self.handle.registerTimer(due)
                self.sides.updateValue((side,), (isn, following, due))
        return out

    def _seen(self, side: int, r: dict) -> None:
        isn, following, due = self.sides.getValue((side,)) if self.sides.containsKey((side,)) else (None, 0, 0)
        seq, n = r["seq"], len(r["body"])
        if r["flags"] & flow.SYN:
            seq = (seq + 1) & 0xFFFFFFFF
        isn = seq if isn is None else isn
        if n:
            base = (isn + following) & 0xFFFFFFFF
            at = following + ((seq - base + flow.HALF) & 0xFFFFFFFF) - flow.HALF
            if at > following:
                self.waiting.updateValue((side, at), (n, r["ts"]))
                if not due:
                    due = int((r["ts"] + self.wait) * 1000)
                    self.handle.registerTimer(due)
            else:
                following = self._drained(side, max(following, at + n))
                if due and not any(k[0] == side for k in self.waiting.keys()):
                    self._cancel(due)
                    due = 0
        self.sides.updateValue((side,), (isn, following, due))

    def _cancel(self, due: int) -> None:
        other = [v[2] for v in self.sides.values()]
        if other.count(due) <= 1:  # both sides may wait for one moment
            self.handle.deleteTimer(due)

    def _drained(self, side: int, following: int) -> int:
        for at, n in sorted((k[1], v[0]) for k, v in self.waiting.iterator() if k[0] == side):
            if at > following:
                break
            following = max(following, at + n)
            self.waiting.removeKey((side, at))
        return following

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = self._missed(key, at)
        held = self.flow.get() if self.flow.exists() else None
        if held is not None and held[3] == at:
            rows = [dict(zip(_NAMES, r, strict=True)) for r in self.segments.get()]
            out += [{"capture_id": key[0], "kind": "session", "gap": None, "session": s} for s in flow.rebuild(rows, self.ports, self.limit)]
            for due in {v[2] for v in self.sides.values()} - {0, at}:
                self.handle.deleteTimer(due)
            for state in (self.segments, self.waiting, self.sides, self.flow):
                state.clear()
        if out:
            yield pd.DataFrame(out, columns=["capture_id", "kind", "gap", "session"])

    def close(self) -> None:
        pass


def flows_with_timers(segments: DataFrame, ports=flow.MAIL_PORTS, limit: int = flow.HANDSHAKE, idle: float = flow.IDLE, wait: float = flow.GAP_WAIT) -> DataFrame:
    """A stream of segments (SEGMENTS with event_time and a watermark) as rows of TIMED.

    kind `session`: a flow that was silent for `idle` seconds of event time, rebuilt by the batch rule from its segments,
    cut to twice `limit` bytes; `gap`: a hole that nobody filled within `wait` seconds, told once when its timer fires.
    Rows behind the watermark are dropped; a flow that goes on later is a session of its own, as in the batch rule. Needs
    spark.sql.streaming.stateStore.providerClass to be RocksDB's (ROCKSDB).
    """
    spark = segments.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    keyed = segments.withColumn("lo", F.least(a, b).cast("string")).withColumn("hi", F.greatest(a, b).cast("string")).withColumn("lan", F.coalesce(F.col("vlan"), F.lit(-1)))
    return keyed.groupBy("capture_id", "lo", "hi", "lan").transformWithStateInPandas(FlowTimers(tuple(ports), limit, idle, wait), TIMED, "append", "EventTime")


# -- good rows and bad ones


def arrival_problem(content: Column, length: Column, most: int = 1 << 31) -> Column:
    """Why a file that arrived is no capture to read: `too large`, `empty`, `no capture`; null if nothing is wrong."""
    known = F.substring(content, 1, 4).isin(*[F.lit(m) for m in (*MAGIC, SECTION)])
    return F.when(length > most, "too large").when(F.coalesce(length, F.lit(0)) == 0, "empty").when(~F.coalesce(known, F.lit(False)), "no capture")


def parted(stream: DataFrame, problem: Column, good: str, bad: str, checkpoint: str, name: str = "parted") -> DataStreamWriter:
    """A writer that puts rows without a problem under `good` and the others, with the column `problem`, under `bad`.

    Each batch writes its own folder, batch_id=n, whole: a batch that runs again replaces what it wrote, so every row is
    in exactly one place however often a batch failed between the two. The metrics `rows` and `problems` of each batch
    are in the query's progress, under `name`. Start it with trigger and start(); read the folders as Parquet.
    """
    told = stream.withColumn("problem", problem).observe(name, F.count(F.lit(1)).alias("rows"), F.count("problem").alias("problems"))

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            batch.where("problem is not null").write.mode("overwrite").parquet(f"{bad}/batch_id={number}")
            batch.where("problem is null").drop("problem").write.mode("overwrite").parquet(f"{good}/batch_id={number}")
        finally:
            batch.unpersist()

    return told.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
