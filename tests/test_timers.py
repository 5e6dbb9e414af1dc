"""Streams against batches: timers that fire, restarts from a checkpoint, batches that run again."""

import json
import random

import pytest
from pyspark.sql import functions as F

import wire as W
from mailsonde.operators import flow
from mailsonde.streaming import sessions as streaming
from mailsonde.streaming import timers

NAMES = [x.split(" ")[0] for x in flow.SEGMENTS.split(", ")]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, timers.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def packets(r):
    """Flows with holes: filled in time, filled late, never filled; a flow that is silent for 300 s and goes on."""
    rows, at = [], 0

    def add(port, t, seq, body, flags=24, side="c"):
        nonlocal at
        ends = [(W.CLIENT, port), (W.SERVER, 25)]
        (a, ap), (b, bp) = ends if side == "c" else ends[::-1]
        rows.append(("c", at, W.T0 + t, None, a, ap, b, bp, seq, flags, body))
        at += 1

    for port in (1, 2, 3, 4):
        add(port, port, 100, b"", 2)
    add(1, 10, 101, b"abc")
    add(1, 12, 110, b"later")  # a hole of six bytes, filled after 8 s
    add(2, 12, 105, b"x")  # a hole of four, never filled
    add(1, 20, 104, b"middle")
    add(3, 21, 103, b"zz")  # a hole of two, filled after 50 s
    add(2, 30, 900, b"back", side="s")
    add(3, 71, 101, b"yy")
    add(4, 80, 101, b"first")
    add(4, 500, 106, b"second")
    add(9, 3000, 1, b"end")
    return rows


def run(df, path, out):
    q = df.writeStream.option("checkpointLocation", path).trigger(availableNow=True).format("parquet").start(out)
    q.awaitTermination()


def test_timers_fire_and_restarts_give_the_batch_answer(rocks, tmp_path):
    spark, rows = rocks, packets(random.Random(1))
    schema = spark.createDataFrame([], flow.SEGMENTS).schema
    parts = [rows[:7], rows[7:10], rows[10:13], rows[13:], [("c", 99, W.T0 + 9000, None, "1.1.1.1", 5, "2.2.2.2", 25, 1, 24, b"far")]]
    source = lambda: streaming.with_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), "ts", "1 second")
    for i, part in enumerate(parts):  # each part is a run of its own: stopped, and started from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        run(timers.flows_with_timers(source()), f"{tmp_path}/state", f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    told = lambda s: (s["client_port"], s["first_seen"], s["last_seen"], bytes(s["c2s_payload"]), bytes(s["s2c_payload"]), len(s["quality"]["gaps"]))
    want = sorted(told(s) for s in flow.reassembled(spark.createDataFrame(rows, schema)).collect())
    assert sorted(told(r["session"]) for r in got.where("kind = 'session'").collect()) == want and len(want) == 6
    gaps = sorted((r["gap"]["side"], r["gap"]["offset"], r["gap"]["len"], r["gap"]["at"] - W.T0) for r in got.where("kind = 'gap'").collect())
    assert gaps == [("c2s", 0, 2, 51.0), ("c2s", 0, 4, 42.0)]  # flow 1's hole was filled in time: its timer was taken back
    with pytest.raises(ValueError, match="RocksDB"):
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        timers.flows_with_timers(source())


def test_rows_are_in_one_place_after_a_batch_runs_again(spark, tmp_path):
    rows = [(i, None if i % 7 == 0 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, v double")
    df.where("id < 60").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    start = lambda: timers.parted(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/*"), F.when(F.col("v").isNull(), "no value"), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/state").trigger(availableNow=True).start()
    q = start()
    q.awaitTermination()
    metrics = [json.loads(p.json)["observedMetrics"]["parted"] for p in q.recentProgress if p.numInputRows]
    assert [(m["rows"], m["problems"]) for m in metrics] == [(60, 9)]
    df.where("id >= 60").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    start().awaitTermination()
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)  # as if the driver had died after writing: the batch runs again
    start().awaitTermination()
    good, bad = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/bad")
    ids = sorted(r["id"] for r in good.select("id").unionByName(bad.select("id")).collect())
    assert ids == list(range(100)) and {r["problem"] for r in bad.collect()} == {"no value"} and bad.count() == 15


def test_arrivals(spark):
    rows = [(b"\xa1\xb2\xc3\xd4" + b"x" * 9, 13), (b"\x0a\x0d\x0d\x0a", 4), (b"GIF8", 4), (b"", 0), (None, None), (b"\xa1\xb2\xc3\xd4", 1 << 40)]
    df = spark.createDataFrame([(bytearray(c) if c is not None else None, n) for c, n in rows], "content binary, length long")
    assert [r[0] for r in df.select(timers.arrival_problem(F.col("content"), F.col("length"))).collect()] == [None, None, "no capture", "empty", "empty", "too large"]
