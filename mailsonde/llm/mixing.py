"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, stored

BUCKETS = 4096


def text_size(c):
    """Number of runs without ASCII white space; null has none. Counted as a split, inside the JVM."""
    trimmed = F.regexp_replace(F.coalesce(c, F.lit("")), rf"\A{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def text_name(c):
    return F.md5(F.coalesce(c, F.lit("")))


def water_fill(sources: DataFrame, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size, weight) with a column `target`.

    The mix holds share times all sizes. Sources are clamped at cap times their size, and what they leave is given to
    the others by weight, until none is above. In closed form: in order of cap * size / weight, source k and all later
    ones stay below their clamps if the level (what is left) / (their weights) does not exceed k's own ratio. Weights
    must be positive. Works on one row a source.
    """
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    x = sources.withColumn("room", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("room") / F.col("weight"))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    x = x.withColumn("level", level)
    # The first level that its own source's ratio allows; none: all sources are clamped.
    x = x.withColumn("fill", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("fill").isNull(), F.col("room")).otherwise(F.least("room", F.col("fill") * F.col("weight")))
    return x.select("source", "source_size", "weight", target.alias("target"))


def source_weights(sources: DataFrame, cycle: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """sources with `weight`: the cycle over the sources by code point (UTF-8 byte order is the same), null last."""
    at = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(cycle)))
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (at + 1).cast("int")))


def sampled(sizes: DataFrame, targets: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """sizes (id, h, source, size, and what else) with source_size, target, taken and times: whole repetitions plus a seeded fraction.

    Every document of a source is taken floor(target / source_size) times; the rest of the target is filled by whole
    documents in the order of a seeded hash of their ids and texts (h), up to the one whose middle crosses it, so that the sum misses
    the target by half a document at most. Sums by (source, bucket of the hash) find the crossing bucket, and only its
    rows are put in order: no source is ever gathered, however hot. sizes and targets must be stored tables.
    """
    u = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("h")))
    rows = sizes.withColumn("u", u).withColumn("bucket", F.conv(F.substring("u", 1, 3), 16, 10).cast("int"))
    goal = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    base = targets
    targets = targets.withColumn("whole", goal.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    by = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
    same = F.col("b.source").eqNullSafe(F.col("t.source"))
    cross = by.withColumn("upto", upto).alias("b").join(targets.alias("t"), same).where("upto > rest")
    cross = cross.groupBy("b.source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("c"))
    targets = targets.alias("t").join(cross.alias("x"), F.col("t.source").eqNullSafe(F.col("x.source")), "left").select("t.*", F.col("c.bucket").alias("at"), F.col("c.before").alias("before"))
    full = rows.alias("r").join(broadcast_if_small(targets, base).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target", "whole", "rest", "at", "before")
    edge = full.where("bucket = at")
    run = F.sum("size").over(Window.partitionBy("source").orderBy("u", F.asc_nulls_last("id"), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("extra", (F.col("before") + run - F.col("size") / 2 <= F.col("rest")).cast("int"))
    rest = full.where("at is null or bucket <> at").withColumn("extra", F.coalesce((F.col("bucket") < F.col("at")).cast("int"), F.lit(0)))
    out = rest.unionByName(edge).withColumn("times", F.col("whole") + F.col("extra"))
    return out.withColumn("taken", F.col("times") * F.col("size")).drop("u", "bucket", "whole", "rest", "at", "before", "extra")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, cycle=(3.0, 1.0, 2.0), seed: int = 42) -> DataFrame:
    """Per document: id, h, source, size, source_size, target, taken, times; h is the md5 of the text.

    Texts are read once, whole, into a stored table of sizes; all else works on that. Null texts have size 0 and take 0
    words; null sources are one source, last in order; rows that share an id, or have none, are told apart by their
    texts, and repeated rows are taken each for itself, by size where hashes tie. A source without words gets target
    0. An empty table gives no rows. Other columns are not read.
    """
    sizes = stored(docs.select(F.col(id_col).alias("id"), text_name(F.col(text)).alias("h"), F.col(source).alias("source"), text_size(F.col(text)).alias("size")), "sizes")
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sampled(sizes, stored(water_fill(source_weights(sums, cycle), share, cap), "targets"), seed)


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with docs' columns; documents without words, null texts among them, go.

    The plan is joined by id and text; rows that share both come as often as the one taken most. Null ids and sources are
    kept apart as in plan_mix(); texts are read whole. No documents: no rows. docs must not have columns __times or __copy.
    """
    times = plan_mix(docs, id_col, **how).where("times > 0 and size > 0").groupBy("id", "h").agg(F.max("times").alias("__times"))
    text = docs[how.get("text", "text")]
    kept = docs.join(times, docs[id_col].eqNullSafe(times["id"]) & (text_name(text) == times["h"]))
    return kept.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(*[docs[c] for c in docs.columns])
