"""Relational operators: lookups with defaults, deduplication, idle sessions, trailing counts, interval joins, chains, set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_default(left: DataFrame, dimension: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """A left join whose missing columns take defaults. The planner broadcasts the dimension if its size allows."""
    return left.join(dimension.select(*on, *defaults), on, "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def first_of_hash(df: DataFrame, content: str, ident: str) -> DataFrame:
    """One row a content: its SHA-256, the smallest id, how many copies."""
    return df.where(F.col(content).isNotNull()).groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(ident).alias(ident), F.count("*").alias("copies"))


def idle_sessions(df: DataFrame, keys: list[str], ts: str, tie: str, idle: float, span: float = 86_400.0) -> DataFrame:
    """df with session_no: a new one begins after `idle` seconds without a row of the key.

    A key's rows are put in order by spans of time, so one with a large share of all rows is the work of many tasks: a
    span hands on its last time and how many sessions began in it, one row each. Null keys are one key, rows with a null
    time form a span of their own; ties go by `tie`.
    """
    cut = F.floor(F.col(ts) / F.lit(span))
    order = Window.partitionBy(*keys, "__span").orderBy(ts, tie)
    rows = df.withColumn("__span", cut).withColumn("__gap", F.col(ts) - F.lag(ts).over(order)).withColumn("__first", F.row_number().over(order) == 1)
    begins = F.when(~F.col("__first") & (F.col("__gap").isNull() | (F.col("__gap") >= idle)), 1).otherwise(0)
    rows = rows.withColumn("__own", F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = rows.groupBy(*keys, "__span").agg(F.min(ts).alias("__from"), F.max(ts).alias("__to"), F.max("__own").alias("__n"))
    among = Window.partitionBy(*keys).orderBy("__span")
    gap = F.col("__from") - F.lag("__to").over(among)
    spans = spans.withColumn("__n", F.col("__n") + F.when(gap.isNull() | (gap >= idle), 1).otherwise(0)).withColumn("__upto", F.sum("__n").over(among.rowsBetween(Window.unboundedPreceding, -1)))
    # Sessions begun before this span, and whether one begins with it.
    spans = spans.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__span").alias("__at"), F.coalesce("__upto", F.lit(0)).alias("__base"), F.when(gap.isNull() | (gap >= idle), 1).otherwise(0).alias("__opens"))
    same = F.col("__span").eqNullSafe(F.col("__at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(spans, same).select(*df.columns, (F.col("__base") + F.col("__opens") + F.col("__own")).alias("session_no"))


def trailing_count(df: DataFrame, keys: list[str], at: str, period: int, out: str = "n") -> DataFrame:
    """df with how many rows of the key lie in the last `period` whole units of `at` (an integer), itself and its equals included.

    Rows are dealt into buckets of a period, and lent to the next one, so a task orders the rows of two periods of a key,
    never all of a hot key's. Null keys are one key; rows with a null time count the others like them.
    """
    bucket = F.floor(F.col(at) / F.lit(period))
    lent = F.explode(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("b"), F.lit(False).alias("own"))))
    rows = df.withColumn("__x", lent).where(F.col("__x.own") | F.col(at).isNotNull())
    w = Window.partitionBy(*keys, "__x.b").orderBy(at).rangeBetween(-period, 0)
    return rows.withColumn(out, F.count("*").over(w)).where("__x.own").drop("__x")


def exploded_chain(df: DataFrame, chain: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != chain], F.posexplode(chain).alias("chain_position", "item")).withColumn("is_leaf", F.col("chain_position") == 0)


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count("*").alias("shared"))


#: Width of the narrowest time bucket of interval_join, how much wider the next ones are, and how many widths there are.
WIDTH, WIDER, LEVELS = 3600.0, 16, 5


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """points joined with all intervals of their keys that hold their time, both ends included; columns of both.

    An equi-join by time bucket: an interval lies in at most WIDER + 1 buckets of the width that suits its length, a
    point in one bucket of each width, so a pair meets once and no range-only condition is left. Intervals without an
    end, or longer than the widest bucket allows, meet their keys' points directly. Null keys, times and starts match
    nothing; an interval that ends before it starts is empty; repeated rows each count. Names must not clash but for keys.
    """
    step, length = [WIDTH * WIDER**i for i in range(LEVELS)], F.col(end) - F.col(start)
    level = F.lit(LEVELS)
    for i in reversed(range(LEVELS)):
        level = F.when(length <= step[i] * (WIDER - 1), i).otherwise(level)
    wide = F.element_at(F.array(*map(F.lit, [*step, 1.0])), F.col("__level") + 1)
    own = intervals.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start)))).withColumn("__level", F.coalesce(level, F.lit(LEVELS)))
    bucket = F.when(F.col("__level") == LEVELS, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col(start) / wide), F.floor(F.col(end) / wide)))
    own = own.withColumn("__bucket", F.explode(bucket))
    mine = F.explode(F.array(*[F.struct(F.lit(i).alias("__level"), F.floor(F.col(at) / w).alias("__bucket")) for i, w in enumerate(step)], F.struct(F.lit(LEVELS).alias("__level"), F.lit(0).cast("long").alias("__bucket"))))
    asked = points.where(F.col(at).isNotNull()).withColumn("__b", mine).select(*points.columns, "__b.__level", "__b.__bucket")
    met = asked.join(own, [*keys, "__level", "__bucket"]).where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) <= F.col(end))))
    return met.drop("__level", "__bucket")
