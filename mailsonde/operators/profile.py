"""Feature profiles, drift, splits, thresholds and score summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def feature_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Per feature: counts, moments, exact quantiles and a quality class. Features are rows before they are grouped.

    Quantiles are selected by refined ranges (ranks.quantiles), as soon as this is called; nulls count nowhere, NaN and
    infinities in the counts only. Features without values have no row.
    """
    num = lambda c: F.col(c).cast("double")
    sane = df.select(*[F.when(~F.isnan(num(c)) & (F.abs(num(c)) != float("inf")), num(c)).alias(c) for c in names])
    q = [(c, *map(float, v)) if v[0] is not None else (c, None, None, None) for c, v in quantiles(sane, names, [0.5, 0.95, 0.99]).items()]
    ordered = df.sparkSession.createDataFrame(q, "feature string, median double, p95 double, p99 double")
    x = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "feature", "v")
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    g = x.groupBy("feature").agg(
        F.count("v").alias("n"), F.count_if(F.isnan("v")).alias("n_nan"), F.count_if(F.col("v") == 0).alias("n_zero"), F.count_distinct("v").alias("n_unique"), F.avg(finite).alias("mean"), F.stddev_samp(finite).alias("std"), F.var_samp(finite).alias("var"),
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(F.when(finite.isNotNull(), 1.0).otherwise(0.0)).alias("finite_rate"),
    )
    kind = F.when(F.col("n_unique") <= 1, "CONSTANT").when(F.col("std") < 1e-3, "NEAR_CONSTANT").when(F.col("finite_rate") < 1, "REQUIRES_SEMANTIC_REVIEW").otherwise("VALID")
    return g.join(F.broadcast(ordered), "feature", "left").withColumn("quality", kind)


def shift(df: DataFrame, feature: str, value: str, base: Column, other: Column) -> DataFrame:
    """|difference of means| over the base's deviation + 1e-6, per feature, and what it is called; null where a side is empty."""
    v = F.col(value)
    g = df.groupBy(feature).agg(F.avg(F.when(base, v)).alias("m0"), F.stddev_samp(F.when(base, v)).alias("s0"), F.avg(F.when(other, v)).alias("m1"))
    z = F.abs(F.col("m1") - F.col("m0")) / (F.col("s0") + 1e-6)
    return g.withColumn("z", z).withColumn("shift", F.when(z.isNull(), None).when(z < 0.5, "STABLE").when(z < 1.0, "MODERATE_SHIFT").otherwise("SEVERE_SHIFT"))


def group_split(df: DataFrame, group: str, seed: int = 42, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """(group, split): whole groups, in the order of a seeded hash. One row a group is put in order, not the rows."""
    g = df.select(F.coalesce(F.col(group), F.lit("")).alias(group)).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}|"), group), 256))
    p = F.percent_rank().over(Window.orderBy("h"))
    return g.withColumn("p", p).select(group, F.when(F.col("p") < train, "train").when(F.col("p") < train + validation, "validation").otherwise("test").alias("split"))


def threshold_grid(df: DataFrame, score: str, label: str, thresholds=tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """The confusion matrix and its ratios at each threshold, from one pass: each row counts once per threshold."""
    grid = df.select(F.col(score).alias("s"), F.col(label).alias("y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    g = grid.groupBy("threshold").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)})


def best_threshold(grid: DataFrame, recall: float = 0.80) -> DataFrame:
    """The threshold of highest precision among those that keep the recall."""
    return grid.where(F.col("recall") >= recall).agg(F.max_by("threshold", F.struct("precision", "threshold")).alias("threshold"))


def score_summary(df: DataFrame, score: str, flag: float = 0.5) -> DataFrame:
    """Scores scaled to [0, 1] by their own range (all alike: 0): mean, deviation, 95th percentile, share at the flag or above.

    The percentile is that of the scores as they are, scaled afterwards; it is selected by refined ranges. Nulls are left
    out; without scores one row of nulls and n = 0.
    """
    bounds = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    scaled = lambda v: F.when(F.col("hi") > F.col("lo"), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    (p95,) = quantiles(df, [score], [0.95])[score]
    s = df.where(F.col(score).isNotNull()).join(F.broadcast(bounds), F.lit(True)).select(scaled(F.col(score)).alias("x"), scaled(F.lit(p95).cast("double")).alias("q"))
    return s.agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("q").alias("p95"), F.avg(F.when(F.col("x") >= flag, 1.0).otherwise(0.0)).alias("flag_rate"))


def invalid_vectors(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector is null, of another length, or holds null, NaN or infinity."""
    bad = F.col(vector).isNull() | (F.size(vector) != size) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(bad)
