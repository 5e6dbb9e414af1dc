"""Supervised models compared under grouped splits: no group is ever on both sides.

Folds are a function of the group's name, so they need no shuffle and are the same in every run. Each model is trained
once a fold by Spark's own estimators; all predictions go into one table, and one aggregate over it counts every model's
and fold's confusion.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.trust import settled

FOLDS = 5


def share(group: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that follows from the group's name and the seed; null groups are one group."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(group.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def with_fold(df: DataFrame, group: str, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """df with `fold`, 0 to folds - 1, the same for all rows of a group."""
    return df.withColumn("fold", F.floor(share(F.col(group), seed) * folds).cast("int"))


def assembled(df: DataFrame, features: list[str], label: str, *keep: str) -> DataFrame:
    """Rows with a label of 0 or 1 as (features, label, keep); null and NaN features count 0."""
    known = df.where(F.col(label).isin(0, 1))
    x = known.select(*keep, F.col(label).cast("double").alias("label"), *[F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x_{f}") for f in features])
    return VectorAssembler(inputCols=[f"x_{f}" for f in features], outputCol="features").transform(x).select("features", "label", *keep)


def cross_validated(df: DataFrame, features: list[str], label: str, group: str, models: dict[str, Estimator], folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """(model, fold, group, label, prediction) of every labelled row, predicted by a model that saw no row of its group.

    A fold whose other folds lack a class is predicted by none: its rows are left out, and comparison() shows fewer
    folds. Rows without a label are left out; repeated rows count each. Predictions are written, so models run once.
    """
    x = settled(with_fold(assembled(df, features, label, group), group, folds, seed), "folds")
    classes = {r["fold"]: (r["n0"], r["n1"]) for r in x.groupBy("fold").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1")).collect()}
    out = None
    for name, model in models.items():
        for fold in sorted(classes):
            if not all(sum(n[k] for f, n in classes.items() if f != fold) for k in (0, 1)):
                continue
            told = model.fit(x.where(F.col("fold") != fold)).transform(x.where(F.col("fold") == fold))
            part = told.select(F.lit(name).alias("model"), "fold", F.col(group).alias("group"), "label", "prediction")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return df.sparkSession.createDataFrame([], "model string, fold int, group string, label double, prediction double")
    return settled(out, "predictions")


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """(by, tp, fp, fn, tn, precision, recall, f1, accuracy) in one pass; ratios without a denominator are null."""
    y, p = F.col("label") == 1, F.col("prediction") == 1
    g = predictions.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)})


def comparison(predictions: DataFrame) -> DataFrame:
    """Per model: folds, mean and deviation of the folds' f1, and the best model first: by mean f1, then by name."""
    g = confusion(predictions, "model", "fold").groupBy("model").agg(F.count("*").alias("folds"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("mean_f1"), F.stddev_pop(F.coalesce("f1", F.lit(0.0))).alias("dev_f1"))
    return g.orderBy(F.desc("mean_f1"), "model")


def learning_curve(df: DataFrame, features: list[str], label: str, group: str, model: Estimator, shares=(0.25, 0.5, 0.75, 1.0), test: float = 0.2, seed: int = 42) -> DataFrame:
    """(share, groups, confusion columns): the same held-out groups, predicted by models that saw growing shares of the others' groups.

    Shares without both classes are left out.
    """
    at = share(F.col(group), seed)
    x = settled(assembled(df, features, label, group).withColumn("at", at), "curve")
    held, out = x.where(F.col("at") < test), None
    for s in shares:
        seen = x.where((F.col("at") >= test) & (F.col("at") < test + (1 - test) * s))
        n = seen.agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b"), F.count_distinct(group).alias("g")).first()
        if n["a"] and n["b"]:
            part = model.fit(seen).transform(held).select(F.lit(float(s)).alias("share"), F.lit(n["g"]).alias("groups"), "label", "prediction")
            out = part if out is None else out.unionByName(part)
    return confusion(out, "share", "groups") if out is not None else held.sparkSession.createDataFrame([], "share double, groups long, tp long, fp long, fn long, tn long, precision double, recall double, f1 double, accuracy double")


def ablation(df: DataFrame, features: list[str], label: str, group: str, model: Estimator, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """(without, f1, lost): f1 over all folds without each feature, and how much less that is than with all (`without` null)."""
    sets = {None: features} | {f: [x for x in features if x != f] for f in features if len(features) > 1}
    parts = [confusion(cross_validated(df, some, label, group, {"m": model}, folds, seed)).select(F.lit(gone).cast("string").alias("without"), F.coalesce("f1", F.lit(0.0)).alias("f1")) for gone, some in sets.items()]
    rows = [r for p in parts for r in p.collect()]  # one row a feature
    whole = next(r["f1"] for r in rows if r["without"] is None)
    return df.sparkSession.createDataFrame([(r["without"], r["f1"], whole - r["f1"]) for r in rows], "without string, f1 double, lost double")
