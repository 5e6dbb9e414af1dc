"""Exact order statistics by refined ranges: no value buffer, no task that holds a column.

Values are counted by buckets whose number grows with the value; a bucket that holds a wanted rank becomes a cell, and only
its values are read again, cut into buckets between its own least and greatest value, until these two are one. The first
buckets are a value's sign and binary order of magnitude, so each later step gains sixteen binary digits whatever the
values' spread: five passes at most, of which only the first two see all rows.
"""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.trust import settled

BUCKETS = 65_536
CELLS = "cell long, feature string"
HITS = "cell long, rank long"
STEPS = "cell long, bucket long, next long, lo double, hi double"


def selected(x: DataFrame, ranks: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values of given ranks (from 0) of each feature of x (feature, v), v neither null nor NaN.

    What goes to the driver and to every task is one row a wanted rank and pass.
    """
    spark = x.sparkSession
    found: dict[tuple[str, int], float] = {}
    size = F.least(F.greatest(F.floor(F.log2(F.abs("v"))), F.lit(-1100)), F.lit(1100)) + 1200
    magnitude = F.when(F.col("v") == 0, 0).when(F.col("v") > 0, size).otherwise(-size).cast("long")
    # A cell: its feature, and for each wanted rank the place among the cell's own values.
    cells = {i: (f, {k: k for k in ks}) for i, (f, ks) in enumerate(sorted(ranks.items())) if ks}
    if not cells:
        return found
    rows = x.join(F.broadcast(spark.createDataFrame([(i, f) for i, (f, _) in cells.items()], CELLS)), "feature").select("cell", "v", magnitude.alias("bucket"))
    passes = 0
    while True:
        counts = rows.groupBy("cell", "bucket").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # At most BUCKETS rows a cell.
        upto = F.sum("n").over(Window.partitionBy("cell").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        wanted = spark.createDataFrame([(i, own) for i, (_, ks) in cells.items() for own in set(ks.values())], HITS)
        hits = counts.withColumn("upto", upto).join(F.broadcast(wanted), "cell").where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).collect()
        following: dict[tuple[int, int], tuple[str, dict[int, int], float, float]] = {}
        for r in hits:
            feature, ks = cells[r["cell"]]
            for k, own in ks.items():
                if own == r["rank"]:
                    if r["lo"] == r["hi"]:
                        found[feature, k] = r["lo"]
                    else:
                        following.setdefault((r["cell"], r["bucket"]), (feature, {}, r["lo"], r["hi"]))[1][k] = own - (r["upto"] - r["n"])
        if not following:
            return found
        cells = {i: (feature, ks) for i, (feature, ks, _, _) in enumerate(following.values())}
        step = spark.createDataFrame([(cell, bucket, i, lo, hi) for i, ((cell, bucket), (_, _, lo, hi)) in enumerate(following.items())], STEPS)
        # Halves keep the difference of the ends finite; ends that round to one half still part into two buckets.
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.coalesce(F.least(F.floor(share * (BUCKETS - 1)), F.lit(BUCKETS - 1)), F.when(F.col("v") > F.col("lo"), 1).otherwise(0))
        rows = rows.join(F.broadcast(step), ["cell", "bucket"]).select(F.col("next").alias("cell"), "v", bucket.cast("long").alias("bucket"))
        passes += 1
        if passes == 2:
            rows = settled(rows, "ranks")  # a few buckets' values: the passes after this one leave the source alone


def quantiles(df: DataFrame, names: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, interpolated between neighbours as percentile() does; None for columns without values.

    Nulls and NaN are left out; infinities count by their order. Names times probabilities numbers go to the driver.
    """
    x = df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "feature", "v").where("v is not null and not isnan(v)")
    sizes = {r["feature"]: r["count"] for r in x.groupBy("feature").count().collect()}
    places = {c: [p * (sizes[c] - 1) for p in probs] for c in names if sizes.get(c)}
    got = selected(x, {c: {k for q in qs for k in (floor(q), ceil(q))} for c, qs in places.items()})
    out: dict[str, list[float | None]] = {}
    for c in names:
        out[c] = [None] * len(probs)
        for i, q in enumerate(places.get(c, [])):
            a, b = got[c, floor(q)], got[c, ceil(q)]
            out[c][i] = a if a == b else a * (ceil(q) - q) + b * (q - floor(q))
    return out
