"""Connected components by repeated contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Rows that a task takes: fewer, larger files where a graph is small.
ROWS = 500_000


def _rank(c):
    return F.struct(F.xxhash64(c).alias("h"), c.alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a, b); component is the smallest id reachable.

    Each round points every vertex at the neighbour (or itself) of lowest hashed rank, jumps once more, and maps the
    edges onto what was pointed at; hashed ranks make the vertices left shrink by a constant share on paths and stars
    alike, so rounds grow with the logarithm of the longest path. Minima are combined before each shuffle, and the joins
    on a hub's id are ones that adaptive execution may split. Each round's tables are written by one task for ROWS edges,
    whatever the number of shuffle partitions. Null ends and loops are dropped. No edges: no rows.
    """
    both = edges.where("a <> b").select("a", "b")
    tasks = 1 + 2 * both.count() // ROWS
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", tasks)
    labels = None
    while True:
        near = both.groupBy("a").agg(F.min(_rank(F.col("b"))).alias("m"))
        to = near.select(F.col("a").alias("v"), F.least(_rank(F.col("a")), "m")["v"].alias("p"))
        to = stored(to, "pointers", tasks)
        if labels is None and to.isEmpty():
            return to.select(F.col("v").alias("id"), F.col("p").alias("component"))
        jump = to.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        to = to.join(jump, "p", "left").select("v", F.coalesce("pp", "p").alias("p"))
        if labels is None:
            labels = stored(to.select(F.col("v").alias("id"), F.col("p").alias("label")), "labels", tasks)
        else:
            step = to.select(F.col("v").alias("label"), "p")
            labels = stored(labels.join(step, "label", "left").select("id", F.coalesce("p", "label").alias("label")), "labels", tasks)
        ends = to.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        other = to.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        left = both.join(ends, "a").join(other, "b").where("pa <> pb")
        both = stored(left.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges", tasks)
        if both.isEmpty():
            break
    least = labels.groupBy("label").agg(F.min("id").alias("component"))
    return labels.join(least, "label").select("id", "component")
