"""Isolation forest: trees from bounded samples, scores by trees that every task has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, SEED = 100, 256, 42


def _depth(n) -> np.ndarray:
    """Average path length of a search without success among n rows."""
    n = np.asarray(n, float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    return np.where(big, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), out)


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """Nodes (feature, split, left, right, size); feature -1: a leaf."""
    nodes: list[list[float]] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes)
        lo, hi = x[rows].min(0), x[rows].max(0)
        free = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(free):
            nodes.append([-1, 0, -1, -1, len(rows)])
            continue
        f = rng.choice(free)
        split = rng.uniform(lo[f], hi[f])
        nodes.append([f, split, -1, -1, len(rows)])
        left = x[rows, f] < split
        todo += [(rows[left], depth + 1, len(nodes) - 1, 0), (rows[~left], depth + 1, len(nodes) - 1, 1)]
    return np.array(nodes)


def fit(vectors: DataFrame, vector: str, ident: str, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> list[np.ndarray]:
    """Each tree takes `sample` rows of a pool of at most 20 * sample rows, first by a hash of their ids."""
    pool = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(ident, F.lit(seed)), ident).limit(20 * sample).select(vector).toPandas()[vector]
    if not len(pool):
        return []
    x, rng = np.array(pool.tolist(), float), np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(2, min(sample, len(x))))))
    return [grow(x[rng.choice(len(x), min(sample, len(x)), replace=False)], rng, limit) for _ in range(trees)]


def score(x: np.ndarray, trees: list[np.ndarray], sample: int = SAMPLE) -> np.ndarray:
    total = np.zeros(len(x))
    for t in trees:
        node, depth = np.zeros(len(x), int), np.zeros(len(x))
        while True:
            inner = np.flatnonzero(t[node, 0] >= 0)
            if not len(inner):
                break
            n = t[node[inner]]
            left = x[inner, n[:, 0].astype(int)] < n[:, 1]
            node[inner] = np.where(left, n[:, 2], n[:, 3]).astype(int)
            depth[inner] += 1
        total += depth + _depth(t[node, 4])
    return 2.0 ** (-(total / len(trees)) / max(float(_depth(sample)), 1e-9))


def anomaly_scores(vectors: DataFrame, ident: str, vector: str, contamination: float = 0.05) -> DataFrame:
    """(ident, anomaly_score in (0, 1], is_anomaly: above the quantile that contamination names). Null vectors score null.

    Without a model (no rows) scores are null, never a made-up constant.
    """
    trees = fit(vectors, vector, ident)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out, ok = np.full(len(s), np.nan), s.notna().to_numpy()
            if trees and ok.any():
                out[ok] = score(np.array(s[ok].tolist(), float), trees)
            yield pd.Series(out).astype("Float64").mask(np.isnan(out))

    out = vectors.select(ident, scored(vector).alias("anomaly_score"))
    cut = out.agg(F.percentile_approx("anomaly_score", 1 - contamination, 10_000).alias("cut"))
    return out.join(F.broadcast(cut), F.lit(True)).select(ident, "anomaly_score", (F.col("anomaly_score") > F.col("cut")).alias("is_anomaly"))
