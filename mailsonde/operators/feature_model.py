"""The feature pipeline as an estimator and a model: medians, quantiles and an isolation forest, saved as plain Parquet.

Fitting gathers numbers only (names x quantiles, and the forest's bounded sample); transforming is one pass. A saved model
is three tables and a manifest with the digest of all their numbers: loading takes kinds on a list, checks the digest, and
can demand one that somebody approved. Nothing in it is code.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anomaly
from .ranks import quantiles

KIND, VERSION = "isolation-forest-on-normal-scores", 1
GRID = "feature int, i int, q double"
NODES = "tree int, i int, feature int, split double, left int, right int, size int"


class ModelRefused(ValueError):
    """A saved model that is damaged, of a kind that is not wanted, or not approved."""


class NotFitted(RuntimeError):
    pass


class _Settings(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    idCol = Param(Params._dummy(), "idCol", "column whose hash orders the forest's sample", TypeConverters.toString)
    quantiles = Param(Params._dummy(), "quantiles", "points of each feature's grid, two or more", TypeConverters.toInt)
    trees = Param(Params._dummy(), "trees", "trees of the forest", TypeConverters.toInt)
    sample = Param(Params._dummy(), "sample", "rows of a tree; the forest sees 20 times as many at most", TypeConverters.toInt)
    contamination = Param(Params._dummy(), "contamination", "share of the fitted rows above the threshold", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of the forest", TypeConverters.toInt)

    def _told(self) -> dict:
        return {p.name: self.getOrDefault(p) for p in self.params if self.isDefined(p)}


class FeaturePipeline(Estimator, _Settings):
    """fit() gives a FeaturePipelineModel; the estimator itself transforms nothing.

    Nulls and NaN become a feature's median (0 if it has no values), features are mapped by their own quantiles to normal
    scores, and the forest scores what comes out. Rows of null ids, ties and repeated rows count like any other; a table
    without rows cannot be fitted.
    """

    def __init__(self, inputCols: list[str], idCol: str, **settings):
        super().__init__()
        self._setDefault(quantiles=100, trees=anomaly.TREES, sample=anomaly.SAMPLE, contamination=0.05, seed=anomaly.SEED)
        self._set(inputCols=inputCols, idCol=idCol, **settings)

    def transform(self, dataset, params=None):
        raise NotFitted("fit() gives the model that transforms")

    def _fit(self, dataset: DataFrame) -> FeaturePipelineModel:
        told = self._told()
        names = told["inputCols"]
        probs = [i / (told["quantiles"] - 1) for i in range(told["quantiles"])]
        found = quantiles(dataset, names, [0.5, *probs])
        if dataset.isEmpty():
            raise NotFitted("no rows to fit")
        medians = [found[n][0] if found[n][0] is not None else 0.0 for n in names]
        grids = [found[n][1:] if found[n][1] is not None else [0.0] * len(probs) for n in names]
        half = FeaturePipelineModel(told, medians, grids, [], 0.0)
        vectors = dataset.select(F.col(told["idCol"]).alias("__id"), half.vector().alias("__v"))
        trees = anomaly.fit(vectors, "__v", "__id", told["trees"], told["sample"], told["seed"])
        model = FeaturePipelineModel(told, medians, grids, trees, 0.0)
        scored = model.transform(dataset).select("anomaly_score")
        model.threshold = quantiles(scored, ["anomaly_score"], [1 - told["contamination"]])["anomaly_score"][0]
        return model


class FeaturePipelineModel(Model, _Settings):
    """transform() adds anomaly_score (0 to 1) and is_anomaly (above the threshold); columns of these names are replaced."""

    def __init__(self, told: dict, medians: list[float], grids: list[list[float]], trees: list[np.ndarray], threshold: float):
        super().__init__()
        self._set(**told)
        self.medians, self.grids, self.trees, self.threshold = [float(x) for x in medians], [[float(x) for x in g] for g in grids], trees, float(threshold)

    def vector(self):
        """The normal scores of a row's features as an array."""
        names, medians, grids = self.getOrDefault("inputCols"), self.medians, [np.array(g) for g in self.grids]
        probs = np.linspace(0, 1, len(grids[0]))
        inverse = np.vectorize(NormalDist().inv_cdf, otypes=[float])

        @F.pandas_udf("array<double>")
        def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for part in rows:
                out = np.zeros((len(part), len(names)))
                for k, (grid, median) in enumerate(zip(grids, medians, strict=True)):
                    x = part.iloc[:, k].astype(float).fillna(median).to_numpy()
                    if grid[0] != grid[-1]:  # of ties the middle of the run of equal quantiles
                        up, down = np.interp(x, grid, probs), 1 - np.interp(-x, -grid[::-1], probs)
                        out[:, k] = inverse(np.clip((up + down) / 2, 1e-7, 1 - 1e-7))
                yield pd.Series(list(out))

        return run(F.struct(*[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(names)]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, sample = self.trees, self.getOrDefault("sample")
        if not trees:
            raise NotFitted("the model has no trees")

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                yield pd.Series(anomaly.score(np.array(v.tolist(), float), trees, sample)) if len(v) else pd.Series([], dtype=float)

        out = dataset.withColumn("anomaly_score", scored(self.vector()))
        return out.withColumn("is_anomaly", F.col("anomaly_score") > self.threshold)

    def tables(self) -> tuple[list[tuple], list[tuple]]:
        """(grids with the median at -1, nodes of the trees), as rows of GRID and NODES."""
        grid = [(f, i, q) for f, (m, g) in enumerate(zip(self.medians, self.grids, strict=True)) for i, q in enumerate([m, *g], -1)]
        nodes = [(t, i, int(n[0]), float(n[1]), int(n[2]), int(n[3]), int(n[4])) for t, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        return grid, nodes

    def digest(self) -> str:
        """SHA-256 of everything that the model's answers depend on; numbers by their exact value."""
        exact = lambda row: [x.hex() if isinstance(x, float) else x for x in row]
        grid, nodes = self.tables()
        told = {"kind": KIND, "version": VERSION, "settings": {k: exact([v])[0] for k, v in self._told().items()}, "threshold": self.threshold.hex(), "grid": [exact(r) for r in grid], "nodes": [exact(r) for r in nodes]}
        return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()

    def save(self, path: str) -> str:
        """Write the model under path, replacing what is there; its digest, for whoever approves it."""
        spark, (grid, nodes) = SparkSession.active(), self.tables()
        spark.createDataFrame(grid, GRID).coalesce(1).write.mode("overwrite").parquet(f"{path}/grid")
        spark.createDataFrame(nodes, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        manifest = {"kind": KIND, "version": VERSION, "settings": self._told(), "threshold": self.threshold, "sha256": self.digest()}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        return manifest["sha256"]

    @classmethod
    def load(cls, path: str, kinds: tuple[str, ...] = (KIND,), approved: set[str] | None = None) -> FeaturePipelineModel:
        """The model saved under path. ModelRefused where its kind is none of `kinds`, where anything in it was changed, or where `approved` lacks its digest."""
        spark = SparkSession.active()
        try:
            manifest = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/manifest").collect()))
            if manifest["kind"] not in kinds or manifest["version"] != VERSION:
                raise ModelRefused(f"a model of kind {manifest['kind']!r}, version {manifest['version']!r}")
            grid = spark.read.schema(GRID).parquet(f"{path}/grid").orderBy("feature", "i").collect()
            rows = spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("tree", "i").collect()
            medians, grids, trees = [], [], []
            for r in grid:
                if r["i"] < 0:
                    medians.append(r["q"])
                    grids.append([])
                else:
                    grids[-1].append(r["q"])
            for r in rows:
                if r["i"] == 0:
                    trees.append([])
                trees[-1].append([r["feature"], r["split"], r["left"], r["right"], r["size"]])
            model = cls(manifest["settings"], medians, grids, [np.array(t, float) for t in trees], manifest["threshold"])
            told = model.digest()
        except ModelRefused:
            raise
        except Exception as e:  # whatever a damaged file makes of its reader
            raise ModelRefused(f"cannot be read: {type(e).__name__}") from e
        if told != manifest["sha256"]:
            raise ModelRefused("its content is not what its manifest says")
        if approved is not None and told not in approved:
            raise ModelRefused("not approved")
        return model
