"""Grouped cross-validation: groups stay whole, counts are what SQL counts, signal and noise are told apart."""

import random

import duckdb
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier

from mailsonde.operators import comparison as C


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(2)
    rows = []
    for g in range(40):
        for _ in range(12):
            y = r.random() < 0.4
            rows.append((f"g{g}" if g else None, (1.0 if y else 0.0) + r.gauss(0, 0.2), r.gauss(0, 1) if r.random() < 0.9 else None, int(y)))
    rows += [("g1", 1.0, float("nan"), None), ("g2", 1.0, 1.0, 7)]
    return spark.createDataFrame(rows, "grp string, a double, b double, y int").repartition(4)


@pytest.fixture(scope="module")
def models(spark):
    return {"forest": RandomForestClassifier(numTrees=5, maxDepth=3, seed=1), "tree": DecisionTreeClassifier(maxDepth=2, seed=1)}


def test_groups_stay_whole_and_counts_agree_with_sql(spark, data, models):
    p = C.cross_validated(data, ["a", "b"], "y", "grp", models)
    folds = C.with_fold(data, "grp").where("y in (0, 1)")
    assert max(r["n"] for r in folds.select("grp", "fold").distinct().groupBy("grp").agg({"fold": "count"}).withColumnRenamed("count(fold)", "n").collect()) == 1
    assert p.groupBy("model").count().collect()[0]["count"] == folds.count() == 480
    seen = {(r["group"], r["fold"]) for r in p.select("group", "fold").distinct().collect()}
    assert seen == {(r["grp"], r["fold"]) for r in folds.select("grp", "fold").distinct().collect()}
    rows = p.toPandas()
    db = duckdb.connect()
    db.register("p", rows)
    want = db.execute("SELECT model, fold, count(*) FILTER (label = 1 AND prediction = 1) tp, count(*) FILTER (label = 0 AND prediction = 1) fp, count(*) FILTER (label = 1 AND prediction = 0) fn, count(*) FILTER (label = 0 AND prediction = 0) tn FROM p GROUP BY ALL").fetchall()
    got = C.confusion(p, "model", "fold")
    assert sorted(want) == sorted(tuple(r[:6]) for r in got.collect())
    for r in got.collect():
        assert r["precision"] == pytest.approx(r["tp"] / (r["tp"] + r["fp"])) and r["accuracy"] == pytest.approx((r["tp"] + r["tn"]) / sum(r[2:6]))
    best = C.comparison(p).collect()
    assert {r["model"] for r in best} == set(models) and best[0]["mean_f1"] >= best[1]["mean_f1"] > 0.9 and best[0]["folds"] == 5


def test_curve_and_ablation(data, models):
    curve = {r["share"]: r for r in C.learning_curve(data, ["a", "b"], "y", "grp", models["tree"], (0.01, 0.3, 1.0)).collect()}
    assert 1.0 in curve and curve[1.0]["f1"] > 0.9 and curve[0.3]["groups"] < curve[1.0]["groups"]
    assert len({sum(r[2:6]) for r in curve.values()}) == 1  # the same held-out rows
    lost = {r["without"]: r["lost"] for r in C.ablation(data, ["a", "b"], "y", "grp", models["tree"], folds=3).collect()}
    assert lost[None] == 0 and lost["a"] > 0.3 and abs(lost["b"]) < 0.1


def test_nothing_to_learn_from(spark, data, models):
    assert C.cross_validated(data.limit(0), ["a"], "y", "grp", models).count() == 0
    one = data.where("y = 1")
    assert C.cross_validated(one, ["a"], "y", "grp", models).count() == 0 and C.learning_curve(one, ["a"], "y", "grp", models["tree"]).count() == 0
    assert C.confusion(C.cross_validated(one, ["a"], "y", "grp", models), "model").count() == 0
