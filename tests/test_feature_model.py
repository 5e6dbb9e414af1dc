"""The feature pipeline: saved, loaded and refused."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mailsonde.operators import feature_model as M


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(6)
    rows = [(i, r.gauss(0, 1), None if i % 9 == 0 else float(r.randrange(4)), 5.0, None) for i in range(400)] + [(900, 60.0, 90.0, 5.0, None), (901, float("nan"), 1.0, 5.0, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double").repartition(3)


@pytest.fixture(scope="module")
def model(data):
    return M.FeaturePipeline(["a", "b", "c", "d"], "id", trees=20, sample=64, contamination=0.1).fit(data)


def answers(m, data):
    return sorted((r["id"], r["anomaly_score"], r["is_anomaly"]) for r in m.transform(data).select("id", "anomaly_score", "is_anomaly").collect())


def test_an_outlier_and_the_share_above_the_threshold(model, data):
    got = answers(model, data.withColumn("anomaly_score", F.lit("x")))
    assert all(0 < s <= 1 for _, s, _ in got) and dict((i, a) for i, _, a in got)[900]
    assert abs(sum(a for *_, a in got) / len(got) - 0.1) < 0.02
    assert model.medians[2:] == [5.0, 0.0] and model.transform(data.limit(0)).count() == 0


def test_saved_and_loaded_gives_equal_rows(model, data, tmp_path):
    told = model.save(f"file://{tmp_path}/m")
    loaded = M.FeaturePipelineModel.load(f"file://{tmp_path}/m", approved={told})
    assert answers(loaded, data) == answers(model, data) and loaded.digest() == told
    again = M.FeaturePipeline(["a", "b", "c", "d"], "id", trees=20, sample=64, contamination=0.1).fit(data.repartition(7))
    assert again.digest() == told  # fitting does not depend on partitions
    assert M.FeaturePipeline(["a", "b", "c", "d"], "id", trees=20, sample=64, contamination=0.1, seed=1).fit(data).save(f"file://{tmp_path}/m") != told
    assert M.FeaturePipelineModel.load(f"file://{tmp_path}/m").digest() != told  # the second save replaced the first


def test_what_was_changed_is_refused(spark, model, tmp_path):
    at = tmp_path / "m"
    model.save(f"file://{at}")
    load = lambda **k: M.FeaturePipelineModel.load(f"file://{at}", **k)
    with pytest.raises(M.ModelRefused, match="approved"):
        load(approved={"0" * 64})
    with pytest.raises(M.ModelRefused, match="kind"):
        load(kinds=("something else",))
    for name in ("grid", "nodes"):
        (file,) = (at / name).glob("*.parquet")
        whole = file.read_bytes()
        crc = file.with_name(f".{file.name}.crc")
        crc.unlink(missing_ok=True)
        for place in range(4, len(whole), max(1, len(whole) // 25)):  # a byte here and there
            file.write_bytes(whole[:place] + bytes([whole[place] ^ 0x10]) + whole[place + 1 :])
            try:
                assert load().digest() == model.digest(), (name, place)  # only bytes that hold no content may pass
            except M.ModelRefused:
                pass
        file.write_bytes(whole)
    (file,) = (at / "manifest").glob("part-*")
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    told = json.loads(file.read_text())
    for change in ({"threshold": told["threshold"] + 1e-9}, {"settings": {**told["settings"], "sample": 65}}, {"sha256": "1" * 64}, {"version": 2}):
        file.write_text(json.dumps({**told, **change}))
        with pytest.raises(M.ModelRefused):
            load()
    file.write_text("no manifest")
    with pytest.raises(M.ModelRefused):
        load()
    with pytest.raises(M.ModelRefused):
        M.FeaturePipelineModel.load(f"file://{tmp_path}/nowhere")


def test_what_is_not_fitted_says_so(spark, data):
    with pytest.raises(M.NotFitted):
        M.FeaturePipeline(["a"], "id").transform(data)
    with pytest.raises(M.NotFitted):
        M.FeaturePipeline(["a"], "id").fit(data.limit(0))
    with pytest.raises(M.NotFitted):
        M.FeaturePipelineModel({"inputCols": ["a"], "sample": 4}, [0.0], [[0.0, 1.0]], [], 0.0).transform(data)
