"""Order statistics against sorted lists."""

import math
import random
from math import ceil, floor

import pytest

from mailsonde.functions import features
from mailsonde.operators import profile, ranks


def plain(values, p):
    xs = sorted(v for v in values if v is not None and v == v)
    if not xs:
        return None
    q = p * (len(xs) - 1)
    a, b = xs[floor(q)], xs[ceil(q)]
    return a if a == b else a * (ceil(q) - q) + b * (q - floor(q))


def columns(r, n):
    return {
        "plain": [r.gauss(0, 1) for _ in range(n)], "ties": [r.choice([0.0, 1.0, -1.0, 0.1]) for _ in range(n)], "spread": [r.choice([-1, 1]) * 10.0 ** r.uniform(-300, 300) for _ in range(n)], "close": [1.0 + r.randrange(1 << 20) * 2**-52 for _ in range(n)],
        "odd": [r.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-324, 1.7e308, -1.7e308, 3.0]) for _ in range(n)], "none": [None] * n, "one": [7.0] + [None] * (n - 1), "hot": [0.5 if r.random() < 0.9 else r.random() for _ in range(n)],
    }


@pytest.mark.parametrize("n", [1, 2, 500])
def test_quantiles_are_exact(spark, n):
    cols = columns(random.Random(n), n)
    names = list(cols)
    df = spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} double" for c in names)).repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    got = ranks.quantiles(df, names, probs)
    for c in names:
        for p, v in zip(probs, got[c], strict=True):
            want = plain(cols[c], p)
            assert v == want or (want is not None and v is not None and math.isnan(v) == math.isnan(want) and math.isclose(v, want, rel_tol=1e-12) or (v != v and want != want)), (c, p, v, want)


def test_empty_and_users_of_quantiles(spark):
    schema = "a double, b double"
    assert ranks.quantiles(spark.createDataFrame([], schema), ["a", "b"], [0.5]) == {"a": [None], "b": [None]}
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, None), (4.0, None)], schema)
    assert sorted(x["a"] for x in features.imputed(df, ["a", "b"]).collect()) == [1.0, 2.0, 2.0, 4.0]
    got = {x["feature"]: x for x in profile.feature_profile(df, ["a", "b"]).collect()}
    assert got["a"]["median"] == 2.0 and got["a"]["n"] == 3 and got["a"]["quality"] == "REQUIRES_SEMANTIC_REVIEW"
    s = profile.score_summary(df, "a").first()
    assert (s["n"], round(s["p95"], 6)) == (3, round((3.8 - 1) / 3, 6))
    plan = profile.feature_profile(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
