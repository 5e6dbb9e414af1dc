import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

@pytest.fixture
def rnd():
    return random.Random(5)


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, source]) rows, with extra columns whose names operators use themselves."""

    def build(rows, clash=True):
        rows = [(*r, "s0") if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)
        if clash:
            for name in ("id", "n", "key", "spans", "sources", "score", "label", "license", "toxicity", "repeats", "size", "w", "t", "component_id", "covered"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build
