"""Scrubbing, custody and audit."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import redact


def scrubbed(df: DataFrame, salt: str, keep_for: str | None = None) -> DataFrame:
    """Addresses and credentials in every string of every row, nested ones included, are replaced; kept only with a reason given."""
    if keep_for:
        return df

    def walk(c, kind: T.DataType):
        if isinstance(kind, T.StringType):
            return redact(c, salt)
        if isinstance(kind, T.ArrayType) and _text_in(kind.elementType):
            return F.transform(c, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType) and _text_in(kind.valueType):
            return F.transform_values(c, lambda _, x: walk(x, kind.valueType))
        if isinstance(kind, T.StructType) and _text_in(kind):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _text_in(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_text_in(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _text_in(kind.elementType)
    return _text_in(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def custody_manifest(captures: DataFrame, bounds: DataFrame, **facts: str) -> dict:
    """Digests, counts and the evidence period. Facts that are missing fail: nothing is filled in."""
    needed = {"analyst", "model_sha256", "rules_version"}
    if lacking := sorted(k for k in needed if not facts.get(k)):
        raise ValueError(f"missing: {', '.join(lacking)}")
    rows = captures.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("sha256")).first()
    b = bounds.first()
    out = {**facts, "n_captures": rows["n"], "captures_sha256": rows["sha256"], "evidence_from": b["evidence_from"], "evidence_to": b["evidence_to"]}
    return {**out, "digest": hashlib.sha256(json.dumps(out, sort_keys=True).encode()).hexdigest()}


def valid_manifest(manifest: dict) -> bool:
    rest = {k: v for k, v in manifest.items() if k != "digest"}
    return hashlib.sha256(json.dumps(rest, sort_keys=True).encode()).hexdigest() == manifest.get("digest")


def latest(log: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """An append log's latest value of each key."""
    return log.groupBy(key).agg(F.max_by(value, ts).alias(value), F.max(ts).alias(ts))
