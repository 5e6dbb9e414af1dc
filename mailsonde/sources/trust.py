"""Trust stores and stored tables: certificates from PEM and DER files, and a place to cut long plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PEM = r"-----BEGIN CERTIFICATE-----([A-Za-z0-9+/=\s]+?)-----END CERTIFICATE-----"


def read_certificates(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(der, source, file_sha256) of all certificates in PEM and DER files under path.

    source names what they are there for: `intermediate`, or any other name for trusted roots. file_sha256 tells which
    bundle a verdict rests on. Files without a certificate give one row with what they hold, which no reader accepts.
    """
    files = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("file_sha256"))
    text = F.decode("content", "ISO-8859-1")
    parts = F.regexp_extract_all(text, F.lit(PEM), F.lit(1))
    ders = F.when(F.size(parts) > 0, F.transform(parts, lambda x: F.unbase64(F.regexp_replace(x, r"\s+", "")))).otherwise(F.array("content"))
    return files.select(F.explode(ders).alias("der"), F.lit(source).alias("source"), "file_sha256")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name in the folder in spark.checkpoint.dir.

    A folder of this machine is used only where that setting is missing and Spark runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_path, "own", None) or f"file://{tempfile.mkdtemp(prefix='mailsonde-')}"
        shared_path.own = base
    return f"{base.rstrip('/')}/mailsonde/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that later plans start there and lost executors cost tasks only."""
    df.write.parquet(at := shared_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(at)
