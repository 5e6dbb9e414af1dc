"""What the operators share: word rules, the shared work folder, stored tables, file access."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word characters of lower-cased text: digits, a-z and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space, as bytes.split() has it.
SPACE = r"[\x20\x09-\x0D]+"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in _FOLD)


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 text; null has none."""
    return data.translate(_WORDS).split() if data else []


def space_words(data: bytes | None) -> list[bytes]:
    """Lower-cased runs without ASCII white space."""
    return data.translate(_FOLD).split() if data else []


def lower_ascii(c):
    return F.translate(c, UPPER, LOWER)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one only where that is unset and Spark is local."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = getattr(work_dir, "own", None) or f"file://{tempfile.mkdtemp(prefix='mailsonde-')}"
        work_dir.own = at
    return f"{at.rstrip('/')}/mailsonde"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends here and outlives lost executors.

    tasks: as many tasks write at most, for tables whose rows are few beside the number of shuffle partitions. Each file
    costs its executor three processes where Hadoop has no native library (it sets a local file's mode by chmod).
    """
    (df.coalesce(tasks) if tasks else df).write.parquet(path := new_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, like: DataFrame | None = None, rows: int = 100_000) -> DataFrame:
    """df with a broadcast hint if it (or the stored table `like`, of as many rows) has at most `rows` rows; else the planner's choice."""
    return F.broadcast(df) if (df if like is None else like).limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(uri: str):
    """pyarrow's file system and the path in it, for file:, hdfs:, s3: and gs: locations and plain paths."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts) -> int:
    """Write a file through a temporary name, so that a task that is run again or twice leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    n, draft = 0, f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(draft, compression=None) as out:
        for x in parts:
            out.write(x)
            n += len(x)
    fs.move(draft, path)
    return n
