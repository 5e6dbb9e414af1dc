"""A training corpus from documents: score out toxic texts, thin near copies, keep the benchmark out, mix, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsonde.llm import decontaminate, minhash_dedup, mixing, token_store, toxicity
from mailsonde.llm.common import stored, table

THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below THRESHOLD; the model learns from labelled rows that are not held out.

    Null and empty texts get the score of a text without marked words; repeated rows go or stay together; ids without a
    label, or null, are scored like any other. No documents: no rows. A column __toxicity would be replaced and lost.
    """
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity.score") < THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id: five-word shingles, similarity of 0.8 or more.

    Null and empty texts are in no group and stay, as do rows without an id; texts of any length are compared whole;
    repeated rows of a kept id stay. No documents: no rows.
    """
    return minhash_dedup.deduplicated(docs, n=5, percent=80, by_letters=True)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark.

    Equal texts go or stay together, whatever their ids; null and empty texts stay; texts are searched whole. No documents:
    no rows; no benchmark: all rows.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken twice is there twice.

    Documents without words, null texts among them, go; null sources are one source; rows that share id and text come as
    often as the one taken most. No documents: no rows.
    """
    return mixing.mixed(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, with a row a document as it is read back from them, in ascending id, null ids last.

    Null and empty texts have the end id alone; a document taken twice is there twice. No documents: no rows.
    """
    return token_store.token_store(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("benchmark", drop_benchmark), ("mix", mix), ("tokens", tokenise)]

#: SQL expresses neither the model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name.replace(' ', '-')}")
    return docs
