"""A training corpus from documents: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mooreflow.llm import decontam, langid, line_dedup, near_dedup, packing
from mooreflow.llm.common import Workspace, collect_executors, without
from mooreflow.session import ship

#: Mean marginal of a document's language below which it is rejected: no language fits it.
LEAST_SCORE = 0.35


def _fresh(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, begun with what ran before collected in the executors: it then takes no more memory than alone."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@_fresh
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is none of the learned ones, go; null and empty texts
    have no letter. Where no row has a label nothing is learned, so nothing is rejected: all rows stay."""
    ship(spark)
    model = langid.fit(langid.training_sample(docs, F.lit(True)))
    if not model.labels:
        return docs
    found = langid.detect(docs, model)
    rejected = found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE)).select("row", "check")
    return without(docs, Workspace(spark, "language").stage(rejected, "rejected"), "text")


@_fresh
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line repeats go; a document that loses all its words goes too. Documents that
    lose no line stay as they are, null and empty ones too."""
    return line_dedup.dedup(docs, equal_words=1)


@_fresh
def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id, and of rows that
    share it one. Documents without words are no group and stay."""
    found = near_dedup.groups(docs)
    dropped = Workspace(spark, "near-drops").stage(found.where(~F.col("kept")).select("row", "check"), "dropped")
    return without(docs, dropped, "text")


@_fresh
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row that does; a null or empty text holds none."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_fresh
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences; a null or empty text is the end token alone."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup_documents),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack_sequences),
]

#: A conditional random field and a subset-sum packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written to the shared folder. An empty table
    gives an empty result. Rows that share a doc_id are documents of their own, and other columns than
    doc_id and text, whatever their names, go along unread but for lang, from which languages are learned."""
    ship(spark)
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.stage(docs, name)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
