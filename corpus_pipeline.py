"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.llm import common, lang_id, mixing, packing, quality, simhash
from tamarisk.sources import storage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.judge(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents far from every language learned go. The model learns from the
    labels of its own input outside the held-out quarter. Where it finds none there,
    only documents without a letter go."""
    model = lang_id.fit(docs.filter(~lang_id.held_out(F.col("doc_id"))))
    return lang_id.predict(docs.select(*COLUMNS), model).filter("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each linked group stays: of the smallest id, nulls last, one of
    its rows. Rows are told apart by a key of their own, so repeated, clashing and
    null ids neither keep a copy nor cost another document."""
    rows = common.keyed(docs.select(*COLUMNS), "row_key")
    return rows.join(simhash.representatives(rows, "row_key"), "row_key", "left_semi").select(*COLUMNS)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every use of a document in the mix, in its order."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_place").select(*COLUMNS)


def binary_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", target_mix),
    ("packing", binary_packing),
]

#: Fingerprints, the vocabularies and the schedule are beyond SQL; tests hold the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages are written and read again; what a stage made on its way, and the table
    it read, go once its own is written."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = storage.new_path(spark, f"stage-{k}")
        with common.passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            storage.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
