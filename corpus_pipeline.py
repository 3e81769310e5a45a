"""From raw documents to sampled training segmentations, in five stages.

Each stage gets ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes it as Parquet into the cluster's shared folder and reads it back as the
next one's ``docs``.  All but the last return the columns of ``documents``.

1. language_id: documents without a recognisable or with an ambiguous language go;
2. line_dedup: repeated lines go, ``n_chars`` follows the text;
3. near_dedup: one document of each group of near duplicates stays;
4. source_mixing: rows in the order of the Pfair schedule (tempered shares);
5. sentencepiece: sampled segmentations of each document, with its place in
   that schedule.

A Parquet scan does not keep the order of rows, so the schedule, a function of
the stage's doc_ids and sources, stands in the last stage's columns as well:
``mix_order``, by which the result is to be read, and ``mix_slot``.

No stage caps, samples or cuts rows.  Null and empty texts go in stage 1.

Each stage asks for batches of some MB (``small_batches``): a batch of Spark's
usual 10 000 rows holds tens of MB of text, several times over in an executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytune.llm import lang_id, line_dedup, mixing, near_dedup, sp_lattice
from skytune.llm.common import small_batches, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = lang_id.identify(docs)
    return found.where((F.col("lang_pred") != lang_id.UND) & ~F.col("ambiguous")).select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed_rows(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    placed = mixing.mix_sources(docs.select("doc_id", "source", "text")).drop("mix_block", "mix_phase")
    return sp_lattice.sample_segmentations(placed).drop("text")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
          ("source_mixing", source_mixing), ("sentencepiece", sentencepiece)]

#: SQL can express neither the classifier nor the samples; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
