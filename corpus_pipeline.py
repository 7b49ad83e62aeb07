"""Documents made ready for training: each stage is one operator on what the stage before has kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contamination, jaccard, language, lines, packing
from tidemark.session import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of an Arrow batch, about. By default only rows are counted, and executors and workers keep much of what large batches took.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage):
    """``stage`` with Arrow batches of ``BATCH`` bytes. The setting stays in the session, as what a stage returns runs later."""

    @functools.wraps(stage)
    def limited(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH))
        return stage(spark, docs, sf_dir)

    return limited


@in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; the model learns from the given languages of all documents."""
    found = language.identify(docs.select(*COLUMNS), language.train(docs))
    return found.where(~language.rejected()).select(*COLUMNS)


@in_small_batches
def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; a document without lines left is empty, but stays."""
    return lines.dedup_lines(docs.select(*COLUMNS))


@in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 on word 5-grams join, the one with the smallest id; of equal rows, one."""
    docs = docs.select(*COLUMNS)
    later = jaccard.near_texts(docs).where("doc_id > class_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])


@in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.find_items(docs.select(*COLUMNS), benchmark).where(F.size("matches") == 0).select(*COLUMNS)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document lies in the training sequences."""
    pieces = packing.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), carry_ids=False)
    return packing.pack(pieces, docs.count()).drop("row")


STAGES = [
    ("language", known_language),
    ("lines", distinct_lines),
    ("near", one_of_each_group),
    ("benchmark", without_benchmark),
    ("pack", packed),
]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again. The session's size of Arrow batches is as before then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get(BATCH_SETTING)
    try:
        for name, stage in STAGES:
            path = new_folder(spark, name)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return docs
