"""The corpus pipeline: documents are judged, deduplicated, cleaned and packed, stage by stage.

Each stage takes (spark, docs, sf_dir) and its result is written and read again as the next one's docs. All but the last
return the columns of documents. Defined results: nulls and empty texts as each operator defines them; an empty table gives
an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantrail.llm import ngram_join, packing, pii, quality, suffix_array
from quantrail.llm.common import delete, own_folder, table, within

CAPACITY = 4096
#: Bytes of words that a worker of the last stage remembers: fewer than in the query alone, for executors come here with the memory of earlier stages.
KEPT = 40 << 20


def _with_text(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trained trees go."""
    forest = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; of its equal rows, one."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of more than fifty words are cut from their documents; every document stays."""
    return _with_text(suffix_array.cut_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked."""
    return _with_text(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row for each piece of a document."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, kept=KEPT))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Trees, MinHash and tokenisation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again; a stage's folder is deleted when the next one is written.

    The result is a table too; it goes with the driver's program.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{own_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with within(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs
