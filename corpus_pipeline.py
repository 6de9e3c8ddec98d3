"""From raw documents to packed training sequences: five stages, each written and read again by its caller.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the pieces of the packed
sequences. n_chars stays the length of the text as it was before any passage was removed.

Edge cases, in each stage: columns of any other name are carried along, whatever they are called; an empty table stays
empty; repeated rows and rows of equal or null doc_id are documents of their own, unless their texts are near copies.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm.decontamination import clean_documents
from mnemora.llm.nearcopies import keep_one_copy
from mnemora.llm.packing import pack
from mnemora.llm.quality import good_documents
from mnemora.llm.queries import table, tokenizer_path
from mnemora.llm.shared import ensure_checkpoint_dir, remove
from mnemora.llm.substrings import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts have no words and get the network's score for that."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, Jaccard similarity of 0.8 or more, the smallest doc_id
    (a null one last). Texts without words, null ones too, are one group."""
    return keep_one_copy(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words that stand earlier in the corpus are cut out of the texts. Every row stays; a null text stays null."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens. A null or empty text is its end mark alone."""
    return pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontamination", decontamination), ("packing", packing)]

ORACLE_SQL = None
"""SQL can express neither the classifier nor the packing; tests/llm/test_pipeline.py holds run() against plain loops."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared checkpoint folder and read again. A stage's
    folder is removed once the next stage is written; the last one is the result's and stays."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
