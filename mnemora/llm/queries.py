"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm.contract_sql import PREFIX_TRIE, merkle_manifest
from mnemora.llm.licenses import documents_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.licenses import documents_as_files, licence_scan

    return licence_scan(documents_as_files(table(spark, sf_dir, "documents")))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.substrings import repeats_report

    return repeats_report(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.decontamination import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.chat import PROBE, as_events, digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(as_events(rows.unionByName(probe))))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.prefixes import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.fingerprints import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_simhash_near_dedup, op3_substring_dedup, op4_quality_classifier, op5_benchmark_decontamination, op6_toxicity, op7_best_fit_packing, op8_chat_formatting, op9_embedding_near_dedup, op10_token_counts, op11_prefix_trie, op12_document_fingerprints, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": documents_sql(), "op11_prefix_trie": PREFIX_TRIE, "op13_merkle_manifest": merkle_manifest()}
