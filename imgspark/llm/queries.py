"""The registered queries of the operators, over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit_packing import pack
from .bpe import bpe_digests
from .common import table
from .conversation_repair import repair_conversations
from .exact_dedup import exact_dedup
from .html_wrapper import main_text
from .line_dedup import line_dedup
from .periodic_runs import periodic_runs
from .quality_rules import quality_rules
from .secret_scan import secret_digests
from .shard_sort import shard_sort
from .simhash_dedup import simhash_dedup
from .source_mix import source_mix
from .sql import ORACLE  # noqa: F401
from .warc import warc_revisits


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_lines_removed", "n_chars_lines", "n_chars_kept", "kept")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = simhash_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return q.select("doc_id", "n_lines", "n_lines_dropped", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(table(spark, sf_dir, "documents"))


def op10_shard_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_sort(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), repeat=True)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash_dedup, op3_bpe, op4_exact_dedup, op5_warc_revisits, op6_line_dedup, op7_main_text, op8_secret_scan, op9_source_mix, op10_shard_sort, op11_conversation_repair, op12_periodic_runs, op13_best_fit_packing)}
