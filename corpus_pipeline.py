"""A corpus pipeline over `documents`: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again as the next one's docs; so a lost executor never costs more than one stage. All stages but the last return the columns
of documents, and each works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgspark.llm.bpe import bpe_digests
from imgspark.llm.common import remove, scratch, table
from imgspark.llm.exact_dedup import keep_owners
from imgspark.llm.quality_rules import quality_rules
from imgspark.llm.queries import tokenizer_path
from imgspark.llm.simhash_dedup import keep_one
from imgspark.llm.source_mix import mixed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; the others lose their failing lines, and n_chars counts what is left.

    Null and blank texts and texts under 50 words are rejected; a text without failing lines stays as it is. Rows are judged each for
    itself, so repeated rows and ids need no care. Every other column is handed on as it came, whatever its name."""
    judged = quality_rules(docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))).filter("kept")
    new = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return judged.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one of them if that repeats; null and empty texts are equal.

    A row is known by doc_id and text, so an id that repeats with another text loses nothing. All columns are handed on."""
    return keep_owners(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (fingerprints within 3 bits, in chains) the row with the smallest doc_id stays.

    A row is known by doc_id and text; a null doc_id comes last; texts without words are one class. All columns are handed on."""
    return keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rounded: up to twice, or not at all.

    A null source is a source of its own, a text without words is taken no time; repeated rows are documents like any other. All
    columns are handed on."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each row; a null text counts as empty, rows that repeat stay."""
    return bpe_digests(docs.select("doc_id", "lang", "source", "text"), tokenizer_path()).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: BPE can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at, before = scratch(spark, "corpus-pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, f"{at}/{before}")
        before = name
    return docs
