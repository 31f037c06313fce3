"""From raw documents to training sequences, in five stages.

1. Language identification: texts without an identifiable language go.
2. Near-duplicates by SimHash over three-word shingles, at most two differing bits: one document of
   each group stays.
3. Decontamination: texts that hold a copy of a benchmark item go.
4. Secrets are masked in the text.
5. Texts become SentencePiece ids.

Every stage takes all rows its predecessor kept, as written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm import decontaminate, langid, pieces, secrets, simhash
from fiscora.session import hand_over


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, and its ids."""
    return pieces.encode(docs, pieces.Vocabulary.load())


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL expresses neither the language model nor fingerprints, alignment or segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = hand_over(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
