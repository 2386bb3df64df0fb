"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

toxicity drops documents that the model rejects; near_duplicates leaves one of each group; decontamination drops those
with benchmark passages; personal_data puts placeholders in the place of personal data; packing makes sequences of ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkpact.llm import decontam, jaccard, packing, pii, toxicity
from sparkpact.llm.shared import shared_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. It learns from the labelled documents that are left of `docs`."""
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that n-gram Jaccard similarity links, the document with the smallest id stays."""
    return jaccard.representatives(docs, COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item, edited or not, go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows, in its own type. A null text stays null."""
    found = pii.personal_data(docs, COLUMNS, redact=True)
    size = F.coalesce(F.char_length("redacted"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", size.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences, a row for each piece of a document."""
    return packing.packed(docs, str(public_tokenizers.path(packing.TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Trained models and alignments can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
