"""A corpus pipeline: each stage applies one operator to all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, others
of any name too, as they are. Whatever other columns hold, nulls in them decide nothing. An empty table gives an empty one.
Texts are taken whole, however long. Each stage says what it does with null and empty texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, langid, packing, secrets, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go.

    Null, empty and letterless texts are of no language and go too. Repeated rows are decided alike. Of languages as near
    as each other the first by name is taken. Without any labelled row nothing can be learned, and every document goes.
    """
    return langid.keep_accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays.

    Null and empty texts are one group, which is linked like any other. Of rows that could stay for a group one does, of
    repeated rows too, and always the same; rows with a null id are texts like others.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; items that are null or have no letter or digit match nothing. Repeated rows
    are decided alike. Without a benchmark every document stays.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays.

    Null and empty texts stay as they are. Overlapping secrets become one mask; of two ways to read a run the likelier is
    taken. ``n_chars``, if there is one, is counted again.
    """
    out = docs.withColumn("text", secrets.redacted(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in training sequences.

    Null and empty texts are one token, the end. Repeated rows are packed each for itself. Documents of equal length are
    alike to the plan; each takes the place of its rank within the length.
    """
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", mask_secrets), ("pack", pack)]

#: No SQL can say trained models, fingerprints and packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
