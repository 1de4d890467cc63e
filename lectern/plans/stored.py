"""The stored index that the queries of a data folder search: built at the first use within an application, then read."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.operators import retrieval as R
from lectern.plans._registry import table
from lectern.sources import readers
from lectern.store import Store, shared_dir

#: The one model of the tables: ``embeddings``.
MODEL = "given"
_OPEN: dict[tuple[str, str], Store] = {}
_SIZES: dict[tuple[str, str], tuple[int, float]] = {}


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as vectors of chunks; their label is the book."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("book_id"), "embedding")


def _key(spark: SparkSession, sf: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf


def materialise(df: DataFrame) -> DataFrame:
    """A short frame that is used several times, written to the shared folder and read again."""
    spark = df.sparkSession
    return Store(spark, f"{shared_dir(spark)}/frames").keep(df)


def _make(store: Store, name: str, spark: SparkSession, sf: str) -> None:
    if name == "blocks":
        rows = R.postings_in_blocks(chunks(spark, sf))
    elif name == "lengths":  # a pass over the texts only if there are no postings yet
        rows = R.lengths_of(store.read("blocks")) if store.has("blocks") else R.lengths(chunks(spark, sf))
    elif name == "terms":  # in order, so that a beginning of words is a run of rows
        rows = R.terms_of(stored(spark, sf, "blocks")).repartitionByRange("term").sortWithinPartitions("term")
    elif name == "centroids":
        rows = R.build_centroids(vectors(spark, sf)).withColumn("model", F.lit(MODEL))
    elif name == "word_vectors":
        from lectern.plans.evaluation import DIM, word_vectors

        words = chunks(spark, sf).select("chunk_id", F.concat_ws(" ", X.tokens(F.col("text"))).alias("text"))
        rows = readers.embed(words, word_vectors, DIM)
    else:
        rows = vectors(spark, sf)
        if name == "packed":
            p = V.packed(F.col("embedding"))
            rows = rows.withColumn("p", p).select("chunk_id", "book_id", F.lit(None).cast("array<float>").alias("embedding"), "p.data", "p.scale")
        else:
            rows = rows.withColumns({"data": F.lit(None).cast("binary"), "scale": F.lit(None).cast("double")})
        rows = rows.withColumns({"model": F.lit(MODEL), "segment_id": F.lit(None).cast("bigint")})
    store.replace(name, rows)


def stored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of the index: postings in blocks, lengths, terms, vectors (packed, or of words) or centroids of whole tables."""
    key = _key(spark, sf)
    if key not in _OPEN:
        _OPEN[key] = Store(spark, f"{shared_dir(spark)}/index-{hashlib.sha256(sf.encode()).hexdigest()[:16]}")
    if not _OPEN[key].has(name):
        _make(_OPEN[key], name, spark, sf)
    rows = _OPEN[key].read(name)
    return rows.drop("segment_id") if "segment_id" in rows.columns else rows


def size(spark: SparkSession, sf: str) -> tuple[int, float]:
    """How many chunks there are and their mean length: part of the index, so worked out once."""
    key = _key(spark, sf)
    if key not in _SIZES:
        _SIZES[key] = R.size_of(stored(spark, sf, "lengths"))
    return _SIZES[key]
