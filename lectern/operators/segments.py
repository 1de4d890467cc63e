"""The catalogue of intervals: how sources are split, whose chunk ids are whose, and how far each model has come.

A segment is one source split one way; it owns the ids from ``chunk_start``, ``chunk_count`` of them. A model embeds the
segments of one chunking, each from its beginning, so all that it has done of a segment is one number, ``n_embedded``: what is embedded and what is
left are ranges worked out from rows of segments, and no vector is read for either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import corpus as C

#: Which rules cut the chunks. A chunking by other rules is another one.
VERSION = 1


def registered(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """``known`` chunkings (chunking_id, version, target, overlap) with those wanted (version, target, overlap) that are new, numbered on. A row a chunking."""
    same = ["version", "target", "overlap"]
    fresh = wanted.select(*same).distinct().join(known, same, "left_anti").withColumn("one", F.lit(1)).withColumn("id", F.struct(*same))
    last = known.agg(F.coalesce(F.max("chunking_id"), F.lit(0)).alias("last"))
    order = F.row_number().over(W.orderBy("id"))
    new = fresh.withColumn("n", order).join(F.broadcast(last)).select((F.col("n") + F.col("last")).cast("bigint").alias("chunking_id"), *same)  # one row
    return known.select("chunking_id", *same).unionByName(new)


def per_chunking(chunkings: DataFrame, segments: DataFrame) -> DataFrame:
    """Every chunking with its segments and chunks, also those that split nothing: the widest first."""
    n = segments.groupBy("chunking_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("chunk_count").alias("chunks"))
    return chunkings.join(n, "chunking_id", "left").fillna(0, ["segments", "chunks"]).orderBy(F.desc("target"), "chunking_id")


def standing(segments: DataFrame, progress: DataFrame, models: DataFrame) -> DataFrame:
    """The segments of each model's chunking (of any, for a model that has none yet) with how much it has done: model, n_embedded and the segment's columns."""
    every = F.lit(-1).cast("bigint")  # stands for all chunkings
    bound = models.select("model", F.coalesce("chunking_id", every).alias("of"))
    j = segments.withColumn("of", F.explode(F.array("chunking_id", every))).join(bound, "of").drop("of")
    done = progress.groupBy("model", "segment_id").agg(F.max("n_embedded").alias("n_embedded"))
    j = j.join(done, ["model", "segment_id"], "left")
    return j.withColumn("n_embedded", F.least(F.coalesce("n_embedded", F.lit(0)), F.col("chunk_count")))


def embedded(standings: DataFrame) -> DataFrame:
    """What is embedded, as ranges of ids: ``chunk_start`` and the ``chunk_count`` done."""
    return standings.filter("n_embedded > 0").withColumn("chunk_count", F.col("n_embedded")).drop("n_embedded")


def pending(standings: DataFrame) -> DataFrame:
    """What is left: segment_id, book_id, start, n of each range that has not been done."""
    left = F.col("chunk_count") - F.col("n_embedded")
    return standings.filter(left > 0).select("segment_id", "book_id", "chunk_start", (F.col("chunk_start") + F.col("n_embedded")).alias("start"), left.alias("n"))


def first_ids(ranges: DataFrame, most: int) -> DataFrame:
    """Of ranges (start, n) those that hold the first ``most`` ids of all, the last one cut."""
    ahead = C.before(ranges, "start", "n")
    take = F.least(F.col("n"), F.lit(most) - F.col("before"))
    return ahead.filter(F.col("before") < most).withColumn("n", take).drop("before")


def coverage(standings: DataFrame) -> DataFrame:
    """model, live (chunks of its own chunking), done, coverage."""
    one = standings.groupBy("model").agg(F.sum("chunk_count").alias("live"), F.sum("n_embedded").alias("done"))
    return one.withColumn("coverage", F.coalesce(F.try_divide("done", "live"), F.lit(0.0)))


def of_books(standings: DataFrame) -> DataFrame:
    """model, book_id, live, done."""
    return standings.groupBy("model", "book_id").agg(F.sum("chunk_count").alias("live"), F.sum("n_embedded").alias("done"))


def waiting(standings: DataFrame, carries: DataFrame) -> DataFrame:
    """Carries (model, chunk_id, segment_id, ...) that no embedding has come to yet."""
    left = standings.filter("n_embedded < chunk_count").select("model", "segment_id", (F.col("chunk_start") + F.col("n_embedded")).alias("from"))
    return carries.join(left, ["model", "segment_id"]).filter(F.col("chunk_id") >= F.col("from")).select(*carries.columns)


def troubles(models: DataFrame, failures: DataFrame, carries: DataFrame) -> DataFrame:
    """model, failures, carries of every model, those without any too."""
    n = lambda rows, name: rows.groupBy("model").agg(F.count(F.lit(1)).alias(name))
    return models.select("model").join(n(failures, "failures"), "model", "left").join(n(carries, "carries"), "model", "left").fillna(0, ["failures", "carries"])


def identity(sources: DataFrame, by: str) -> DataFrame:
    """``by``, content (the hash of its files' hashes in order; of a single file its own), paths (of their names), size_bytes: what a book is. As long as its list of files."""
    held = sources.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ordinal", "path", "content_sha256"))).alias("s"), F.sum("size_bytes").alias("size_bytes"))
    joined = lambda name: F.sha2(F.concat_ws("\n", F.transform("s", lambda x: x[name])).cast("binary"), 256)
    one = F.when(F.size("s") == 1, F.col("s")[0]["content_sha256"]).otherwise(joined("content_sha256"))
    return held.select(by, one.alias("content"), joined("path").alias("paths"), "size_bytes")
