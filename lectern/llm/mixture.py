"""Mixing sources to target weights by systematic sampling.

Each source has a target of words, and each of its documents the same expected number of copies: target over size of
the source. Documents stand in a fixed order within their source; prefix sums of the expected copies start at one
random offset, and a document is emitted once for each whole number that its stretch of the sum crosses. The order
goes by size in steps of about a thirtieth, so the words taken differ from the target by little more than the largest
document's. Sums are whole numbers of 2**-32 copies in decimals, hence exact: reruns agree, and no document has more than the
most copies allowed.

Only DataFrame operations are used. Texts are read once, for their sizes. Places in the order come from counts by cell
(source, step of size, hash of the id), so no window holds a source; equal rows are counted before they are shuffled.
One row a source is sorted in one task.

Defined results: a null or empty text has size 0, and a source of such texts target 0; a null source is a source of its
own, the last; rows with the same id, source and size are interchangeable, each is a row of the result; a null id is an
id like others; an empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm._common import fresh, materialise
from lectern.llm._ranks import cell_starts, step

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 2024
_WORD = r"[^\x20\x09-\x0D]+"
_ONE = 1 << 32  # of a copy
_STEP_BITS, _HASH_DIGITS = 5, 3


def words(text: Column) -> Column:
    """How many words a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def _hex(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` and each source's ``target``.

    Sources by code point, null last, take the weights in turn and share all sizes by them; a target stops at ``most``
    times its source's size and what is over is shared again, until none is above. So all others lie on one
    level of words a weight. With sources by the level at which they stop, that level is the highest of those that the sources up to each leave.
    """
    numbered = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int")))
    stop = (F.col("source_size") * most).alias("stop")
    rows = numbered.select("*", stop)
    every, before = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    rows = rows.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.max("level").over(every)
    return rows.select("source", "source_size", F.least(F.col("stop").cast("double"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, source, nth (among equal rows, from 1), size, source_size, target, copies, taken: a row for every document."""
    sized = materialise(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size")))
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    cell = step(F.col("size"), _STEP_BITS) * 16**_HASH_DIGITS + _hex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), _HASH_DIGITS)
    same = sized.groupBy("source", "size", "doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("key", key).withColumn("cell", cell)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumn("key", key)
    rate = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double")) * _ONE + 0.5), F.lit(0))
    offset = _hex(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary"), 256), 8)
    cells = cell_starts(same, ["key"], "cell", "n", (4,) * _HASH_DIGITS).join(sources.drop("source").withColumn("rate", rate).withColumn("offset", offset), "key")
    within = W.partitionBy("key", "cell").orderBy("size", F.col("doc_id").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    placed = same.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(cells, ["key", "cell"])
    # a row each again: runs of equal rows in pieces, as an array has its bounds
    piece = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 4096)))
    rows = placed.withColumn("piece", piece).withColumn("j", F.explode(F.sequence(F.col("piece") * 4096, F.least(F.col("n") - 1, F.col("piece") * 4096 + 4095))))
    at = F.col("before") + F.col("inner") + F.col("j")
    crossed = lambda i: F.call_function("div", F.col("offset").cast("decimal(38,0)") + (i.cast("decimal(19,0)") * F.col("rate").cast("decimal(18,0)")), F.lit(_ONE).cast("decimal(38,0)"))
    rows = rows.withColumn("copies", crossed(at + 1) - crossed(at))
    return rows.select("doc_id", "source", (F.col("j") + 1).alias("nth"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(docs: DataFrame, plan: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as ``plan`` (of ``mix``) has copies of it. Rows without a copy are joined by no text."""
    names = {n: fresh(docs, n) for n in ("_size", "_nth", "_copy")}
    size, nth, copy = names.values()
    rows = docs.withColumn(size, words(F.col(text)))
    rows = rows.withColumn(nth, F.row_number().over(W.partitionBy(doc_id, source, size).orderBy(F.xxhash64(text))))
    p = plan.filter("copies > 0").select(F.col("doc_id").alias("_p_id"), F.col("source").alias("_p_source"), F.col("size").alias("_p_size"), F.col("nth").alias("_p_nth"), F.col("copies").alias("_p_copies"))
    same = rows[doc_id].eqNullSafe(p["_p_id"]) & rows[source].eqNullSafe(p["_p_source"]) & (rows[size] == p["_p_size"]) & (rows[nth] == p["_p_nth"])
    return rows.join(p, same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_p_copies")))).select(*docs.columns)
