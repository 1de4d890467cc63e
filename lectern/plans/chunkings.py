"""Queries of the catalogue of intervals: conversations are books, their turns sources, split in two ways at once.

Chunking 1 has a chunk for each 300 bytes and chunking 2 one for each 700; a third has split nothing yet. Model ``fine`` embeds the
first, ``wide`` the second, ``new`` none so far. Each has embedded a number of chunks of every source that follows from its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import corpus as C
from lectern.operators import segments as S
from lectern.plans._registry import query, table

WIDTHS = (300, 700, 5000)
MODELS = {"fine": 1, "wide": 2, "new": None}
#: Ids of one step of an embedding.
STEP = 5000
FIRST = {1: 7, 2: 5}

SRC = "SELECT conv_id AS book_id, turn AS ordinal, conv_id * 1000 + turn AS source_id, strlen(text) AS bytes FROM conversations"
SPLIT = f"SELECT c AS chunking_id, source_id * 2 + c AS segment_id, source_id, book_id, ordinal, CAST(ceil(bytes / w::DOUBLE) AS BIGINT) AS chunk_count FROM ({SRC}), (VALUES (1, {WIDTHS[0]}), (2, {WIDTHS[1]})) t(c, w)"
SEGMENTS = f"SELECT chunking_id, segment_id, source_id, book_id, CAST(sum(chunk_count) OVER (ORDER BY chunking_id, book_id, ordinal) - chunk_count + 1 AS BIGINT) AS chunk_start, chunk_count FROM ({SPLIT})"
STANDING = f"""SELECT m.model, s.*, least(chunk_count, CASE m.model WHEN 'fine' THEN source_id * {FIRST[1]} % (chunk_count + 2) WHEN 'wide' THEN source_id * {FIRST[2]} % (chunk_count + 2) ELSE 0 END) AS n_embedded
  FROM ({SEGMENTS}) s JOIN (VALUES ('fine', 1), ('wide', 2), ('new', NULL)) m(model, bound) ON m.bound IS NULL OR m.bound = s.chunking_id"""


def chunkings(spark: SparkSession) -> DataFrame:
    """The three ways to split, as they are registered one after another."""
    known = spark.createDataFrame([], "chunking_id bigint, version int, target int, overlap int")
    for width in WIDTHS:
        wanted = spark.createDataFrame([(S.VERSION, width, 0)], "version int, target int, overlap int")
        known = S.registered(known, wanted)
    return S.registered(known, wanted)  # what is known is not registered again


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """All turns split in both ways: the ids of the second chunking follow those of the first."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ordinal"), (F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), F.octet_length("text").alias("bytes"))
    out, after = None, None
    for number, width in enumerate(WIDTHS[:2], 1):
        sized = c.withColumn("n", F.ceil(F.col("bytes") / float(width)).cast("bigint"))
        own = C.allocate(sized.select("book_id", "ordinal", "n")).join(c.select("book_id", "ordinal", "source_id"), ["book_id", "ordinal"])
        if after is not None:
            own = own.join(F.broadcast(after)).withColumn("chunk_start", F.col("chunk_start") + F.col("last"))  # one row
        after = sized.agg(F.sum("n").alias("last"))
        own = own.select(F.lit(number).cast("bigint").alias("chunking_id"), (F.col("source_id") * 2 + number).alias("segment_id"), "source_id", "book_id", "chunk_start", "chunk_count")
        out = own if out is None else out.unionByName(own)
    return out


def standings(spark: SparkSession, sf: str) -> DataFrame:
    s = segments(spark, sf)
    rows = [s.filter(F.col("chunking_id") == number).select(F.lit(model).alias("model"), "segment_id", (F.col("source_id") * FIRST[number] % (F.col("chunk_count") + 2)).alias("n_embedded")) for model, number in MODELS.items() if number]
    known = spark.createDataFrame(list(MODELS.items()), "model string, chunking_id bigint")
    return S.standing(s, rows[0].unionByName(rows[1]), known)


@query(f"""SELECT c AS chunking_id, w AS target, count(segment_id) AS segments, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks
  FROM (VALUES (1, {WIDTHS[0]}), (2, {WIDTHS[1]}), (3, {WIDTHS[2]})) t(c, w) LEFT JOIN ({SPLIT}) ON chunking_id = c GROUP BY c, w""")
def chunks_per_chunking(spark: SparkSession, sf: str) -> DataFrame:
    """Every way to split with what it has split; the one that split nothing has zeros."""
    return S.per_chunking(chunkings(spark), segments(spark, sf)).select("chunking_id", "target", "segments", "chunks")


@query(f"SELECT model, CAST(sum(chunk_count) AS BIGINT) AS live, CAST(sum(n_embedded) AS BIGINT) AS done, round(coalesce(sum(n_embedded) / nullif(sum(chunk_count), 0), 0), 6) AS coverage FROM ({STANDING}) GROUP BY model")
def coverage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Each model against the chunks of its own chunking, the unbound one against all."""
    return S.coverage(standings(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query(f"SELECT model, book_id, CAST(sum(chunk_count) AS BIGINT) AS live, CAST(sum(n_embedded) AS BIGINT) AS done FROM ({STANDING}) GROUP BY 1, 2")
def embedded_by_book(spark: SparkSession, sf: str) -> DataFrame:
    """How far each model has come in every book."""
    return S.of_books(standings(spark, sf))


@query(f"SELECT model, segment_id, unnest(range(chunk_start, chunk_start + n_embedded)) AS chunk_id FROM ({STANDING}) WHERE model <> 'new'")
def embedded_population(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk ids that a search of each model may see: every id looked up among the embedded ranges by an equi-join on buckets."""
    s = segments(spark, sf)
    ids = s.select(F.explode(F.sequence(F.col("chunk_start"), F.col("chunk_start") + F.col("chunk_count") - 1)).alias("chunk_id"), "chunk_count").filter("chunk_count > 0").drop("chunk_count")
    return C.owners(ids, S.embedded(standings(spark, sf).filter("model <> 'new'"))).select("model", "segment_id", "chunk_id")


@query(f"""SELECT model, segment_id, start, n FROM (SELECT model, segment_id, start, CAST(least(n, {STEP} - (sum(n) OVER (PARTITION BY model ORDER BY start) - n)) AS BIGINT) AS n
  FROM (SELECT model, segment_id, chunk_start + n_embedded AS start, chunk_count - n_embedded AS n FROM ({STANDING}) WHERE model <> 'new' AND n_embedded < chunk_count)) WHERE n > 0""")
def next_step_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The ranges of ids that each model embeds next, the last one cut. No vector is read for it."""
    s, out = standings(spark, sf), None
    for model in ("fine", "wide"):
        part = S.first_ids(S.pending(s.filter(F.col("model") == model)), STEP).select(F.lit(model).alias("model"), "segment_id", "start", "n")
        out = part if out is None else out.unionByName(part)
    return out


#: Every fiftieth id that is embedded failed; every fortieth id of a chunking has a vector from before an edit.
IDS = f"SELECT model, chunk_start + n_embedded AS next, unnest(range(chunk_start, chunk_start + chunk_count)) AS chunk_id FROM ({STANDING}) WHERE model <> 'new'"


@query(f"""SELECT m.model, count(*) FILTER (WHERE chunk_id % 50 = 0 AND chunk_id < next) AS failures, count(*) FILTER (WHERE chunk_id % 40 = 0 AND chunk_id >= next) AS carries
  FROM (VALUES ('fine'), ('wide'), ('new')) m(model) LEFT JOIN ({IDS}) i ON i.model = m.model GROUP BY m.model""")
def troubles_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that each model could not read, and vectors that still wait to be taken over; the model that has none has zeros."""
    s, known = standings(spark, sf).filter("model <> 'new'"), spark.createDataFrame([(m,) for m in MODELS], "model string")
    every = s.filter("chunk_count > 0").select("model", "segment_id", F.explode(F.sequence(F.col("chunk_start"), F.col("chunk_start") + F.col("chunk_count") - 1)).alias("chunk_id"))
    failed = C.owners(every.filter("chunk_id % 50 = 0").select(F.col("model").alias("of"), "chunk_id"), S.embedded(s)).filter("of = model")
    return S.troubles(known, failed, S.waiting(s, every.filter("chunk_id % 40 = 0")))


#: Two states of books of several files: later, of books 10k+3 the first file differs, 10k+5 are gone, 10k+7 have another key, of 10k+9 two files changed places; 10k+1 are not split this way yet.
WAS = "SELECT 'c' || conv_id AS key, conv_id, turn AS ordinal, 'f' || turn AS path, sha256(text) AS h FROM conversations"
NOW = """SELECT CASE WHEN conv_id % 10 = 7 THEN 'm' ELSE 'c' END || conv_id AS key, conv_id, CASE WHEN conv_id % 10 = 9 AND turn < 2 THEN 1 - turn ELSE turn END AS ordinal, 'f' || turn AS path,
  sha256(CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN 'A preface. ' || text ELSE text END) AS h FROM conversations WHERE conv_id % 10 <> 5"""
LISTS = "SELECT key, any_value(conv_id) AS conv_id, string_agg(h, ',' ORDER BY ordinal) AS hs, string_agg(path, ',' ORDER BY ordinal) AS ps FROM ({}) GROUP BY key"


@query(f"""WITH o AS ({LISTS.format(WAS)}), n AS ({LISTS.format(NOW)}), gone AS (SELECT hs, min(key) AS was FROM o WHERE key NOT IN (SELECT key FROM n) GROUP BY 1)
SELECT n.key, CASE WHEN o.hs = n.hs AND o.ps = n.ps THEN CASE WHEN o.conv_id % 10 = 1 THEN 'rechunked' ELSE 'unchanged' END WHEN o.hs IS NOT NULL THEN 'updated' WHEN was IS NOT NULL THEN 'moved' ELSE 'added' END AS status
FROM n LEFT JOIN o USING (key) LEFT JOIN gone ON gone.hs = n.hs""")
def ingest_of_chapters(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of books of several files: known by the ordered list of their files' hashes and names."""
    c = table(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    path, size = F.concat(F.lit("f"), turn.cast("string")).alias("path"), F.octet_length("text").alias("size_bytes")
    hashed = lambda text: F.sha2(text.cast("binary"), 256).alias("content_sha256")
    was = c.select(F.concat(F.lit("c"), conv.cast("string")).alias("key"), "conv_id", turn.alias("ordinal"), path, size, hashed(F.col("text")))
    text = F.when((conv % 10 == 3) & (turn == 0), F.concat(F.lit("A preface. "), "text")).otherwise(F.col("text"))
    place = F.when((conv % 10 == 9) & (turn < 2), 1 - turn).otherwise(turn)
    now = c.filter("conv_id % 10 <> 5").select(F.concat(F.when(conv % 10 == 7, "m").otherwise("c"), conv.cast("string")).alias("key"), place.alias("ordinal"), path, size, hashed(text))
    split = was.filter(conv % 10 != 1).select("key").distinct()
    return C.ingest_status(_listed(was), _listed(now), split)


def _listed(sources: DataFrame) -> DataFrame:
    return S.identity(sources, "key").select("key", F.concat_ws(" ", "content", "paths").alias("hashes"), "content")
