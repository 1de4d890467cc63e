"""Queries of ingest, ids, scope and upkeep: documents and conversations are books."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.plans._registry import query, table


def SIGNED(data: str) -> str:  # noqa: N802
    """The first 8 bytes of SHA-256 as a signed number, in DuckDB."""
    u = f"('0x' || substr(sha256({data}), 1, 16))::UBIGINT::HUGEINT"
    return f"(CASE WHEN {u} >= 9223372036854775808 THEN {u} - 18446744073709551616 ELSE {u} END)::BIGINT"


#: Segments of the tests: a turn of a conversation has a chunk for each 300 bytes.
SEG = "SELECT conv_id AS book_id, turn AS ordinal, CAST(ceil(strlen(text) / 300.0) AS BIGINT) AS n FROM conversations"
ALLOC = f"SELECT book_id, ordinal, CAST(sum(n) OVER (ORDER BY book_id, ordinal) - n + 1 AS BIGINT) AS chunk_start, n AS chunk_count FROM ({SEG})"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ordinal"), F.ceil(F.octet_length("text") / 300.0).cast("bigint").alias("n"))


def allocated(spark: SparkSession, sf: str) -> DataFrame:
    return C.allocate(segments(spark, sf))


@query("SELECT doc_id, strlen(text) AS bytes, sha256(text) AS sha FROM documents")
def source_scan_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query(f"SELECT doc_id, {SIGNED('text')} AS content_hash FROM documents")
def chunk_hash_signed64(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", X.content_hash(F.col("text").cast("binary")).alias("content_hash"))


@query()
def chunk_spans(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk(docs(spark, sf).select(F.col("doc_id").alias("book_id"), "text"))


@query()
def chunk_spans_utf8(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk(docs(spark, sf).select(F.col("doc_id").alias("book_id"), "text"), 101)


@query(ALLOC)
def chunk_id_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return allocated(spark, sf)


@query(f"SELECT book_id, min(chunk_start) AS first_chunk, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM ({ALLOC}) GROUP BY book_id")
def book_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return allocated(spark, sf).groupBy("book_id").agg(F.min("chunk_start").alias("first_chunk"), F.sum("chunk_count").alias("chunks"))


POINTS = f"SELECT unnest(range(1, (SELECT sum(n)::BIGINT + 1 FROM ({SEG})))) AS chunk_id"


@query(f"SELECT chunk_id, book_id, ordinal, chunk_id - chunk_start AS place FROM ({POINTS}) p JOIN ({ALLOC}) s ON chunk_id >= chunk_start AND chunk_id < chunk_start + chunk_count")
def locate_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk id looked up: its segment, and its place there."""
    s = allocated(spark, sf)
    ids = s.select(F.explode(F.sequence(F.col("chunk_start"), F.col("chunk_start") + F.col("chunk_count") - 1)).alias("chunk_id"))
    return C.owners(ids, s).select("chunk_id", "book_id", "ordinal", (F.col("chunk_id") - F.col("chunk_start")).alias("place"))


@query(f"SELECT book_id, ordinal, unnest(range(0, chunk_count)) AS place FROM ({ALLOC})")
def segment_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    s = allocated(spark, sf).filter("chunk_count > 0")
    return s.select("book_id", "ordinal", F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("place"))


@query("SELECT min(vec_id) AS start, max(vec_id) + 1 AS stop FROM (SELECT vec_id, vec_id - row_number() OVER (ORDER BY vec_id) AS g FROM embeddings WHERE vec_id % 7 <> 0) GROUP BY g")
def merge_ranges_islands(spark: SparkSession, sf: str) -> DataFrame:
    return C.merge_ids(table(spark, sf, "embeddings").filter("vec_id % 7 <> 0").select(F.col("vec_id").alias("chunk_id")), 100)


@query("SELECT doc_id FROM documents WHERE regexp_full_match(lower(source), 'src1.')")
def scope_glob(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf)
    return d.filter(C.matches("SRC1?", F.col("source"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(lower(source), 'rc1') OR contains(lower(lang), 'rc1')")
def scope_substring(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).filter(C.matches("RC1", F.col("source"), F.col("lang"))).select("doc_id")


SCOPES = ("src1*", "rc2", "nothing")


@query("""SELECT p AS pattern, count(doc_id) AS hits FROM (VALUES ('src1*'), ('rc2'), ('nothing')) t(p)
  LEFT JOIN documents ON CASE p WHEN 'src1*' THEN source LIKE 'src1%' WHEN 'rc2' THEN contains(source, 'rc2') ELSE contains(source, 'nothing') END GROUP BY p""")
def scope_union_misses(spark: SparkSession, sf: str) -> DataFrame:
    """How many books each pattern of a scope matches; 0 for a miss."""
    counts = docs(spark, sf).agg(*[F.count_if(C.matches(p, F.col("source"))).alias(p) for p in SCOPES])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, SCOPES)), F.array(*[F.col(f"`{p}`") for p in SCOPES]))).alias("pattern", "hits"))


@query("SELECT source AS shelf, count(*) AS books, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) FILTER (WHERE lang = 'fr') AS set_aside FROM documents GROUP BY source")
def shelves(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupBy(F.col("source").alias("shelf")).agg(F.count(F.lit(1)).alias("books"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("lang") == "fr").alias("set_aside"))


@query("""SELECT coalesce(string_agg(part, '/' ORDER BY pos), '') AS root FROM (SELECT pos, part, bool_and(same) OVER (ORDER BY pos) AS all_same FROM
  (SELECT pos, min(part) AS part, count(DISTINCT part) = 1 AND count(*) = (SELECT count(*) FROM pages) AS same FROM (SELECT generate_subscripts(string_split(url, '/'), 1) AS pos, unnest(string_split(url, '/')) AS part FROM pages) GROUP BY pos)) WHERE all_same""")
def shelf_root(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest directory that all share."""
    p = table(spark, sf, "pages").select("url", F.posexplode(F.split("url", "/")).alias("pos", "part"))
    n = table(spark, sf, "pages").agg(F.count(F.lit(1)).alias("all"))
    level = p.groupBy("pos").agg(F.min("part").alias("part"), F.max("part").alias("last"), F.count(F.lit(1)).alias("n")).join(F.broadcast(n))  # one row
    held = level.agg(F.array_sort(F.collect_list(F.struct("pos", "part", ((F.col("part") == F.col("last")) & (F.col("n") == F.col("all"))).alias("same")))).alias("p"))  # as many as a path has parts
    first_odd = F.array_position(F.transform("p", lambda x: x["same"]), F.lit(False))
    keep = F.when(first_odd > 0, (first_odd - 1).cast("int")).otherwise(F.size("p"))
    return held.select(F.array_join(F.transform(F.slice("p", F.lit(1), keep), lambda x: x["part"]), "/").alias("root"))


@query("SELECT conv_id AS book_id, count(*) AS sources, CAST(sum(ceil(strlen(text) / 300.0)) AS BIGINT) AS chunks, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def books_detail(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.groupBy(F.col("conv_id").alias("book_id")).agg(F.count(F.lit(1)).alias("sources"), F.sum(F.ceil(F.octet_length("text") / 300.0)).cast("bigint").alias("chunks"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])).alias("roles"))


@query("SELECT doc_id AS book_id FROM documents WHERE length(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c\\x1c-\\x1f]+', '', 'g')) = 0 OR text IS NULL UNION ALL SELECT -1")
def empty_books(spark: SparkSession, sf: str) -> DataFrame:
    """Books of which no chunk comes: texts of white space alone, and one more (-1) that is such."""
    d = docs(spark, sf).select(F.col("doc_id").alias("book_id"), "text")
    d = d.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("book_id"), F.lit(" \n\t ").alias("text")))
    return d.select("book_id").join(C.chunk(d).select("book_id").distinct(), "book_id", "left_anti")


@query("SELECT title, n FROM (SELECT substr(text, 1, 80) AS title, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1 ORDER BY n DESC, title LIMIT 20")
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = docs(spark, sf).groupBy(F.substring("text", 1, 80).alias("title")).agg(F.count(F.lit(1)).alias("n"))
    return t.filter("n > 1").orderBy(F.desc("n"), "title").limit(20)


@query("SELECT p_partkey AS book_id, count(l_orderkey) AS chunks, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS quantity FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def left_join_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("chunks"), F.sum("l_quantity").cast("bigint").alias("quantity"))
    j = table(spark, sf, "part").join(n, F.col("l_partkey") == F.col("p_partkey"), "left")
    return j.select(F.col("p_partkey").alias("book_id"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("quantity", F.lit(0)).alias("quantity"))


#: Two states of the files: later, ids 10k+3 have a prefix, ids 10k+5 are gone, ids 10k+7 have another key.
OLD = "SELECT 'b' || doc_id AS key, doc_id, text FROM documents"
NEW = "SELECT CASE WHEN doc_id % 10 = 7 THEN 'm' ELSE 'b' END || doc_id AS key, doc_id, CASE WHEN doc_id % 10 = 3 THEN 'A preface. ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 5 UNION ALL SELECT 'new', -1, 'a new book'"


def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, sf).select("doc_id", "text")
    old = d.select(F.concat(F.lit("b"), "doc_id").alias("key"), "doc_id", "text")
    changed = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("A preface. "), "text")).otherwise(F.col("text"))
    new = d.filter("doc_id % 10 <> 5").select(F.concat(F.when(F.col("doc_id") % 10 == 7, "m").otherwise("b"), "doc_id").alias("key"), "doc_id", changed.alias("text"))
    extra = spark.range(1).select(F.lit("new").alias("key"), F.lit(-1).cast("bigint").alias("doc_id"), F.lit("a new book").alias("text"))
    return old, new.unionByName(extra)


@query(f"""WITH o AS ({OLD}), n AS ({NEW}), gone AS (SELECT sha256(text) AS h, min(key) AS was FROM o WHERE key NOT IN (SELECT key FROM n) GROUP BY 1)
SELECT n.key, CASE WHEN o.text = n.text THEN 'unchanged' WHEN o.text IS NOT NULL THEN 'updated' WHEN was IS NOT NULL THEN 'moved' ELSE 'added' END AS status
FROM n LEFT JOIN o USING (key) LEFT JOIN gone ON h = sha256(n.text)""")
def ingest_status(spark: SparkSession, sf: str) -> DataFrame:
    old, new = snapshots(spark, sf)
    shape = lambda d: d.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("hashes"))
    return C.ingest_status(shape(old), shape(new))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT n.key, min(o.key) AS was FROM n JOIN o ON sha256(n.text) = sha256(o.text) WHERE n.key NOT IN (SELECT key FROM o) AND o.key NOT IN (SELECT key FROM n) GROUP BY n.key")
def moved_book_match(spark: SparkSession, sf: str) -> DataFrame:
    old, new = snapshots(spark, sf)
    h = F.sha2(F.col("text").cast("binary"), 256)
    gone = old.join(new.select("key"), "key", "left_anti").groupBy(h.alias("h")).agg(F.min("key").alias("was"))
    return new.join(old.select("key"), "key", "left_anti").select("key", h.alias("h")).join(gone, "h").select("key", "was")


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT n.doc_id AS new_chunk, max(o.doc_id) AS old_chunk FROM n JOIN o ON sha256(n.text) = sha256(o.text) GROUP BY n.doc_id, n.key")
def salvage_carries(spark: SparkSession, sf: str) -> DataFrame:
    old, new = snapshots(spark, sf)
    shape = lambda d: d.select(F.col("doc_id").alias("chunk_id"), X.content_hash(F.col("text").cast("binary")).alias("content_hash"))
    return C.carries(shape(old), shape(new))


@query(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT o.key, CASE WHEN n.text IS NULL THEN 'missing' WHEN n.text = o.text THEN 'intact' ELSE 'changed' END AS state FROM o LEFT JOIN n USING (key)")
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    old, new = snapshots(spark, sf)
    j = old.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("h")).join(new.select("key", F.sha2(F.col("text").cast("binary"), 256).alias("now")), "key", "left")
    return j.select("key", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("h"), "intact").otherwise("changed").alias("state"))


#: Bytes of a recorded span; the last one of a book may be shorter.
SPAN = 1000
#: Every span of every book as it was (data, place, size), beside its bytes as they are now.
SPANS_SQL = f"""SELECT doc_id, place, least({SPAN}, octet_length(was) - place) AS size, was, now FROM (SELECT o.doc_id, unnest(range(0, octet_length(o.data), {SPAN})) AS place, o.data AS was, n.data AS now
  FROM (SELECT doc_id, encode(text) AS data FROM ({OLD}) WHERE strlen(text) > 0) o LEFT JOIN (SELECT doc_id, encode(text) AS data FROM ({NEW})) n USING (doc_id))"""


def spans_now(spark: SparkSession, sf: str, of: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """doc_id, place, found: ``of`` (place, size, expected hash) for every span of every book, beside columns ``was`` and ``now``.

    The spans are worked out within a book's own row, so its bytes are never copied beside each of them.
    """
    old, new = snapshots(spark, sf)
    o = old.filter(F.octet_length("text") > 0).select("doc_id", F.col("text").cast("binary").alias("was"))
    j = o.join(new.select("doc_id", F.col("text").cast("binary").alias("now")), "doc_id", "left")
    n = F.octet_length("was")

    def one(place: Column) -> Column:
        size = F.least(F.lit(SPAN), n - place)
        return F.struct(place.cast("bigint").alias("place"), of(place, size, X.content_hash(F.substring("was", place + 1, size))).alias("found"))

    return j.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(SPAN)), one)).alias("s")).select("doc_id", "s.*")


@query(f"""SELECT doc_id, place, CASE WHEN now IS NULL THEN 'missing' WHEN {SIGNED('now[place + 1 : place + size]')} = {SIGNED('was[place + 1 : place + size]')} THEN 'exact'
  WHEN {SIGNED('now[place + 1 + shift : place + size + shift]')} = {SIGNED('was[place + 1 : place + size]')} THEN 'shifted' ELSE 'changed' END AS state FROM (SELECT *, octet_length(now) - octet_length(was) AS shift FROM ({SPANS_SQL}))""")
def span_locate_states(spark: SparkSession, sf: str) -> DataFrame:
    """Every span of every book, found again after the files have changed."""
    shift = F.octet_length("now") - F.octet_length("was")
    return spans_now(spark, sf, lambda place, size, expected: C.locate(F.col("now"), place, size, expected, shift)).withColumnRenamed("found", "state")


#: After the removal of every third book.
LIVE = f"SELECT row_number() OVER (ORDER BY chunk_start) AS segment_id, chunk_start, chunk_count FROM ({ALLOC}) WHERE book_id % 3 <> 0"
PLAN = f"SELECT chunk_start, chunk_count, CAST(sum(chunk_count) OVER (ORDER BY chunk_start) - chunk_count + 1 AS BIGINT) AS new_start FROM ({LIVE})"


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    live = allocated(spark, sf).filter("book_id % 3 <> 0").withColumn("segment_id", F.col("chunk_start"))
    return C.compaction_plan(live)


@query(f"SELECT chunk_start, chunk_count, new_start, new_start <> chunk_start AS moves, new_start <> chunk_start AND chunk_start < new_start + chunk_count AS self_overlaps FROM ({PLAN}) WHERE chunk_count > 0")
def compaction_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).drop("segment_id")


@query(f"SELECT chunk_start + i AS old_id, new_start + i AS new_id FROM (SELECT chunk_start, new_start, unnest(range(0, chunk_count)) AS i FROM ({PLAN}))")
def compaction_remap(spark: SparkSession, sf: str) -> DataFrame:
    p = _plan(spark, sf)
    return p.select(F.explode(F.sequence(F.lit(0), F.col("chunk_count") - 1)).alias("i"), "chunk_start", "new_start").select((F.col("chunk_start") + F.col("i")).alias("old_id"), (F.col("new_start") + F.col("i")).alias("new_id"))


@query("SELECT page_id, CASE WHEN url = 'https://a' OR url LIKE 'https://%' THEN 'https:/moved/' || substr(url, 9) ELSE url END AS path FROM pages")
def relocate_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", C.relocated(F.col("url"), "https:/", "https:/moved").alias("path"))


@query(r"SELECT kind, id, p90, p90 > 30 AS garbled FROM (SELECT kind, id, CASE WHEN len(n) >= 50 THEN n[CAST(floor(len(n) * 0.9) AS INT) + 1] END AS p90 FROM (SELECT kind, id, list_sort([length(w) for w in regexp_split_to_array(text, '\s+') if length(regexp_replace(w, '[^\p{L}]+', '', 'g')) > 0 AND length(regexp_replace(w, '[^\p{L}]+', '', 'g')) * 2 >= length(w)]) AS n FROM (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)))")
def garbled_p90(spark: SparkSession, sf: str) -> DataFrame:
    C.bounded_batches(spark)
    d = docs(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return d.unionByName(p).select("kind", "id", C.word_p90(F.col("text")).alias("p90")).withColumn("garbled", F.col("p90") > 30)
