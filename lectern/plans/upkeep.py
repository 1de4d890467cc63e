"""Queries of sources, models, wording and evaluation that stand beside those of the other modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import retrieval as R
from lectern.plans._registry import query, table
from lectern.plans.corpus import NEW, OLD, SIGNED, SPANS_SQL, docs, snapshots, spans_now
from lectern.plans.reports import RUNS, runs
from lectern.plans.stored import vectors
from lectern.sources import readers

#: Documents as files: a folder for each source, the language as suffix.
PATHS = "SELECT doc_id, source || '/' || doc_id || '.' || lang AS path FROM documents"


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"))


@query(f"SELECT doc_id FROM ({PATHS}) WHERE lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) IN ('en', 'fr')")
def suffix_filter(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).filter(readers.acceptable(F.col("path"), ("en", "fr"))).select("doc_id")


@query(f"SELECT lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS suffix, count(*) AS count FROM ({PATHS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def found_instead(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest suffixes, for when nothing fits."""
    return readers.found_instead(paths(spark, sf))


@query(f"SELECT doc_id, place, CASE WHEN {SIGNED('now[place + 1 : place + size]')} = {SIGNED('was[place + 1 : place + size]')} THEN md5(now[place + 1 : place + size]) END AS span FROM ({SPANS_SQL})")
def read_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Every span of every book as recorded (its digest, for brevity), or nothing where the file says something else now."""
    return spans_now(spark, sf, lambda place, size, expected: F.md5(C.read_span(F.col("now"), place, size, expected))).withColumnRenamed("found", "span")


@query()
def reading_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk of 600 bytes of every book, with what is around it up to whole sentences."""
    d = docs(spark, sf).select(F.col("doc_id").alias("book_id"), "text")
    j = C.chunk(d, 600).join(d, "book_id").select("book_id", "ordinal", C.reading_windows(F.col("text").cast("binary"), "byte_offset", "byte_length").alias("w"))
    return j.select("book_id", "ordinal", F.col("w.offset").alias("offset"), F.col("w.text").alias("text"))


@query(f"""WITH o AS (SELECT key, strlen(text) AS size_bytes, doc_id % 4 AS mtime FROM ({OLD})), n AS (SELECT key, strlen(text) AS size_bytes, CASE WHEN doc_id % 10 = 1 THEN 9 ELSE doc_id % 4 END AS mtime FROM ({NEW}))
SELECT n.key, CASE WHEN o.key IS NULL THEN 'new' WHEN o.size_bytes = n.size_bytes AND o.mtime = n.mtime THEN 'same' ELSE 'suspect' END AS state FROM n LEFT JOIN o USING (key)""")
def stat_fast_path(spark: SparkSession, sf: str) -> DataFrame:
    """Files that need no hashing, as size and time are those recorded."""
    old, new = snapshots(spark, sf)
    size, time = F.octet_length("text").alias("size_bytes"), F.col("doc_id") % 4
    return C.stat_suspects(old.select("key", size, time.alias("mtime")), new.select("key", size, F.when(F.col("doc_id") % 10 == 1, 9).otherwise(time).alias("mtime")))


@query("SELECT doc_id, source = 'src1' AS by_shelf, 'b' || doc_id IN ('b1', 'b20', 'b300') AS by_key FROM documents WHERE source = 'src1' OR 'b' || doc_id IN ('b1', 'b20', 'b300')")
def exact_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Books by the name of their shelf, and by their own: no patterns."""
    d = docs(spark, sf).select("doc_id", (F.col("source") == "src1").alias("by_shelf"), F.concat(F.lit("b"), "doc_id").isin("b1", "b20", "b300").alias("by_key"))
    return d.filter("by_shelf OR by_key")


WANTED = "(VALUES ('click'), ('sign'), ('e'), ('zzz'), ('chase')) t(wanted)"


@query(f"SELECT wanted, CASE WHEN bool_or(model = wanted) THEN wanted WHEN count(model) = 1 THEN min(model) END AS model FROM {WANTED} LEFT JOIN (SELECT DISTINCT event_type AS model FROM events) ON contains(model, wanted) GROUP BY wanted")
def model_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A model by its name, or by a part of it that no other name holds."""
    return C.find_models(spark.sql(f"SELECT * FROM {WANTED}"), table(spark, sf, "events").select(F.col("event_type").alias("model")).distinct())


#: Users of the journal as models: what even events said of them before, and what odd ones say now.
REG_OLD = "SELECT user_id AS model, 64 * (1 + min(event_id) % 3) AS dim, CASE WHEN user_id % 2 = 0 THEN 'hub/' || user_id END AS source FROM events WHERE event_id % 2 = 0 GROUP BY user_id"
REG_NEW = "SELECT user_id AS model, 64 * (1 + max(event_id) % 3) AS dim, CASE WHEN user_id % 3 > 0 THEN 'new/' || user_id END AS source FROM events WHERE event_id % 2 = 1 GROUP BY user_id"


@query(f"SELECT model, coalesce(o.dim, n.dim) AS dim, coalesce(o.source, n.source) AS source, coalesce(o.dim <> n.dim, false) AS clash FROM ({REG_OLD}) o FULL JOIN ({REG_NEW}) n USING (model)")
def register_model(spark: SparkSession, sf: str) -> DataFrame:
    """Models registered anew: what was known stays, gaps are filled, another dimension is a clash."""
    e, user = table(spark, sf, "events"), F.col("user_id")

    def known(odd: int, last, prefix: str, told) -> DataFrame:  # noqa: ANN001
        dims = e.filter(F.col("event_id") % 2 == odd).groupBy(user.alias("model")).agg((64 * (1 + last("event_id") % 3)).alias("dim"))
        return dims.withColumn("source", F.when(told(F.col("model")), F.concat(F.lit(prefix), F.col("model").cast("string"))))

    return C.registered(known(0, F.min, "hub/", lambda m: m % 2 == 0), known(1, F.max, "new/", lambda m: m % 3 > 0))


@query(f"SELECT model, dim, count(id) AS runs, CAST(coalesce(sum(embedded), 0) AS BIGINT) AS embedded FROM ({REG_NEW}) LEFT JOIN (SELECT * FROM ({RUNS}) WHERE seconds > 90 AND embedded > 480) ON model_id = model GROUP BY model, dim")
def runs_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """Every model that odd events name with its long runs; one without any has zeros."""
    e = table(spark, sf, "events").filter("event_id % 2 = 1").groupBy(F.col("user_id").alias("model")).agg((64 * (1 + F.max("event_id") % 3)).alias("dim"))
    n = runs(spark, sf).filter("seconds > 90 AND embedded > 480").groupBy(F.col("model_id").alias("model")).agg(F.count(F.lit(1)).alias("runs"), F.sum("embedded").alias("embedded"))
    return e.join(n, "model", "left").fillna(0, ["runs", "embedded"])


@query("SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings WHERE label <> 2")
def nth_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """The place of every embedded chunk among all, where a book is set aside."""
    return C.numbered(vectors(spark, sf).filter("book_id <> 2"))


@query("SELECT vec_id AS chunk_id, text FROM embeddings JOIN documents ON doc_id = vec_id")
def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The texts of all chunks that have a vector, in order of their ids."""
    d = docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text")
    return d.join(vectors(spark, sf), "chunk_id", "left_semi").sort("chunk_id")


@query("SELECT label AS book_id, CAST(sum(len(embedding) * 4) AS BIGINT) AS full_bytes, CAST(sum(len(embedding) + 4) AS BIGINT) AS int8_bytes FROM embeddings GROUP BY label")
def stored_widths(spark: SparkSession, sf: str) -> DataFrame:
    """What vectors take in single precision, and as whole numbers with a scale."""
    v = vectors(spark, sf).groupBy("book_id")
    return v.agg(F.sum(F.size("embedding") * 4).alias("full_bytes"), F.sum(F.size("embedding") + 4).alias("int8_bytes"))


@query("SELECT label AS book_id, count(*) AS failures, count(*) FILTER (WHERE text IS NOT NULL) AS carries FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE text IS NULL OR length(trim(text)) < 40 GROUP BY label")
def failures_per_model(spark: SparkSession, sf: str) -> DataFrame:
    """By label of its vectors: chunks that an embedding could not be trusted for, and how many of them still have a text to be done again."""
    v = vectors(spark, sf).select("chunk_id", "book_id").join(docs(spark, sf).select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "left")
    bad = v.filter(F.col("text").isNull() | (F.length(F.trim("text")) < 40))
    return bad.groupBy("book_id").agg(F.count(F.lit(1)).alias("failures"), F.count("text").alias("carries"))


@query("SELECT source AS shelf, count(*) FILTER (WHERE lang <> 'fr') AS newly_set_aside, count(*) AS set_aside FROM documents GROUP BY source")
def set_aside_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Setting a whole shelf aside: how many of its books were not yet."""
    return docs(spark, sf).groupBy(F.col("source").alias("shelf")).agg(F.count_if(F.col("lang") != "fr").alias("newly_set_aside"), F.count(F.lit(1)).alias("set_aside"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT (role = 'user' AND contains(lower(text), 'ering'))")
def forget_questions(spark: SparkSession, sf: str) -> DataFrame:
    """What stays of a log when questions that hold a text are forgotten."""
    gone = (F.col("role") == "user") & F.contains(F.lower("text"), F.lit("ering"))
    return table(spark, sf, "conversations").filter(~gone).select("conv_id", "turn")


@query("""SELECT id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN ((n + 50) // 100) // 10 || '.' || ((n + 50) // 100) % 10 || ' KB' WHEN n < 1000000000 THEN ((n + 50000) // 100000) // 10 || '.' || ((n + 50000) // 100000) % 10 || ' MB'
  ELSE ((n + 50000000) // 100000000) // 10 || '.' || ((n + 50000000) // 100000000) % 10 || ' GB' END AS label FROM (SELECT doc_id AS id, strlen(text)::BIGINT * power(10, doc_id % 7)::BIGINT AS n FROM documents)""")
def size_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.octet_length("text").cast("bigint") * F.pow(F.lit(10), F.col("doc_id") % 7).cast("bigint")
    return docs(spark, sf).select(F.col("doc_id").alias("id"), X.size_label(n).alias("label"))


@query("SELECT event_id, CASE WHEN s < 0 THEN 'just now' WHEN s >= 86400 THEN s // 86400 || 'd ago' WHEN s >= 3600 THEN s // 3600 || 'h ago' WHEN s >= 60 THEN s // 60 || 'm ago' ELSE s || 's ago' END AS age FROM (SELECT event_id, CAST(trunc((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 1000000) AS BIGINT) AS s FROM events)")
def age_labels(spark: SparkSession, sf: str) -> DataFrame:
    """How long before the middle of a month each event was."""
    s = F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf, "events").select("event_id", X.age_label(s).alias("age"))


@query("SELECT page_id, CASE WHEN length(url) <= 28 THEN url ELSE substr(url, 1, 15) || '…' || right(url, 12) END AS title FROM pages")
def elided_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.elide(F.col("url"), 28).alias("title"))


UNMARKED = ", ".join(f"'{w}'" for w in X.UNMARKED)
MARK = "CASE " + " ".join(f"WHEN w LIKE '%{e}' AND length(w) > {len(e) + 3} THEN w[:-{len(e) + 1}]" for e in ("ing", "ies", "es", "ed", "s")) + " ELSE w END"


@query(f"""SELECT item_id, string_agg(s, ' ' ORDER BY length(s) DESC, s) AS terms FROM (SELECT DISTINCT item_id, {MARK} AS s FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark) WHERE length(w) >= 3 AND w NOT IN ({UNMARKED})) GROUP BY item_id""")
def marked_terms(spark: SparkSession, sf: str) -> DataFrame:
    """What to mark in passages for each question."""
    return table(spark, sf, "benchmark").select("item_id", F.array_join(X.marked_terms(F.col("text")), " ").alias("terms"))


@query(r"SELECT conv_id, turn, '[' || (turn + 1) || '] ' || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1600) AS passage FROM conversations WHERE text <> ''")
def rendered_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages as a model reads them; a passage is cut where the model's block ends."""
    c = table(spark, sf, "conversations").filter("text <> ''")
    return c.select("conv_id", "turn", X.rendered(F.col("turn") + 1, F.col("text")).alias("passage"))


#: Turns as replies of a model: a preamble, then a line for each sentence.
REPLIES = "SELECT conv_id, turn, 'Sure, here it is:' || chr(10) || '- \"' || replace(text, '. ', '.' || chr(10)) AS reply FROM conversations"


@query(f"""SELECT conv_id, turn, coalesce([x for x in [regexp_replace(l, '^[ "“”*-]+|[ "“”*-]+$', '', 'g') for l in string_split(reply, chr(10))]
  if len([w for w in regexp_split_to_array(x, '\\s+') if w <> '']) BETWEEN 3 AND 40 AND NOT regexp_matches(lower(x), '^(here|sure|one |a different|rephrase)')][1], '') AS question FROM ({REPLIES})""")
def rephrase_pick(spark: SparkSession, sf: str) -> DataFrame:
    """The question that is picked from each reply."""
    reply = F.concat(F.lit('Sure, here it is:\n- "'), F.replace("text", F.lit(". "), F.lit(".\n")))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.rephrasing(reply).alias("question"))
