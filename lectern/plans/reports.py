"""Queries of reports, evaluation, answers and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import answers as A
from lectern.operators import corpus as C
from lectern.operators import retrieval as R
from lectern.plans._registry import query, table
from lectern.plans.retrieval import TOK
from lectern.plans.stored import stored, vectors
from lectern.streaming import incremental as S

#: Books are languages and sources of documents; a chunk is embedded if there is a vector of its number.
BOOKS = "SELECT doc_id AS chunk_id, source AS book FROM documents"
PROGRESS = f"SELECT dense_rank() OVER (ORDER BY book) AS book_id, book, count(*) AS n, count(vec_id) AS done FROM ({BOOKS}) LEFT JOIN embeddings ON vec_id = chunk_id GROUP BY book"


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """book, n, done: every source with its documents, and how many of them have a vector."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("book"))
    have = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.lit(1).alias("one"))
    return d.join(have, "chunk_id", "left").groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.count("one").alias("done"))


def _outstanding(spark: SparkSession, sf: str) -> DataFrame:
    """One row by the operator; a book's number is its place by name. There is a row a source."""
    p = progress(spark, sf).withColumn("book_id", F.row_number().over(W.orderBy("book")).cast("bigint"))
    return C.outstanding(p.select("book_id", "n"), p.select("book_id", "done"))


@query(f"SELECT CAST(sum(n) AS BIGINT) AS live, CAST(sum(done) AS BIGINT) AS done, CAST(greatest(0, sum(n) - sum(done)) AS BIGINT) AS to_embed FROM ({PROGRESS})")
def outstanding_work(spark: SparkSession, sf: str) -> DataFrame:
    return _outstanding(spark, sf).select("live", "done", "to_embed")


@query(f"SELECT count(*) FILTER (WHERE done = n) AS complete, count(*) FILTER (WHERE done > 0 AND done < n) AS part_way, count(*) FILTER (WHERE done = 0) AS not_started, round(sum(done) / sum(n), 6) AS coverage FROM ({PROGRESS})")
def model_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _outstanding(spark, sf).select("complete", "part_way", "not_started", F.round(F.try_divide("done", "live"), 6).alias("coverage"))


@query(f"SELECT book_id, n - done AS backlog FROM ({PROGRESS}) WHERE done > 0 AND done < n ORDER BY n - done DESC, book_id LIMIT 1")
def progress_inflight(spark: SparkSession, sf: str) -> DataFrame:
    """The book at work: of the largest backlog, the earliest."""
    return _outstanding(spark, sf).select(F.col("at_work").alias("book_id"), "backlog")


#: Runs from the journal: a user is a model, the value its seconds, the event's number what it embedded.
RUNS = "SELECT event_id AS id, user_id AS model_id, value AS seconds, event_id % 500 AS embedded, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.5 WHEN 2 THEN 7.0 ELSE 1.0 END AS duty, value * 1.5 AS wall_seconds FROM events"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    duty = F.when(i % 4 == 1, 0.5).when(i % 4 == 2, 7.0).when(i % 4 == 3, 1.0)
    return e.select(i.alias("id"), F.col("user_id").alias("model_id"), F.col("value").alias("seconds"), (i % 500).alias("embedded"), duty.alias("duty"), (F.col("value") * 1.5).alias("wall_seconds"))


@query(f"""SELECT model_id, round(v[len(v) // 2 + 1], 6) AS rate FROM (SELECT model_id, list_sort(list(embedded / seconds / CASE WHEN duty > 0 AND duty <= 1 THEN duty::DOUBLE ELSE 1.0::DOUBLE END)) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY id DESC) AS r FROM ({RUNS}) WHERE seconds > 30 AND embedded > 0) WHERE r <= 10 GROUP BY model_id)""")
def observed_rate(spark: SparkSession, sf: str) -> DataFrame:
    return C.observed_rate(runs(spark, sf)).withColumn("rate", F.round("rate", 6))


@query(f"SELECT model_id, count(*) AS runs, round(sum(seconds), 4) AS seconds, CAST(sum(embedded) AS BIGINT) AS embedded, round(sum(embedded) / nullif(sum(seconds), 0), 6) AS mean_rate FROM ({RUNS}) GROUP BY model_id")
def history_totals(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).groupBy("model_id").agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum("seconds"), 4).alias("seconds"), F.sum("embedded").alias("embedded"), F.round(F.try_divide(F.sum("embedded"), F.sum("seconds")), 6).alias("mean_rate"))


@query(f"SELECT id, round(wall_seconds - seconds, 6) AS asleep FROM ({RUNS}) WHERE wall_seconds - seconds >= 60")
def asleep(spark: SparkSession, sf: str) -> DataFrame:
    """Runs during which the machine slept for a minute or more."""
    gap = F.col("wall_seconds") - F.col("seconds")
    return runs(spark, sf).filter(gap >= 60).select("id", F.round(gap, 6).alias("asleep"))


@query("SELECT conv_id, turn, json_extract_string(to_json({'role': role, 'turn': turn}), '$.role') AS role FROM conversations WHERE text ILIKE '%ering%' ORDER BY conv_id DESC, turn DESC LIMIT 20")
def question_log_find(spark: SparkSession, sf: str) -> DataFrame:
    """The newest questions that hold a text, whatever its case."""
    c = table(spark, sf, "conversations").filter(F.col("text").ilike("%ering%")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(20)
    return c.select("conv_id", "turn", F.get_json_object(F.to_json(F.struct("role", "turn")), "$.role").alias("role"))


@query(f"SELECT doc_id, array_to_string([t for t in regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') if length(t) > 1 OR regexp_full_match(t, '[0-9]')], ' ') AS terms, len({TOK}) > 1 AS has_phrase FROM documents")
def query_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as questions: their terms."""
    t = X.query_terms(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(t, " ").alias("terms"), (F.size(X.tokens(F.col("text"))) > 1).alias("has_phrase"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'eron') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])eron')")
def contains_term(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter(X.contains_term(F.col("text"), F.lit("eron"))).select("doc_id")


STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
STEM = "CASE WHEN w LIKE '%ing' AND length(w) >= 7 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%es' AND length(w) >= 6 THEN w[:-3] WHEN w LIKE '%s' AND length(w) >= 5 THEN w[:-2] ELSE w END"
QWORDS = f"list_distinct([w for w in regexp_extract_all(lower(substr(text, 1, 80)), '[\\p{{L}}\\p{{N}}_]+') if length(w) >= 3 AND w NOT IN ({STOP})])"


@query(f"SELECT item_id, round(share, 6) AS share, CASE WHEN share >= 0.5 THEN 'shares' ELSE 'little' END AS band FROM (SELECT item_id, CASE WHEN len(q) > 0 THEN len([w for w in q if contains(lower(substr(text, 81)), {STEM})]) / len(q) ELSE 0 END AS share FROM (SELECT *, {QWORDS} AS q FROM benchmark))")
def overlap_band(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a question's wording its passage shares: the first 80 characters of an item against the rest."""
    share = X.overlap_share(F.substring("text", 1, 80), F.expr("substring(text, 81)"))
    return table(spark, sf, "benchmark").select("item_id", share.alias("s")).select("item_id", F.round("s", 6).alias("share"), F.when(F.col("s") >= 0.5, "shares").otherwise("little").alias("band"))


@query("SELECT h AS holding, b AS breadth, round(CASE WHEN b <= 0 OR n - h < b THEN 1 ELSE 1 - list_product([(n - h - i)::DOUBLE / (n - i) for i in range(0, b)]) END, 6) AS chance FROM (SELECT count(DISTINCT label) AS n FROM embeddings), (SELECT unnest(range(1, 11)) AS h), (SELECT unnest([1, 3, 5]) AS b)")
def routing_chance(spark: SparkSession, sf: str) -> DataFrame:
    """The chance that a random choice of books holds one of those wanted."""
    n = vectors(spark, sf).agg(F.count_distinct("book_id").alias("n"))
    g = n.select("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))).alias("h")).select("n", "h", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("b"))
    miss = F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("b") - 1, F.lit(0))), F.lit(1.0), lambda a, i: a * (F.col("n") - F.col("h") - i) / (F.col("n") - i))
    return g.select(F.col("h").alias("holding"), F.col("b").alias("breadth"), F.round(F.when((F.col("b") <= 0) | (F.col("n") - F.col("h") < F.col("b")), 1.0).otherwise(1 - miss), 6).alias("chance"))


@query()
def routing_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a question's own book, and the book of its flat best hit, are among the five that it is routed to by whole profiles."""
    v = vectors(spark, sf)
    q = v.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("book_id").alias("wanted"), F.col("embedding").alias("query"))
    routed = R.route_many(stored(spark, sf, "centroids"), q.drop("wanted"), 5).select("query_id", "book_id")
    best = R.flat_many(v, q.drop("wanted"), 1).join(v.select("chunk_id", F.col("book_id").alias("top_book")), "chunk_id").select("query_id", "top_book")
    j = routed.join(q.select("query_id", "wanted"), "query_id").join(best, "query_id")
    return j.groupBy("query_id").agg(F.count_if(F.col("book_id") == F.col("wanted")).alias("kept"), F.count_if(F.col("book_id") == F.col("top_book")).alias("kept_flat_top"))


#: Every turn as a claim that quotes a stretch of itself, with other quotes and dashes; a third cite the turn before, where it does not stand.
CLAIMS = """SELECT conv_id * 1000 + turn AS claim_id, conv_id * 1000 + turn - CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END AS cited,
  replace(replace(substr(text, 6, 60), '-', '–'), '''', '’') AS quote FROM conversations WHERE text <> ''"""
PASSAGES = "SELECT conv_id * 1000 + turn AS rank, text FROM conversations WHERE text <> ''"


def _plain_sql(c: str) -> str:
    for a, b in X.TYPOGRAPHY.items():
        c = f"replace({c}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query(f"SELECT claim_id, c.cited, quote, coalesce(contains({_plain_sql('p.text')}, {_plain_sql('quote')}), false) AS verified FROM ({CLAIMS}) c LEFT JOIN ({PASSAGES}) p ON p.rank = c.cited")
def verify_quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every claim's quote stands in the passage that it cites, whatever quotes and dashes either has."""
    c = table(spark, sf, "conversations").filter("text <> ''")
    number = F.col("conv_id") * 1000 + F.col("turn")
    quote = F.replace(F.replace(F.substring("text", 6, 60), F.lit("-"), F.lit("–")), F.lit("'"), F.lit("’"))
    claims = c.select(number.alias("claim_id"), (number - F.when(F.col("turn") % 3 == 2, 1).otherwise(0)).alias("cited"), quote.alias("quote"))
    return A.verify(claims, c.select(number.alias("rank"), "text"))


@query(f"SELECT doc_id, {_plain_sql('text')} AS plain FROM documents")
def normalise_typography(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.plain_typography(F.col("text")).alias("plain"))


@query("SELECT conv_id, turn, list_contains([trim(l) for l in string_split(text, chr(10))], 'NO ANSWER IN PASSAGES') AS refused FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || chr(10) || ' NO ANSWER IN PASSAGES ' ELSE text END AS text FROM conversations)")
def refused(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n NO ANSWER IN PASSAGES "))).otherwise(F.col("text")))
    return c.select("conv_id", "turn", A.refused(F.col("text")).alias("refused"))


@query()
def find_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole turn as an answer that quotes it: the claims found in it."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit('It says "'), F.regexp_replace("text", '["“”\n]', " "), F.lit('" [1]. And so on [2].')).alias("answer"))
    return c.select("conv_id", "turn", F.explode(A.claims(F.col("answer"))).alias("c")).select("conv_id", "turn", "c.*")


@query("SELECT CASE WHEN live = 0 THEN 'add' WHEN models = 0 THEN 'embed' WHEN pending > 0 THEN 'embed the rest' WHEN unprofiled > 0 THEN 'route' WHEN lexical < live THEN 'index words' ELSE 'ask' END AS step FROM (SELECT (SELECT count(*) FROM documents) AS live, least(1, (SELECT count(*) FROM embeddings)) AS models, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS pending, 0 AS unprofiled, (SELECT count(*) FROM documents) AS lexical)")
def next_step_rule(spark: SparkSession, sf: str) -> DataFrame:
    """What comes next for the stored index."""
    d, v = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    gap = R.profile_gap(stored(spark, sf, "centroids").groupBy("book_id").agg(F.max("built_from").alias("n")), vectors(spark, sf).groupBy("book_id").agg(F.count(F.lit(1)).alias("n")))
    parts = [
        d.agg(F.count(F.lit(1)).alias("live")),
        v.agg(F.least(F.lit(1), F.count(F.lit(1))).alias("models")),
        d.join(v, F.col("vec_id") == F.col("doc_id"), "left_anti").agg(F.count(F.lit(1)).alias("pending")),
        gap.agg(F.count_if(F.col("state") != "current").alias("unprofiled")),
        stored(spark, sf, "lengths").agg(F.count(F.lit(1)).alias("lexical")),
    ]
    one = parts[0]
    for p in parts[1:]:  # each is one row
        one = one.join(F.broadcast(p))
    return C.next_step(one).select("step")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: activity by the hour."""
    return S.tumbling(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def events_session(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions of users."""
    return S.sessions(table(spark, sf, "events"))


@query("SELECT (SELECT count(*) FROM documents) AS books, (SELECT count(DISTINCT source) FROM documents) AS shelves, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS bytes, (SELECT count(*) FROM embeddings) AS vectors")
def status_totals(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("books"), F.count_distinct("source").alias("shelves"), F.sum(F.octet_length("text")).alias("bytes"))
    return d.join(F.broadcast(table(spark, sf, "embeddings").agg(F.count(F.lit(1)).alias("vectors"))))  # one row each


NAMES = "SELECT DISTINCT (event_id % 300) || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' ELSE ' ' || event_type END AS name FROM events"


@query(f"SELECT name, CASE WHEN regexp_full_match(name, '[0-9]+[smh]?') THEN CAST(regexp_extract(name, '[0-9]+') AS BIGINT) * CASE right(name, 1) WHEN 'h' THEN 3600 WHEN 'm' THEN 60 ELSE 1 END END AS seconds FROM ({NAMES})")
def parse_duration(spark: SparkSession, sf: str) -> DataFrame:
    """Every way in which the journal writes a length of time; null where it is none."""
    i = F.col("event_id")
    unit = F.when(i % 5 == 0, "").when(i % 5 == 1, "s").when(i % 5 == 2, "m").when(i % 5 == 3, "h").otherwise(F.concat(F.lit(" "), "event_type"))
    return table(spark, sf, "events").select(F.concat((i % 300).cast("string"), unit).alias("name")).distinct().select("name", X.duration_seconds(F.col("name")).alias("seconds"))


@query(f"""SELECT doc_id, array_to_string(['"' || t || '"' for t in terms], ' OR ') AS any_word, CASE WHEN len(terms) >= 2 THEN '"' || array_to_string(terms, ' ') || '"' ELSE '' END AS phrase
  FROM (SELECT doc_id, [t for t in regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') if length(t) > 1 OR regexp_full_match(t, '[0-9]')] AS terms FROM documents)""")
def match_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Every text as a question in the language of an index of words: any of its words, and all as a phrase."""
    t = table(spark, sf, "documents").select("doc_id", X.query_terms(F.col("text")).alias("t"))
    return t.select("doc_id", X.or_query(F.col("t")).alias("any_word"), X.phrase_query(F.col("t")).alias("phrase"))


@query("""SELECT doc_id, CASE WHEN len(w) >= 18 THEN array_to_string(w[len(w) // 4 + 1 : len(w) // 4 + 9], ' ') END AS phrase
  FROM (SELECT doc_id, [x for x in regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+') if x <> ''] AS w FROM documents)""")
def distinctive_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Nine words from a quarter into every text."""
    return table(spark, sf, "documents").select("doc_id", X.distinctive_phrase(F.col("text")).alias("phrase"))


@query()
def best_extracts(spark: SparkSession, sf: str) -> DataFrame:
    """What to show of every turn for the words of its conversation's first turn; tested against a plain version over whole texts."""
    c = table(spark, sf, "conversations")
    first = c.filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("question")).select("conv_id", X.marked_terms(F.col("question")).alias("terms"))
    e = c.join(first, "conv_id").select("conv_id", "turn", A.extracts(F.col("text"), F.col("terms")).alias("e"))
    return e.select("conv_id", "turn", "e.*")
