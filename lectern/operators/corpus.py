"""Chunks and their ids, proofs of text, scope, ingest decisions and upkeep of the tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X

TARGET = 3600
_BLANK = b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Books in one bucket of a running total; buckets are then few enough for one window.
BUCKET = 4096


def _ends_of_breaks(whole: np.ndarray) -> list[list[int]]:
    """For each kind of break, best first, where it ends: blank lines, lines, sentences, words."""
    line, space = whole == 10, whole == 32
    pair = [np.flatnonzero(a[:-1] & b[1:]) + 2 for a, b in ((line, line), (whole == 46, space))]
    return [ends.tolist() for ends in (pair[0], np.flatnonzero(line) + 1, pair[1], np.flatnonzero(space) + 1)]


def _stretches(data: bytes, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Where chunks begin and end, white space and all: one pass for the breaks, then a look-up of each kind for a cut."""
    size = len(data)
    breaks = _ends_of_breaks(np.frombuffer(data, dtype=np.uint8)) if size > target else []

    def character(at: int, step: int) -> int:
        """The nearest place at or beyond ``at``, in the direction of ``step``, where a character begins: a few bytes off at most, in sound text."""
        while 0 < at < size and data[at] & 0xC0 == 0x80:
            at += step
        return at

    def cut(at: int) -> int:
        ideal = at + target
        if ideal >= size:
            return size
        for width, ends in zip((2, 1, 2, 1), breaks, strict=True):
            i = bisect_right(ends, ideal + 1)  # the last that ends within one byte of the target
            if i and ends[i - 1] >= ideal - max(1, target // 4) + width:
                return ends[i - 1]
        whole_characters = character(ideal, -1)
        return whole_characters if whole_characters > at else character(ideal, 1)

    at, end = 0, 0
    while end < size:
        end = cut(at)
        yield at, end
        at = character(max(at + 1, end - overlap), 1)
        if at >= size:
            return


def chunk_spans(data: bytes, target: int = TARGET, overlap: int = 0) -> list[tuple[int, int]]:
    """(offset, length) of chunks of about ``target`` bytes, without the white space at their ends.

    A chunk ends after the last blank line of the quarter before its target; without one after the last line, else
    sentence, else word; else at the target, but never within a character. The next begins there, less ``overlap``.
    """
    if target < 1 or not 0 <= overlap < target:
        raise ValueError("a target is at least 1, and an overlap less than it")
    spans = []
    for a, b in _stretches(data, target, overlap):
        text = data[a:b].lstrip(_BLANK)
        if kept := text.rstrip(_BLANK):
            spans.append((b - len(text), len(kept)))
    return spans


#: Bytes of chunks that a worker hands on at once, and characters of a text that are looked at together.
AT_ONCE = 1 << 22


def bounded_batches(spark: SparkSession) -> None:
    """Rows and bytes of one Arrow batch, so that what a Python worker holds does not depend on the input."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(AT_ONCE))


def chunk(docs: DataFrame, target: int = TARGET, overlap: int = 0, with_text: bool = False) -> DataFrame:
    """book_id, ordinal, byte_offset, byte_length, content_hash, and text if asked for, of the chunks of docs (book_id, text)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["book_id"].dataType.simpleString()
    names = ["book_id", "ordinal", "byte_offset", "byte_length", "data"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, held = [], 0
            for b, t in zip(batch["book_id"], batch["text"], strict=True):
                data = (t or "").encode()
                for i, (o, n) in enumerate(chunk_spans(data, target, overlap)):
                    rows.append((b, i, o, n, data[o : o + n]))
                    held += n + 128  # a row's other columns too, as chunks may be short
                    if held >= AT_ONCE:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)

    spans = docs.select("book_id", "text").mapInPandas(run, f"book_id {kind}, ordinal int, byte_offset bigint, byte_length bigint, data binary")
    hashed = spans.withColumn("content_hash", X.content_hash(F.col("data")))
    return hashed.withColumn("text", F.decode("data", "UTF-8")).drop("data") if with_text else hashed.drop("data")


def before(totals: DataFrame, id_col: str, value: str) -> DataFrame:
    """``totals`` (one row an id) with the sum of ``value`` over all smaller ids, as ``before``.

    Two levels: within buckets of ids, and over the buckets, of which there is one for ``BUCKET`` ids.
    """
    bucket = F.floor(F.col(id_col) / BUCKET)
    t = totals.withColumn("__b", bucket)
    inner = t.withColumn("__in", F.sum(value).over(W.partitionBy("__b").orderBy(id_col)) - F.col(value))
    per = t.groupBy("__b").agg(F.sum(value).alias("__n"))
    outer = per.withColumn("__out", F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).drop("__n")
    return inner.join(outer, "__b").withColumn("before", F.col("__in") + F.col("__out")).drop("__b", "__in", "__out")


def allocate(segments: DataFrame) -> DataFrame:
    """Dense chunk ids from 1 for segments (book_id, ordinal, n): chunk_start of each, in book and reading order."""
    books = before(segments.groupBy("book_id").agg(F.sum("n").alias("total")), "book_id", "total").select("book_id", "before")
    w = W.partitionBy("book_id").orderBy("ordinal")
    return segments.join(books, "book_id").select("book_id", "ordinal", (F.col("before") + F.sum("n").over(w) - F.col("n") + 1).alias("chunk_start"), F.col("n").alias("chunk_count"))


def owners(points: DataFrame, segments: DataFrame, width: int = 64) -> DataFrame:
    """The segment that holds each chunk_id: an equi-join on ranges of ids, not a nested loop."""
    dealt = segments.filter("chunk_count > 0").withColumn("__b", F.explode(F.sequence(F.floor(F.col("chunk_start") / width), F.floor((F.col("chunk_start") + F.col("chunk_count") - 1) / width))))
    hit = points.withColumn("__b", F.floor(F.col("chunk_id") / width)).join(dealt, "__b")
    return hit.filter((F.col("chunk_id") >= F.col("chunk_start")) & (F.col("chunk_id") < F.col("chunk_start") + F.col("chunk_count"))).drop("__b")


def merge_ids(ids: DataFrame, width: int = 65_536) -> DataFrame:
    """Maximal runs of consecutive ids (chunk_id): start, stop.

    Runs are made within buckets. Only those that touch an edge of their bucket, at most two a bucket, can go on in the
    next, and only they come together in one window.
    """
    b = ids.select("chunk_id", F.floor(F.col("chunk_id") / width).alias("b")).distinct()
    run = F.col("chunk_id") - F.row_number().over(W.partitionBy("b").orderBy("chunk_id"))
    runs = b.withColumn("g", run).groupBy("b", "g").agg(F.min("chunk_id").alias("start"), (F.max("chunk_id") + 1).alias("stop"))
    edge = (F.col("start") == F.col("b") * width) | (F.col("stop") == (F.col("b") + 1) * width)
    return runs.filter(~edge).select("start", "stop").unionByName(merge_ranges(runs.filter(edge).select("start", "stop")))


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Touching ranges (start, stop) as one."""
    w = W.orderBy("start")
    new = F.when(F.col("start") <= F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1)), 0).otherwise(1)
    return ranges.withColumn("n", new).withColumn("g", F.sum("n").over(w)).groupBy("g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("g")


def glob_regex(pattern: str) -> str:
    """A shell pattern as a whole-string regular expression."""
    import fnmatch

    return fnmatch.translate(pattern.lower()).replace("(?s:", "(?s)(?:").replace(r"\Z", "$").replace(r"\z", "$")


def matches(pattern: str, *names: Column) -> Column:
    """Whether any name matches: a glob if the pattern has one of its signs, else a substring; case does not count."""
    if any(c in pattern for c in "*?["):
        tests = [F.lower(n).rlike("^" + glob_regex(pattern)) for n in names]
    else:
        tests = [F.contains(F.lower(n), F.lit(pattern.lower())) for n in names]
    hit = F.lit(False)
    for t in tests:
        hit = hit | F.coalesce(t, F.lit(False))
    return hit


def searchable(vectors: DataFrame, books: DataFrame, scope: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """The one place that decides what a search may see: within scope, and no book that is set aside."""
    if not everything:
        vectors = vectors.join(books.filter("excluded").select("book_id"), "book_id", "left_anti")
    return vectors if scope is None else vectors.join(scope.select("book_id"), "book_id", "left_semi")


def locate(data: Column, offset: Column, length: Column, expected: Column, shift: Column) -> Column:
    """State of a recorded span in a file's bytes now: exact, shifted, changed or missing."""
    at: callable = lambda o: F.when(o >= 0, X.content_hash(F.substring(data, o.cast("int") + 1, length.cast("int"))))
    return F.when(data.isNull(), "missing").when(at(offset) == expected, "exact").when(at(offset + shift) == expected, "shifted").otherwise("changed")


def read_span(data: Column, offset: Column, length: Column, expected: Column) -> Column:
    """The bytes of a recorded span; null if they are not the bytes recorded."""
    span = F.substring(data, offset.cast("int") + 1, length.cast("int"))
    return F.when(X.content_hash(span) == expected, span)


# Fixed value: where a sentence ends, with a closing quote or without, or a line; quotes as UTF-8.
_EDGE = re.compile(rb"[.!?](?:[\"')]|\xe2\x80\x9d|\xe2\x80\x99)?\s+|\n\s*")


def reading_window(data: bytes, offset: int, length: int, before: int = 500, after: int = 500) -> tuple[str, int]:
    """A passage with up to so many bytes around it that it begins and ends with a sentence: text, and its byte offset.

    What is around is trimmed to its first and last sentence edge; the passage itself is never cut.
    """
    low, high, stop = max(0, offset - before), min(len(data), offset + length + after), offset + length
    while low < offset and data[low] & 0xC0 == 0x80:
        low += 1
    while stop < high < len(data) and data[high] & 0xC0 == 0x80:
        high -= 1
    if m := _EDGE.search(data, low, offset):
        low = m.end()
    last = None
    for last in _EDGE.finditer(data, stop, high):
        pass
    if last:
        high = last.start() + 1
    text = data[low:high].decode("utf-8", "replace")
    return text.strip(), low + len(text[: len(text) - len(text.lstrip())].encode())


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("offset", T.LongType())]))
def reading_windows(data: pd.Series, offset: pd.Series, length: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([reading_window(d, int(o), int(n)) for d, o, n in zip(data, offset, length, strict=True)], columns=["text", "offset"])


def stat_suspects(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, state of files (key, size_bytes, mtime): same by size and time, else suspect and to be hashed, or new."""
    j = new.join(old.select("key", F.col("size_bytes").alias("was"), F.col("mtime").alias("then")), "key", "left")
    same = (F.col("was") == F.col("size_bytes")) & F.col("then").eqNullSafe(F.col("mtime"))
    return j.select("key", F.when(F.col("was").isNull(), "new").when(same, "same").otherwise("suspect").alias("state"))


def find_models(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """wanted, model: the name that is ``wanted``, else the only one that holds it, else null. Names are a short list."""
    held = names.agg(F.array_sort(F.collect_set("model")).alias("all"))  # one row
    fits = F.filter("all", lambda n: F.contains(n, F.col("wanted")))
    return wanted.join(F.broadcast(held)).select("wanted", F.when(F.array_contains("all", F.col("wanted")), F.col("wanted")).when(F.size(fits) == 1, F.get(fits, 0)).alias("model"))


def registered(old: DataFrame, new: DataFrame) -> DataFrame:
    """model, dim, source after registering anew: what is known stays, gaps are filled; ``clash`` if the dimension differs."""
    j = old.alias("o").join(new.alias("n"), "model", "full")
    return j.select("model", F.coalesce("o.dim", "n.dim").alias("dim"), F.coalesce("o.source", "n.source").alias("source"), F.coalesce(F.col("o.dim") != F.col("n.dim"), F.lit(False)).alias("clash"))


def numbered(ids: DataFrame) -> DataFrame:
    """chunk_id with its place ``n`` (from 1) in the order of ids, by two-level sums."""
    return before(ids.select("chunk_id").withColumn("one", F.lit(1)), "chunk_id", "one").select("chunk_id", (F.col("before") + 1).alias("n"))


def ingest_status(old: DataFrame, new: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """key, status of each book found: old and new have key and hashes (what its files are and are called), and content (what they are) if that is not all.

    ``split`` holds the keys of old books that this way of splitting has split; an unchanged one that it has not is rechunked.
    """
    what = "content" if "content" in new.columns else "hashes"
    gone = old.join(new, "key", "left_anti").groupBy(what).agg(F.min("key").alias("was"))
    j = new.join(old.select("key", F.col("hashes").alias("old_hashes")), "key", "left").join(gone, what, "left")
    done = F.lit("unchanged")
    if split is not None:
        j = j.join(split.select("key", F.lit(True).alias("split")), "key", "left")
        done = F.when(F.col("split"), "unchanged").otherwise("rechunked")
    status = F.when(F.col("old_hashes") == F.col("hashes"), done).when(F.col("old_hashes").isNotNull(), "updated").when(F.col("was").isNotNull(), "moved").otherwise("added")
    return j.select("key", status.alias("status"))


def carries(old: DataFrame, new: DataFrame, same_book: bool = False) -> DataFrame:
    """new_chunk, old_chunk: vectors that can be copied, as the content is the same; the last old chunk of a hash gives its own."""
    on = ["content_hash", "book_id"] if same_book else ["content_hash"]
    last = old.groupBy(*on).agg(F.max("chunk_id").alias("old_chunk"))
    return new.join(last, on).select(F.col("chunk_id").alias("new_chunk"), "old_chunk")


def compaction_plan(segments: DataFrame) -> DataFrame:
    """segment_id, chunk_start, chunk_count, new_start, moves, self_overlaps: live segments close up, in order of their ids."""
    live = segments.filter("chunk_count > 0")
    p = before(live.select(F.col("chunk_start"), "chunk_count", "segment_id"), "chunk_start", "chunk_count")
    return p.select("segment_id", "chunk_start", "chunk_count", (F.col("before") + 1).alias("new_start")).withColumn("moves", F.col("new_start") != F.col("chunk_start")).withColumn("self_overlaps", F.col("moves") & (F.col("chunk_start") < F.col("new_start") + F.col("chunk_count")))


def relocated(path: Column, old: str, new: str) -> Column:
    """A path below ``old`` moved below ``new``; the boundary is a whole path part."""
    inside = (path == old) | path.startswith(old.rstrip("/") + "/")
    return F.when(inside, F.concat(F.lit(new), F.substring(path, F.lit(len(old) + 1), F.length(path)))).otherwise(path)


def upper_median(values: Column) -> Column:
    """The middle value; of two the larger."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.when(F.size(v) > 0, F.element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int")))


def observed_rate(runs: DataFrame, last: int = 10) -> DataFrame:
    """model_id, rate: upper median of embedded a second at full duty, of the last runs of over 30 seconds."""
    fit = runs.filter("seconds > 30 and embedded > 0")
    newest = fit.withColumn("r", F.row_number().over(W.partitionBy("model_id").orderBy(F.desc("id")))).filter(F.col("r") <= last)
    duty = F.when(F.col("duty").isNotNull() & (F.col("duty") > 0) & (F.col("duty") <= 1), F.col("duty")).otherwise(1.0)
    return newest.groupBy("model_id").agg(upper_median(F.collect_list(F.col("embedded") / F.col("seconds") / duty)).alias("rate"))


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter, by the Unicode tables of Python."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


_SPACE = re.compile(r"[ \t\n\x0b\f\r]")


def _word_sizes(text: str, most: int = AT_ONCE) -> np.ndarray:
    """Lengths of the words of a text that are at least half letters; long texts are looked at in parts that end with white space."""
    found, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, at + most)
        end = space.end() if space else len(text)
        code = np.frombuffer(text[at:end].encode("utf-32-le"), dtype=np.uint32)
        blank = (code == 32) | ((code >= 9) & (code <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, blank, True].view(np.int8)))  # where words begin and end, in turn
        begins, ends = edge[::2], edge[1::2]
        letters = np.r_[0, np.cumsum(_letters()[code], dtype=np.int64)]
        n, own = ends - begins, letters[ends] - letters[begins]
        found.append(n[(own > 0) & (own * 2 >= n)])
        at = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def word_p90(text: Column, least: int = 50) -> Column:
    """The 90th of a hundred word lengths of a text, by rank; null below ``least`` words. A word is at least half letters."""

    @F.pandas_udf("int")
    def p90(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            n = _word_sizes(t) if t else ()
            at = int(len(n) * 0.9)
            out.append(int(np.partition(n, at)[at]) if len(n) >= max(least, 1) else None)
        return pd.Series(out, dtype="Int32")

    return p90(text)


def next_step(survey: DataFrame) -> DataFrame:
    """The first thing to do, from one row of counts: live chunks, models, pending, unprofiled, lexical chunks; ``ask`` if all is done."""
    rule = F.when(F.col("live") == 0, "add").when(F.col("models") == 0, "embed").when(F.col("pending") > 0, "embed the rest").when(F.col("unprofiled") > 0, "route").when(F.col("lexical") < F.col("live"), "index words").otherwise("ask")
    return survey.select("*", rule.alias("step"))


def outstanding(live: DataFrame, progress: DataFrame) -> DataFrame:
    """One row of live (book_id, n) against progress (book_id, done): live, done, to_embed, complete, part_way, not_started, at_work, backlog.

    The book at work is, of those begun and not ended, that of the largest backlog; of several the earliest.
    """
    j = live.join(progress.select("book_id", "done"), "book_id", "left").select("book_id", "n", F.least(F.coalesce("done", F.lit(0)), F.col("n")).alias("done"))
    begun = (F.col("done") > 0) & (F.col("done") < F.col("n"))
    most = F.max(F.when(begun, F.struct((F.col("n") - F.col("done")).alias("backlog"), (-F.col("book_id")).alias("b"))))
    one = j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("live"), F.coalesce(F.sum("done"), F.lit(0)).alias("done"), F.count_if(F.col("done") == F.col("n")).alias("complete"), F.count_if(begun).alias("part_way"), F.count_if((F.col("done") == 0) & (F.col("n") > 0)).alias("not_started"), most.alias("m"))
    return one.select("live", "done", F.greatest(F.lit(0), F.col("live") - F.col("done")).alias("to_embed"), "complete", "part_way", "not_started", (-F.col("m.b")).alias("at_work"), F.col("m.backlog").alias("backlog"))
